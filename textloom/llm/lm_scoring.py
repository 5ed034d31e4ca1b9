"""Cross-entropy difference between a target and a background bigram model.

Both models share one vocabulary, order and smoothing. They hold every word and
every bigram of the corpus, so they grow with it: counts are exact, by 64-bit
hashes of words and bigrams. A bigram's probability is

    p(b | a) = (c(a, b) + mu * p(b)) / (c(a) + mu),  p(b) = (c(b) + 1) / (N + V + 1)

with c(a) the number of bigrams that start with a, N the side's tokens and V the
words of both sides (and one for unknown words), so both models are proper. A
document is scored by what is left of its side's counts without it (leave one
out); V stays. Its score is its target loss less its background loss, per token
in nats: low scores are like the target.

Texts are scored from one reading and never shuffled. Documents are packed into chunks of
about 4 MB, each a row of distinct word hashes and word numbers. A chunk sends
its distinct words and bigrams and its own counts of them once, in arrays by key
share; a share adds them up and sends the sums back in the same order. A key
that is in every document costs one entry a chunk. Chunks and shares both grow
with the root of the corpus, so the rows that they exchange, a row for each pair
of them, grow in proportion to it and keep carrying many keys.

Defined results: null and empty texts have no tokens, and null losses and score.
Without target (or background) rows that model is uniform over the vocabulary.
Repeated rows count and are scored each, each without itself only. A document is
of the target if its id is among the target ids, however often it is listed
there; a null id is of the background. A long text is one chunk by itself, so
memory follows the longest text. Only the two named columns are read, so others
can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import mix, word_hashes
from textloom.llm.scratch import checked_broadcast, materialize, small_batches

MU = 50.0
#: Bytes of text, and rows, after which a chunk of documents ends, and tokens of the corpus whose keys one share gathers, about; see ``scale``.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 1 << 17
SHARE_TOKENS = 1_000_000
#: Bytes of text up to which chunks and shares are as small as that.
SCALE_BYTES = 10 << 30
_WORD, _START = (mix(np.array([k], np.uint64))[0] for k in (12, 13))
_PREVIOUS = mix(np.array([14], np.uint64))[0] | np.uint64(1)
#: Counts below this take a byte, others nine.
ESCAPE = 255


def pack(counts: np.ndarray) -> bytes:
    """Counts as a byte each; those of ESCAPE or more follow as 64-bit integers."""
    return np.minimum(counts, ESCAPE).astype(np.uint8).tobytes() + counts[counts >= ESCAPE].astype("<i8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8)[:n].astype(np.int64)
    out[out == ESCAPE] = np.frombuffer(data[n:], "<i8")
    return out


def _counts(at: np.ndarray, size: int, side: np.ndarray) -> np.ndarray:
    """(size, 2): how often each number is in ``at`` where ``side`` is true, and elsewhere."""
    return np.stack([np.bincount(at[rows], minlength=size) for rows in (side, ~side)], axis=1).astype(np.int64)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, at): the distinct hashes by falling frequency, and the number of each hash among them."""
    words, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return words[order], rank[at]


@dataclass
class Chunk:
    """Some rows' tokens as numbers of distinct words; row i has at[bounds[i]:bounds[i + 1]]."""

    words: np.ndarray  # hashes, by falling frequency
    at: np.ndarray
    bounds: np.ndarray
    previous: np.ndarray = field(init=False)  # the word before each token, len(words) at a row's start
    pairs: np.ndarray = field(init=False)  # distinct bigrams, previous * len(words) + word
    pair: np.ndarray = field(init=False)  # each token's bigram

    def __post_init__(self) -> None:
        self.full = np.flatnonzero(np.diff(self.bounds))
        self.previous = np.empty_like(self.at)
        self.previous[1:] = self.at[:-1]
        self.previous[self.bounds[:-1][self.full]] = len(self.words)
        self.pairs, self.pair = np.unique(self.previous * len(self.words) + self.at, return_inverse=True)

    @classmethod
    def of(cls, hashes: np.ndarray, bounds: np.ndarray) -> Chunk:
        return cls(*numbered(hashes), bounds)

    def keys(self) -> np.ndarray:
        """The keys of the words, even, and then of the bigrams, odd."""
        v = max(len(self.words), 1)
        before = np.append(self.words, _START)[self.pairs // v]
        word = mix(self.words ^ _WORD) & ~np.uint64(1)
        return np.concatenate([word, mix(mix(before * _PREVIOUS) + self.words[self.pairs % v]) | np.uint64(1)])

    def last(self) -> np.ndarray:
        """The last word of each row that has one."""
        return self.at[self.bounds[1:][self.full] - 1]

    def counted(self, target: np.ndarray) -> np.ndarray:
        """(keys, 4): counts by side of each key, and of the rows that end in it (none for bigrams)."""
        side = np.repeat(target, np.diff(self.bounds))
        word = np.concatenate([_counts(self.at, len(self.words), side), _counts(self.last(), len(self.words), target[self.full])], axis=1)
        pair = _counts(self.pair, len(self.pairs), side)
        return np.concatenate([word, np.pad(pair, ((0, 0), (0, 2)))])

    def losses(self, counts: np.ndarray, corpus: Corpus, target: np.ndarray | None = None, mu: float = MU) -> np.ndarray:
        """(rows, 2): losses per token by side, 0 for rows without tokens.

        ``counts`` has the corpus's counts of ``keys``; where ``target`` is given,
        each row's own counts are taken off its side's.
        """
        v, sizes = len(self.words), np.diff(self.bounds)
        out = np.zeros((len(sizes), 2))
        if not len(self.full):
            return out
        row = np.repeat(np.arange(len(sizes)), sizes)
        start = self.previous == v
        word, end, pair = counts[:v, :2], counts[:v, 2:], counts[v:, :2]
        known = np.append(word - end, [corpus.starts], axis=0)
        own_word = own_pair = own_context = own_size = np.zeros(len(row), np.int64)
        mine = np.zeros(len(row), bool) if target is None else target[row]
        if target is not None:
            own_size = sizes[row]
            _, at, times = np.unique(row * v + self.at, return_inverse=True, return_counts=True)
            own_word = times[at]
            _, at, times = np.unique(row * len(self.pairs) + self.pair, return_inverse=True, return_counts=True)
            own_pair = times[at]
            last = np.full(len(sizes), -1)
            last[self.full] = self.last()
            own_context = np.where(start, 1, np.append(0, own_word[:-1]) - (last[row] == self.previous))
        for side, less in ((0, mine), (1, ~mine)):
            w = word[self.at, side] - less * own_word
            p = pair[self.pair, side] - less * own_pair
            c = known[self.previous, side] - less * own_context
            total = corpus.tokens[side] - less * own_size
            mass = p + mu * (w + 1) / (total + corpus.words + 1)
            out[self.full, side] = -np.add.reduceat(np.log(mass) - np.log(c + mu), self.bounds[:-1][self.full]) / sizes[self.full]
        return out


@dataclass
class Corpus:
    """What both models know of the whole corpus besides the counts of keys."""

    tokens: tuple[int, int]  # by side
    starts: tuple[int, int]  # rows with tokens, by side
    words: int  # of both sides


@dataclass
class Models:
    """Both sides' counts in one piece; a key that isn't among them counts zero."""

    keys: np.ndarray  # sorted
    counts: np.ndarray
    corpus: Corpus

    def losses(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, losses per token by side) of each row."""
        chunk = Chunk.of(*word_hashes(column))
        wanted = chunk.keys()
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        counts = np.where((self.keys[at] == wanted)[:, None], self.counts[at], 0) if len(self.keys) else np.zeros((len(wanted), 4), np.int64)
        return np.diff(chunk.bounds), chunk.losses(counts, self.corpus)


def train(docs: DataFrame) -> Models:
    """Models of (text, target) rows in one piece, for corpora that the driver can hold; scoring doesn't use it."""
    rows = docs.select("text", "target").toArrow()
    chunk, target = Chunk.of(*word_hashes(rows["text"].combine_chunks())), rows["target"].to_numpy().astype(bool)
    sizes = np.diff(chunk.bounds)
    by_side = lambda x: (int(x[target].sum()), int(x[~target].sum()))
    keys = chunk.keys()
    order = np.argsort(keys)
    return Models(keys[order], chunk.counted(target)[order], Corpus(by_side(sizes), by_side(sizes > 0), len(chunk.words)))


def _planes(at: np.ndarray, size: int) -> bytes:
    """Numbers below ``size``, lowest bytes first: the bytes of one place lie together, so rare high ones compress."""
    width = max(1, (max(size - 1, 0).bit_length() + 7) // 8)
    return np.ascontiguousarray(at.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<i8").ravel()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


CHUNK_SCHEMA = "chunk bigint, ids array<bigint>, target array<boolean>, sizes array<int>, words binary, at binary, tokens array<bigint>, starts array<bigint>"


def scale(size: int) -> float:
    """How many times larger than the least chunks and shares are, for a corpus of so many bytes."""
    return max(1.0, (size / SCALE_BYTES) ** 0.5)


def chunks(sided: DataFrame, times: float = 1.0) -> DataFrame:
    """Rows of (doc_id, text, target) packed into chunks, with their tokens and rows with tokens by side."""
    most, most_rows = int(CHUNK_BYTES * times), int(CHUNK_ROWS * times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, targets, sizes, hashes = [], [], [], []

        def emit(k: int) -> pa.RecordBatch:
            size, target = np.concatenate(sizes), np.concatenate(targets)
            words, at = numbered(np.concatenate(hashes))
            by_side = lambda x: np.array([x[target].sum(), x[~target].sum()])
            columns = [
                pa.array([number + k], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), _lists([target], pa.bool_()),
                _lists([size], pa.int32()), pa.array([words.tobytes()], pa.binary()), pa.array([_planes(at, len(words))], pa.binary()),
                _lists([by_side(size)], pa.int64()), _lists([by_side(size > 0)], pa.int64()),
            ]
            for x in (ids, targets, sizes, hashes):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in CHUNK_SCHEMA.split(", ")])

        held, rows, k = 0, 0, 0
        for batch in batches:
            lengths = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(lengths, lengths[at] + most - held, "right")) - 1)
                part = batch.slice(at, end - at)
                found, bounds = word_hashes(part.column(1))
                ids.append(part.column(0))
                targets.append(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                sizes.append(np.diff(bounds))
                hashes.append(found)
                held, rows, at = held + lengths[end] - lengths[at], rows + end - at, end
                if held >= most or rows >= most_rows or at < batch.num_rows:
                    yield emit(k)
                    held, rows, k = 0, 0, k + 1
        if rows:
            yield emit(k)

    return sided.select("doc_id", "text", "target").mapInArrow(run, CHUNK_SCHEMA)


def _chunk(words: pa.Scalar, at: pa.Scalar, sizes: pa.Scalar) -> Chunk:
    bounds = np.append(0, np.cumsum(sizes.values.to_numpy()))
    return Chunk(np.frombuffer(words.as_py(), np.uint64), _unplaned(at.as_py(), int(bounds[-1])), bounds)


def _by_share(keys: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, share): the keys' order by share, and the shares in that order; words stay before bigrams."""
    share = ((keys >> np.uint64(1)) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    return order, share[order]


def _flat(counts: np.ndarray, words: int) -> np.ndarray:
    """The four columns of word counts and the two of bigram counts, column by column."""
    return np.concatenate([counts[:words].T.ravel(), counts[words:, :2].T.ravel()])


def _unflat(flat: np.ndarray, words: int, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.int64)
    out[:words] = flat[: 4 * words].reshape(4, words).T
    out[words:, :2] = flat[4 * words :].reshape(2, n - words).T
    return out


def _asked(chunked: DataFrame, shares: int) -> DataFrame:
    """(share, chunk, words, keys, counts): the distinct keys of each chunk by share, the words first, and the chunk's own counts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, target, sizes, words, at = (batch.column(c)[i] for c in range(5))
                chunk = _chunk(words, at, sizes)
                keys, counts = chunk.keys(), chunk.counted(target.values.to_numpy(zero_copy_only=False).astype(bool))
                order, share = _by_share(keys, shares)
                present, first = np.unique(share, return_index=True)
                keys, counts = keys[order], counts[order]
                rows = []
                for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
                    n = int(np.count_nonzero((keys[a:b] & np.uint64(1)) == 0))
                    rows.append((n, keys[a:b].tobytes(), pack(_flat(counts[a:b], n))))
                n, k, c = zip(*rows, strict=True) if rows else ((), (), ())
                columns = [pa.array(present, pa.int64()), pa.array([number.as_py()] * len(rows), pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["share", "chunk", "words", "keys", "counts"])

    return chunked.select("chunk", "target", "sizes", "words", "at").mapInArrow(run, "share bigint, chunk bigint, words int, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(chunk, share, counts, vocabulary): the corpus's counts of the keys each chunk asked for, in its order; a share's vocabulary is on one of its rows."""

    def run(table: pa.Table) -> pa.Table:
        words = table["words"].to_pylist()
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
        own = [_unflat(unpack(x.as_py(), 2 * (n + len(k))), n, len(k)) for x, n, k in zip(table["counts"], words, parts, strict=True)]
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate(own)
        total = np.stack([np.bincount(at, counts[:, c], len(distinct)).astype(np.int64) for c in range(4)], axis=1)
        ends = np.cumsum([len(k) for k in parts])
        flat = [pack(_flat(total[at[e - len(k) : e]], n)) for e, k, n in zip(ends, parts, words, strict=True)]
        vocabulary = np.zeros(len(parts), np.int64)
        vocabulary[0] = np.count_nonzero((distinct & np.uint64(1)) == 0)
        return pa.table([table["chunk"], table["share"], pa.array(flat, pa.binary()), pa.array(vocabulary)], ["chunk", "share", "counts", "vocabulary"])

    return asked.groupBy("share").applyInArrow(run, "chunk bigint, share bigint, counts binary, vocabulary bigint")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, target, target_loss, background_loss, score) for every row.

    ``target_ids`` has the ids of the target documents in a column ``doc_id``;
    all other rows are the background. Ids too many to broadcast are joined by a
    shuffle, the only one of texts, and done once. A first scan adds up the
    texts' sizes, by which chunks and shares are sized.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(True).alias("listed")).where("doc_id is not null").distinct()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sided = rows.join(checked_broadcast(materialize(ids, "target")), "doc_id", "left").select("doc_id", "text", F.coalesce("listed", F.lit(False)).alias("target"))
    times = scale(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    chunked = materialize(chunks(sided, times), "chunks")
    sums = chunked.agg(*(F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for c in ("tokens", "starts") for k in (0, 1))).first()
    shares = max(spark.sparkContext.defaultParallelism, -(-(sums[0] + sums[1]) // int(SHARE_TOKENS * times)))
    answered = materialize(_answered(_asked(chunked, shares)), "counts")
    vocabulary = answered.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0]
    corpus = Corpus(tuple(sums[:2]), tuple(sums[2:]), vocabulary)

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _chunk(*(packed[c][0] for c in ("words", "at", "sizes")))
        keys = chunk.keys()
        order, share = _by_share(keys, shares)
        counts = np.zeros((len(keys), 4), np.int64)
        by = np.argsort(answers["share"].to_numpy())
        present, first = np.unique(share, return_index=True)
        for a, b, i in zip(first, np.append(first[1:], len(order)), by, strict=True):
            n = int(np.count_nonzero((keys[order[a:b]] & np.uint64(1)) == 0))
            counts[order[a:b]] = _unflat(unpack(answers["counts"][int(i)].as_py(), 2 * (n + b - a)), n, int(b - a))
        target = packed["target"][0].values.to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.diff(chunk.bounds)
        loss, none = chunk.losses(counts, corpus, target), sizes == 0
        columns = [pa.array(x, pa.float64(), mask=none) for x in (loss[:, 0], loss[:, 1], loss[:, 0] - loss[:, 1])]
        names = ["doc_id", "tokens", "target", "target_loss", "background_loss", "score"]
        return pa.table([packed["ids"][0].values, pa.array(sizes.astype(np.int64)), pa.array(target), *columns], names)

    schema = "doc_id bigint, tokens bigint, target boolean, target_loss double, background_loss double, score double"
    left = chunked.select("chunk", "ids", "target", "sizes", "words", "at").groupBy("chunk")
    return left.cogroup(answered.select("chunk", "share", "counts").groupBy("chunk")).applyInArrow(score, schema)
