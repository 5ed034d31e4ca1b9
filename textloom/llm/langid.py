"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams of its words with a boundary mark on
either side; each is hashed to a row of an embedding table, the rows are
averaged, and a linear softmax reads the average. Embeddings and softmax are
trained by stochastic gradient descent in numpy on a bounded sample. A
temperature fitted on a part of the sample that training didn't see calibrates
the probabilities.

A softmax is sure of foreign texts, too, so a text is rejected by its typicality:
the mean log probability of its subwords among those of the label it got, with
DOUBT standard errors to the good, as the mean of a short text says little. The
least typicality is fitted on the same unseen part, each text once as what it is
and once as foreign, that is by its best among the other labels: it rejects
FOREIGN of the foreign ones, but at most OWN of the texts of the label itself.

At prediction the embedding table times the softmax weights is one table of
logits by bucket, next to the log probabilities, so a text costs one gather per
subword.

Defined results: null texts and texts without a letter get ``und`` with score 0
and are rejected; without labelled rows every text does. With one language all
other texts get it with score 1, and none is rejected. Ties go to the smaller
label. Repeated rows keep a row each, and count once in the sample if id and
label repeat. Long texts are read whole, in pieces of bounded size. An empty
table gives no rows. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bytewords import flat, folded
from textloom.llm.scratch import checked_broadcast, materialize, small_batches

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (2, 3, 4)
#: The training sample: at most this many rows of each label, and of all labels.
PER_LABEL, SAMPLE_ROWS = 400, 8000
#: The share of foreign texts that is rejected, and the largest share of texts of the label itself.
FOREIGN, OWN = 0.95, 0.002
#: Standard errors of the mean that a text's typicality is raised by.
DOUBT = 3.0
#: Subwords that a sampled text counts for in a label's log probabilities, and those that every bucket starts with.
WEIGHT, PRIOR = 300.0, 0.5
#: Bytes of text whose subwords are hashed at once.
PIECE = 1 << 18
UND = "und"


def subwords(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width, (buckets, bounds) of the subwords of a byte buffer whose rows start at ``offs``.

    Digits and ``_`` separate words here. A subword has a letter, and boundary
    marks only at its ends. Row i has
    buckets[bounds[i]:bounds[i + 1]].
    """
    low, word = folded(data)
    word &= (low > 57) & (low != 95)
    code = np.where(word, low, 32).astype(np.uint32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    edge = edge[1:-1]  # a row ends between i and i + 1
    for n in WIDTHS:
        if len(data) < n:
            return
        last = len(data) - n + 1
        inner = word[1 : 1 + last].copy()
        if n == 2:
            inner |= word[:last]
        for k in range(2, n - 1):
            inner &= word[k : k + last]
        for k in range(n - 1):
            inner &= ~edge[k : k + last]
        at = np.flatnonzero(inner)
        h = code[at]
        for k in range(1, n):
            h = (h << np.uint32(8)) | code[at + k]
        h = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        yield (h >> np.uint32(32 - 15)).astype(np.int32), np.searchsorted(at, offs)


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, rows) in pieces of bounded size.

    A longer text comes in several pieces that overlap by a subword less one,
    so that, within rounding at the seams, no subword is lost.
    """
    data, offs = flat(column)
    i, overlap = 0, max(WIDTHS) - 1
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1)
        if offs[j] - offs[i] <= PIECE:
            yield data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, j - i
        else:
            for at in range(int(offs[i]), int(offs[j]), PIECE):
                part = data[at : min(at + PIECE + overlap, offs[j])]
                yield part, np.array([0, len(part)]), i, 1
        i = j


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float
    typical: np.ndarray  # buckets x labels: log probability of a bucket in texts of a label
    least: np.ndarray  # by label: the typicality below which a text is rejected

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities and typicalities, rows x labels each."""
        k = len(self.labels)
        table = np.concatenate([self.logits, self.typical], axis=1).astype(np.float32)
        total = np.zeros((len(column), 2 * k))
        count = np.zeros(len(column))
        for data, offs, first, n in pieces(column):
            for buckets, bounds in subwords(data, offs):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                count[first : first + n] += sizes
                if len(full):
                    total[first + full] += np.add.reduceat(table[buckets], bounds[:-1][full], axis=0)
        count = np.maximum(count, 1)[:, None]
        mean = total / count
        return softmax((mean[:, :k] + self.bias) / self.temperature), mean[:, k:] + DOUBT * spread(self.typical) / np.sqrt(count)

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(label, score, accepted) of each text."""
        if not self.labels:
            return [UND] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        p, typical = self.scores(column)
        best = p.argmax(axis=1)
        rows = np.arange(len(best))
        letters = np.array([has_letter(t.as_py()) for t in column], bool)
        names = [self.labels[b] if ok else UND for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, p[rows, best], 0.0), letters & (typical[rows, best] >= self.least[best])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def short(bag: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A draw of 4 to 40 subwords of a bag, as of a short text."""
    at, share = bag
    drawn, counts = np.unique(rng.choice(at, int(rng.integers(4, 41)), p=share / share.sum()), return_counts=True)
    return drawn, counts / counts.sum()


def log_shares(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: int) -> np.ndarray:
    """(buckets, labels): log probabilities of the buckets in the texts of each label."""
    counts = np.full((BUCKETS, labels), PRIOR)
    for (at, share), label in zip(bags, y, strict=True):
        counts[at, label] += WEIGHT * share
    return np.log(counts / counts.sum(axis=0))


def spread(typical: np.ndarray) -> np.ndarray:
    """The standard deviation of a subword's log probability in texts of each label."""
    share = np.exp(typical)
    return np.sqrt(np.maximum(0, (share * typical**2).sum(axis=0) - (share * typical).sum(axis=0) ** 2))


def least_typical(typical: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least typicality by label, from the typicalities (texts, labels) of unseen texts."""
    out = np.full(typical.shape[1], -np.inf)
    if typical.shape[1] < 2:
        return out
    rows = np.arange(len(y))
    other = typical.copy()
    other[rows, y] = -np.inf
    foreign = np.quantile(other.max(axis=1), FOREIGN) if len(y) else -np.inf
    for label in range(len(out)):
        own = typical[y == label, label]
        if len(own):
            out[label] = min(foreign, np.quantile(own, OWN))
    return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], epochs: int = 8, rate: float = 1.0, seed: int = 42) -> Model:
    """Train on (buckets, shares) bags; a fifth of them only calibrates."""
    if len(labels) < 2:
        flat_table = np.zeros((BUCKETS, len(labels)))
        return Model(labels, flat_table, np.zeros(len(labels)), 1.0, flat_table, np.full(len(labels), -np.inf))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    weight, bias = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    steps = max(1, epochs * len(learn))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            buckets, share = short(bags[i], rng) if rng.random() < 0.5 else bags[i]
            mean = share @ embed[buckets]
            error = softmax((mean @ weight + bias)[None])[0]
            error[y[i]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            back = weight @ error
            weight -= lr * np.outer(mean, error)
            bias -= lr * error * 0.1
            embed[buckets] -= lr * 20 * share[:, None] * back
    logits = embed @ weight
    typical = log_shares([bags[i] for i in learn], y[learn], len(labels))
    tried = [bags[i] if k % 2 else short(bags[i], rng) for k, i in enumerate(np.repeat(held, 2))]
    held_y = np.repeat(y[held], 2)
    raw = np.array([share @ logits[at] + bias for at, share in tried]).reshape(len(tried), len(labels))
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 500, 90) if len(tried) else ():
        loss = -np.log(softmax(raw / t)[np.arange(len(tried)), held_y] + 1e-12).mean()
        if loss < best:
            best, temperature = loss, float(t)
    own = np.array([share @ typical[at] for at, share in tried]).reshape(len(tried), len(labels))
    return Model(labels, logits, bias, temperature, typical, least_typical(own, held_y))


def bag(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct buckets of one text (BUCKETS at most) with their shares."""
    counts = np.zeros(BUCKETS)
    for data, offs, _, _ in pieces(column.slice(i, 1)):
        for buckets, _ in subwords(data, offs):
            counts += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1.0, counts.sum())


def learnable(doc_id: Column) -> Column:
    """Rows that may be learnt from: CRC-32 of the id as text, mod 5, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def train(docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on at most PER_LABEL rows of each label and SAMPLE_ROWS in all, in hash order of their ids.

    Ids are drawn first, on two narrow columns; texts are then fetched for them
    and bagged on the executors, so the driver gets bags, not texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & (allowed if allowed is not None else F.lit(True)))
    # Hashes are uniform, so a share of 2 * PER_LABEL / n of their range holds enough of a label's n rows.
    counts = checked_broadcast(materialize(rows.groupBy("label").agg(F.count("*").alias("n")), "labels"))
    place = F.shiftrightunsigned("h", 11).cast("double") / float(2**53)
    near = rows.select("label", "id", F.xxhash64("id").alias("h")).join(counts, "label").where(place * F.col("n") < 2 * PER_LABEL)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).where(F.col("r") <= PER_LABEL)
    drawn = materialize(ranked.orderBy("r", "label").limit(SAMPLE_ROWS).select("label", "id").distinct(), "drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, share = bag(batch.column(2), i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([at.astype(np.int32).tobytes()]), pa.array([share.astype(np.float32).tobytes()])],
                    ["label", "id", "at", "share"],
                )

    bags = rows.join(checked_broadcast(drawn, SAMPLE_ROWS), ["label", "id"]).select("label", "id", "text").mapInArrow(run, "label string, id string, at binary, share binary")
    # Repeated ids count once; the sample's bounds hold for what reaches the driver.
    got = bags.groupBy("label", "id").agg(F.min(F.struct("at", "share")).alias("x")).orderBy("label", "id").limit(SAMPLE_ROWS).collect()
    got = [r for r in got if r.x["at"]]
    labels = sorted({r.label for r in got})
    parsed = [(np.frombuffer(r.x["at"], np.int32), np.frombuffer(r.x["share"], np.float32).astype(np.float64)) for r in got]
    return fit(parsed, np.array([labels.index(r.label) for r in got], np.int64), labels)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, accepted = shared.value.judge(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"]
            )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")


def accepted_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns as they are."""
    small_batches(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.judge(batch.column(place))[2]))

    return docs.mapInArrow(run, docs.schema)


def op6_langid(docs: DataFrame) -> DataFrame:
    """The registered query: prediction for every document, learnt from those not held out."""
    out = predict(docs, train(docs, learnable(F.col("id"))))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "accepted")
