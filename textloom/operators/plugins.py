"""Seams for models that the library doesn't ship: taggers, embedders, scorers and generators.

A plug-in is a factory that is called once per Python worker and returns a
callable over a list of inputs, so a model is loaded once and fed batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Texts = Sequence[str]


def embedder(factory: Callable[[], Callable[[Texts], Sequence[Sequence[float]]]]) -> Callable[[Column], Column]:
    """A column function from text to array<float>."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series([list(v) for v in model(texts.fillna("").tolist())])

    return run


def pair_scorer(factory: Callable[[], Callable[[Texts, Texts], Sequence[float]]]) -> Callable[[Column, Column], Column]:
    """A column function from two texts to a double."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for a, b in batches:
            yield pd.Series(list(model(a.fillna("").tolist(), b.fillna("").tolist())), dtype="float64")

    return run


TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "NUM")


def pos_ratios(df: DataFrame, text: str, factory: Callable[[], Callable[[Texts], Sequence[Sequence[str]]]]) -> DataFrame:
    """``df`` with noun_ratio .. num_ratio over the tags that a tagger gives to the words of each text."""

    @F.pandas_udf("array<string>")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series([list(t) for t in model(texts.fillna("").tolist())])

    names = [f"{t.lower()}_ratio" for t in TAGS]
    tagged = df.drop(*(c for c in names if c in df.columns)).withColumn("__tags", tags(F.col(text)))
    share = lambda t: F.when(F.size("__tags") > 0, F.size(F.filter("__tags", lambda x: x == t)) / F.size("__tags")).otherwise(0.0)
    return tagged.select("*", *(share(t).alias(n) for t, n in zip(TAGS, names, strict=True))).drop("__tags")


def generate(df: DataFrame, prompt: str, factory: Callable[[], Callable[[str], str]], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``df`` with ``generated`` and ``error``; a failing call is tried again after doubling waits."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, generated string, error string"
    place = df.columns.index(prompt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()

        def one(text):
            said = None
            for k in range(tries):
                try:
                    return model(text), None
                except Exception as e:
                    said = f"{type(e).__name__}: {e}"
                    if k + 1 < tries:
                        time.sleep(wait * 2**k)
            return None, said

        for rows in batches:
            done = [one(t) for t in rows.iloc[:, place]]
            yield rows.assign(generated=[g for g, _ in done], error=[e for _, e in done])

    return df.mapInPandas(run, schema)
