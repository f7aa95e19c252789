"""Plug points for models: encoders, generators and stemmers, with offline defaults that need no model.

A model runs in an iterator of Arrow batches, so that it is loaded once per task and called on whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import let, tokens

#: A function that makes a batch function, called once per task.
ModelFactory = Callable[[], Callable[[list[str]], list]]


def hash_encoder(text: Column, dim: int = 64) -> Column:
    """Unit vector of a text by feature hashing of its words, all on the JVM; a text without words gives zeros."""

    def places(words: Column) -> Column:
        at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
        return let(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double")))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))

    return let(let(tokens(text), places), unit)


def encoder(factory: ModelFactory, batch: int = 128) -> Callable[[Column], Column]:
    """A text column to array<float> by a model; null texts are encoded as empty ones."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([v for at in range(0, len(texts), batch) for v in encode(texts[at : at + batch])])

    return run


def generator(factory: ModelFactory, batch: int = 16) -> Callable[[Column], Column]:
    """A prompt column to a reply column by a model; a batch that raises gives nulls, for which callers have fallbacks."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reply = factory()
        for s in batches:
            out: list = []
            for at in range(0, len(s), batch):
                part = s.iloc[at : at + batch].fillna("").tolist()
                try:
                    out += reply(part)
                except Exception:  # noqa: BLE001 - a model's failure is a missing reply
                    out += [None] * len(part)
            yield pd.Series(out)

    return run


def stemmed(words: Column, suffixes: tuple[str, ...] = ("ies", "ing", "ed", "es", "s")) -> Column:
    """Light stemming of an array of words: the first of the suffixes is cut where four letters or more stay. Off by default in tokens."""

    def stem(w: Column) -> Column:
        out = None
        for s in suffixes:
            hit = w.endswith(s) & (F.length(w) >= len(s) + 4)
            cut = F.substring(w, F.lit(1), F.length(w) - len(s))
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return out.otherwise(w)

    return F.transform(words, stem)
