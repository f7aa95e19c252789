"""Record-level operators: normalising, validating, keeping first of repeated ids, paging, sampling, statistics."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import strip

STRICT_ID = r"^CAND_[0-9]{7}$"


def _normal(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.nullif(strip(c), F.lit(""))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_normal(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: _normal(x, kind.elementType))
    return c


def normalize(df: DataFrame) -> DataFrame:
    """Strings stripped, empty ones null; through structs and arrays of structs. Strings within arrays and maps stay."""
    return df.select(*[_normal(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def is_valid(id_col: str, strict: bool = False) -> Column:
    """Whether a row has an id; strict: of the form CAND_ and seven digits."""
    c = F.coalesce(strip(F.col(id_col).cast("string")), F.lit(""))
    return c.rlike(STRICT_ID) if strict else c != ""


def split_valid(df: DataFrame, id_col: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    return df.where(is_valid(id_col, strict)), df.where(~is_valid(id_col, strict))


def keep_first(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first row of each id by the order columns. Rows of a null id are all kept."""
    w = Window.partitionBy(id_col).orderBy(*order)
    some, none = df.where(F.col(id_col).isNotNull()), df.where(F.col(id_col).isNull())
    return some.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(none)


def errors(df: DataFrame, id_col: str, order: list[str], strict: bool = True) -> DataFrame:
    """One row per row that keep_first or validation leaves out: its order columns and the kind of error."""
    w = Window.partitionBy(id_col).orderBy(*order)
    repeated = (F.row_number().over(w) > 1) & F.col(id_col).isNotNull()
    kind = F.when(~is_valid(id_col, strict), "MalformedCandidateProfile").when(repeated, "DuplicateCandidateID")
    return df.withColumn("error", kind).where(F.col("error").isNotNull()).select(id_col, *order, "error")


def page(df: DataFrame, order: list[str], size: int, index: int) -> DataFrame:
    """The index-th page (from 0) of the rows in order; beyond the end it has no rows."""
    if index < 0 or size < 1:
        raise ValueError("page index must be >= 0 and size >= 1")
    return df.orderBy(*order).offset(index * size).limit(size)


def batches(df: DataFrame, size: int = 256) -> Iterator[list[dict]]:
    """Rows as lists of dicts, one partition at a time on the driver."""
    out: list[dict] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        out.append(r.asDict(recursive=True))
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def shuffle_key(id_col: str, seed: int) -> Column:
    """A pseudo-random but reproducible sort key."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.orderBy(shuffle_key(id_col, seed), id_col)


def shuffle_places(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds place, from 1, of every row in the seeded shuffle; no task holds them all."""
    from rankloom.operators.ranking import global_rank

    key = df.withColumn("_key", shuffle_key(id_col, seed))
    return global_rank(key, ["_key", id_col], id_col).withColumnRenamed("rank", "place").drop("_key")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same for the same seed however the input is partitioned."""
    return shuffled(df, id_col, seed).limit(n)


def stats(df: DataFrame, id_col: str, strict: bool = False) -> DataFrame:
    """total_raw, valid, invalid, duplicates in one aggregate."""
    ok = is_valid(id_col, strict)
    d = df.agg(F.count("*").alias("total_raw"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_distinct(F.when(ok, strip(F.col(id_col)))).alias("_d"))
    return d.select("total_raw", "valid", "invalid", (F.col("valid") - F.col("_d")).alias("duplicates"))


def observed(df: DataFrame, id_col: str, strict: bool = False) -> tuple[DataFrame, Observation]:
    """df with counts of total, valid and invalid rows gathered while it runs."""
    o = Observation("load")
    ok = is_valid(id_col, strict)
    return df.observe(o, F.count(F.lit(1)).alias("total_raw"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid")), o
