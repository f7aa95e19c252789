"""Streaming forms of operators: an extension, since the batch operators already cover all that has to be computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import rejects


def split_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) of a stream of raw records; the same narrow operator as in batch."""
    parsed = rejects.parse_records(lines)
    return parsed.where("reason IS NULL"), rejects.rejected(parsed)


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per key and window; events later than ``late`` are dropped by the watermark."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    w = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), key, "n", "total")


def first_of_each(records: DataFrame, id_col: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first record of each id within the watermark."""
    return records.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([id_col]).drop("_ts")
