"""Queries of the streaming operators: a stream of files run to its end and read from a memory sink."""

from __future__ import annotations

import uuid

from rankloom.plans.catalogue import query, table
from rankloom.session import ensure_checkpoint_dir
from rankloom.streaming import streams


def _drain(spark, df, mode: str):
    name = "s" + uuid.uuid4().hex
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{ensure_checkpoint_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("stream_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3")
def stream_windows(spark, sf_dir):
    return _drain(spark, streams.windowed_counts(_stream(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day"), "complete")
