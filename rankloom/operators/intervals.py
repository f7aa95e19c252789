"""Overlapping and gapped intervals as continuous periods and gaps (problem 4).

Rows are range-partitioned and sorted by (entity, start) and written to the shared checkpoint
folder. A first scan gives each partition's summary (its first and last entity, the last entity's
largest end and the start of its last island); the summaries, one per partition, are prefix-combined;
a second scan labels islands with the carried state and emits gaps as it goes. A hot entity is
therefore spread over as many partitions as its rows need, unlike a window over the entity.

Defined results
---------------
* rows with a null entity, without a start, or whose end (time included) is before the start don't count;
* a null end is open: nothing can follow an open interval, its period ends ``open``;
* intervals that share a day or are ``join_days`` apart (1: neighbouring days) belong to one period;
* repeated rows and ties don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import checkpoint

#: Day number of an end that hasn't come, past every date.
OPEN = 2_000_000_000
_LABELS = "entity string, island long, upto long, gap_from long, gap_to long"
_SUMMARY = "pid int, first_entity string, last_entity string, island long, upto long"


def _scan(batch, state: tuple[str | None, int, int], join_days: int):
    """Labels of a sorted batch, given (entity, largest end so far, start of its island); and the state after it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ent = batch.column("entity")
    s = batch.column("s").to_numpy(zero_copy_only=False).astype(np.int64)
    e = batch.column("e").to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(s)
    new_ent = np.ones(n, bool)
    if n > 1:
        new_ent[1:] = pc.not_equal(ent.slice(1), ent.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    carried = state[0] is not None and ent[0].as_py() == state[0]
    group = np.cumsum(new_ent) - 1
    # Running maximum within an entity: ends shifted by a step per entity, so that one pass over the batch does.
    step = np.int64(1 << 33)
    shifted = e + group * step
    if carried:
        shifted[0] = max(shifted[0], state[1])
    upto = np.maximum.accumulate(shifted) - group * step
    before = np.empty(n, np.int64)
    before[1:] = upto[:-1]
    before[0] = state[1] if carried else -step
    first = new_ent.copy()
    first[0] = not carried
    island_starts = first | (s > before + join_days)
    island = np.where(island_starts, np.arange(n), -1)
    island = np.maximum.accumulate(island)
    label = np.where(island >= 0, s[np.maximum(island, 0)], state[2])
    gap = island_starts & ~first
    # The last row of each run of one island within the batch holds the run's largest end.
    last = np.ones(n, bool)
    last[:-1] = island_starts[1:]
    where = np.flatnonzero(last)
    runs = (ent.take(pa.array(where)), label[where], upto[where])
    holes = np.flatnonzero(gap)
    gaps = (ent.take(pa.array(holes)), before[holes] + 1, s[holes] - 1)
    return runs, gaps, (ent[n - 1].as_py(), int(upto[-1]), int(label[-1]))


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, join_days: int = 1, partitions: int | None = None) -> DataFrame:
    """Columns ``entity``, kind (period or gap), from_day, to_day (yyyy-mm-dd or open)."""
    day = lambda c: F.unix_date(F.to_date(F.col(c)))
    rows = df.where(F.col(entity).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start)))).select(
        F.col(entity).cast("string").alias("entity"), day(start).cast("long").alias("s"), F.coalesce(day(end), F.lit(OPEN)).cast("long").alias("e")
    )
    order = (partitions, "entity", "s") if partitions else ("entity", "s")
    kept = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions("entity", "s").withColumn("pid", F.spark_partition_id()))

    def summarise(batches: Iterator) -> Iterator:
        import pyarrow as pa

        state, first, pid = (None, 0, 0), None, None
        for b in batches:
            if b.num_rows:
                if pid is None:
                    pid, first = b.column("pid")[0].as_py(), b.column("entity")[0].as_py()
                _, _, state = _scan(b, state, join_days)
        if pid is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first_entity": [first], "last_entity": [state[0]], "island": [state[2]], "upto": [state[1]]})

    carry: dict[int, tuple[str | None, int, int]] = {}
    state: tuple[str | None, int, int] = (None, 0, 0)
    for r in sorted(kept.mapInArrow(summarise, _SUMMARY).collect(), key=lambda r: r.pid):  # one row per partition
        carry[r.pid] = state
        if state[0] == r.first_entity == r.last_entity and r.island <= state[1] + join_days:
            state = (state[0], max(state[1], r.upto), state[2])
        else:
            state = (r.last_entity, r.upto, r.island)

    def label(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = None
        for b in batches:
            if not b.num_rows:
                continue
            at = carry[b.column("pid")[0].as_py()] if at is None else at
            runs, gaps, at = _scan(b, at, join_days)
            n, m = len(runs[0]), len(gaps[0])
            none = lambda k: pa.nulls(k, pa.int64())
            both = [pa.concat_arrays([runs[0], gaps[0]]), pa.concat_arrays([pa.array(runs[1]), none(m)]), pa.concat_arrays([pa.array(runs[2]), none(m)]), pa.concat_arrays([none(n), pa.array(gaps[1])]), pa.concat_arrays([none(n), pa.array(gaps[2])])]
            yield pa.RecordBatch.from_arrays(both, names=["entity", "island", "upto", "gap_from", "gap_to"])

    labels = kept.mapInArrow(label, _LABELS)
    text = lambda c: F.date_from_unix_date(F.col(c).cast("int")).cast("string")
    # One shuffle for both: a gap is its own group; the runs of an island that spans batches or partitions meet here.
    merged = labels.groupBy("entity", "island", "gap_from", "gap_to").agg(F.max("upto").alias("upto"))
    is_gap = F.col("gap_from").isNotNull()
    return merged.select(
        F.col("entity"),
        F.when(is_gap, "gap").otherwise("period").alias("kind"),
        F.when(is_gap, text("gap_from")).otherwise(text("island")).alias("from_day"),
        F.when(is_gap, text("gap_to")).when(F.col("upto") >= OPEN, "open").otherwise(text("upto")).alias("to_day"),
    )
