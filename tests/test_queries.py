"""A part of the catalogue against its SQL over the smallest tables, and what the driver asks of the entry module."""

import importlib

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["p1_found", "p3_found", "p4_found", "p3_career_history", "bm25_topk", "ndcg_at_k", "hybrid_fusion", "profiles", "matched_skills", "final_order", "section_split", "violations_submission", "stream_windows"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from pathlib import Path

    from tools.compare import rows

    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, r.fetchall())


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
