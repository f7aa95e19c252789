"""The whole dataflow on the smallest tables."""

from rankloom.operators import export
from rankloom.plans import pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline_and_benchmark(spark):
    c = spark.read.parquet(f"{SF}/candidates.parquet")
    q = spark.createDataFrame([(1, "python machine learning data engineer")], "query int, text string")
    s = pipeline.run(spark, c, q)
    rows = s.frames["submission"].orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and all(r.reasoning for r in rows)
    assert all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))
    assert not {v.check for v in export.violations(s.frames["submission"], len(rows)).collect()} - {"tie_order"}
    assert [a["node_name"] for a in s.audit] == list(pipeline.STAGES) and s.audit_frame().where("status <> 'completed'").count() == 0
    got = pipeline.benchmark(spark, c, q, {"a": {}, "bad": {"nope": {}}}, lambda st: {"n": st.frames["ranked"].count()})
    assert got["a"]["metrics"]["n"] == len(rows) and "error" in got["bad"]


def test_pipeline_with_a_model_and_truth(spark):
    from pyspark.sql import functions as F

    c = spark.read.parquet(f"{SF}/candidates.parquet")
    q = spark.createDataFrame([(1, "python machine learning data engineer")], "query int, text string")
    truth = spark.createDataFrame([(1, "CAND_0000001")], "query long, doc string")
    body = '{"strengths": [], "concerns": [], "hiring_recommendation": "Yes", "confidence": 0.7, "recruiter_score": 0.9, "reasoning": "r"}'
    s = pipeline.run(spark, c, q, reply=lambda prompt: F.when(prompt.isNotNull(), F.lit(body)), truth=truth)
    assert {r.hiring_confidence for r in s.frames["reranked"].collect()} == {0.7}
    assert s.frames["metrics"].count() == 9 and s.frames["features"].select("metadata.feature_count").first()[0] == 16
    e = s.frames["explanations"].first()
    assert e.summary and e.reasoning and 0 < e.confidence <= 1 and isinstance(e.risks, list)


def test_pipeline_names_what_is_missing(spark):
    c = spark.read.parquet(f"{SF}/candidates.parquet")
    s = pipeline.run(spark, c, spark.createDataFrame([(1, "x")], "query int, text string"), stages=["load", "rank"])
    assert [(e["node_name"], e["error"]) for e in s.errors] == [("rank", "MissingFrame")]


def test_pipeline_stops_without_rows(spark):
    c = spark.read.parquet(f"{SF}/candidates.parquet").limit(0)
    s = pipeline.run(spark, c, spark.createDataFrame([(1, "x")], "query int, text string"))
    assert [e["error"] for e in s.errors] == ["EmptyDataset"] and "profiles" not in s.frames
