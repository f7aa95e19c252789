"""Fusion, metrics, BM25 and vectors on hand-made values."""

import math

import pytest

from rankloom.operators import metrics, retrieval


def ranked(spark, q):
    return spark.createDataFrame([(k, d, i + 1) for k, ds in q.items() for i, d in enumerate(ds)], "query string, doc string, rank int")


def truth(spark, q):
    return spark.createDataFrame([(k, d) for k, ds in q.items() for d in ds], "query string, doc string")


def one(df):
    return {r.query: r.value for r in df.collect()}


def test_metric_values(spark):
    r, t = ranked(spark, {"q": "abc"}), truth(spark, {"q": "ad"})
    assert one(metrics.recall_at_k(r, t, 2)) == {"q": 0.5} and one(metrics.precision_at_k(r, t, 2)) == {"q": 0.5}
    assert one(metrics.mrr(r, truth(spark, {"q": "b"}), 0)) == {"q": 0.5}
    assert one(metrics.average_precision(ranked(spark, {"q": "abcd"}), truth(spark, {"q": "ac"}))) == {"q": round((1 + 2 / 3) / 2, 6)}
    got = one(metrics.ndcg_at_k(ranked(spark, {"q": "132"}), truth(spark, {"q": "12"}), 3))["q"]
    assert got == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert one(metrics.topk_accuracy(ranked(spark, {"q": "bc"}), truth(spark, {"q": "a"}), 1)) == {"q": 0.0}
    assert metrics.coverage(ranked(spark, {"1": "ab", "2": "bc"}), truth(spark, {"1": "abcd"})).first().value == 0.75
    assert one(metrics.recall_at_k(r, truth(spark, {"other": "z"}), 2)) == {"q": 0.0, "other": 0.0}


def test_fusion_values(spark):
    hits = lambda rows: spark.createDataFrame([(1, d, s) for d, s in rows], "query int, doc string, score double")
    got = [(r.doc, r.score, r.rank) for r in retrieval.fuse(hits([("001", 0.9), ("002", 0.8)]), hits([("002", 0.95), ("003", 0.9)]), 10).orderBy("rank").collect()]
    assert got == [("002", 0.875, 1), ("001", 0.45, 2), ("003", 0.45, 3)]
    assert retrieval.fuse(hits([]), hits([("a", 3.0), ("b", 1.0)]), 1, normalize="min_max").collect()[0].score == 0.5


def test_bm25_small(spark):
    docs = spark.createDataFrame([(1, "python machine learning engineer"), (2, "java backend development spring boot"), (3, "data scientist python r"), (4, None), (5, ""), (3, "data scientist python r")], "id long, text string")
    q = spark.createDataFrame([(1, "python machine learning"), (2, "golang kubernetes"), (3, None)], "qid int, qt string")
    got = retrieval.bm25(docs, q, "id", "text", "qid", "qt").orderBy("query", "rank").collect()
    assert [(r.query, r.doc) for r in got] == [(1, 1), (1, 3)]
    assert retrieval.bm25(docs.limit(0), q, "id", "text", "qid", "qt").count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, None)], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, qv array<double>")
    assert [r.doc for r in retrieval.vector_top_k(v, q, "id", "v", "qid", "qv", 3).orderBy("rank").collect()] == [1, 4, 2]
    assert [(r.doc, r.score) for r in retrieval.vector_top_k(v, q, "id", "v", "qid", "qv", 3, "l2").orderBy("rank").collect()] == [(1, 0.0), (4, 0.0), (2, 0.8)]
    assert retrieval.vector_top_k(v, q.limit(0), "id", "v", "qid", "qv").count() == 0
    assert sorted(r.id for r in retrieval.upsert(v, v.where("id = 2"), "id").collect()) == [1, 2, 3, 4, 5]
