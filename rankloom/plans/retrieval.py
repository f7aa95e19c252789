"""Queries of retrieval, fusion and metrics. Job queries are the evaluation items, documents the candidates' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import metrics, retrieval
from rankloom.plans.catalogue import query, table
from rankloom.session import checkpoint, spread, when_small

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: A query that repeats a term.
_ONE = "python machine learning engineer python search ranking"


def words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({col}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ({_STOP}))"


def _bm25_sql(queries: str, k: int, okapi: bool = False) -> str:
    idf = "ln((n_docs - df + 0.5) / (df + 0.5)" + (")" if okapi else " + 1)")
    weights = f"""every AS (SELECT term, count(DISTINCT doc) AS df FROM (SELECT doc, unnest(w) AS term FROM d) GROUP BY term),
     raw AS (SELECT term, avg_len, {idf} AS raw FROM every, s),
     i AS (SELECT term, avg_len, {"CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END" if okapi else "raw"} AS idf FROM raw)"""
    return f"""
WITH d AS (SELECT * FROM (SELECT doc_id AS doc, {words_sql("text")} AS w FROM documents) WHERE len(w) > 0),
     s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
     q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({words_sql("qt")}) AS term FROM ({queries})) GROUP BY query, term),
     {weights},
     p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc, len, term),
     x AS (SELECT query, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN i USING (term) JOIN q USING (term) GROUP BY query, doc),
     r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM x)
SELECT query, doc, score, rank FROM r WHERE rank <= {k} AND score > 0"""


ONE_SQL = _bm25_sql(f"SELECT 1 AS query, '{_ONE}' AS qt", 100)
_MANY_SQL = _bm25_sql("SELECT item_id AS query, text AS qt FROM eval_items", 10)


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _one(spark):
    return spark.createDataFrame([(1, _ONE)], "query int, qt string")


def _many(spark, sf_dir, k=10):
    return retrieval.bm25(_docs(spark, sf_dir), table(spark, sf_dir, "eval_items").select("item_id", F.col("text").alias("qt")), "doc_id", "text", "item_id", "qt", k)


@query("bm25_topk", ONE_SQL)
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_docs(spark, sf_dir), _one(spark), "doc_id", "text", "query", "qt", 100)


@query("bm25_okapi_topk", _bm25_sql(f"SELECT 1 AS query, '{_ONE}' AS qt", 100, True))
def bm25_okapi_topk(spark, sf_dir):
    return retrieval.bm25(_docs(spark, sf_dir), _one(spark), "doc_id", "text", "query", "qt", 100, idf="okapi")


@query("bm25_multi_query", _MANY_SQL)
def bm25_multi_query(spark, sf_dir):
    return _many(spark, sf_dir)


@query("bm25_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS avg_len FROM (SELECT {words_sql('text')} AS w FROM documents) WHERE len(w) > 0")
def bm25_corpus_stats(spark, sf_dir):
    d = retrieval.corpus_stats(retrieval.tokenised(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return d.withColumn("avg_len", F.round("avg_len", 6))


@query("bm25_term_stats", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents) GROUP BY term")
def bm25_term_stats(spark, sf_dir):
    return retrieval.term_stats(retrieval.tokenised(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("index_upsert", "SELECT doc_id, CASE WHEN doc_type = 'resume' THEN 'second version: ' || text ELSE text END AS text FROM documents")
def index_upsert(spark, sf_dir):
    """All résumés come again, changed."""
    d = table(spark, sf_dir, "documents")
    changed = d.where("doc_type = 'resume'").select("doc_id", F.concat(F.lit("second version: "), "text").alias("text"))
    return retrieval.upsert(d.select("doc_id", "text"), changed, "doc_id")


@query("index_remove", "SELECT doc_id, text FROM documents WHERE employer IS DISTINCT FROM (SELECT employer FROM documents WHERE employer IS NOT NULL GROUP BY employer ORDER BY count(*) DESC, employer LIMIT 1)")
def index_remove(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "employer")
    top = d.where("employer IS NOT NULL").groupBy("employer").count().orderBy(F.desc("count"), "employer").limit(1)
    return retrieval.remove(d, d.join(top.select("employer"), "employer", "left_semi"), "doc_id").select("doc_id", "text")


@query("query_text_assembly", """
SELECT field, array_to_string(list(canonical ORDER BY canonical), ' ') AS query_text, 'Must have: ' || array_to_string(list(canonical ORDER BY canonical), ', ') || ' | Industry: ' || field AS dense_text
FROM ref_values GROUP BY field""")
def query_text_assembly(spark, sf_dir):
    d = table(spark, sf_dir, "ref_values").groupBy("field").agg(F.array_sort(F.collect_list("canonical")).alias("c"))
    return d.select("field", retrieval.search_query_text([F.col("c")]).alias("query_text"), retrieval.labelled_query_text({"Must have": F.col("c"), "Nice to have": F.array().cast("array<string>"), "Industry": F.array("field")}).alias("dense_text"))


def _vector_sql(metric: str, where: str, k: int) -> str:
    if metric == "ip":
        score, order = "round(list_dot_product(q.v, d.v), 6)", "DESC"
    else:
        score, order = "round(list_sum(list_transform(list_zip(q.v, d.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)", "ASC"
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query, d.vec_id AS doc, {score} AS score FROM v q, v d WHERE {where}),
     r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score {order}, doc) AS rank FROM s)
SELECT query, doc, score + 0.0 AS score, rank FROM r WHERE rank <= {k}"""


def _vectors(spark, sf_dir, where, k, metric):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.vector_top_k(v, v.where(where), "vec_id", "embedding", "vec_id", "embedding", k, metric)


@query("dense_ip_topk", _vector_sql("ip", "q.vec_id = 0", 50))
def dense_ip_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, "vec_id = 0", 50, "ip")


@query("dense_l2_topk", _vector_sql("l2", "q.vec_id = 0", 50))
def dense_l2_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, "vec_id = 0", 50, "l2")


@query("dense_multi_topk", _vector_sql("ip", "q.vec_id % 20 = 0", 10))
def dense_multi_topk(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 20, against all."""
    return _vectors(spark, sf_dir, "vec_id % 20 = 0", 10, "ip")


@query("l2_normalize", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def l2_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(retrieval.l2_normalize(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("vector_upsert", "SELECT vec_id, label FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id, 30 FROM embeddings WHERE label = 3")
def vector_upsert(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return retrieval.upsert(v, v.where("label = 3").withColumn("label", F.lit(30)), "vec_id")


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label <> 5")
def vector_delete(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return retrieval.remove(v, v.where("label = 5"), "vec_id")


@query("vector_get", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE vec_id = 42")
def vector_get(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 42").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


_FUSION_SQL = f"""
WITH s AS (SELECT query, doc, score FROM ({_MANY_SQL})), d AS (SELECT query + 1 AS query, doc, score FROM ({_vector_sql("ip", "q.vec_id < 240", 10)})),
     f AS (SELECT coalesce(d.query, s.query) AS query, coalesce(d.doc, s.doc) AS doc, coalesce(d.score, 0.0) AS dense_score, coalesce(s.score, 0.0) AS bm25_score FROM d FULL JOIN s ON d.query = s.query AND d.doc = s.doc),
     x AS (SELECT *, round(dense_score * 0.5 + bm25_score * 0.5, 9) AS score FROM f),
     r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM x)
SELECT query, doc, dense_score, bm25_score, score, rank FROM r WHERE rank <= 10"""


@query("hybrid_fusion", _FUSION_SQL)
def hybrid_fusion(spark, sf_dir):
    dense = _vectors(spark, sf_dir, "vec_id < 240", 10, "ip").withColumn("query", F.col("query") + 1)
    return retrieval.fuse(dense, _many(spark, sf_dir), 10)


# Metrics: a document is relevant to an item if it holds the item's text word for word.
_TRUTH_SQL = "SELECT item_id AS query, doc_id AS doc FROM documents d, eval_items e WHERE contains(d.text, e.text)"


def _truth(spark, sf_dir):
    """Found through a run of five words (an equi-join), then checked exactly; no cross join, and texts join by id only."""
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - 4)), lambda i: F.array_join(F.slice(c, i, 5), " "))
    words = lambda c: F.split(c, r"[^\p{L}\p{N}]+")
    # The third to seventh words of an item lie whole within any text that holds it.
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query"), F.col("text").alias("item"), F.array_join(F.slice(words(F.col("text")), 3, 5), " ").alias("run"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    near = docs.select("doc", F.explode(text.let(words(F.col("text")), lambda w: F.array_distinct(runs(w)))).alias("run")).join(when_small(items), "run").select("doc", "query", "item").distinct()
    return docs.join(near, "doc").where(F.col("text").contains(F.col("item"))).select("query", "doc")


def _metric_sql(value: str) -> str:
    return f"""
WITH r AS ({_MANY_SQL}), t AS ({_TRUTH_SQL}), n AS (SELECT query, count(*) AS n_rel FROM t GROUP BY query),
     j AS (SELECT r.query, r.doc, r.rank, CASE WHEN t.doc IS NULL THEN 0 ELSE 1 END AS rel, CASE WHEN t.doc IS NULL THEN 0.0 ELSE count(t.doc) OVER (PARTITION BY r.query ORDER BY r.rank) / r.rank END AS p FROM r LEFT JOIN t ON r.query = t.query AND r.doc = t.doc)
SELECT coalesce(j.query, n.query) AS query, coalesce(round({value}, 6), 0.0) AS value FROM j FULL JOIN n ON j.query = n.query GROUP BY 1"""


_N = "coalesce(max(n_rel), 0)"
_VALUES = {
    "recall_at_k": f"count(DISTINCT CASE WHEN rank <= 5 AND rel = 1 THEN doc END) / nullif({_N}, 0)",
    "precision_at_k": "count(DISTINCT CASE WHEN rank <= 5 AND rel = 1 THEN doc END) / 5.0",
    "hit_rate": "max(coalesce(rel, 0))::DOUBLE",
    "mrr": "1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END)",
    "ndcg_at_k": f"sum(CASE WHEN rel = 1 AND rank <= 5 THEN 1.0::DOUBLE / log2(rank + 1) END) / list_sum(list_transform(range(1, 1 + greatest(1, least({_N}, 5))), lambda i: 1.0::DOUBLE / log2(i + 1)))",
    "average_precision": f"sum(p) / nullif({_N}, 0)",
    "topk_accuracy": "max(CASE WHEN rank <= 5 AND rel = 1 THEN 1.0::DOUBLE ELSE 0.0 END)",
    "ranking_precision_at_k": "count(CASE WHEN rank <= 5 AND rel = 1 THEN doc END) / 5.0",
    "ranking_recall_at_k": f"count(CASE WHEN rank <= 5 AND rel = 1 THEN doc END) / nullif({_N}, 0)",
}


def _register(name: str) -> None:
    @query(name, _metric_sql(_VALUES[name]))
    def run(spark, sf_dir):
        return metrics.METRICS[name](_many(spark, sf_dir), _truth(spark, sf_dir), 5)


for _name in _VALUES:
    _register(_name)


@query("coverage", f"WITH r AS ({_MANY_SQL}), t AS (SELECT DISTINCT doc FROM ({_TRUTH_SQL})) SELECT round(count(*) FILTER (doc IN (SELECT doc FROM r)) / count(*), 6) AS value FROM t")
def coverage(spark, sf_dir):
    return metrics.coverage(_many(spark, sf_dir), _truth(spark, sf_dir))


@query("evaluation_report", " UNION ALL ".join(f"SELECT '{n}' AS metric, 5 AS k, count(*) AS queries, round(avg(value), 6) AS mean FROM ({_metric_sql(v)})" for n, v in _VALUES.items()))
def evaluation_report(spark, sf_dir):
    return metrics.evaluate(checkpoint(_many(spark, sf_dir)), checkpoint(_truth(spark, sf_dir)), 5, list(_VALUES))


_MANY50_SQL = _bm25_sql("SELECT item_id AS query, text AS qt FROM eval_items", 50)
_FIFTY = lambda value: _metric_sql(value).replace(_MANY_SQL, _MANY50_SQL)


@query("composite_score", f"""
SELECT a.query, round(0.50 * a.value + 0.30 * d.value + 0.15 * b.value + 0.05 * c.value, 6) AS value
FROM ({_FIFTY(_VALUES["ndcg_at_k"].replace("5", "10").replace("0.510", "0.5"))}) a JOIN ({_FIFTY(_VALUES["ndcg_at_k"].replace("5", "50").replace("0.550", "0.5"))}) d ON a.query = d.query
JOIN ({_FIFTY(_VALUES["average_precision"])}) b ON a.query = b.query JOIN ({_FIFTY("count(CASE WHEN rank <= 10 AND rel = 1 THEN doc END) / 10.0")}) c ON a.query = c.query""")
def composite_score(spark, sf_dir):
    """From hit lists of fifty."""
    r, t = checkpoint(_many(spark, sf_dir, 50)), checkpoint(_truth(spark, sf_dir))
    ten = metrics.per_query(r, t, 10, ["ndcg_at_k", "average_precision", "ranking_precision_at_k"])
    fifty = metrics.per_query(r, t, 50, ["ndcg_at_k"]).withColumnRenamed("ndcg_at_k", "ndcg_50")
    value = metrics.composite(F.col("ndcg_at_k"), F.col("ndcg_50"), F.col("average_precision"), F.col("ranking_precision_at_k"))
    return ten.join(fifty, "query").select("query", F.round(value, 6).alias("value"))
