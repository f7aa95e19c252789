"""Retrieval and ranking metrics over (query, doc, rank) and the relevant (query, doc), one row per query.

``METRICS`` is the plug-in registry: name -> function(ranked, truth, k) -> DataFrame(query, value); ``SUMMARIES`` holds
the metrics of a whole run: name -> function(frame, ...) -> DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: k -> value per query, as an aggregate over its judged rows (doc, rank, rel, n_rel).
Value = Callable[[int], Column]
Metric = Callable[[DataFrame, DataFrame, int], DataFrame]
VALUES: dict[str, Value] = {}
METRICS: dict[str, Metric] = {}


def judged(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """query, doc, rank, rel (0 or 1)."""
    t = truth.select("query", "doc").distinct().withColumn("rel", F.lit(1))
    return ranked.select("query", "doc", "rank").join(t, ["query", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(ranked: DataFrame, truth: DataFrame, k: int, names: list[str]) -> DataFrame:
    """One row per query of either side, one column per metric: the rows are judged and grouped once for all of them."""
    n_rel = truth.select("query", "doc").distinct().groupBy("query").agg(F.count("*").alias("n_rel"))
    rows = judged(ranked, truth).join(n_rel, "query", "full_outer").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    return rows.groupBy("query").agg(*[F.coalesce(F.round(VALUES[n](k), 6), F.lit(0.0)).alias(n) for n in names])


def metric(name: str) -> Callable[[Value], Metric]:
    """Registers a metric; it becomes a function(ranked, truth, k) -> DataFrame(query, value)."""

    def keep(f: Value) -> Metric:
        VALUES[name] = f

        def measure(ranked: DataFrame, truth: DataFrame, k: int = 0) -> DataFrame:
            return per_query(ranked, truth, k, [name]).withColumnRenamed(name, "value")

        measure.__name__, measure.__doc__ = name, f.__doc__
        METRICS[name] = measure
        return measure

    return keep


def _hits(k: int, distinct: bool) -> Column:
    hit = F.when((F.col("rank") <= k) & (F.col("rel") == 1), F.col("doc"))
    return F.count_distinct(hit) if distinct else F.count(hit)


@metric("recall_at_k")
def recall_at_k(k: int) -> Column:
    return F.try_divide(_hits(k, True), F.max("n_rel"))


@metric("precision_at_k")
def precision_at_k(k: int) -> Column:
    """Divides by k, not by the number retrieved."""
    return _hits(k, True) / F.lit(float(k))


@metric("hit_rate")
def hit_rate(k: int = 0) -> Column:
    return F.max(F.coalesce("rel", F.lit(0))).cast("double")


@metric("mrr")
def mrr(k: int = 0) -> Column:
    return 1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank")))


@metric("ndcg_at_k")
def ndcg_at_k(k: int) -> Column:
    gain = F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.max("n_rel"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return gain / ideal


@metric("average_precision")
def average_precision(k: int = 0) -> Column:
    """Sum of the precision at each relevant rank, divided by all that is relevant; of a query only its relevant ranks are gathered."""
    ranks = F.array_sort(F.collect_list(F.when(F.col("rel") == 1, F.col("rank"))))
    total = F.aggregate(F.transform(ranks, lambda r, i: (i + 1.0) / r), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total, F.max("n_rel"))


@metric("topk_accuracy")
def topk_accuracy(k: int) -> Column:
    return F.max(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1.0).otherwise(0.0))


@metric("ranking_precision_at_k")
def ranking_precision_at_k(k: int) -> Column:
    """Repeated documents count each time."""
    return _hits(k, False) / F.lit(float(k))


@metric("ranking_recall_at_k")
def ranking_recall_at_k(k: int) -> Column:
    return F.try_divide(_hits(k, False), F.max("n_rel"))


def coverage(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of all relevant documents that any query retrieved."""
    docs = truth.select("doc").distinct()
    found = docs.join(ranked.select("doc").distinct(), "doc", "left_semi")
    return docs.agg(F.count("*").alias("n")).crossJoin(found.agg(F.count("*").alias("f"))).select(F.coalesce(F.round(F.try_divide("f", "n"), 6), F.lit(0.0)).alias("value"))


def evaluate(ranked: DataFrame, truth: DataFrame, k: int, names: list[str] | None = None) -> DataFrame:
    """metric, k, queries, mean over the queries; one pass over the rows for all metrics."""
    names = names or list(VALUES)
    d = per_query(ranked, truth, k, names).agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])
    return d.unpivot("queries", names, "metric", "mean").select("metric", F.lit(k).alias("k"), "queries", "mean")


def composite(ndcg10: Column, ndcg50: Column, ap: Column, p10: Column) -> Column:
    return 0.50 * ndcg10 + 0.30 * ndcg50 + 0.15 * ap + 0.05 * p10


def share(condition: Column) -> Column:
    """Share of the rows for which the condition holds; 0 of no rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def confidence_distribution(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col).cast("double")
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 6).alias("mean"), F.count(c).alias("count"))


def node_latency(audit: DataFrame, node: str, started: str, completed: str) -> DataFrame:
    """node, latency_ms of its first run."""
    ms = (F.unix_micros(F.col(completed).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1000.0
    return audit.groupBy(node).agg(F.round(F.min_by(ms, F.struct(F.col(started), F.col(completed))), 2).alias("latency_ms"))


def runtime_and_throughput(audit: DataFrame, started: str, completed: str) -> DataFrame:
    """runtime_ms from the first start to the last end, and rows per second (0 without time)."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = F.max(us(completed)) - F.min(us(started))
    return audit.agg(F.round(span / 1000.0, 2).alias("runtime_ms"), F.coalesce(F.round(F.try_divide(F.count("*") * 1e6, F.when(span > 0, span)), 6), F.lit(0.0)).alias("rows_per_second"))


def success_rate(explanations: DataFrame, summary: str = "summary", reasoning: str = "reasoning") -> DataFrame:
    """value: share of the explanations whose summary and reasoning say something."""
    said = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return explanations.agg(F.round(share(said(summary) & said(reasoning)), 6).alias("value"))


def fallback_rate(explanations: DataFrame, source: str = "source") -> DataFrame:
    """value: share of the explanations that come from a fallback."""
    return explanations.agg(F.round(share(F.lower(F.col(source)).contains("fallback")), 6).alias("value"))


#: Metrics of a whole run.
SUMMARIES: dict[str, Callable[..., DataFrame]] = {
    "coverage": coverage, "explanation_success_rate": success_rate, "fallback_rate": fallback_rate, "confidence_distribution": confidence_distribution, "node_latency": node_latency, "pipeline_runtime": runtime_and_throughput,
}
