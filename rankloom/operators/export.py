"""Export rows and their validation. Validators give a table of violations (check, key, detail); none means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSESSMENT = ("technical_score", "career_score", "behavior_score", "risk_score", "culture_fit", "hiring_confidence", "final_score")
EXPLANATION = ("summary", "strengths", "weaknesses", "reasoning", "recommendation", "confidence")
COLUMNS = ("candidate_id", "rank", "hybrid_score", *(f"recruiter_{c}" for c in ASSESSMENT), *(f"explanation_{c}" for c in EXPLANATION))
NO_EXPLANATION = "No explanation available."


def _last(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the last by order; without one the greatest by its values, so that runs agree."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if order else F.desc(F.to_json(F.struct("*"))))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def serialize(ranked: DataFrame, assessments: DataFrame, explanations: DataFrame, order: str | None = None) -> DataFrame:
    """The export columns of all ranked rows: left joins, lists joined by '; ', sorted by rank."""
    a = _last(assessments, "candidate_id", order).select("candidate_id", *[F.col(c).alias(f"recruiter_{c}") for c in ASSESSMENT])
    e = _last(explanations, "candidate_id", order)
    flat = [(F.array_join(F.col(c), "; ") if e.schema[c].dataType.typeName() == "array" else F.col(c)).alias(f"explanation_{c}") for c in EXPLANATION]
    return ranked.select("candidate_id", "rank", "hybrid_score").join(a, "candidate_id", "left").join(e.select("candidate_id", *flat), "candidate_id", "left").select(*COLUMNS).orderBy("rank")


def submission(ranked: DataFrame, explanations: DataFrame) -> DataFrame:
    """candidate_id, rank, score, reasoning; rows without an explanation get a fixed text."""
    e = explanations.select("candidate_id", "reasoning")
    return ranked.join(e, "candidate_id", "left").select("candidate_id", "rank", "score", F.coalesce(F.nullif(F.trim("reasoning"), F.lit("")), F.lit(NO_EXPLANATION)).alias("reasoning"))


def _found(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def schema_problems(df: DataFrame, expected: tuple[str, ...] = COLUMNS) -> list[str]:
    return [f"missing {c}" for c in expected if c not in df.columns] + [f"unexpected {c}" for c in df.columns if c not in expected]


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and blank strings per column, counted in one aggregate."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    counts = df.agg(*[F.count_if(blank(c)).alias(c) for c in columns])
    pairs = counts.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("key", "n"))
    return _found(pairs.where("n > 0"), "null_or_blank", F.col("key"), F.col("n"))


def violations(df: DataFrame, size: int = 100, strict_id: str = r"^CAND_[0-9]{7}$") -> DataFrame:
    """All that is wrong with a submission of ``size`` rows (candidate_id, rank, score)."""
    rows = df.agg(F.count("*").alias("n"))
    ids = df.groupBy("candidate_id").agg(F.count("*").alias("n"))
    ranks = df.groupBy("rank").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("rank"))
    w = Window.orderBy("rank")
    # A submission has at most a few hundred rows; those beyond the size are reported by row_count and not ordered.
    near = df.where(F.col("rank").between(1, size)).withColumn("before", F.lag("score").over(w)).withColumn("before_id", F.lag("candidate_id").over(w))
    parts = [
        _found(rows.where(F.col("n") != size), "row_count", F.lit(None), F.col("n")),
        _found(df.where(~F.coalesce(F.col("candidate_id").rlike(strict_id), F.lit(False))), "candidate_id", F.col("candidate_id"), F.col("rank")),
        _found(ids.where("n > 1"), "duplicate_candidate_id", F.col("candidate_id"), F.col("n")),
        _found(ranks.where("n > 1"), "duplicate_rank", F.col("rank"), F.col("n")),
        _found(df.where(~F.coalesce(F.col("rank").between(1, size), F.lit(False))), "rank_range", F.col("candidate_id"), F.col("rank")),
        _found(every.join(df.select(F.col("rank").cast("int").alias("rank")), "rank", "left_anti"), "missing_rank", F.col("rank"), F.lit(None)),
        _found(df.where(F.col("score").isNull()), "score", F.col("candidate_id"), F.lit(None)),
        _found(near.where(F.col("score") > F.col("before")), "score_order", F.col("candidate_id"), F.col("rank")),
        _found(near.where((F.col("score") == F.col("before")) & (F.col("candidate_id") < F.col("before_id"))), "tie_order", F.col("candidate_id"), F.col("rank")),
    ]
    return reduce(DataFrame.unionByName, parts)


def rank_summary(df: DataFrame) -> DataFrame:
    """rows, distinct ranks, least and greatest rank, scores outside [0, 1]: one row that tells whether ranks are 1..n."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.count_if(~F.coalesce(F.col("hybrid_score").between(0, 1), F.lit(False))).alias("bad_scores"))


#: Row constraints of the data contracts: name -> condition that must hold where its columns are given.
def constraint_violations(df: DataFrame, id_col: str, constraints: dict[str, Column]) -> DataFrame:
    """check, key for each row and constraint that is false (null counts as holding)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), n) for n, c in constraints.items()]))
    return df.select(F.explode(failed).alias("check"), F.col(id_col).cast("string").alias("key"))
