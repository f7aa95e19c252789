"""Scores to final orders: blending, ordering, verdict parsing, weighted criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICT = "strengths array<string>, concerns array<string>, hiring_recommendation string, confidence double, recruiter_score double, reasoning string"
RECOMMENDATIONS = ("Strong Yes", "Yes", "Maybe", "No")


def positional_score(place: Column) -> Column:
    """0.95 for the first place, 0.009 less for each further, never below 0; two decimals."""
    return F.round(F.greatest(F.lit(0.0), F.lit(0.95) - F.lit(0.009) * (place - 1)), 2)


def reranked(score: Column, gain: float = 0.02) -> Column:
    """A score raised by a fixed gain, at most 1; two decimals. The order stays."""
    return F.round(F.least(score + gain, F.lit(1.0)), 2)


def blend(previous: Column, recruiter: Column, previous_weight: float = 0.5, recruiter_weight: float = 0.5) -> Column:
    total = previous_weight + recruiter_weight
    a, b = (previous_weight / total, recruiter_weight / total) if total else (0.5, 0.5)
    return F.round(previous * a + recruiter * b, 6)


def final_order(df: DataFrame, score: str = "final_score", previous_rank: str = "previous_rank", id_col: str = "candidate_id", k: int | None = None) -> DataFrame:
    """Adds rank by score (largest first), then the previous rank, then the id. With k, only the first k are ranked."""
    if k is not None:
        df = df.where(F.col(id_col).isNotNull()).orderBy(F.desc(score), previous_rank, id_col).limit(k)
    else:
        return global_rank(df, [F.desc(score), F.col(previous_rank), F.col(id_col)], id_col)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), previous_rank, id_col)).cast("long"))


def global_rank(df: DataFrame, order: list, id_col: str) -> DataFrame:
    """Adds rank over all rows without one task holding them: range-partitioned by the order, offsets by partition counts."""
    from rankloom.session import checkpoint

    kept = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = {r._p: r.n for r in kept.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    start, at = {}, 0
    for p in sorted(sizes):
        start[p] = at
        at += sizes[p]
    if not start:
        return kept.drop("_i", "_p").withColumn("rank", F.lit(None).cast("long"))
    offset = F.try_element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("_p"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("_p").orderBy("_i")).cast("long") + offset).drop("_i", "_p")


def parse_verdict(text: Column) -> Column:
    """The verdict struct in a model's reply: the reply as JSON, else from its first { to its last }; null if it doesn't hold.

    All fields must be there, confidence and score within [0, 1] and the recommendation one of the four.
    """
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    v = F.from_json(F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), text).otherwise(body), VERDICT)
    valid = (
        F.try_parse_json(body).isNotNull() & v["strengths"].isNotNull() & v["concerns"].isNotNull() & v["reasoning"].isNotNull() & v["hiring_recommendation"].isin(*RECOMMENDATIONS)
        & v["confidence"].between(0.0, 1.0) & v["recruiter_score"].between(0.0, 1.0)
    )
    return F.when(valid, v)


def default_verdict() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(none.alias("strengths"), none.alias("concerns"), F.lit("No").alias("hiring_recommendation"), F.lit(0.1).alias("confidence"), F.lit(0.1).alias("recruiter_score"), F.lit("").alias("reasoning"))


def verdict_or_default(text: Column) -> Column:
    return F.coalesce(parse_verdict(text), default_verdict())


def weighted(criteria: dict[str, float]) -> Column:
    """Weighted sum of columns; a null counts 0."""
    out = F.lit(0.0)
    for c, w in criteria.items():
        out = out + F.coalesce(F.col(c), F.lit(0.0)) * w
    return F.round(out, 6)


def prompt(template: str, **parts: Column) -> Column:
    """A template with its structs as JSON, one prompt per row."""
    from rankloom.functions.text import substitute

    return substitute(template, {k: F.to_json(v) for k, v in parts.items()})


def impossible_profile(skills: Column, jobs: Column, years: Column) -> Column:
    """Expert in a skill used for no time, or jobs that together last over a year more than all experience."""
    expert = F.exists(skills, lambda s: (s["proficiency"] == "expert") & (F.coalesce(s["duration_months"], F.lit(1)) == 0))
    months = F.aggregate(jobs, F.lit(0), lambda a, j: a + F.coalesce(j["duration_months"], F.lit(0)))
    return F.coalesce(expert, F.lit(False)) | F.coalesce(months > 12 * years + 12, F.lit(False))


def keyword_stuffer(skills: Column, least: int = 10, months: int = 3) -> Column:
    """Many skills, most of them hardly used."""
    idle = F.size(F.filter(skills, lambda s: F.coalesce(s["duration_months"], F.lit(0)) < months))
    return F.coalesce((F.size(skills) >= least) & (idle * 2 > F.size(skills)), F.lit(False))


def behavioural_twin(years: Column, response_rate: Column, interview_rate: Column) -> Column:
    """A profile as good as another on paper whose owner neither answers nor turns up."""
    return F.coalesce((years >= 5) & (response_rate < 0.1) & (interview_rate < 0.3), F.lit(False))
