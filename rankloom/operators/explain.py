"""Evidence from careers and rule-based explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEADERSHIP = r"lead|manager|head|director|architect|team lead|mentor|managed|coached"


def interval_years(jobs: DataFrame, entity: str, start: str, end: str, as_of: str) -> DataFrame:
    """entity, years: days of all intervals over 365.25, two decimals; an open end counts to as_of. Overlaps count twice."""
    days = F.datediff(F.coalesce(F.to_date(F.col(end)), F.to_date(F.lit(as_of))), F.to_date(F.col(start)))
    return jobs.where(F.col(start).isNotNull()).groupBy(entity).agg(F.round(F.sum(days) / 365.25, 2).alias("years"))


def career_progression(jobs: DataFrame, entity: str, start: str, title: str, company: str, id_col: str) -> DataFrame:
    """One row per change of title between neighbouring jobs of an entity: entity, id, sentence."""
    w = Window.partitionBy(entity).orderBy(start, id_col)
    d = jobs.where(F.col(start).isNotNull()).withColumn("before", F.lag(title).over(w))
    changed = d.where(F.col("before").isNotNull() & F.col(title).isNotNull() & (F.col("before") != F.col(title)))
    return changed.select(entity, id_col, F.concat(F.lit("Moved from "), F.col("before"), F.lit(" to "), F.col(title), F.lit(" at "), F.coalesce(F.col(company), F.lit("")), F.lit(".")).alias("sentence"))


def leadership(jobs: DataFrame, id_col: str, title: str, description: str) -> DataFrame:
    return jobs.select(id_col, F.coalesce(F.lower(title).rlike(LEADERSHIP), F.lit(False)).alias("in_title"), F.coalesce(F.lower(description).rlike(LEADERSHIP), F.lit(False)).alias("in_description"))


def employment_gaps(jobs: DataFrame, entity: str, start: str, end: str, id_col: str, days: int = 180) -> DataFrame:
    """Neighbouring jobs by start with more than ``days`` between the end of one and the start of the next: entity, id of the next, gap_days."""
    w = Window.partitionBy(entity).orderBy(start, id_col)
    d = jobs.where(F.col(start).isNotNull()).withColumn("prev_end", F.lag(end).over(w))
    gap = F.datediff(F.to_date(F.col(start)), F.to_date(F.col("prev_end"))).cast("long")
    return d.withColumn("gap_days", gap).where(F.col("gap_days") > days).select(entity, id_col, "gap_days")


def recent_changes(jobs: DataFrame, entity: str, start: str, end: str, as_of: str, years: int = 5, most: int = 3) -> DataFrame:
    """Entities with more than ``most`` jobs started in the last years: entity, recent_jobs."""
    latest = F.greatest(F.year(F.max(F.to_date(F.col(end)))), F.year(F.to_date(F.lit(as_of))))
    per = jobs.where(F.col(start).isNotNull()).groupBy(entity).agg(F.coalesce(latest, F.year(F.to_date(F.lit(as_of)))).alias("latest"))
    d = jobs.where(F.col(start).isNotNull()).join(per, entity).where(F.col("latest") - F.year(F.col(start)) <= years)
    return d.groupBy(entity).agg(F.count("*").alias("recent_jobs")).where(F.col("recent_jobs") > most)


def recommendation(score: Column, risks: Column) -> Column:
    """risks: how many risk factors there are."""
    return F.when((score >= 0.8) & (risks == 0), "Strong Hire").when((score >= 0.6) & (risks == 0), "Consider for Interview").when((score >= 0.4) & (risks < 2), "Possible Fit, requires further review").otherwise("No Hire")


def confidence(score: Column, hiring_confidence: Column, clean: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.lit(0.5) + F.coalesce(score * 0.2, F.lit(0.0)) + F.coalesce(hiring_confidence * 0.3, F.lit(0.0)) + F.when(clean, 0.1).otherwise(0.0)), 6)


def summary(name: Column, title: Column, score: Column) -> Column:
    say = lambda a, b: F.concat(name, F.lit(f" {a} for the "), title, F.lit(f" role, {b}"))
    return (
        F.when(score >= 0.75, say("is a strong candidate", "demonstrating excellent alignment with key requirements."))
        .when(score >= 0.5, say("is a good candidate", "with several relevant skills and experiences."))
        .otherwise(say("has some relevant background", "but may have gaps in critical areas."))
    )


def _listed(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, "; "), F.lit(".")))


def strengths(matched: Column, years: Column, required: Column, education: Column, projects: Column, leadership_: Column) -> Column:
    return F.array_compact(F.array(
        _listed("Strong alignment with must-have skills: ", matched),
        F.when(years >= required, F.concat(F.lit("Exceeds or meets the required "), required.cast("string"), F.lit(" years of experience with "), years.cast("string"), F.lit(" years.")))
        .when(years > 0, F.concat(F.lit("Possesses "), years.cast("string"), F.lit(" years of relevant experience."))),
        _listed("Relevant educational background in: ", education), _listed("Demonstrates practical experience through projects like: ", projects), _listed("Evidence of leadership roles/activities: ", leadership_),
    ))


def weaknesses(missing: Column, risks: Column, years: Column, required: Column) -> Column:
    return F.array_compact(F.array(
        _listed("Missing critical must-have skills: ", missing), _listed("Identified potential risk factors: ", risks),
        F.when((years < required) & (required > 0), F.concat(F.lit("Candidate has fewer years of experience ("), years.cast("string"), F.lit(" years) than the required "), required.cast("string"), F.lit("."))),
    ))


def reasoning(name: Column, title: Column, company: Column, strong: Column, weak: Column, score: Column, rank: Column) -> Column:
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ". "), F.lit(".")))
    return F.concat_ws(
        " ", F.concat(F.lit("The candidate "), name, F.lit(" was assessed for the "), title, F.lit(" role at "), company, F.lit(".")), part("Strengths include: ", strong), part("Areas for development or concern are: ", weak),
        F.concat(F.lit("The candidate achieved a ranking score of "), F.format_string("%.2f", score), F.lit(" (Rank: "), rank.cast("string"), F.lit(").")),
    )


def with_fallback(generated: Column, fallback: Column) -> Column:
    """A generated text, or the rule-based one where it is missing or blank."""
    return F.coalesce(F.when(F.trim(generated) != "", generated), fallback)


def education_relevance(degree: Column, field: Column, keywords: list[str]) -> Column:
    """The degree if it holds a keyword, else the field of study if that does, else null."""
    holds = lambda c: F.lower(c).rlike("|".join(keywords))
    return F.when(holds(degree), degree).when(holds(field), field)


def project_relevance(technologies: Column, wanted: list[str]) -> Column:
    """Whether a job's technologies (structs with a name) hold a wanted one."""
    return F.arrays_overlap(F.transform(technologies, lambda t: F.lower(t["name"])), F.array(*[F.lit(w.lower()) for w in wanted]))


def risks(years: Column, required: Column, missing: Column, recent_jobs: Column, activity: Column, gap_days: Column) -> Column:
    """The list of risk factors; a null input gives none."""
    return F.array_compact(F.array(
        F.when(years < required, F.lit("Insufficient experience")), F.when(F.size(missing) > 0, F.concat(F.lit("Missing critical skills: "), F.array_join(missing, ", "))),
        F.when(recent_jobs > 3, F.lit("Frequent job changes")), F.when(activity < 0.3, F.lit("Low activity score")), F.when(gap_days > 180, F.lit("Employment gap")),
    ))


def evidence(ranked: DataFrame, features: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """What explanations are made of, one row per ranked row: rank and score, matched and missing skills and years from
    the features, activity, recent_jobs, gap_days, education, projects and leadership from the people (null if unknown)."""
    d = ranked.join(features, keys, "left").join(people, "candidate_id", "left")
    none = F.array().cast("array<string>")
    lists = [c for c in ("matched", "missing", "education", "projects", "leadership") if c in d.columns]
    return d.withColumns({c: F.coalesce(F.col(c), none) for c in lists})


def build(evidence_rows: DataFrame, name: Column, title: Column, company: Column) -> DataFrame:
    """Adds risks, summary, strengths, weaknesses, reasoning, recommendation and confidence to rows of evidence."""
    d = evidence_rows.withColumn("risks", risks(F.col("years"), F.col("required_years"), F.col("missing"), F.col("recent_jobs"), F.col("activity"), F.col("gap_days")))
    d = d.withColumn("strengths", strengths(F.col("matched"), F.col("years"), F.col("required_years"), F.col("education"), F.col("projects"), F.col("leadership")))
    d = d.withColumn("weaknesses", weaknesses(F.col("missing"), F.col("risks"), F.col("years"), F.col("required_years")))
    d = d.withColumn("summary", summary(name, title, F.col("score"))).withColumn("reasoning", reasoning(name, title, company, F.col("strengths"), F.col("weaknesses"), F.col("score"), F.col("rank")))
    n = F.size("risks")
    return d.withColumn("recommendation", recommendation(F.col("score"), n)).withColumn("confidence", confidence(F.col("score"), F.col("hiring_confidence"), n == 0))
