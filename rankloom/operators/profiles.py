"""Flat search profiles from nested candidate records: one select of expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import clean, let
from rankloom.operators.records import is_valid


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _given(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c.cast("string") != "", F.lit(False))


def cleaned_list(items: Column, form) -> Column:
    """Elements formatted and cleaned; null elements and empty results are left out, a null list is empty."""
    there = F.filter(items, lambda x: x.isNotNull())
    return F.coalesce(F.filter(F.transform(there, lambda x: clean(form(x))), lambda s: s != ""), F.array().cast("array<string>"))


def job_text(j: Column) -> Column:
    return F.concat(
        _or_empty(j["title"]), F.lit(" at "), _or_empty(j["company"]),
        F.when(F.coalesce(j["duration_months"] != 0, F.lit(False)), F.concat(F.lit(" ("), j["duration_months"].cast("string"), F.lit(" months)"))).otherwise(""),
        F.when(_given(j["description"]), F.concat(F.lit(" - "), j["description"])).otherwise(""),
    )


def education_text(e: Column) -> Column:
    years = F.coalesce((e["start_year"] != 0) & (e["end_year"] != 0), F.lit(False))
    return F.concat(
        _or_empty(e["degree"]), F.when(_given(e["field_of_study"]), F.concat(F.lit(" in "), e["field_of_study"])).otherwise(""), F.when(_given(e["institution"]), F.concat(F.lit(" from "), e["institution"])).otherwise(""),
        F.when(_given(e["tier"]) & (e["tier"] != "unknown"), F.concat(F.lit(" ("), F.initcap(F.replace(e["tier"], F.lit("_"), F.lit(" "))), F.lit(")"))).otherwise(""),
        F.when(years, F.concat(F.lit(" ("), e["start_year"].cast("string"), F.lit("-"), e["end_year"].cast("string"), F.lit(")"))).otherwise(""),
    )


def certification_text(c: Column) -> Column:
    return F.concat(
        _or_empty(c["name"]), F.when(_given(c["issuer"]), F.concat(F.lit(" by "), c["issuer"])).otherwise(""),
        F.when(F.coalesce(c["year"] != 0, F.lit(False)), F.concat(F.lit(" ("), c["year"].cast("string"), F.lit(")"))).otherwise(""),
    )


def _current(field: str, own: Column) -> Column:
    """The profile's value, else that of the first current job that has one."""
    jobs = F.filter(F.col("career_history"), lambda j: F.coalesce(j["is_current"], F.lit(False)) & _given(j[field]))
    return clean(F.when(_given(own), own).otherwise(F.try_element_at(jobs, F.lit(1))[field]))


def years_of_experience() -> Column:
    """The profile's own years, else the months of all jobs as years, to one place (half to even); 0 without either."""
    months = F.aggregate(F.col("career_history"), F.lit(0.0), lambda s, j: s + F.coalesce(j["duration_months"], F.lit(0)))
    return F.coalesce(F.bround(F.col("profile.years_of_experience"), 1), F.bround(months / 12.0, 1), F.lit(0.0))


def activity_text() -> Column:
    s = F.col("redrob_signals")
    parts = F.concat_ws(
        " ",
        F.concat(F.lit("Profile completeness score is "), F.coalesce(s["profile_completeness_score"], F.lit(0.0)).cast("string"), F.lit("%.")),
        F.when(s["open_to_work_flag"], F.lit("Open to work.")),
        F.when(_given(s["last_active_date"]), F.concat(F.lit("Last active on "), s["last_active_date"], F.lit("."))),
        F.when(s["applications_submitted_30d"] != 0, F.concat(F.lit("Submitted "), s["applications_submitted_30d"].cast("string"), F.lit(" applications in the last 30 days."))),
        F.when(s["connection_count"] != 0, F.concat(F.lit("Has "), s["connection_count"].cast("string"), F.lit(" connections on the platform."))),
    )
    return F.when(s.isNotNull(), parts).otherwise("")


def _segments(labelled: list[Column]) -> Column:
    """Non-empty segments, of equal ones without case the first, joined by blank lines."""
    def first_of_equal(p: Column) -> Column:
        return F.filter(p["parts"], lambda x, i: F.array_position(p["low"], F.lower(x)) == i + 1)

    parts = F.filter(F.array(*[clean(c) for c in labelled]), lambda x: x != "")
    both = let(parts, lambda x: F.struct(x.alias("parts"), F.transform(x, lambda y: F.lower(y)).alias("low")))
    return F.array_join(let(both, first_of_equal), "\n\n")


def build_profiles(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """candidate_id and the flat profile of the rows that have an id; columns in ``keep`` go along."""
    p = F.col("profile")
    loc, country = clean(p["location"]), clean(p["country"])
    flat = df.where(is_valid("candidate_id")).select(
        *keep, "candidate_id", clean(p["anonymized_name"]).alias("full_name"), clean(p["headline"]).alias("headline"), clean(p["summary"]).alias("summary"),
        F.concat_ws(", ", F.nullif(loc, F.lit("")), F.nullif(country, F.lit(""))).alias("location"),
        _current("company", p["current_company"]).alias("current_company"), _current("title", p["current_title"]).alias("current_role"),
        years_of_experience().alias("years_experience"),
        cleaned_list(F.col("skills"), lambda s: _or_empty(s["name"])).alias("skills"), cleaned_list(F.col("career_history"), job_text).alias("experience"),
        cleaned_list(F.col("education"), education_text).alias("education"), cleaned_list(F.col("certifications"), certification_text).alias("certifications"),
        activity_text().alias("activity"), F.coalesce(F.bround(F.col("redrob_signals.profile_completeness_score") / 100.0, 2), F.lit(0.0)).alias("profile_completeness"),
    )
    role, company = F.col("current_role"), F.col("current_company")
    listed = lambda label, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, sep)))
    text = _segments([
        F.col("headline"), F.col("summary"),
        F.when((role != "") & (company != ""), F.concat(F.lit("Current Role: "), role, F.lit(" at "), company)).otherwise(F.concat(role, company)),
        listed("Skills: ", F.col("skills"), ", "), listed("Experience:\n", F.col("experience"), "\n"), listed("Education:\n", F.col("education"), "\n"), listed("Certifications:\n", F.col("certifications"), "\n"),
        F.when(F.col("activity") != "", F.concat(F.lit("Activity: "), F.col("activity"))),
    ])
    return flat.withColumn("search_text", text).withColumns({"num_skills": F.size("skills").cast("long"), "num_certifications": F.size("certifications").cast("long")})
