"""Match features of a job description and a candidate: array expressions, no UDF, no shuffle.

Matching of required skills ignores case; preferred skills, overlaps and intersections compare as written.
"Machine Learning" counts as held if one of the three frameworks is, and only then as not missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import cosine, let

ML = "machine learning"
FRAMEWORKS = ("tensorflow", "keras", "pytorch")


def lowered(a: Column) -> Column:
    return F.transform(a, lambda x: F.lower(x))


def _has_framework(low: Column) -> Column:
    return F.arrays_overlap(low, F.array(*[F.lit(f) for f in FRAMEWORKS]))


def _held(x: Column, low: Column) -> Column:
    """Whether a required skill is among a candidate's skills in lower case."""
    return F.when(F.lower(x) == ML, _has_framework(low)).otherwise(F.array_contains(low, F.lower(x)))


def matched_skills(jd: Column, cand: Column) -> Column:
    def of(low: Column) -> Column:
        own = F.filter(jd, lambda x: F.array_contains(low, F.lower(x)))
        ml = F.when(F.array_contains(lowered(jd), ML) & _has_framework(low), F.array(F.lit("Machine Learning"))).otherwise(F.array().cast("array<string>"))
        return F.array_sort(F.array_union(own, ml))

    return let(lowered(cand), of)


def missing_skills(required: Column, cand: Column) -> Column:
    return let(lowered(cand), lambda low: F.array_sort(F.filter(required, lambda x: ~_held(x, low))))


def required_matches(required: Column, cand: Column) -> Column:
    return let(lowered(cand), lambda low: F.size(F.filter(required, lambda x: _held(x, low))).cast("long"))


def preferred_matches(preferred: Column, cand: Column) -> Column:
    return F.size(F.array_intersect(preferred, cand)).cast("long")


def share_of(n: Column, items: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), F.size(items).cast("double")), F.lit(0.0))


def matched(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 0 if either side is empty or null."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def any_common(a: Column, b: Column, ignore_case: bool = False) -> Column:
    x, y = (lowered(a), lowered(b)) if ignore_case else (a, b)
    return F.coalesce(F.when(F.arrays_overlap(x, y), 1.0), F.lit(0.0))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(F.when((F.lower(a) == F.lower(b)) & (a != ""), 1.0), F.lit(0.0))


def experience_gap(required: Column, years: Column) -> Column:
    return F.greatest(F.lit(0.0), required - years)


def experience_match(required: Column, years: Column) -> Column:
    """1 from the required years on, 0 from five years below, linear between."""
    return F.when((required == 0) | (years >= required), 1.0).when(required - years >= 5, 0.0).otherwise((years - (required - 5)) / 5.0)


def keyword_matches(words: Column, a: Column, b: Column) -> Column:
    return F.array_sort(F.filter(words, lambda w: F.lower(a).contains(F.lower(w)) & F.lower(b).contains(F.lower(w))))


#: Kinds of skill that are intersected (raw) and compared by Jaccard (normalised).
KINDS = ("certifications", "languages", "frameworks", "databases", "cloud", "devops", "ai_ml", "soft_skills")


def feature_vector(df: DataFrame, jd: str = "jd", cand: str = "cand") -> DataFrame:
    """Adds structs ``raw`` and ``normalized`` computed from the structs jd and cand.

    jd: title, seniority, required_years, required, preferred, keywords, description, domains, industries, locations, employment_types, degrees and KINDS;
    cand: the same names with years, skills and summary. Absent fields count as empty.
    """
    have = {s: {f.name for f in df.schema[s].dataType.fields} for s in (jd, cand)}
    arr = lambda s, n: F.coalesce(F.col(s)[n], F.array().cast("array<string>")) if n in have[s] else F.array().cast("array<string>")
    txt = lambda s, n: F.coalesce(F.col(s)[n], F.lit("")) if n in have[s] else F.lit("")
    num = lambda s, n: F.coalesce(F.col(s)[n].cast("double"), F.lit(0.0)) if n in have[s] else F.lit(0.0)
    req, pref, skills = arr(jd, "required"), arr(jd, "preferred"), arr(cand, "skills")
    need, years = num(jd, "required_years"), num(cand, "years")
    raw = F.struct(
        matched_skills(F.array_union(req, pref), skills).alias("matched_skills"), missing_skills(req, skills).alias("missing_skills"), required_matches(req, skills).alias("required_skill_matches"), preferred_matches(pref, skills).alias("preferred_skill_matches"),
        years.alias("candidate_years"), need.alias("required_years"), experience_gap(need, years).alias("experience_gap_years"),
        *[matched(arr(jd, k), arr(cand, k)).alias(f"matched_{k}") for k in KINDS], keyword_matches(arr(jd, "keywords"), txt(jd, "description"), txt(cand, "summary")).alias("keyword_matches"),
    )
    stack = ("languages", "frameworks", "databases", "cloud", "devops", "ai_ml")
    union = lambda s: F.array_distinct(F.concat(*[arr(s, k) for k in stack]))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    normal = F.struct(
        r6(jaccard(F.array_union(req, pref), skills), "skill_overlap"), r6(share_of(required_matches(req, skills), req), "required_skill_coverage"), r6(share_of(preferred_matches(pref, skills), pref), "preferred_skill_coverage"),
        r6(experience_match(need, years), "experience_match"), any_common(arr(jd, "degrees"), arr(cand, "degrees"), True).alias("education_match"), r6(cosine(txt(jd, "title"), txt(cand, "title")), "title_similarity"), same(txt(jd, "seniority"), txt(cand, "seniority")).alias("seniority_match"),
        r6(jaccard(arr(jd, "domains"), arr(cand, "domains")), "domain_match"), r6(jaccard(arr(jd, "industries"), arr(cand, "industries")), "industry_match"), any_common(arr(jd, "locations"), arr(cand, "locations")).alias("location_match"), any_common(arr(jd, "employment_types"), arr(cand, "employment_types")).alias("employment_type_match"),
        *[r6(jaccard(arr(jd, k), arr(cand, k)), f"{k}_match") for k in KINDS], r6(cosine(txt(jd, "description"), txt(cand, "summary")), "keyword_similarity"), r6(jaccard(union(jd), union(cand)), "technology_stack_match"),
    )
    return df.withColumn("raw", raw).withColumn("normalized", normal)


#: Raw metrics that are counted as features.
FEATURE_COUNT = 16


def with_metadata(df: DataFrame, version: str = "1.0") -> DataFrame:
    """Adds the struct ``metadata``: feature_count, generated_at (UTC) and version."""
    return df.withColumn("metadata", F.struct(F.lit(FEATURE_COUNT).alias("feature_count"), F.current_timestamp().alias("generated_at"), F.lit(version).alias("version")))
