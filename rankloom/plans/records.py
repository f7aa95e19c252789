"""Queries of record-level operators and profiles, on the nested candidates and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import profiles, records
from rankloom.plans.catalogue import query, table

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Java's \s under (?U) is White_Space, which leaves out 1c to 1f.
_USPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_USPACE}+', ''), '{_USPACE}+$', '')"


def clean_sql(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, '{_USPACE}+', ' ', 'g'), ' '), '')"


@query("normalize_records", f"""
SELECT row_id, nullif({strip_sql("candidate_id")}, '') AS candidate_id, nullif({strip_sql("profile.headline")}, '') AS headline, nullif({strip_sql("profile.summary")}, '') AS summary,
       list_transform(career_history, lambda j: nullif({strip_sql("j.company")}, '')) AS companies FROM candidates""")
def normalize_records(spark, sf_dir):
    d = records.normalize(table(spark, sf_dir, "candidates"))
    return d.select("row_id", "candidate_id", F.col("profile.headline").alias("headline"), F.col("profile.summary").alias("summary"), F.transform("career_history", lambda j: j["company"]).alias("companies"))


@query("validate_ids", f"SELECT row_id, {strip_sql('candidate_id')} <> '' AS valid, regexp_full_match({strip_sql('candidate_id')}, 'CAND_[0-9]{{7}}') AS strict FROM candidates WHERE candidate_id IS NOT NULL UNION ALL SELECT row_id, false, false FROM candidates WHERE candidate_id IS NULL")
def validate_ids(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("row_id", records.is_valid("candidate_id").alias("valid"), records.is_valid("candidate_id", True).alias("strict"))


@query("dedupe_keep_first", """
SELECT row_id, candidate_id FROM (SELECT row_id, candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at, row_id) AS n FROM candidates WHERE candidate_id IS NOT NULL) WHERE n = 1
UNION ALL SELECT row_id, candidate_id FROM candidates WHERE candidate_id IS NULL""")
def dedupe_keep_first(spark, sf_dir):
    return records.keep_first(table(spark, sf_dir, "candidates").select("row_id", "candidate_id", "ingested_at"), "candidate_id", ["ingested_at", "row_id"]).select("row_id", "candidate_id")


@query("error_rows", f"""
SELECT candidate_id, row_id, CASE WHEN NOT coalesce(regexp_full_match({strip_sql("candidate_id")}, 'CAND_[0-9]{{7}}'), false) THEN 'MalformedCandidateProfile' ELSE 'DuplicateCandidateID' END AS error
FROM (SELECT candidate_id, row_id, row_number() OVER (PARTITION BY candidate_id ORDER BY row_id) AS n FROM candidates)
WHERE NOT coalesce(regexp_full_match({strip_sql("candidate_id")}, 'CAND_[0-9]{{7}}'), false) OR n > 1""")
def error_rows(spark, sf_dir):
    return records.errors(table(spark, sf_dir, "candidates").select("row_id", "candidate_id"), "candidate_id", ["row_id"])


@query("load_stats", f"""
SELECT count(*) AS total_raw, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN id END) AS duplicates
FROM (SELECT {strip_sql("candidate_id")} AS id, coalesce({strip_sql("candidate_id")}, '') <> '' AS ok FROM candidates)""")
def load_stats(spark, sf_dir):
    return records.stats(table(spark, sf_dir, "candidates").select("candidate_id"), "candidate_id")


@query("page_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 256 OFFSET 512")
def page_n(spark, sf_dir):
    return records.page(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 256, 2)


@query("sample_n", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 100")
def sample_n(spark, sf_dir):
    return records.sample_n(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 7)


@query("shuffle_order", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':11'), doc_id) AS place FROM documents ORDER BY place")
def shuffle_order(spark, sf_dir):
    """All documents in the order of a seeded shuffle."""
    return records.shuffle_places(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 11).orderBy("place")


@query("shuffle_places", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':11'), doc_id) AS place FROM documents")
def shuffle_places(spark, sf_dir):
    """The place of every document in the seeded shuffle."""
    return records.shuffle_places(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 11)


@query("point_lookup", "SELECT doc_id, doc_type, employer FROM documents WHERE doc_id = 77")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 77").select("doc_id", "doc_type", "employer")


@query("flat_projection", f"SELECT row_id, list_transform(skills, lambda s: s.name) AS skill_names, coalesce(profile.years_of_experience, 0.0) AS years FROM candidates WHERE coalesce({strip_sql('candidate_id')}, '') <> ''")
def flat_projection(spark, sf_dir):
    d = table(spark, sf_dir, "candidates").where(records.is_valid("candidate_id"))
    return d.select("row_id", F.transform("skills", lambda s: s["name"]).alias("skill_names"), F.coalesce("profile.years_of_experience", F.lit(0.0)).alias("years"))


_VALID = f"coalesce({strip_sql('candidate_id')}, '') <> ''"
_JOB = """coalesce(j.title, '') || ' at ' || coalesce(j.company, '') || CASE WHEN coalesce(j.duration_months, 0) <> 0 THEN ' (' || j.duration_months || ' months)' ELSE '' END || CASE WHEN coalesce(j.description, '') <> '' THEN ' - ' || j.description ELSE '' END"""
_EDU = """coalesce(e.degree, '') || CASE WHEN coalesce(e.field_of_study, '') <> '' THEN ' in ' || e.field_of_study ELSE '' END || CASE WHEN coalesce(e.institution, '') <> '' THEN ' from ' || e.institution ELSE '' END
 || CASE WHEN coalesce(e.tier, '') NOT IN ('', 'unknown') THEN ' (' || array_to_string(list_transform(string_split(replace(e.tier, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ')' ELSE '' END
 || CASE WHEN coalesce(e.start_year, 0) <> 0 AND coalesce(e.end_year, 0) <> 0 THEN ' (' || e.start_year || '-' || e.end_year || ')' ELSE '' END"""
_CERT = "coalesce(c.name, '') || CASE WHEN coalesce(c.issuer, '') <> '' THEN ' by ' || c.issuer ELSE '' END || CASE WHEN coalesce(c.year, 0) <> 0 THEN ' (' || c.year || ')' ELSE '' END"


def _list(col: str, var: str, form: str) -> str:
    return f"coalesce(list_filter(list_transform(list_filter({col}, lambda {var}: {var} IS NOT NULL), lambda {var}: {clean_sql(form)}), lambda s: s <> ''), [])"


def _current(field: str, own: str) -> str:
    return clean_sql(f"CASE WHEN coalesce({own}, '') <> '' THEN {own} ELSE list_filter(career_history, lambda j: coalesce(j.is_current, false) AND coalesce(j.{field}, '') <> '')[1].{field} END")


_S = "redrob_signals"
_ACTIVITY = f"""CASE WHEN {_S} IS NULL THEN '' ELSE concat_ws(' ', 'Profile completeness score is ' || coalesce({_S}.profile_completeness_score, 0.0)::DOUBLE || '%.', CASE WHEN {_S}.open_to_work_flag THEN 'Open to work.' END,
 CASE WHEN coalesce({_S}.last_active_date, '') <> '' THEN 'Last active on ' || {_S}.last_active_date || '.' END, CASE WHEN {_S}.applications_submitted_30d <> 0 THEN 'Submitted ' || {_S}.applications_submitted_30d || ' applications in the last 30 days.' END,
 CASE WHEN {_S}.connection_count <> 0 THEN 'Has ' || {_S}.connection_count || ' connections on the platform.' END) END"""
_PROFILES = f"""
SELECT row_id, candidate_id, {clean_sql("profile.anonymized_name")} AS full_name, {clean_sql("profile.headline")} AS headline, {clean_sql("profile.summary")} AS summary,
       concat_ws(', ', nullif({clean_sql("profile.location")}, ''), nullif({clean_sql("profile.country")}, '')) AS location, {_current("company", "profile.current_company")} AS current_company, {_current("title", "profile.current_title")} AS current_role,
       {_list("skills", "s", "coalesce(s.name, '')")} AS skills, {_list("career_history", "j", _JOB)} AS experience, {_list("education", "e", _EDU)} AS education, {_list("certifications", "c", _CERT)} AS certifications, {_ACTIVITY} AS activity
FROM candidates WHERE {_VALID}"""
_SEARCH = f"""
WITH p AS ({_PROFILES}),
     g AS (SELECT row_id, list_filter([{", ".join(clean_sql(x) for x in ("headline", "summary", "CASE WHEN current_role <> '' AND current_company <> '' THEN 'Current Role: ' || current_role || ' at ' || current_company ELSE current_role || current_company END", "CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END", "CASE WHEN len(experience) > 0 THEN 'Experience: ' || array_to_string(experience, ' ') END", "CASE WHEN len(education) > 0 THEN 'Education: ' || array_to_string(education, ' ') END", "CASE WHEN len(certifications) > 0 THEN 'Certifications: ' || array_to_string(certifications, ' ') END", "CASE WHEN activity <> '' THEN 'Activity: ' || activity END"))}], lambda x: x <> '') AS parts FROM p)
SELECT row_id, array_to_string(list_filter(parts, lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), lower(x)) = i), chr(10) || chr(10)) AS search_text FROM g"""


def _profiles(spark, sf_dir, *cols):
    return profiles.build_profiles(table(spark, sf_dir, "candidates"), ("row_id",)).select("row_id", *cols)


@query("profiles", _PROFILES)
def build(spark, sf_dir):
    return _profiles(spark, sf_dir, "candidate_id", "full_name", "headline", "summary", "location", "current_company", "current_role", "skills", "experience", "education", "certifications", "activity")


@query("profile_search_text", _SEARCH)
def profile_search_text(spark, sf_dir):
    return _profiles(spark, sf_dir, "search_text")


@query("profile_years", f"""
SELECT row_id, coalesce(round_even(profile.years_of_experience, 1), round_even(list_sum(list_transform(career_history, lambda j: coalesce(j.duration_months, 0))) / 12.0::DOUBLE, 1), 0.0) AS years_experience,
       len({_list("skills", "s", "coalesce(s.name, '')")}) AS num_skills FROM candidates WHERE {_VALID}""")
def profile_years(spark, sf_dir):
    return _profiles(spark, sf_dir, "years_experience", "num_skills")
