"""Queries of the core's record-cleaning problems: rejected records (1), nested records (3), intervals (4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import intervals, nested, rejects
from rankloom.plans.catalogue import query, table
from rankloom.session import spread

_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FIELD = r"(?s)(?:\"(?:[^\"]|\"\")*\"|[^\",]*)"
_P1 = rf"""
WITH l AS (SELECT raw_id, kind, regexp_replace(line, '[\r\n]+$', '') AS line FROM raw_records
           WHERE kind IN ('candidate', 'manifest') AND NOT regexp_full_match(line, '{_SPACE}*')),
     q AS (SELECT *, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS ok FROM l),
     f AS (SELECT *, CASE WHEN ok THEN regexp_extract_all(',' || line, ',({_FIELD})', 1) END AS v FROM q),
     c AS (SELECT *, v[CASE kind WHEN 'candidate' THEN 1 ELSE 3 END] AS x FROM f),
     u AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS t FROM c),
     r AS (SELECT raw_id, CASE WHEN NOT ok THEN 'quoting'
                WHEN len(v) <> CASE kind WHEN 'candidate' THEN 8 ELSE 5 END THEN 'columns'
                WHEN kind = 'candidate' AND NOT regexp_full_match(t, 'CAND_[0-9]{{7}}') THEN 'candidate_id'
                WHEN kind = 'manifest' AND (NOT regexp_full_match(t, '[0-9]+') OR coalesce(TRY_CAST(t AS HUGEINT), 2147483648) > 2147483647) THEN 'record_count' END AS reason FROM u)
SELECT raw_id, reason FROM r WHERE reason IS NOT NULL"""


@query("p1_found", _P1)
def p1_found(spark, sf_dir):
    found = rejects.rejected(rejects.parse_records(spread(table(spark, sf_dir, "raw_records"))))
    return found.where("reason <> 'kind'").select("raw_id", "reason")


@query("p1_reason_counts", f"WITH found AS ({_P1}) SELECT reason, count(*) AS n FROM found GROUP BY reason")
def p1_reason_counts(spark, sf_dir):
    return p1_found(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def _loaded(kind: str, fields: dict[str, str]) -> str:
    """SQL of the records of a kind that load, as typed columns."""
    text = "CASE WHEN v[{k}][1] = '\"' THEN replace(v[{k}][2:-2], '\"\"', '\"') ELSE v[{k}] END"
    trimmed = "nullif(regexp_replace(regexp_replace(" + text + ", '^{s}+', ''), '{s}+$', ''), '')"
    cols = ", ".join((f"TRY_CAST({trimmed} AS {t})" if t != "VARCHAR" else trimmed).format(k=k, s=_SPACE) + f" AS {name}" for k, (name, t) in enumerate(fields.items(), 1))
    return f"""
WITH bad AS ({_P1}),
     l AS (SELECT raw_id, regexp_replace(line, '[\r\n]+$', '') AS line FROM raw_records
           WHERE kind = '{kind}' AND NOT regexp_full_match(line, '{_SPACE}*') AND raw_id NOT IN (SELECT raw_id FROM bad)),
     f AS (SELECT raw_id, regexp_extract_all(',' || line, ',({_FIELD})', 1) AS v FROM l)
SELECT raw_id, {cols} FROM f"""


@query("p1_loaded_manifests", _loaded("manifest", {"source": "VARCHAR", "fingerprint": "VARCHAR", "record_count": "INTEGER", "format": "VARCHAR", "cached_at": "TIMESTAMP"}))
def p1_loaded_manifests(spark, sf_dir):
    return rejects.loaded(rejects.parse_records(spread(table(spark, sf_dir, "raw_records"))), rejects.MANIFEST)


@query("p1_loaded_candidates", _loaded("candidate", {"candidate_id": "VARCHAR", "anonymized_name": "VARCHAR", "headline": "VARCHAR", "location": "VARCHAR", "years_of_experience": "DOUBLE", "current_title": "VARCHAR", "signup_date": "DATE", "skills": "VARCHAR"}))
def p1_loaded_candidates(spark, sf_dir):
    return rejects.loaded(rejects.parse_records(spread(table(spark, sf_dir, "raw_records"))), rejects.CANDIDATE)


@query("p1_reader_errors", f"""WITH found AS ({_P1}) SELECT count(*) AS rejected, count(*) AS explained FROM found""")
def p1_reader_errors(spark, sf_dir):
    """Every rejected record comes with the reader's finding."""
    found = rejects.rejected(rejects.parse_records(spread(table(spark, sf_dir, "raw_records")))).where("reason <> 'kind'")
    return found.agg(F.count("*").alias("rejected"), F.count("reader_error").alias("explained"))


_P3_CHILDREN = ("profile", "career_history", "redrob_signals", "expected_salary_range_inr_lpa", "skill_assessment_scores")
_P3 = """
SELECT row_id, 'profile' AS child, 0::BIGINT AS pos, '' AS child_key FROM candidates WHERE profile IS NOT NULL
UNION ALL SELECT row_id, 'redrob_signals', 0, '' FROM candidates WHERE redrob_signals IS NOT NULL
UNION ALL SELECT row_id, 'expected_salary_range_inr_lpa', 0, '' FROM candidates WHERE redrob_signals IS NOT NULL AND redrob_signals.expected_salary_range_inr_lpa IS NOT NULL
UNION ALL SELECT row_id, 'skill_assessment_scores', 0, k FROM (SELECT row_id, unnest(map_keys(redrob_signals.skill_assessment_scores)) AS k FROM candidates)
UNION ALL SELECT row_id, 'career_history', p, '' FROM (SELECT row_id, unnest(career_history) AS j, unnest(range(1, len(career_history) + 1)) AS p FROM candidates) WHERE j IS NOT NULL"""


def _candidates(spark, sf_dir):
    """The delivered files under their merged schema."""
    return spark.read.option("mergeSchema", "true").parquet(f"{sf_dir}/candidates.parquet")


@query("p3_found", _P3)
def p3_found(spark, sf_dir):
    links = nested.object_links(_candidates(spark, sf_dir), "row_id", _P3_CHILDREN)
    return links.select("row_id", "child", "pos", "child_key")


@query("p3_children_of_parents", """
SELECT row_id AS root_key, row_id || '/redrob_signals/0' AS self_key, redrob_signals.connection_count AS connection_count,
       len(map_keys(redrob_signals.skill_assessment_scores))::BIGINT AS scores, round(list_sum(map_values(redrob_signals.skill_assessment_scores)), 4) AS total
FROM candidates WHERE len(map_keys(redrob_signals.skill_assessment_scores)) > 0""")
def p3_children_of_parents(spark, sf_dir):
    """Children joined back to their parents by the surrogate keys."""
    tables = nested.flatten(_candidates(spark, sf_dir), "row_id")
    scores = tables["redrob_signals_skill_assessment_scores"].groupBy("root_key", "parent_key").agg(F.count("*").alias("scores"), F.round(F.sum("value"), 4).alias("total"))
    parents = tables["redrob_signals"].select("root_key", "self_key", "connection_count")
    return parents.join(scores.withColumnRenamed("parent_key", "self_key"), ["root_key", "self_key"])


@query("p3_merged_deliveries", """
SELECT row_id, candidate_id, profile.headline AS headline, CASE WHEN row_id % 2 = 0 THEN profile.years_of_experience END AS years,
       CASE WHEN row_id % 2 = 1 THEN len(career_history) END::BIGINT AS jobs, row_id % 2 = 0 AS early FROM candidates""")
def p3_merged_deliveries(spark, sf_dir):
    """Deliveries of differing schema (fields missing, ids narrower) under the merged one."""
    d = table(spark, sf_dir, "candidates")
    early = d.where("row_id % 2 = 0").select(F.col("row_id").cast("int").alias("row_id"), "candidate_id", F.when(F.col("profile").isNotNull(), F.struct("profile.headline", "profile.years_of_experience")).alias("profile"), F.lit(True).alias("early"))
    late = d.where("row_id % 2 = 1").select("row_id", "candidate_id", F.when(F.col("profile").isNotNull(), F.struct("profile.headline")).alias("profile"), F.transform("career_history", lambda j: F.struct(j["company"].alias("company"))).alias("career_history"))
    m = nested.union_merged([early, late])
    return m.select("row_id", "candidate_id", "profile.headline", F.col("profile.years_of_experience").alias("years"), F.when(F.col("career_history").isNotNull(), F.size("career_history").cast("long")).alias("jobs"), F.coalesce("early", F.lit(False)).alias("early"))


@query("p3_career_history", """
SELECT row_id AS root_key, row_id::VARCHAR AS parent_key, row_id || '/career_history/' || p AS self_key, p AS pos, '' AS child_key,
       j.company, j.title, j.start_date, j.end_date, j.duration_months, j.is_current, j.industry, j.company_size, j.description
FROM (SELECT row_id, unnest(career_history) AS j, unnest(range(1, len(career_history) + 1)) AS p FROM candidates) WHERE j IS NOT NULL""")
def p3_career_history(spark, sf_dir):
    return nested.child_table(table(spark, sf_dir, "candidates"), "row_id", ("career_history",))


@query("p3_skill_scores", """
SELECT row_id AS root_key, row_id || '/redrob_signals/0' AS parent_key, row_id || '/redrob_signals/0/skill_assessment_scores/' || e.key AS self_key,
       0::BIGINT AS pos, e.key AS child_key, e.value AS value
FROM (SELECT row_id, unnest(map_entries(redrob_signals.skill_assessment_scores)) AS e FROM candidates)""")
def p3_skill_scores(spark, sf_dir):
    return nested.child_table(table(spark, sf_dir, "candidates"), "row_id", ("redrob_signals", "skill_assessment_scores"))


@query("p3_salary_ranges", """
SELECT row_id AS root_key, row_id || '/redrob_signals/0' AS parent_key, row_id || '/redrob_signals/0/expected_salary_range_inr_lpa/0' AS self_key,
       0::BIGINT AS pos, '' AS child_key, redrob_signals.expected_salary_range_inr_lpa.min AS min, redrob_signals.expected_salary_range_inr_lpa.max AS max
FROM candidates WHERE redrob_signals.expected_salary_range_inr_lpa IS NOT NULL""")
def p3_salary_ranges(spark, sf_dir):
    return nested.child_table(table(spark, sf_dir, "candidates"), "row_id", ("redrob_signals", "expected_salary_range_inr_lpa"))


_P4 = """
WITH j AS (SELECT candidate_id, start_date::DATE AS s, coalesce(end_date::DATE, DATE '9999-12-31') AS e FROM experience
           WHERE candidate_id IS NOT NULL AND start_date IS NOT NULL AND (end_date IS NULL OR end_date >= start_date)),
     m AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j),
     i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m),
     p AS (SELECT candidate_id, n, min(s) AS s, max(e) AS e FROM i GROUP BY candidate_id, n),
     g AS (SELECT *, lead(s) OVER (PARTITION BY candidate_id ORDER BY s) AS next_s FROM p)
SELECT candidate_id, 'period' AS kind, strftime(s, '%Y-%m-%d') AS from_day, CASE WHEN e = DATE '9999-12-31' THEN 'open' ELSE strftime(e, '%Y-%m-%d') END AS to_day FROM p
UNION ALL SELECT candidate_id, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(next_s - 1, '%Y-%m-%d') FROM g WHERE next_s IS NOT NULL"""


@query("p4_found", _P4)
def p4_found(spark, sf_dir):
    d = intervals.periods_and_gaps(table(spark, sf_dir, "experience"), "candidate_id", "start_date", "end_date")
    return d.withColumnRenamed("entity", "candidate_id")


@query("p4_gap_days", f"""
WITH found AS ({_P4}) SELECT candidate_id, count(*) AS gaps, sum(date_diff('day', from_day::DATE, to_day::DATE) + 1)::BIGINT AS days
FROM found WHERE kind = 'gap' GROUP BY candidate_id""")
def p4_gap_days(spark, sf_dir):
    d = p4_found(spark, sf_dir).where("kind = 'gap'")
    return d.groupBy("candidate_id").agg(F.count("*").alias("gaps"), F.sum(F.datediff(F.col("to_day").cast("date"), F.col("from_day").cast("date")) + 1).alias("days"))
