"""Queries of features, ranking and explanations over candidates, experience and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import features
from rankloom.operators import explain, metrics, ranking
from rankloom.plans.catalogue import query, table

REQUIRED = ("Python", "Machine Learning", "Apache Spark", "PostgreSQL", "docker")
PREFERRED = ("Apache Kafka", "Kubernetes", "Data Modelling", "TensorFlow")
TITLE, DESCRIPTION = "Senior Machine Learning Engineer", "search ranking with python and apache spark in a small team"
KEYWORDS = ("python", "spark", "ranking", "team", "search")
AS_OF = "2024-06-30"

_arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_lower = lambda a: f"list_transform({a}, lambda x: lower(x))"
_CAND = "SELECT row_id, coalesce(list_filter(list_transform(skills, lambda s: s.name), lambda n: n IS NOT NULL), []) AS c, coalesce(profile.years_of_experience, 0.0) AS y, coalesce(profile.current_title, '') AS t, coalesce(profile.summary, '') AS s, coalesce(list_filter(list_transform(education, lambda e: e.degree), lambda d: d IS NOT NULL), []) AS d, coalesce(list_filter(list_transform(languages, lambda l: l.language), lambda d: d IS NOT NULL), []) AS l, CASE WHEN profile.country IS NULL THEN [] ELSE [profile.country] END AS p FROM candidates"
_FW = f"list_has_any({_lower('c')}, {_arr(features.FRAMEWORKS)})"
_HELD = f"CASE WHEN lower(x) = 'machine learning' THEN {_FW} ELSE list_contains({_lower('c')}, lower(x)) END"


def _candidates(spark, sf_dir):
    """row_id and the struct cand; jd is one row of literals."""
    names = lambda a, f: F.coalesce(F.filter(F.transform(F.col(a), lambda s: s[f]), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    p = F.col("profile")
    cand = F.struct(
        names("skills", "name").alias("skills"), F.coalesce(p["years_of_experience"], F.lit(0.0)).alias("years"), F.coalesce(p["current_title"], F.lit("")).alias("title"), F.coalesce(p["summary"], F.lit("")).alias("summary"),
        names("education", "degree").alias("degrees"), names("languages", "language").alias("languages"), F.when(p["country"].isNotNull(), F.array(p["country"])).otherwise(F.array().cast("array<string>")).alias("locations"),
    )
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    jd = F.struct(
        lits(REQUIRED).alias("required"), lits(PREFERRED).alias("preferred"), F.lit(6.0).alias("required_years"), F.lit(TITLE).alias("title"), F.lit(DESCRIPTION).alias("description"), lits(KEYWORDS).alias("keywords"),
        lits(("B.Tech", "m.tech")).alias("degrees"), lits(("English", "German")).alias("languages"), lits(("Arvania", "Drenland")).alias("locations"),
    )
    return table(spark, sf_dir, "candidates").select("row_id", cand.alias("cand"), jd.alias("jd"))


def _feature(spark, sf_dir, *cols):
    return features.feature_vector(_candidates(spark, sf_dir)).select("row_id", *[F.col(c).alias(c.split(".")[1]) for c in cols])


_ALL = _arr(dict.fromkeys(REQUIRED + PREFERRED))
_MATCHED = f"list_sort(list_distinct(list_concat(list_filter({_ALL}, lambda x: list_contains({_lower('c')}, lower(x))), CASE WHEN {_FW} THEN ['Machine Learning'] ELSE [] END)))"


@query("matched_skills", f"SELECT row_id, {_MATCHED} AS matched_skills FROM ({_CAND})")
def matched_skills(spark, sf_dir):
    return _feature(spark, sf_dir, "raw.matched_skills")


@query("missing_skills", f"SELECT row_id, list_sort(list_filter({_arr(REQUIRED)}, lambda x: NOT {_HELD})) AS missing_skills FROM ({_CAND})")
def missing_skills(spark, sf_dir):
    return _feature(spark, sf_dir, "raw.missing_skills")


@query("required_coverage", f"SELECT row_id, len(list_filter({_arr(REQUIRED)}, lambda x: {_HELD})) AS required_skill_matches, round(len(list_filter({_arr(REQUIRED)}, lambda x: {_HELD})) / {len(REQUIRED)}, 6) AS required_skill_coverage FROM ({_CAND})")
def required_coverage(spark, sf_dir):
    return _feature(spark, sf_dir, "raw.required_skill_matches", "normalized.required_skill_coverage")


@query("preferred_coverage", f"SELECT row_id, len(list_intersect({_arr(PREFERRED)}, c)) AS preferred_skill_matches, round(len(list_intersect({_arr(PREFERRED)}, c)) / {len(PREFERRED)}, 6) AS preferred_skill_coverage FROM ({_CAND})")
def preferred_coverage(spark, sf_dir):
    return _feature(spark, sf_dir, "raw.preferred_skill_matches", "normalized.preferred_skill_coverage")


_JACC = lambda a, b: f"coalesce(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6) END, 0.0)"


@query("skill_jaccard", f"SELECT row_id, {_JACC(_ALL, 'c')} AS skill_overlap, {_JACC(_arr(('English', 'German')), 'l')} AS languages_match FROM ({_CAND})")
def skill_jaccard(spark, sf_dir):
    return _feature(spark, sf_dir, "normalized.skill_overlap", "normalized.languages_match")


@query("experience_match", f"SELECT row_id, greatest(0.0, 6.0 - y) AS experience_gap_years, round(CASE WHEN y >= 6 THEN 1.0 WHEN 6 - y >= 5 THEN 0.0 ELSE (y - 1) / 5.0 END, 6) AS experience_match FROM ({_CAND})")
def experience_match(spark, sf_dir):
    return _feature(spark, sf_dir, "raw.experience_gap_years", "normalized.experience_match")


@query("set_any_match", f"SELECT row_id, CASE WHEN list_has_any(['b.tech', 'm.tech'], {_lower('d')}) THEN 1.0::DOUBLE ELSE 0.0 END AS education_match, CASE WHEN list_has_any(['Arvania', 'Drenland'], p) THEN 1.0::DOUBLE ELSE 0.0 END AS location_match FROM ({_CAND})")
def set_any_match(spark, sf_dir):
    return _feature(spark, sf_dir, "normalized.education_match", "normalized.location_match")


@query("tech_stack_match", f"SELECT row_id, {_JACC(_arr(('English', 'German')), 'l')} AS technology_stack_match FROM ({_CAND})")
def tech_stack_match(spark, sf_dir):
    return _feature(spark, sf_dir, "normalized.technology_stack_match")


@query("keyword_matches", f"SELECT row_id, list_sort(list_filter({_arr(KEYWORDS)}, lambda w: contains('{DESCRIPTION}', w) AND contains(lower(s), w))) AS keyword_matches FROM ({_CAND})")
def keyword_matches(spark, sf_dir):
    return _feature(spark, sf_dir, "raw.keyword_matches")


_WORDS = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[\\s\\x{{0b}}]+'), lambda x: x <> '')"
_COS = f"""
WITH p AS ({_CAND}), x AS (SELECT row_id, w, count(*) AS n FROM (SELECT row_id, unnest({_WORDS("t")}) AS w FROM p) GROUP BY 1, 2), q AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split('{TITLE.lower()}', ' ')) AS w) GROUP BY 1),
     d AS (SELECT row_id, sum(x.n * q.n) AS s FROM x JOIN q USING (w) GROUP BY 1), nx AS (SELECT row_id, sqrt(sum(n * n)) AS s FROM x GROUP BY 1)
SELECT p.row_id, coalesce(round(d.s / (nx.s * (SELECT sqrt(sum(n * n)) FROM q)), 6), 0.0) AS title_similarity FROM p LEFT JOIN d USING (row_id) LEFT JOIN nx USING (row_id)"""


@query("title_similarity", _COS)
def title_similarity(spark, sf_dir):
    return _feature(spark, sf_dir, "normalized.title_similarity")


@query("feature_vector")
def feature_vector(spark, sf_dir):
    return features.feature_vector(_candidates(spark, sf_dir)).select("row_id", "raw", "normalized")


# Ranking. Scores of a candidate: skill coverage and experience match; the recruiter's is the response rate.
_SCORES = f"""SELECT row_id, round(len(list_filter({_arr(REQUIRED)}, lambda x: {_HELD})) / {len(REQUIRED)}, 6) AS skill, round(CASE WHEN y >= 6 THEN 1.0 WHEN 6 - y >= 5 THEN 0.0 ELSE (y - 1) / 5.0 END, 6) AS exper, r AS recruiter
FROM ({_CAND.replace(" FROM candidates", ", coalesce(redrob_signals.recruiter_response_rate, 0.0) AS r FROM candidates")})"""


def _scores(spark, sf_dir):
    d = features.feature_vector(_candidates(spark, sf_dir)).select("row_id", F.col("normalized.required_skill_coverage").alias("skill"), F.col("normalized.experience_match").alias("exper"))
    r = table(spark, sf_dir, "candidates").select("row_id", F.coalesce("redrob_signals.recruiter_response_rate", F.lit(0.0)).alias("recruiter"))
    return d.join(r, "row_id")


@query("blend_scores", f"SELECT row_id, round(skill * 0.6 + recruiter * 0.4, 6) AS final_score FROM ({_SCORES})")
def blend_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("row_id", ranking.blend(F.col("skill"), F.col("recruiter"), 0.6, 0.4).alias("final_score"))


@query("multi_criteria", f"""
SELECT row_id, round(skill * 0.35 + exper * 0.30 + coalesce(education, 0.0) * 0.15 + coalesce(activity, 0.0) * 0.10 + recruiter * 0.10, 6) AS score
FROM ({_SCORES}) JOIN (SELECT row_id, CASE WHEN len(list_filter(education, lambda e: e.tier IN ('tier_1', 'tier_2'))) > 0 THEN 1.0 ELSE 0.0 END AS education,
     redrob_signals.profile_completeness_score / 100.0::DOUBLE AS activity FROM candidates) USING (row_id)""")
def multi_criteria(spark, sf_dir):
    """All five criteria."""
    more = table(spark, sf_dir, "candidates").select("row_id", F.exists("education", lambda e: e["tier"].isin("tier_1", "tier_2")).cast("double").alias("education"), (F.col("redrob_signals.profile_completeness_score") / 100.0).alias("activity"))
    weights = {"skill": 0.35, "exper": 0.30, "education": 0.15, "activity": 0.10, "recruiter": 0.10}
    return _scores(spark, sf_dir).join(more, "row_id").select("row_id", ranking.weighted(weights).alias("score"))


@query("trap_kinds", """
SELECT row_id, coalesce(len(skills) >= 10 AND coalesce(len(list_filter(skills, lambda s: coalesce(s.duration_months, 0) < 3)), 0) * 2 > len(skills), false) AS stuffer,
       coalesce(profile.years_of_experience >= 5 AND redrob_signals.recruiter_response_rate < 0.1 AND redrob_signals.interview_completion_rate < 0.3, false) AS twin FROM candidates""")
def trap_kinds(spark, sf_dir):
    c = table(spark, sf_dir, "candidates")
    return c.select("row_id", ranking.keyword_stuffer(F.col("skills")).alias("stuffer"), ranking.behavioural_twin(F.col("profile.years_of_experience"), F.col("redrob_signals.recruiter_response_rate"), F.col("redrob_signals.interview_completion_rate")).alias("twin"))


@query("final_order", f"SELECT row_id, final_score, rank FROM (SELECT row_id, round(skill * 0.6 + recruiter * 0.4, 6) AS final_score, row_number() OVER (ORDER BY round(skill * 0.6 + recruiter * 0.4, 6) DESC, row_id) AS rank FROM ({_SCORES})) WHERE rank <= 100")
def final_order(spark, sf_dir):
    d = blend_scores(spark, sf_dir).withColumn("previous_rank", F.lit(1))
    return ranking.final_order(d, id_col="row_id", k=100).select("row_id", "final_score", "rank")


@query("global_rank", f"SELECT row_id, row_number() OVER (ORDER BY round(skill * 0.6 + recruiter * 0.4, 6) DESC, row_id) AS rank FROM ({_SCORES})")
def global_rank(spark, sf_dir):
    """Ranks of all rows, by range partitions and offsets rather than one window."""
    return ranking.global_rank(blend_scores(spark, sf_dir), [F.desc("final_score"), F.col("row_id")], "row_id").select("row_id", "rank")


@query("positional_rank", "SELECT row_id, round(greatest(0.0, 0.95::DOUBLE - 0.009::DOUBLE * (n - 1)), 2) AS score, round(least(round(greatest(0.0, 0.95::DOUBLE - 0.009::DOUBLE * (n - 1)), 2) + 0.02, 1.0), 2) AS reranked FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM candidates)")
def positional_rank(spark, sf_dir):
    d = ranking.global_rank(table(spark, sf_dir, "candidates").select("row_id"), ["row_id"], "row_id")
    return d.select("row_id", ranking.positional_score(F.col("rank")).alias("score")).withColumn("reranked", ranking.reranked(F.col("score")))


@query("topk_per_group", "SELECT candidate_id, name, proficiency, rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY proficiency DESC NULLS LAST, skill_id) AS rank FROM skills) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("candidate_id").orderBy(F.desc_nulls_last("proficiency"), "skill_id")
    return table(spark, sf_dir, "skills").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("candidate_id", "name", "proficiency", "rank")


def _replies(spark, sf_dir):
    """A model's replies made of events: fenced, bare, with values out of range, or broken."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    conf = F.round(F.pmod(F.col("event_id"), F.lit(12)) / 10.0, 1)
    body = F.concat(F.lit('{"strengths": ["a"], "concerns": [], "hiring_recommendation": "Yes", "confidence": '), conf.cast("string"), F.lit(', "recruiter_score": 0.5, "reasoning": "r"}'))
    k = F.pmod(F.col("event_id"), F.lit(4))
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.lit("no verdict {")).otherwise(F.regexp_replace(body, '"concerns": \\[\\], ', ""))
    return e.select("event_id", text.alias("reply"))


@query("verdict_parse", "SELECT event_id, event_id % 4 IN (0, 1) AND event_id % 12 <= 10 AS valid, CASE WHEN event_id % 4 IN (0, 1) AND event_id % 12 <= 10 THEN round((event_id % 12) / 10.0, 1) ELSE 0.1 END AS confidence FROM events")
def verdict_parse(spark, sf_dir):
    d = _replies(spark, sf_dir)
    return d.select("event_id", ranking.parse_verdict(F.col("reply")).isNotNull().alias("valid"), ranking.verdict_or_default(F.col("reply"))["confidence"].alias("confidence"))


@query("trap_filter", """
SELECT row_id, coalesce(len(list_filter(skills, lambda s: s.proficiency = 'expert' AND coalesce(s.duration_months, 1) = 0)) > 0, false) OR coalesce(coalesce(list_sum(list_transform(career_history, lambda j: coalesce(j.duration_months, 0))), CASE WHEN career_history IS NULL THEN NULL ELSE 0 END) > 12 * profile.years_of_experience + 12, false) AS impossible FROM candidates""")
def trap_filter(spark, sf_dir):
    return table(spark, sf_dir, "candidates").select("row_id", ranking.impossible_profile(F.col("skills"), F.col("career_history"), F.col("profile.years_of_experience")).alias("impossible"))


@query("prefilter", f"SELECT row_id FROM ({_CAND}) WHERE y >= 3 AND list_has_any(l, ['English'])")
def prefilter(spark, sf_dir):
    d = _candidates(spark, sf_dir)
    return d.where((F.col("cand.years") >= 3) & F.array_contains("cand.languages", "English")).select("row_id")


# Careers and explanations.
_JOBS = "(SELECT * FROM experience WHERE start_date IS NOT NULL)"


@query("interval_years", f"SELECT candidate_id, round(sum(date_diff('day', start_date::DATE, coalesce(end_date::DATE, DATE '{AS_OF}'))) / 365.25::DOUBLE, 2) AS years FROM {_JOBS} GROUP BY candidate_id")
def interval_years(spark, sf_dir):
    return explain.interval_years(table(spark, sf_dir, "experience"), "candidate_id", "start_date", "end_date", AS_OF)


@query("career_progression", f"SELECT candidate_id, exp_id, 'Moved from ' || b || ' to ' || title || ' at ' || coalesce(company, '') || '.' AS sentence FROM (SELECT *, lag(title) OVER (PARTITION BY candidate_id ORDER BY start_date, exp_id) AS b FROM {_JOBS}) WHERE b <> title")
def career_progression(spark, sf_dir):
    return explain.career_progression(table(spark, sf_dir, "experience"), "candidate_id", "start_date", "title", "company", "exp_id")


@query("leadership_evidence", f"SELECT exp_id, coalesce(regexp_matches(lower(title), '{explain.LEADERSHIP}'), false) AS in_title, coalesce(regexp_matches(lower(description), '{explain.LEADERSHIP}'), false) AS in_description FROM experience")
def leadership_evidence(spark, sf_dir):
    return explain.leadership(table(spark, sf_dir, "experience"), "exp_id", "title", "description")


@query("employment_gaps", f"SELECT candidate_id, exp_id, g AS gap_days FROM (SELECT *, date_diff('day', lag(end_date) OVER (PARTITION BY candidate_id ORDER BY start_date, exp_id)::DATE, start_date::DATE) AS g FROM {_JOBS}) WHERE g > 180")
def employment_gaps(spark, sf_dir):
    return explain.employment_gaps(table(spark, sf_dir, "experience"), "candidate_id", "start_date", "end_date", "exp_id")


@query("risk_factors", f"""
WITH l AS (SELECT candidate_id, greatest(coalesce(max(year(end_date)), 0), year(DATE '{AS_OF}')) AS latest FROM {_JOBS} GROUP BY 1)
SELECT j.candidate_id, count(*) AS recent_jobs FROM {_JOBS} j JOIN l USING (candidate_id) WHERE latest - year(start_date) <= 5 GROUP BY 1 HAVING count(*) > 3""")
def risk_factors(spark, sf_dir):
    return explain.recent_changes(table(spark, sf_dir, "experience"), "candidate_id", "start_date", "end_date", AS_OF)


@query("education_relevance", "SELECT edu_id, CASE WHEN regexp_matches(lower(degree), 'tech|sc') THEN degree ELSE field_of_study END AS relevant FROM education WHERE regexp_matches(lower(degree), 'tech|sc') OR regexp_matches(lower(field_of_study), 'tech|sc')")
def education_relevance(spark, sf_dir):
    relevant = explain.education_relevance(F.col("degree"), F.col("field_of_study"), ["tech", "sc"])
    return table(spark, sf_dir, "education").select("edu_id", relevant.alias("relevant")).where("relevant IS NOT NULL")


@query("project_relevance", "SELECT exp_id FROM experience WHERE list_has_any(list_transform(technologies, lambda t: lower(t.name)), ['python', 'apache spark', 'docker'])")
def project_relevance(spark, sf_dir):
    return table(spark, sf_dir, "experience").where(explain.project_relevance(F.col("technologies"), ["Python", "Apache Spark", "Docker"])).select("exp_id")


_RISKS = "CASE WHEN y < 6 THEN 1 ELSE 0 END + CASE WHEN m > 0 THEN 1 ELSE 0 END"
_EXPL = f"""SELECT row_id, f AS score, y, m, {_RISKS} AS risks FROM (SELECT row_id, round(skill * 0.6 + recruiter * 0.4, 6) AS f FROM ({_SCORES})) JOIN (SELECT row_id, y, len(list_filter({_arr(REQUIRED)}, lambda x: NOT {_HELD})) AS m FROM ({_CAND})) USING (row_id)"""


def _explained(spark, sf_dir):
    f = features.feature_vector(_candidates(spark, sf_dir)).select("row_id", F.col("raw.missing_skills").alias("missing"), F.col("raw.matched_skills").alias("matched"), F.col("cand.years").alias("y"))
    d = blend_scores(spark, sf_dir).withColumnRenamed("final_score", "score").join(f, "row_id")
    return d.withColumn("risks", F.when(F.col("y") < 6, 1).otherwise(0) + F.when(F.size("missing") > 0, 1).otherwise(0))


@query("recommendation", f"SELECT row_id, CASE WHEN score >= 0.8 AND risks = 0 THEN 'Strong Hire' WHEN score >= 0.6 AND risks = 0 THEN 'Consider for Interview' WHEN score >= 0.4 AND risks < 2 THEN 'Possible Fit, requires further review' ELSE 'No Hire' END AS recommendation FROM ({_EXPL})")
def recommendation(spark, sf_dir):
    return _explained(spark, sf_dir).select("row_id", explain.recommendation(F.col("score"), F.col("risks")).alias("recommendation"))


@query("confidence", f"SELECT row_id, round(least(1.0, 0.5 + score * 0.2 + CASE WHEN risks = 0 THEN 0.1 ELSE 0.0 END), 6) AS confidence FROM ({_EXPL})")
def confidence(spark, sf_dir):
    return _explained(spark, sf_dir).select("row_id", explain.confidence(F.col("score"), F.lit(None).cast("double"), F.col("risks") == 0).alias("confidence"))


@query("explanation_summary", f"SELECT row_id, 'Candidate ' || row_id || CASE WHEN score >= 0.75 THEN ' is a strong candidate for the {TITLE} role, demonstrating excellent alignment with key requirements.' WHEN score >= 0.5 THEN ' is a good candidate for the {TITLE} role, with several relevant skills and experiences.' ELSE ' has some relevant background for the {TITLE} role, but may have gaps in critical areas.' END AS summary FROM ({_EXPL})")
def explanation_summary(spark, sf_dir):
    return _explained(spark, sf_dir).select("row_id", explain.summary(F.concat(F.lit("Candidate "), F.col("row_id").cast("string")), F.lit(TITLE), F.col("score")).alias("summary"))


@query("explanation_text")
def explanation_text(spark, sf_dir):
    d = _explained(spark, sf_dir)
    none = F.array().cast("array<string>")
    strong = explain.strengths(F.col("matched"), F.col("y"), F.lit(6), none, none, none)
    weak = explain.weaknesses(F.col("missing"), none, F.col("y"), F.lit(6))
    return d.select("row_id", explain.reasoning(F.concat(F.lit("Candidate "), F.col("row_id").cast("string")), F.lit(TITLE), F.lit("N/A"), strong, weak, F.col("score"), F.lit(0)).alias("reasoning"))


# Metrics over audit rows; events stand for them.
@query("success_rate", "SELECT round(avg(CASE WHEN coalesce(text, '') <> '' AND coalesce(employer, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS success, round(avg(CASE WHEN contains(coalesce(source, ''), 'dump') THEN 1.0 ELSE 0.0 END), 6) AS fallback FROM documents")
def success_rate(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.round(metrics.share((F.col("text") != "") & (F.col("employer") != "")), 6).alias("success"), F.round(metrics.share(F.col("source").contains("dump")), 6).alias("fallback"))


@query("confidence_distribution", "SELECT min(proficiency) AS min, max(proficiency) AS max, round(avg(proficiency), 6) AS mean, count(proficiency) AS count FROM skills")
def confidence_distribution(spark, sf_dir):
    return metrics.confidence_distribution(table(spark, sf_dir, "skills"), "proficiency")


@query("node_latency", "SELECT event_type AS node, round(us / 1000.0::DOUBLE, 2) AS latency_ms FROM (SELECT event_type, us, row_number() OVER (PARTITION BY event_type ORDER BY ts, us) AS n FROM (SELECT event_type, ts, round(value * 1000)::BIGINT AS us FROM events)) WHERE n = 1")
def node_latency(spark, sf_dir):
    """Each event as a run that took its value in milliseconds."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), F.col("ts").cast("timestamp").alias("started"), F.round(F.col("value") * 1000).cast("long").alias("us"))
    e = e.withColumn("completed", F.timestamp_micros(F.unix_micros("started") + F.col("us")))
    return metrics.node_latency(e, "node", "started", "completed")


@query("pipeline_runtime", "SELECT round(date_diff('microsecond', min(ts), max(ts)) / 1000.0::DOUBLE, 2) AS runtime_ms, round(count(*) * 1000000.0::DOUBLE / date_diff('microsecond', min(ts), max(ts)), 6) AS rows_per_second FROM events")
def pipeline_runtime(spark, sf_dir):
    return metrics.runtime_and_throughput(table(spark, sf_dir, "events"), "ts", "ts")


@query("honeypot_rate", f"""
WITH f AS (SELECT row_id, row_number() OVER (ORDER BY round(skill * 0.6 + recruiter * 0.4, 6) DESC, row_id) AS rank FROM ({_SCORES})), t AS (SELECT row_id, coalesce(len(list_filter(skills, lambda s: s.proficiency = 'expert' AND coalesce(s.duration_months, 1) = 0)) > 0, false) OR coalesce(coalesce(list_sum(list_transform(career_history, lambda j: coalesce(j.duration_months, 0))), CASE WHEN career_history IS NULL THEN NULL ELSE 0 END) > 12 * profile.years_of_experience + 12, false) AS x FROM candidates)
SELECT round(avg(CASE WHEN x THEN 1.0 ELSE 0.0 END), 6) AS rate FROM f JOIN t USING (row_id) WHERE rank <= 100""")
def honeypot_rate(spark, sf_dir):
    d = final_order(spark, sf_dir).join(trap_filter(spark, sf_dir), "row_id")
    return d.agg(F.round(metrics.share(F.col("impossible")), 6).alias("rate"))
