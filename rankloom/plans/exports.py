"""Queries of export, validation and file formats."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import export
from rankloom.plans import retrieval
from rankloom.plans.catalogue import query, table
from rankloom.session import ensure_checkpoint_dir
from rankloom.sources import files


def _ranked(spark, sf_dir):
    """The first hundred candidates by years, without repeats."""
    d = table(spark, sf_dir, "candidates").where(F.col("candidate_id").rlike("^CAND_[0-9]{7}$")).groupBy("candidate_id").agg(F.max(F.coalesce("profile.years_of_experience", F.lit(0.0))).alias("y"))
    d = d.orderBy(F.desc("y"), "candidate_id").limit(100)
    return d.select("candidate_id", F.row_number().over(Window.orderBy(F.desc("y"), "candidate_id")).cast("long").alias("rank"), F.round(F.col("y") / 50, 6).alias("score"))


_RANKED = "SELECT candidate_id, row_number() OVER (ORDER BY y DESC, candidate_id) AS rank, round(y / 50, 6) AS score FROM (SELECT candidate_id, max(coalesce(profile.years_of_experience, 0.0)) AS y FROM candidates WHERE regexp_full_match(candidate_id, 'CAND_[0-9]{7}') GROUP BY 1) ORDER BY y DESC, candidate_id LIMIT 100"


@query("submission_rows", f"WITH r AS ({_RANKED}) SELECT r.candidate_id, rank, score, coalesce(e.reasoning, 'No explanation available.') AS reasoning FROM r LEFT JOIN (SELECT candidate_id, string_agg(DISTINCT degree, ', ' ORDER BY degree) AS reasoning FROM education WHERE degree <> '' GROUP BY 1) e USING (candidate_id)")
def submission_rows(spark, sf_dir):
    e = table(spark, sf_dir, "education").where("degree <> ''").groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("degree")), ", ").alias("reasoning"))
    return export.submission(_ranked(spark, sf_dir), e)


@query("serialize_export", f"""
WITH r AS ({_RANKED}), s AS (SELECT candidate_id, max(proficiency) AS p, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM skills WHERE name <> '' GROUP BY 1)
SELECT r.candidate_id, rank, score AS hybrid_score, {", ".join(f"s.p AS recruiter_{c}" for c in export.ASSESSMENT)}, {", ".join(f"{'s.names' if c in ('strengths', 'weaknesses') else 's.p' if c == 'confidence' else 'CASE WHEN s.candidate_id IS NOT NULL THEN ' + repr(c) + ' END'} AS explanation_{c}" for c in export.EXPLANATION)}
FROM r LEFT JOIN s USING (candidate_id)""")
def serialize_export(spark, sf_dir):
    s = table(spark, sf_dir, "skills").where("name <> ''").groupBy("candidate_id").agg(F.max("proficiency").alias("p"), F.array_sort(F.collect_set("name")).alias("names"))
    a = s.select("candidate_id", *[F.col("p").alias(c) for c in export.ASSESSMENT])
    e = s.select("candidate_id", *[(F.col("names") if c in ("strengths", "weaknesses") else F.col("p") if c == "confidence" else F.lit(c)).alias(c) for c in export.EXPLANATION])
    return export.serialize(_ranked(spark, sf_dir).withColumnRenamed("score", "hybrid_score"), a, e)


@query("violations_submission", """
WITH d AS (SELECT candidate_id, (row_id % 120)::INTEGER AS rank, round(coalesce(profile.years_of_experience, 0.0) / 50, 6) AS score FROM candidates),
     n AS (SELECT *, lag(score) OVER (ORDER BY rank, candidate_id NULLS FIRST, score) AS b FROM d)
SELECT 'row_count' AS check, NULL::VARCHAR AS key, count(*)::VARCHAR AS detail FROM d HAVING count(*) <> 100
UNION ALL SELECT 'candidate_id', candidate_id, rank::VARCHAR FROM d WHERE NOT coalesce(regexp_full_match(candidate_id, 'CAND_[0-9]{7}'), false)
UNION ALL SELECT 'duplicate_candidate_id', candidate_id, count(*)::VARCHAR FROM d GROUP BY candidate_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_rank', rank::VARCHAR, count(*)::VARCHAR FROM d GROUP BY rank HAVING count(*) > 1
UNION ALL SELECT 'rank_range', candidate_id, rank::VARCHAR FROM d WHERE rank NOT BETWEEN 1 AND 100
UNION ALL SELECT 'missing_rank', i::VARCHAR, NULL FROM range(1, 101) t(i) WHERE i NOT IN (SELECT rank FROM d)""")
def violations_submission(spark, sf_dir):
    d = table(spark, sf_dir, "candidates").select("candidate_id", F.pmod("row_id", F.lit(120)).cast("int").alias("rank"), F.round(F.coalesce("profile.years_of_experience", F.lit(0.0)) / 50, 6).alias("score"))
    return export.violations(d).where(~F.col("check").isin("score_order", "tie_order"))


@query("violations_order", f"WITH r AS ({_RANKED}), d AS (SELECT candidate_id, (101 - rank)::INTEGER AS rank, score FROM r), n AS (SELECT *, lag(score) OVER (ORDER BY rank) AS b, lag(candidate_id) OVER (ORDER BY rank) AS bi FROM d) SELECT 'score_order' AS check, candidate_id AS key, rank::VARCHAR AS detail FROM n WHERE score > b UNION ALL SELECT 'tie_order', candidate_id, rank::VARCHAR FROM n WHERE score = b AND candidate_id < bi UNION ALL SELECT 'row_count', NULL, count(*)::VARCHAR FROM d HAVING count(*) <> 100 UNION ALL SELECT 'rank_range', candidate_id, rank::VARCHAR FROM d WHERE rank NOT BETWEEN 1 AND 100 UNION ALL SELECT 'missing_rank', i::VARCHAR, NULL FROM range(1, 101) t(i) WHERE i NOT IN (SELECT rank FROM d)")
def violations_order(spark, sf_dir):
    """A submission ranked the wrong way round."""
    return export.violations(_ranked(spark, sf_dir).withColumn("rank", 101 - F.col("rank")))


@query("violations_nulls", """
SELECT 'null_or_blank' AS check, key, n::VARCHAR AS detail FROM (SELECT 'title' AS key, count(*) FILTER (title IS NULL OR trim(title, ' ') = '') AS n FROM experience
UNION ALL SELECT 'company', count(*) FILTER (company IS NULL OR trim(company, ' ') = '') FROM experience UNION ALL SELECT 'start_date', count(*) FILTER (start_date IS NULL) FROM experience) WHERE n > 0""")
def violations_nulls(spark, sf_dir):
    return export.null_violations(table(spark, sf_dir, "experience"), ["title", "company", "start_date"])


@query("constraint_violations", """
SELECT 'start_before_end' AS check, exp_id::VARCHAR AS key FROM experience WHERE start_date > end_date UNION ALL SELECT 'has_title', exp_id::VARCHAR FROM experience WHERE title = ''
UNION ALL SELECT 'proficiency', exp_id::VARCHAR FROM experience WHERE len(list_filter(technologies, lambda t: t.proficiency NOT BETWEEN 0.3 AND 1)) > 0""")
def constraint_violations(spark, sf_dir):
    rules = {"start_before_end": F.col("start_date") <= F.col("end_date"), "has_title": F.col("title") != "", "proficiency": F.size(F.filter("technologies", lambda t: ~t["proficiency"].between(0.3, 1))) == 0}
    return export.constraint_violations(table(spark, sf_dir, "experience"), "exp_id", rules)


# File formats: tables written out and read back.
def _written(spark, sf_dir, name: str, write) -> str:
    """A folder of the shared checkpoint area, named by the session and the scale."""
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    path = f"{base}/formats/{spark.sparkContext.applicationId}-{os.path.basename(os.path.normpath(sf_dir))}-{name}"
    write(path)
    return path


_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])
_EVENTS = "SELECT event_id, user_id, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE MAP {'kind': event_type} END AS tags FROM events"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.when(F.col("event_id") % 7 != 0, F.create_map(F.lit("kind"), F.col("event_type"))).alias("tags"))


@query("csv_json_cells", _EVENTS)
def csv_json_cells(spark, sf_dir):
    """JSON in CSV cells; cells of every seventh row hold text that isn't JSON and come out null."""
    d = _events(spark, sf_dir).withColumn("tags", F.coalesce(F.to_json("tags"), F.lit("not, json")))
    path = _written(spark, sf_dir, "e.csv", lambda p: d.write.mode("overwrite").csv(p, header=True, quote='"', escape='"'))
    return files.load(spark, path, _EVENT, "csv")[0]


@query("jsonl_bad_lines", f"SELECT * FROM ({_EVENTS}) WHERE event_id % 5 <> 0")
def jsonl_bad_lines(spark, sf_dir):
    """Every fifth line is broken, blank or no object."""
    d = _events(spark, sf_dir)
    k = F.pmod("event_id", F.lit(15))
    line = F.when(k == 0, F.lit("{broken")).when(k == 5, F.lit("")).when(k == 10, F.lit('"text"')).otherwise(F.to_json(F.struct("*")))
    path = _written(spark, sf_dir, "e.jsonl", lambda p: d.select(line.alias("value")).write.mode("overwrite").text(p))
    return files.load(spark, path, _EVENT, "jsonl")[0]


@query("jsonl_rejected", "SELECT CASE WHEN event_id % 15 = 0 THEN '{broken' ELSE '\"text\"' END AS _corrupt_record FROM events WHERE event_id % 15 IN (0, 10)")
def jsonl_rejected(spark, sf_dir):
    d = _events(spark, sf_dir)
    k = F.pmod("event_id", F.lit(15))
    line = F.when(k == 0, F.lit("{broken")).when(k == 5, F.lit("")).when(k == 10, F.lit('"text"')).otherwise(F.to_json(F.struct("*")))
    path = _written(spark, sf_dir, "r.jsonl", lambda p: d.select(line.alias("value")).write.mode("overwrite").text(p))
    return files.load(spark, path, _EVENT, "jsonl")[1]


@query("json_records_wrapper", _EVENTS)
def json_records_wrapper(spark, sf_dir):
    """One JSON file per user, with the rows under ``records``."""
    d = _events(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("event_id", "user_id", "value", "tags")).alias("records")).select(F.to_json(F.struct("records")).alias("value"))
    path = _written(spark, sf_dir, "e.json", lambda p: d.repartition(d.count()).write.mode("overwrite").option("maxRecordsPerFile", 1).text(p))
    return files.load(spark, path, _EVENT, "json")[0]


@query("parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 10")
def parquet_scan(spark, sf_dir):
    good, _ = files.load(spark, f"{sf_dir}/lineitem.parquet")
    return good.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("bm25_saved_index", f"SELECT doc, score, rank FROM ({retrieval.ONE_SQL})")
def bm25_saved_index(spark, sf_dir):
    from rankloom.sources import sinks

    path = _written(spark, sf_dir, "index", lambda p: sinks.save_bm25_index(table(spark, sf_dir, "documents"), "doc_id", "text", p, 16))
    return sinks.search_bm25_index(spark, path, "python machine learning engineer python search ranking".split(), 100).where("score > 0")



@query("pipeline_submission")
def pipeline_submission(spark, sf_dir):
    """All stages from nested candidates to the submission, for one job."""
    from rankloom.plans import pipeline
    from rankloom.sources.files import load_config

    q = spark.createDataFrame([(1, "machine learning engineer python apache spark search ranking")], "query int, text string")
    config = load_config(None, retrieval={"top_k": 500})
    return pipeline.run(spark, table(spark, sf_dir, "candidates"), q, config).frames["submission"]
