"""Records, profiles, ranking, explanations, exports and sources."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import jobs, text
from rankloom.operators import explain, export, ranking, records
from rankloom.sources import files, sinks


def col(spark, c, **values):
    names = list(values)
    d = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'double'}" for n in names)) if names else spark.range(1)
    return d.select(c.alias("c")).first().c


def test_blend_order_and_verdicts(spark):
    assert col(spark, ranking.blend(F.col("a"), F.col("b"), 0.6, 0.4), a=0.8, b=0.85) == 0.82
    d = spark.createDataFrame([("c1", 0.8, 1), ("c2", 0.7, 2), ("c3", 0.8, 3)], "candidate_id string, final_score double, previous_rank int")
    assert [r.candidate_id for r in ranking.final_order(d).orderBy("rank").collect()] == ["c1", "c3", "c2"]
    assert [r.rank for r in ranking.global_rank(d, [F.desc("final_score"), F.col("previous_rank")], "candidate_id").orderBy("rank").collect()] == [1, 2, 3]
    good = '{"strengths": [], "concerns": ["x"], "hiring_recommendation": "Maybe", "confidence": 1.0, "recruiter_score": 0, "reasoning": "r"}'
    parse = lambda t: col(spark, ranking.parse_verdict(F.col("t")), t=t)
    assert parse(good).hiring_recommendation == "Maybe" and parse(f"text ```{good}``` end").confidence == 1.0
    for bad in ("", "{", "no", good.replace("1.0", "1.1"), good.replace('"concerns": ["x"], ', ""), good.replace("Maybe", "Perhaps"), None):
        assert parse(bad) is None
    assert col(spark, ranking.verdict_or_default(F.col("t")), t="x").confidence == 0.1


def test_job_descriptions(spark):
    get = lambda f, t: col(spark, f(F.col("t")), t=t)
    assert get(jobs.min_years, "3-5 years, minimum of 4 years") == 4 and get(jobs.max_years, "3-5 years or 2-9 years") == 5 and get(jobs.min_years, "none") is None
    assert get(jobs.seniority, "Senior or junior engineer") == "junior" and get(jobs.seniority, "8+ years") == "senior" and get(jobs.seniority, "x") is None
    s = get(jobs.salary, "Pay: $50k - $70k per annum")
    assert (s.min, s.max, s.currency, s.period) == (50000.0, 70000.0, "USD", "annual") and get(jobs.salary, "50 people") is None
    assert get(jobs.title, "\n\n  Data Engineer \nmore") == "Data Engineer" and get(jobs.title, "") is None
    d = spark.createDataFrame([(1, "Requirements:\nPython\nSQL\n\nfree text here\nBenefits\nlunch\nRequirements\nGo"), (2, ""), (3, None)], "id int, t string")
    assert {(r.section, r.content) for r in jobs.sections(d, "id", "t").collect()} == {("requirements", "Go"), ("benefits", "lunch")}


def test_shuffle_places_every_row(spark):
    from rankloom.operators import records

    d = spark.range(1203).withColumnRenamed("id", "doc_id")
    got = {r.place: r.doc_id for r in records.shuffle_places(d, "doc_id", 11).collect()}
    assert sorted(got) == list(range(1, 1204)) and [got[k] for k in range(1, 1204)] == [r.doc_id for r in records.shuffled(d, "doc_id", 11).collect()]
    assert records.shuffle_places(d.limit(0), "doc_id", 11).count() == 0


def test_sections_and_parts_are_whole(spark):
    one = "Responsibilities:\nBuild the data platform daily\nLead\n\nBachelor degree in physics required. Python"
    d = spark.createDataFrame([(1, one), (2, " plain\n \n\ntext\n"), (3, None), (4, "Benefits\n")], "id int, t string")
    assert {tuple(r) for r in jobs.all_sections(d, "id", "t").collect()} == {(1, "responsibilities", "Build the data platform daily\nLead"), (1, "unclassified", one), (2, "main_content", "plain\n\ntext"), (4, "main_content", "Benefits")}
    p = {r.id: r for r in jobs.parse_jobs(d, "id", "t").collect()}
    assert len(p) == 4 and p[1].responsibilities == ["Build the data platform daily"] and p[1].technical == ["Python"] and p[2].responsibilities == p[2].education == []
    assert [tuple(e) for e in p[1].education] == [("bachelor", "physics", True)]
    parsed = spark.createDataFrame([(1, "Go", ["SQL x"], [("Rust", ["Java"])]), (2, None, None, None)], "id int, a string, b array<string>, c array<struct<n: string, m: array<string>>>")
    assert {r.id: r.terms for r in jobs.section_terms(parsed, ["a", "b", "c", "none"], ["go", "sql", "rust", "java", "perl"]).collect()} == {1: ["go", "java", "rust", "sql"], 2: []}


def test_text_functions(spark):
    get = lambda f, t: col(spark, f(F.col("t")), t=t)
    assert get(text.tokens, "The C++ Über-engineer, of_2!") == ["c", "über", "engineer", "of_2"] and get(text.tokens, None) == []
    assert col(spark, text.cosine(F.col("a"), F.col("b")), a="x y", b="x z") == pytest.approx(0.5) and col(spark, text.cosine(F.col("a"), F.col("b")), a="", b="x") == 0.0
    assert get(text.normalize_skill, " K8s ") == "Kubernetes" and get(text.map_synonym, "ReactJS") == "React" and get(text.categorize, "html") == "ai_ml"
    with pytest.raises(KeyError):
        text.substitute("$missing", {})
    assert col(spark, text.clamp(F.col("a"), 0, 0), a=0.5) == 0.0


def test_records(spark):
    d = spark.createDataFrame([(1, "a", " x "), (2, "a", ""), (3, None, "y"), (4, None, None), (5, " ", "z")], "ord int, id string, v string")
    assert sorted(r.ord for r in records.keep_first(d, "id", ["ord"]).collect()) == [1, 3, 4, 5]
    assert [r.v for r in records.normalize(d).orderBy("ord").collect()] == ["x", None, "y", None, "z"]
    assert records.stats(d, "id").first().asDict() == {"total_raw": 5, "valid": 2, "invalid": 3, "duplicates": 1}
    assert records.page(d, ["ord"], 2, 9).count() == 0 and records.sample_n(d, "ord", 99, 1).count() == 5
    assert [len(b) for b in records.batches(d, 2)] == [2, 2, 1]
    assert records.normalize(d.limit(0)).count() == 0


def test_explanations(spark):
    assert col(spark, explain.recommendation(F.col("s"), F.col("r")), s=0.85, r=0.0) == "Strong Hire" and col(spark, explain.recommendation(F.col("s"), F.col("r")), s=0.9, r=1.0) == "Possible Fit, requires further review"
    assert col(spark, explain.confidence(F.col("s"), F.col("h"), F.lit(True)), s=1.0, h=1.0) == 1.0
    assert col(spark, explain.with_fallback(F.col("a"), F.lit("f")), a=" ") == "f"


def test_export_and_violations(spark, tmp_path):
    rows = [(f"CAND_{i:07d}", i, 1.0 - i / 1000) for i in range(1, 101)]
    d = spark.createDataFrame(rows, "candidate_id string, rank int, score double")
    assert export.violations(d).count() == 0
    bad = spark.createDataFrame([*rows[:98], ("CAND_0000001", 99, 0.99), ("X", 99, None)], d.schema)
    assert {r.check for r in export.violations(bad).collect()} >= {"duplicate_candidate_id", "candidate_id", "duplicate_rank", "missing_rank", "score", "score_order"}
    p = str(tmp_path / "s.csv")
    assert sinks.write_csv(d, p, order=["rank"]) == 100 and open(p).readline() == "candidate_id,rank,score\n"
    with pytest.raises(FileExistsError):
        sinks.write_csv(d, p)
    with pytest.raises(ValueError):
        sinks.write_csv(d.limit(0), str(tmp_path / "e.csv"))
    sinks.write_report({"a": {"x": 0.5}}, str(tmp_path / "r.csv"), "csv")
    assert (tmp_path / "r.csv").read_text() == "a_x\n0.5\n"


def test_sources(spark, tmp_path):
    assert files.detect_format("x.JSONL.gz") == "jsonl"
    with pytest.raises(files.UnsupportedFormat):
        files.detect_format("x.txt")
    schema = spark.createDataFrame([], "id int, tags array<string>").schema
    (tmp_path / "a.json").write_text('{"records": [{"id": 1, "tags": ["x"]}, 5, {"id": 2}]}')
    (tmp_path / "b.json").write_text('[{"id": 3}, [1]]')
    (tmp_path / "c.json").write_text("{broken")
    for name, ids, bad in (("a", [1, 2], 0), ("b", [3], 0), ("c", [], 1)):
        good, wrong = files.load(spark, str(tmp_path / f"{name}.json"), schema)
        assert sorted(r.id for r in good.collect()) == ids and wrong.count() == bad
    (tmp_path / "d.csv").write_text('id,tags\n1,"[""a""]"\n2,\n3,"[broken"\n')
    assert [(r.id, r.tags) for r in files.load(spark, str(tmp_path / "d.csv"), schema)[0].orderBy("id").collect()] == [(1, ["a"]), (2, None), (3, None)]
    with pytest.raises(files.EmptyDataset):
        files.load_nonempty(spark, str(tmp_path / "c.json"), schema)
    c = str(tmp_path / "cache")
    assert files.cached(spark, str(tmp_path / "d.csv"), c, schema).count() == 3 and files.cached(spark, str(tmp_path / "d.csv"), c, schema).count() == 3
    assert json.loads((tmp_path / "cache/cache.json").read_text())["record_count"] == 3
    files.clear_cache(c)
    cfg = tmp_path / "c.conf.json"
    cfg.write_text('{"retrieval": {"k1": 2.0}}')
    assert files.load_config(str(cfg), retrieval={"b": 0.5}).retrieval == files.RetrievalConfig(k1=2.0, b=0.5)
    with pytest.raises(ValueError):
        files.load_config(None, retrieval={"nope": 1})
