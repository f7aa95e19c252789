"""Model hooks, DOCX, vectors, saved indexes and feature defaults."""

import zipfile

import pytest
from pyspark.sql import functions as F

from rankloom.functions import features, hooks
from rankloom.operators import retrieval
from rankloom.sources import files, sinks

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_hash_encoder_finds_the_same_words(spark):
    d = spark.createDataFrame([(1, "python search ranking"), (2, "ranking search, PYTHON"), (3, "dental nurse"), (4, ""), (5, None)], "id long, t string")
    v = d.select("id", hooks.hash_encoder(F.col("t")).alias("v"))
    got = {r.id: r.v for r in v.collect()}
    assert got[1] == got[2] != got[3] and sum(x * x for x in got[3]) == pytest.approx(1) and set(got[4]) == set(got[5]) == {0.0}
    hits = retrieval.vector_top_k(v, v.where("id = 1"), "id", "v", "id", "v", 2).orderBy("rank").collect()
    assert [r.doc for r in hits] == [1, 2]


def test_models_run_in_batches_and_may_fail(spark):
    def lengths():
        return lambda texts: [[float(len(t))] for t in texts]

    def replies():
        def run(prompts):
            if "bad" in prompts:
                raise RuntimeError
            return [p.upper() for p in prompts]

        return run

    d = spark.createDataFrame([("ab",), (None,), ("bad",)], "t string").coalesce(1)
    assert [r.v for r in d.select(hooks.encoder(lengths)("t").alias("v")).collect()] == [[2.0], [0.0], [3.0]]
    assert [r.v for r in d.select(hooks.generator(replies, batch=1)("t").alias("v")).collect()] == ["AB", "", None]
    assert d.limit(1).select(hooks.stemmed(F.array(F.lit("rankings"), F.lit("testing"), F.lit("as"))).alias("v")).first().v == ["ranking", "test", "as"]


def test_docx(spark, tmp_path):
    body = f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>Data </w:t></w:r><w:r><w:t>Engineer</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "y.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_docx(spark, str(tmp_path / "*.docx")).collect()}
    assert got == {"x.docx": "Data Engineer\na | b", "y.docx": None}


def test_vectors_kept(spark, tmp_path):
    p = str(tmp_path / "v")
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    assert sinks.save_vectors(d, "id", "v", p, 2) == 2 and sinks.validate_vectors(spark, p, 2) == [] and sinks.validate_vectors(spark, p, 3)
    with pytest.raises(ValueError):
        sinks.save_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], d.schema), "id", "v", p)
    assert sinks.load_vectors(spark, p).count() == 2


def test_saved_index_equals_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "python machine learning"), (2, "java spring"), (3, "python python r"), (4, None)], "id long, t string")
    sinks.save_bm25_index(docs, "id", "t", str(tmp_path / "i"), 4)
    q = spark.createDataFrame([(1, "python learning")], "q int, t string")
    want = [(r.doc, r.score) for r in retrieval.bm25(docs, q, "id", "t", "q", "t").orderBy("rank").collect()]
    assert [(r.doc, r.score) for r in sinks.search_bm25_index(spark, str(tmp_path / "i"), ["python", "learning"]).orderBy("rank").collect()] == want


def test_features_of_nothing(spark):
    d = spark.range(1).select(F.struct(F.lit("").alias("title")).alias("jd"), F.struct(F.lit("").alias("title")).alias("cand"))
    r = features.feature_vector(d).first()
    assert {k: v for k, v in r.normalized.asDict().items() if v} == {"experience_match": 1.0}
    assert all(not v for v in r.raw.asDict().values())


def test_machine_learning_rule(spark):
    lits = lambda *x: F.array(*[F.lit(v) for v in x])
    d = spark.range(1)
    assert d.select(features.missing_skills(lits("Machine Learning", "SQL"), lits("machine learning", "sql")).alias("m")).first().m == ["Machine Learning"]
    assert d.select(features.matched_skills(lits("Machine Learning"), lits("Keras")).alias("m")).first().m == ["Machine Learning"]
    assert d.select(features.experience_match(F.lit(8.0), F.lit(5.0)).alias("m")).first().m == pytest.approx(0.4)
