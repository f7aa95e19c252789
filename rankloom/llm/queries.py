"""Queries of the language-model data problems, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.llm import bpe, canon, leak, names, residue
from rankloom.session import spread

QUERIES = {}
ORACLES = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("p6_ids")
def p6_ids(spark, sf_dir):
    return bpe.encode_column(_documents(spark, sf_dir))


@_query("p6_roundtrip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_roundtrip(spark, sf_dir):
    return bpe.decode_column(p6_ids(spark, sf_dir))


@_query("p7_found")
def p7_found(spark, sf_dir):
    d = leak.find_leaks(_documents(spark, sf_dir), _table(spark, sf_dir, "eval_items"))
    return d.select("doc_id", "item_id")


@_query("p7_passages")
def p7_passages(spark, sf_dir):
    return leak.find_leaks(_documents(spark, sf_dir), _table(spark, sf_dir, "eval_items"))


@_query("p7_items")
def p7_items(spark, sf_dir):
    """Each leaked item with the number of documents that hold it."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"))


@_query("p8_found")
def p8_found(spark, sf_dir):
    return residue.find_residue(_documents(spark, sf_dir)).select("doc_id")


@_query("p8_windows")
def p8_windows(spark, sf_dir):
    d = residue.find_residue(_documents(spark, sf_dir))
    return d.select("doc_id", "coverage", F.explode("windows").alias("w")).select("doc_id", "coverage", F.col("w.class").alias("class"), "w.begin", "w.end")


def _p5(spark, sf_dir):
    jobs = _table(spark, sf_dir, "experience").where("origin = 'resume'").select(F.lit("company").alias("label"), F.col("exp_id").alias("id"), F.col("company").alias("text"))
    schools = _table(spark, sf_dir, "education").select(F.lit("institution").alias("label"), F.col("edu_id").alias("id"), F.col("institution").alias("text"))
    return jobs.unionByName(schools)


@_query("p5_found")
def p5_found(spark, sf_dir):
    """Employers of résumé rows and institutions, linked in one pass."""
    return names.find_spellings(_p5(spark, sf_dir))


@_query("p5_clusters")
def p5_clusters(spark, sf_dir):
    """Every row with its organisation (the least id) and the number of rows it is linked to."""
    return names.cluster_rows(_p5(spark, sf_dir))


@_query("p5_undecided")
def p5_undecided(spark, sf_dir):
    """Spellings that fit several organisations equally well, and so join none."""
    return names.undecided(_p5(spark, sf_dir))


def _p2(spark, sf_dir):
    return {t: spread(_table(spark, sf_dir, t)) for t in ("experience", "locations", "skills")}, _table(spark, sf_dir, "ref_values")


@_query("p2_found")
def p2_found(spark, sf_dir):
    return canon.match_columns(*_p2(spark, sf_dir))


@_query("p2_unmatched")
def p2_unmatched(spark, sf_dir):
    """How many values of each list stay without an entry."""
    return p2_found(spark, sf_dir).groupBy("field").agg(F.count("*").alias("typed"), F.count_if(F.col("ref_id") == 0).alias("unmatched"))
