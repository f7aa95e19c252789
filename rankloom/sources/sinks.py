"""Writers: CSV, JSON, Parquet, indexes and vectors as tables, reports."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A single CSV file is written by the driver; above this, use write_csv_dir.
MOST_ROWS = 100_000


def write_atomic(path: str, text: str) -> None:
    """Writes beside the path and renames, so that readers see the old or the new file whole."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None, delimiter: str = ",", quotechar: str = '"', overwrite: bool = False) -> int:
    """One CSV file of a small result (at most MOST_ROWS rows, which is checked); returns the rows. None: ValueError."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    columns = columns or df.columns
    d = df.select(*columns)
    rows = (d.orderBy(*order) if order else d).limit(MOST_ROWS + 1).collect()
    if not rows:
        raise ValueError("nothing to write")
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: use write_csv_dir")
    import io

    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, quotechar=quotechar, lineterminator="\n")
    w.writerow(columns)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    write_atomic(path, out.getvalue())
    return len(rows)


def write_csv_dir(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, sep=delimiter, quote='"', escape='"')


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export(df: DataFrame, path: str, order: str = "rank") -> dict[str, Any]:
    """Validates (columns, nulls and blanks in keys and explanations, repeated ids, ranks), writes one CSV and a note beside it; raises ValueError if it doesn't hold."""
    from rankloom.operators.export import COLUMNS, null_violations, rank_summary, schema_problems

    if problems := schema_problems(df, COLUMNS):
        raise ValueError("; ".join(problems))
    if nulls := null_violations(df, ["candidate_id", "rank", "hybrid_score", "explanation_summary", "explanation_reasoning"]).collect():
        raise ValueError("; ".join(f"{v.key} is null or blank in {v.detail} rows" for v in nulls))
    if twice := df.groupBy("candidate_id").count().where("count > 1").count():
        raise ValueError(f"{twice} ids come more than once")
    s = rank_summary(df).first()
    if s.rows != s.ranks or s.rows and (s.first != 1 or s.last != s.rows):
        raise ValueError(f"ranks aren't 1..{s.rows}")
    if s.bad_scores:
        raise ValueError(f"{s.bad_scores} scores outside [0, 1]")
    n = write_csv(df, path, list(COLUMNS), [order], overwrite=True)
    note = {"rows": n, "columns": list(COLUMNS), "path": path}
    write_atomic(path + ".meta.json", json.dumps(note, indent=1))
    return note


def save_bm25_index(docs: DataFrame, id_col: str, text_col: str, path: str, buckets: int = 64, **params: float) -> None:
    """Postings bucketed by term, term and corpus statistics, and the parameters, as Parquet and JSON, on any file system Spark knows."""
    from rankloom.operators.retrieval import corpus_stats, term_stats, tokenised

    words = tokenised(docs, id_col, text_col)
    postings = words.select("doc", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("term", "doc", "len").agg(F.count("*").alias("tf")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    postings.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    term_stats(words).write.mode("overwrite").parquet(f"{path}/terms")
    corpus_stats(words).write.mode("overwrite").parquet(f"{path}/corpus")
    meta = {"k1": 1.5, "b": 0.75} | params
    docs.sparkSession.createDataFrame([(float(meta["k1"]), float(meta["b"]), buckets)], "k1 double, b double, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def search_bm25_index(spark: SparkSession, path: str, terms: list[str], k: int = 10) -> DataFrame:
    """doc, score, rank from a saved index; only the buckets of the query's terms are read."""
    from collections import Counter

    m = spark.read.schema("k1 double, b double, buckets int").json(f"{path}/meta").first().asDict()
    q = spark.createDataFrame(sorted(Counter(terms).items()), "term string, qtf long")
    buckets = [r[0] for r in q.select(F.pmod(F.xxhash64("term"), F.lit(m["buckets"]))).distinct().collect()]
    p = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms))))
    s = p.join(spark.read.parquet(f"{path}/terms"), "term").join(q, "term").crossJoin(spark.read.parquet(f"{path}/corpus"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = F.col("qtf") * idf * F.col("tf") * (m["k1"] + 1) / (F.col("tf") + m["k1"] * (1 - m["b"] + m["b"] * F.col("len") / F.col("avg_len")))
    from rankloom.operators.retrieval import top_k

    scored = s.withColumn("s", score).groupBy("doc").agg(F.round(F.sum("s"), 6).alias("score")).withColumn("query", F.lit(1))
    return top_k(scored, k).drop("query")


def save_vectors(df: DataFrame, id_col: str, vec_col: str, path: str, dim: int | None = None) -> int:
    """id, vector as Parquet; a vector of another length than dim (or than the first) raises ValueError."""
    sizes = df.agg(F.min(F.size(vec_col)).alias("a"), F.max(F.size(vec_col)).alias("b"), F.count("*").alias("n")).first()
    if sizes.n and (sizes.a != sizes.b or dim not in (None, sizes.a)):
        raise ValueError(f"vectors of {sizes.a} to {sizes.b} numbers")
    df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector")).write.mode("overwrite").parquet(path)
    return sizes.n


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def validate_vectors(spark: SparkSession, path: str, expected: int | None = None) -> list[str]:
    """Problems of a vector table: repeated or null ids, null vectors, an unexpected count."""
    r = spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("vector").isNull()).alias("none")).first()
    out = [f"{r.n - r.ids} repeated or null ids"] if r.n != r.ids else []
    out += [f"{r.none} null vectors"] if r.none else []
    return out + ([f"{r.n} rows, expected {expected}"] if expected not in (None, r.n) else [])


def write_report(metrics: dict[str, dict[str, float]], path: str, fmt: str = "json") -> None:
    """Sections of metrics as JSON, one flat CSV row ({section}_{metric}) or Markdown."""
    if fmt == "json":
        text = json.dumps(metrics, indent=2, sort_keys=True)
    elif fmt == "csv":
        flat = {f"{s}_{m}": v for s, ms in metrics.items() for m, v in ms.items()}
        text = ",".join(flat) + "\n" + ",".join(str(v) for v in flat.values()) + "\n"
    elif fmt == "md":
        text = "# Evaluation\n" + "".join(f"\n## {s}\n\n| metric | value |\n| --- | --- |\n" + "".join(f"| {m} | {v} |\n" for m, v in ms.items()) for s, ms in metrics.items())
    else:
        raise ValueError(f"unknown format {fmt}")
    write_atomic(path, text)
