"""Inverted-index and vector retrieval, and their fusion.

BM25 builds no index on the driver: postings are kept for the queries' terms only, so the shuffle carries
(term, document) counts of those terms; corpus statistics still cover every document. Vector search is exact.
Ties are always broken by id, so results don't depend on partitioning; scores are rounded before ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import let, tokens
from rankloom.session import when_small


def tokenised(docs: DataFrame, id_col: str, text_col: str, strategy: str = "standard") -> DataFrame:
    """doc, words of the documents that have any.

    The explode of a one-element array keeps Spark from splitting each text again for every use of ``words``.
    """
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.array(tokens(F.col(text_col), strategy))).alias("words")).where(F.size("words") > 0)


def corpus_stats(words: DataFrame) -> DataFrame:
    """One row: documents and their average length. Joined to others it only adds two columns, whatever their size."""
    return words.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avg_len"))


def term_stats(words: DataFrame) -> DataFrame:
    """term, df over all documents."""
    return words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int = 10, k1: float = 1.5, b: float = 0.75, idf: str = "plus_one") -> DataFrame:
    """query, doc, score, rank: the k best documents of each query with a positive score.

    idf: plus_one is ln((N - df + .5) / (df + .5) + 1); okapi leaves out the 1 and replaces negative values by a quarter
    of the mean over all terms. Query terms count as often as they occur.
    """
    words = tokenised(docs, id_col, text_col)
    q = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    stats = corpus_stats(words)
    wanted = when_small(q.select("term").distinct(), 100_000)
    postings = (
        words.select("doc", F.size("words").alias("len"), F.explode("words").alias("term"))
        .join(wanted, "term", "left_semi").groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))
    )
    log_odds = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + (1 if idf == "plus_one" else 0))
    if idf == "plus_one":
        weights = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats).select("term", "avg_len", log_odds.alias("idf"))
    else:
        every = term_stats(words).crossJoin(stats).select("term", "avg_len", log_odds.alias("raw"))
        mean = every.agg(F.avg("raw").alias("mean"))
        weights = every.join(wanted, "term", "left_semi").crossJoin(mean).select("term", "avg_len", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    scored = (
        postings.join(weights, "term").select("term", "doc", (F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("s"))
        .join(q, "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("s") * F.col("qtf")), 6).alias("score"))
    )
    return top_k(scored, k).where("score > 0")


def top_k(scored: DataFrame, k: int, group: str = "query", score: str = "score", tie: str = "doc", descending: bool = True) -> DataFrame:
    """Adds rank (1..k) within each group; Spark limits each partition's groups before the shuffle."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, tie)).cast("long")).where(F.col("rank") <= k)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes in place of those of the same key; of repeated keys in changes one row, the largest, stays."""
    cols = base.columns
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in cols if c != key])
    latest = changes.select(*cols).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return base.join(latest.select(key), key, "left_anti").select(*cols).unionByName(latest)


def remove(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def l2_normalize(v):
    """A vector (array column) divided by its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Scores held at once while vectors are compared with a block of queries.
_CELLS = 4_000_000


def vector_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, query_id: str, query_vec: str, k: int = 10, metric: str = "ip") -> DataFrame:
    """query, doc, score, rank by exact search: inner product (largest first) or l2 (squared distance, least first).

    The stated query set is compared with all vectors in one pass per partition: every Arrow batch of vectors is multiplied
    with the matrix of queries and keeps its k best per query, so what is shuffled is k rows per query and batch. The
    queries are broadcast as a matrix, in blocks of bounded size.
    """
    sc = vectors.sparkSession.sparkContext
    block = 10_000
    qs = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v")).where(F.col("v").isNotNull())
    total = qs.count()
    parts = -(-total // block) or 1
    out = None
    for n in range(parts):
        rows = (qs if parts == 1 else qs.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == n)).orderBy("q").collect()
        sent = sc.broadcast(([r.q for r in rows], [list(r.v) for r in rows]))

        def run(batches, sent=sent):
            import numpy as np
            import pyarrow as pa

            ids, vecs = sent.value
            if not ids:
                return
            m = np.asarray(vecs, np.float64)
            for b in batches:
                if not b.num_rows:
                    continue
                rows = max(64, _CELLS // len(ids))
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    docs = part.column(0).to_numpy(zero_copy_only=False)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(docs), -1)
                    s = m @ x.T if metric == "ip" else (m * m).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (m @ x.T)
                    s = np.round(s, 6) + 0.0
                    rank = -s if metric == "ip" else s
                    keep = min(k, len(docs))
                    # All that are as good as the k-th, ties included; the order among them is made where all meet.
                    q, d = np.nonzero(rank <= np.partition(rank, keep - 1, axis=1)[:, keep - 1 : keep])
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids)[q]), pa.array(docs[d]), pa.array(s[q, d])], names=["query", "doc", "score"])

        base = vectors.select(F.col(id_col).cast("long").alias("doc"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull())
        d = base.mapInArrow(run, "query long, doc long, score double")
        out = d if out is None else out.unionByName(d)
    return top_k(out, k, descending=metric == "ip")


def fuse(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 0.5, sparse_weight: float = 0.5, normalize: str | None = None) -> DataFrame:
    """query, doc, dense_score, bm25_score, score, rank: full outer join of two hit lists, what is missing counts 0.

    normalize: None keeps the scores as they are; min_max brings each list of a query to [0, 1] first.
    """
    def prepared(d: DataFrame, name: str) -> DataFrame:
        d = d.select("query", "doc", F.col("score").alias(name))
        if normalize == "min_max":
            w = Window.partitionBy("query")
            low, high = F.min(name).over(w), F.max(name).over(w)
            d = d.withColumn(name, F.coalesce(F.try_divide(F.col(name) - low, high - low), F.lit(1.0)))
        return d

    both = prepared(dense, "dense_score").join(prepared(sparse, "bm25_score"), ["query", "doc"], "full_outer").na.fill(0.0, ["dense_score", "bm25_score"])
    return top_k(both.withColumn("score", F.round(F.col("dense_score") * dense_weight + F.col("bm25_score") * sparse_weight, 9)), k)


def search_query_text(parts: list) -> object:
    """Array and string columns of a structured job description as one query text."""
    return F.concat_ws(" ", *parts)


def labelled_query_text(parts: dict) -> object:
    """``Label: a, b | Label: c`` of the parts that hold anything."""
    return F.concat_ws(" | ", *[F.when(F.length(F.array_join(c, ", ")) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "))) for label, c in parts.items()])
