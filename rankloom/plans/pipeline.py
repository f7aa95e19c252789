"""The stages as one dataflow: load, profiles, job descriptions, hybrid retrieval, features, ranking, re-ranking by a
model's verdicts, evidence, explanations, evaluation, export.

Stages are functions from a state to lazy DataFrames; Catalyst plans across them, and one action at the sink runs them.
Each stage names the frames it needs and those of its results that must have rows: the run ends with an error row where
one is missing or empty. Each stage leaves an audit row; an exception is recorded and raised again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import features as feats
from rankloom.functions import hooks, jobs, text
from rankloom.functions.text import strip
from rankloom.operators import explain, export, metrics, ranking, retrieval
from rankloom.operators.profiles import build_profiles
from rankloom.operators.records import keep_first, split_valid
from rankloom.session import checkpoint
from rankloom.sources.files import Config


@dataclass
class State:
    """What the stages share: named DataFrames, and logs that only grow."""

    spark: SparkSession
    config: Config = field(default_factory=Config)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    audit: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    #: A model's reply to a prompt (see hooks.generator), and its vector of a text; without one, verdicts are left out
    #: and texts are hashed.
    reply: Callable[[Column], Column] | None = None
    encode: Callable[[Column], Column] = hooks.hash_encoder

    @contextmanager
    def stage(self, name: str):
        began = time.time()
        row = {"node_name": name, "started_at": began, "status": "completed"}
        try:
            yield
        except Exception as e:
            row["status"] = "failed"
            self.errors.append({"node_name": name, "error": type(e).__name__, "message": str(e)[:500]})
            raise
        finally:
            row |= {"completed_at": time.time(), "duration_ms": round((time.time() - began) * 1000, 2)}
            self.audit.append(row)

    def audit_frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.audit, "node_name string, started_at double, completed_at double, duration_ms double, status string")


Stage = Callable[[State], None]
STAGES: dict[str, Stage] = {}
#: Frames a stage needs, and those it makes that must have rows for the run to go on.
NEEDS: dict[str, tuple[str, ...]] = {}
FILLS: dict[str, tuple[str, ...]] = {}


def stage(name: str, needs: tuple[str, ...] = (), fills: tuple[str, ...] = ()) -> Callable[[Stage], Stage]:
    def keep(f: Stage) -> Stage:
        STAGES[name], NEEDS[name], FILLS[name] = f, needs, fills
        return f

    return keep


@stage("load", ("candidates", "queries"), ("valid",))
def load(s: State) -> None:
    """Valid rows, first of each id; the others go to ``rejected``."""
    good, bad = split_valid(s.frames["candidates"].withColumn("candidate_id", strip(F.col("candidate_id"))), "candidate_id", strict=True)
    s.frames["valid"] = keep_first(good, "candidate_id", ["ingested_at", "row_id"])
    s.frames["rejected"] = bad


@stage("profiles", ("valid",))
def profiles(s: State) -> None:
    # Three stages read the profiles: they are built once, and the plans behind them stay small.
    s.frames["profiles"] = checkpoint(build_profiles(s.frames["valid"]))


@stage("parse", ("queries",))
def parse(s: State) -> None:
    """Job descriptions: query, text, title, required years and required terms."""
    q = s.frames["queries"].select(F.col("query").cast("long").alias("query"), "text")
    lines = F.filter(F.split(F.col("text"), r"\n"), lambda x: F.trim(x) != "")
    d = q.select("query", "text", F.coalesce(F.trim(F.try_element_at(lines, F.lit(1))), F.lit("")).alias("title"), F.coalesce(jobs.min_years(F.col("text")), F.lit(0)).cast("int").alias("required_years"), F.array_distinct(text.tokens(F.col("text"))).alias("required"))
    s.frames["jobs"] = checkpoint(d)


@stage("retrieve", ("profiles", "jobs"), ("hits",))
def retrieve(s: State) -> None:
    """The best by words and by vectors, fused."""
    c, r = s.config.retrieval, s.config.ranking
    p, q = s.frames["profiles"], s.frames["jobs"]
    sparse = retrieval.bm25(p, q, "candidate_id", "search_text", "query", "text", c.top_k, c.k1, c.b, c.idf)
    # Vectors are searched by number: ids are numbered once, in a written table.
    numbered = checkpoint(checkpoint(p.select("candidate_id", "search_text")).withColumn("n", F.monotonically_increasing_id()))
    vectors = numbered.select("n", s.encode(F.col("search_text")).alias("v"))
    dense = retrieval.vector_top_k(vectors, q.select("query", s.encode(F.col("text")).alias("qv")), "n", "v", "query", "qv", c.top_k, c.metric)
    dense = dense.withColumnRenamed("doc", "n").join(numbered.select("n", F.col("candidate_id").alias("doc")), "n").select("query", "doc", "score")
    fused = retrieval.fuse(dense, sparse.select("query", "doc", "score"), c.top_k, r.dense_weight, r.bm25_weight, r.normalize or "min_max")
    s.frames["hits"] = checkpoint(fused.withColumnRenamed("doc", "candidate_id"))


@stage("features", ("hits", "profiles", "jobs", "valid"))
def features(s: State) -> None:
    """Match features of every hit."""
    people = s.frames["valid"].select("candidate_id", F.transform("skills", lambda k: F.lower(k["name"])).alias("skills"))
    p = s.frames["profiles"].select("candidate_id", F.col("current_role").alias("role"), F.col("years_experience").alias("y"), "search_text")
    d = s.frames["hits"].select("query", "candidate_id").join(s.frames["jobs"], "query").join(people, "candidate_id").join(p, "candidate_id")
    none = F.array().cast("array<string>")
    held = F.array_compact(F.coalesce("skills", none))
    words = F.array_distinct(F.flatten(F.transform(held, lambda x: F.split(x, " "))))
    jd = F.struct("title", "required_years", "required", F.col("text").alias("description"))
    cand = F.struct(F.coalesce("role", F.lit("")).alias("title"), F.coalesce("y", F.lit(0.0)).alias("years"), F.array_union(held, words).alias("skills"), F.coalesce("search_text", F.lit("")).alias("summary"))
    d = feats.feature_vector(d.select("query", "candidate_id", jd.alias("jd"), cand.alias("cand")))
    s.frames["features"] = feats.with_metadata(d.select("query", "candidate_id", "raw", "normalized", F.col("cand.years").alias("years"), F.col("jd.required_years").alias("required_years")))


@stage("rank", ("hits", "features", "profiles"), ("ranked",))
def rank(s: State) -> None:
    """Fused scores blended with the match features and how complete the profile is, ordered."""
    c = s.config.ranking
    n = F.col("normalized")
    match = n["required_skill_coverage"] * 0.4 + n["experience_match"] * 0.2 + n["keyword_similarity"] * 0.2 + F.coalesce("profile_completeness", F.lit(0.0)) * 0.2
    d = s.frames["hits"].select("query", "candidate_id", F.col("score").alias("fused")).join(s.frames["features"], ["query", "candidate_id"]).join(s.frames["profiles"].select("candidate_id", "profile_completeness"), "candidate_id")
    score = ranking.blend(F.least(F.col("fused"), F.lit(1.0)), match, c.previous_weight, c.recruiter_weight)
    s.frames["ranked"] = checkpoint(retrieval.top_k(d.select("query", "candidate_id", score.alias("score")), c.keep, tie="candidate_id"))


@stage("rerank", ("ranked", "features", "jobs"))
def rerank(s: State) -> None:
    """A model's verdicts blended in and ordered again; without a model, or where it fails for all, the order stays."""
    none = F.lit(None).cast("double")
    if s.reply is None:
        s.frames["reranked"] = s.frames["ranked"].withColumn("hiring_confidence", none)
        return
    c = s.config.ranking
    d = s.frames["ranked"].join(s.frames["features"].select("query", "candidate_id", "raw"), ["query", "candidate_id"]).join(s.frames["jobs"].select("query", "title"), "query")
    ask = ranking.prompt("Judge the candidate for $job by $features; reply with a JSON verdict.", job=F.struct("title"), features=F.struct("raw"))
    d = checkpoint(d.withColumn("verdict", ranking.verdict_or_default(s.reply(ask))))
    score = ranking.blend(F.col("score"), F.col("verdict.recruiter_score"), c.previous_weight, c.recruiter_weight)
    again = retrieval.top_k(d.select("query", "candidate_id", score.alias("score")), c.keep, tie="candidate_id")
    s.frames["reranked"] = again.join(d.select("query", "candidate_id", F.col("verdict.confidence").alias("hiring_confidence")), ["query", "candidate_id"])


@stage("explain", ("reranked", "features", "valid", "jobs"))
def explaining(s: State) -> None:
    """Evidence and rule-based explanations of the ranked."""
    f = s.frames["features"].select("query", "candidate_id", F.col("raw.matched_skills").alias("matched"), F.col("raw.missing_skills").alias("missing"), "years", "required_years")
    v = s.frames["valid"]
    titles = F.filter(F.transform("career_history", lambda j: j["title"]), lambda t: F.lower(t).rlike(explain.LEADERSHIP))
    degrees = F.filter(F.transform("education", lambda e: e["degree"]), lambda x: x.isNotNull())
    recent = F.size(F.filter("career_history", lambda j: F.months_between(F.current_date(), j["start_date"].try_cast("date")) <= 60))
    people = v.select(
        "candidate_id", F.coalesce("profile.anonymized_name", "candidate_id").alias("name"), (F.col("redrob_signals.profile_completeness_score") / 100.0).alias("activity"), recent.alias("recent_jobs"),
        F.lit(None).cast("int").alias("gap_days"), degrees.alias("education"), F.array().cast("array<string>").alias("projects"), titles.alias("leadership"),
    )
    s.frames["evidence"] = explain.evidence(s.frames["reranked"], f, people, ["query", "candidate_id"]).join(s.frames["jobs"].select("query", "title"), "query")
    s.frames["explanations"] = explain.build(s.frames["evidence"], F.col("name"), F.col("title"), F.lit("N/A"))


@stage("evaluate", ("reranked",))
def evaluating(s: State) -> None:
    """Metrics against the frame ``truth`` (query, doc), where one was given."""
    if "truth" in s.frames:
        ranked = s.frames["reranked"].select("query", F.col("candidate_id").alias("doc"), "rank")
        s.frames["metrics"] = metrics.evaluate(ranked, s.frames["truth"], s.config.retrieval.top_k)


@stage("export", ("reranked", "explanations"))
def export_rows(s: State) -> None:
    # One submission per query; ranks restart with each, so a submission file is made of one of them.
    e = s.frames["explanations"].select("query", "candidate_id", "reasoning")
    d = s.frames["reranked"].select("query", "candidate_id", "rank", "score").join(e, ["query", "candidate_id"], "left")
    s.frames["submission"] = d.select("candidate_id", "rank", "score", F.coalesce(F.nullif(F.trim("reasoning"), F.lit("")), F.lit(export.NO_EXPLANATION)).alias("reasoning"))


def run(spark: SparkSession, candidates: DataFrame, queries: DataFrame, config: Config | None = None, stages: list[str] | None = None, **more) -> State:
    """Runs the stages in order; queries: query, text. Ends early, with an error row, where a stage's frames are missing or empty.

    more: reply and encode (see State), and truth (query, doc) to evaluate against.
    """
    truth = more.pop("truth", None)
    s = State(spark, config or Config(), {"candidates": candidates, "queries": queries} | ({} if truth is None else {"truth": truth}), **more)
    for name in stages or list(STAGES):
        if missing := [f for f in NEEDS[name] if f not in s.frames]:
            s.errors.append({"node_name": name, "error": "MissingFrame", "message": ", ".join(missing)})
            break
        with s.stage(name):
            STAGES[name](s)
        if empty := [f for f in FILLS[name] if s.frames[f].isEmpty()]:
            s.errors.append({"node_name": name, "error": "EmptyDataset", "message": f"no rows in {', '.join(empty)}"})
            break
    return s


def benchmark(spark: SparkSession, candidates: DataFrame, queries: DataFrame, runs: dict[str, dict], measure: Callable[[State], dict[str, float]]) -> dict[str, dict]:
    """Runs the stages once per named set of configuration overrides; a run that fails is reported and doesn't stop the others."""
    from rankloom.sources.files import load_config

    out: dict[str, dict] = {}
    for name, overrides in runs.items():
        try:
            s = run(spark, candidates, queries, load_config(None, **overrides))
            out[name] = {"metrics": measure(s), "stages": s.audit}
        except Exception as e:  # noqa: BLE001 - isolated by design
            out[name] = {"error": f"{type(e).__name__}: {str(e)[:300]}"}
    return out
