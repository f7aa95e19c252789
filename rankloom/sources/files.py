"""Readers: CSV with JSON cells, JSON, JSON lines, Parquet; text, DOCX and configuration; fingerprinted caches.

Every read uses a fixed schema: nothing is inferred in production reads. Records that don't parse come out beside the
good ones. Formats are told by the extension, .gz included.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import strip

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet"}
CORRUPT = "_corrupt_record"


class UnsupportedFormat(ValueError):
    pass


class EmptyDataset(ValueError):
    pass


def detect_format(path: str) -> str:
    name = path.rstrip("/").lower()
    name = name[:-3] if name.endswith(".gz") else name
    ext = os.path.splitext(name)[1]
    if ext not in FORMATS:
        raise UnsupportedFormat(f"no reader for {ext or path!r}; known: {', '.join(FORMATS)}")
    return FORMATS[ext]


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cells of nested columns are JSON; empty cells are null; a cell that should be JSON but isn't gives null."""
    flat = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(flat).csv(path, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False)

    def cell(f: T.StructField):
        c = F.nullif(strip(F.col(f"`{f.name}`")), F.lit(""))
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.when(c.rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull(), F.from_json(c, f.dataType)).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return raw.select(*[cell(f) for f in schema.fields], CORRUPT)


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file with an array of objects, one object, or an object whose ``records`` are the objects; other items are left out."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), "value")
    kind = F.schema_of_variant("v")
    wrapped = F.when(kind.startswith("OBJECT<") & F.try_variant_get("v", "$.records", "array<variant>").isNotNull(), F.try_variant_get("v", "$.records", "array<variant>"))
    items = F.coalesce(wrapped, F.when(kind.startswith("ARRAY<"), F.try_variant_get("v", "$", "array<variant>")), F.array("v"))
    rows = text.where("v IS NOT NULL").select(F.explode(items).alias("r")).where(F.schema_of_variant("r").startswith("OBJECT<"))
    good = rows.select(F.from_json(F.to_json("r"), schema).alias("r")).select("r.*").withColumn(CORRUPT, F.lit(None).cast("string"))
    bad = text.where("v IS NULL").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.col("value").alias(CORRUPT))
    return good.unionByName(bad)


def _jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are no rows; lines that aren't objects of the schema don't parse."""
    s = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    parsed = lines.select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    # An array is no object, even if the parser would take its first element.
    bad = F.when(F.ltrim("value").startswith("{"), F.col("r")[CORRUPT]).otherwise(F.col("value"))
    return parsed.select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], bad.alias(CORRUPT))


def load(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows that don't parse as ``_corrupt_record``). fmt overrides the extension. Parquet has no bad rows."""
    fmt = fmt or detect_format(path)
    if fmt == "parquet":
        d = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        return d, spark.createDataFrame([], f"{CORRUPT} string")
    if schema is None:
        raise ValueError(f"{fmt} needs a schema")
    if fmt not in ("csv", "json", "jsonl"):
        raise UnsupportedFormat(fmt)
    d = {"csv": _csv, "json": _json, "jsonl": _jsonl}[fmt](spark, path, schema)
    bad = F.col(CORRUPT).isNotNull()
    return d.where(~bad).drop(CORRUPT), d.where(bad).select(CORRUPT)


def load_nonempty(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    good, _ = load(spark, path, schema, fmt)
    if good.isEmpty():
        raise EmptyDataset(path)
    return good


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, text of DOCX files: paragraphs, then the rows of tables with cells joined by ' | '."""

    def run(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        text_of = lambda e: "".join(t.text or "" for t in e.iter(ns + "t"))
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        body = ElementTree.fromstring(z.read("word/document.xml")).find(ns + "body")
                    lines = [text_of(p) for p in body.findall(ns + "p")]
                    lines += [" | ".join(text_of(c).strip() for c in row.iter(ns + "tc")) for t in body.findall(ns + "tbl") for row in t.iter(ns + "tr")]
                    out.append("\n".join(lines))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "text": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def fingerprint(path: str) -> str:
    """Of a local file's path, size and time of change."""
    s = os.stat(path)
    return hashlib.sha256(f"{os.path.abspath(path)}:{s.st_size}:{s.st_mtime_ns}".encode()).hexdigest()


def cached(spark: SparkSession, path: str, cache_dir: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """The good rows of a source, kept as Parquet with a note of the source's fingerprint; a changed source is read again."""
    note = os.path.join(cache_dir, "cache.json")
    now = fingerprint(path)
    if os.path.exists(note):
        with open(note, encoding="utf-8") as f:
            if json.load(f).get("fingerprint") == now:
                return spark.read.parquet(os.path.join(cache_dir, "rows"))
    good, _ = load(spark, path, schema, fmt)
    good.write.mode("overwrite").parquet(os.path.join(cache_dir, "rows"))
    kept = spark.read.parquet(os.path.join(cache_dir, "rows"))
    from rankloom.sources.sinks import write_atomic

    write_atomic(note, json.dumps({"source": path, "fingerprint": now, "record_count": kept.count(), "format": fmt or detect_format(path)}))
    return kept


def clear_cache(cache_dir: str) -> None:
    import shutil

    shutil.rmtree(cache_dir, ignore_errors=True)


@dataclass(frozen=True)
class RetrievalConfig:
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 10
    metric: str = "ip"
    idf: str = "plus_one"


@dataclass(frozen=True)
class RankingConfig:
    dense_weight: float = 0.5
    bm25_weight: float = 0.5
    previous_weight: float = 0.5
    recruiter_weight: float = 0.5
    keep: int = 100
    normalize: str | None = None


@dataclass(frozen=True)
class Config:
    """Explicit argument before file before default."""

    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    ranking: RankingConfig = field(default_factory=RankingConfig)


def load_config(path: str | None = None, **overrides: dict[str, Any]) -> Config:
    """From a JSON file, or a YAML one where PyYAML is installed; unknown keys raise ValueError."""
    data: dict[str, Any] = {}
    if path:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise UnsupportedFormat("YAML needs PyYAML") from e
                data = yaml.safe_load(f) or {}
            else:
                data = json.load(f)
    config = Config()
    for section in {*data, *overrides}:
        if section not in {f.name for f in fields(Config)}:
            raise ValueError(f"unknown section {section}")
        part = getattr(config, section)
        values = {**data.get(section, {}), **overrides.get(section, {})}
        if unknown := values.keys() - {f.name for f in fields(part)}:
            raise ValueError(f"unknown keys in {section}: {sorted(unknown)}")
        config = replace(config, **{section: replace(part, **values)})
    return config


def load_template(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
