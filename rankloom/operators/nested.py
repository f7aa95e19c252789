"""Nested records as related flat tables (problem 3).

The schema, merged over the deliveries where they differ (``union_merged``), is walked once: structs, arrays and maps, of
anything and to any depth. Each nested place becomes a child table, made by exploding one level after the other, with the
parent's surrogate key and the ordinal within it (``child_table``, ``flatten``; ``object_links`` has the links alone).
Everything is Generate/Project on the JVM: no shuffle, no Python; a child's scan reads the columns of its place only.

Defined results
---------------
* a null struct, array, map or element gives no row; an object whose fields are all null is a row;
* ordinals count from 1 within arrays, null elements included; 0 for structs and map entries;
* an array or map that is itself an element of an array or the value of a map is a place called ``element`` below it;
* surrogate keys are ``<row key>`` for the root and ``<parent>/<name>/<ordinal or map key>`` below,
  so equal input gives equal keys in any partitioning; rows of a repeated root key each appear;
* a payload field named like one of the link columns gets the suffix ``_value``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = ("root_key", "parent_key", "self_key", "pos", "child_key")


@dataclass(frozen=True)
class Place:
    """A nested place of the schema: its path, and whether it is a struct, an array or a map."""

    path: tuple[str, ...]
    form: str
    inner: T.DataType

    @property
    def name(self) -> str:
        return "_".join(self.path)


def merge_schemas(a: T.DataType, b: T.DataType) -> T.DataType:
    """The schema that holds both: missing fields become optional, numbers widen, all else that differs becomes string."""
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        there = {f.name: f for f in b.fields}
        mine = {f.name for f in a.fields}
        return T.StructType([T.StructField(f.name, merge_schemas(f.dataType, there[f.name].dataType) if f.name in there else f.dataType, True) for f in a.fields] + [T.StructField(f.name, f.dataType, True) for f in b.fields if f.name not in mine])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_schemas(a.elementType, b.elementType), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(merge_schemas(a.keyType, b.keyType), merge_schemas(a.valueType, b.valueType), True)
    if a == b:
        return a
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
    return order[max(order.index(a), order.index(b))] if a in order and b in order else T.StringType()


def _aligned(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        mine = {f.name: f.dataType for f in have.fields}
        return F.when(c.isNotNull(), F.struct(*[(_aligned(c[f.name], mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: _aligned(x, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast(want)


def union_merged(dfs: Iterable[DataFrame]) -> DataFrame:
    """Deliveries of differing schema as one DataFrame of the merged schema."""
    dfs = list(dfs)
    schema = reduce(merge_schemas, (d.schema for d in dfs))
    parts = []
    for d in dfs:
        mine = {f.name: f.dataType for f in d.schema.fields}
        parts.append(d.select(*[(_aligned(F.col(f"`{f.name}`"), mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]))
    return reduce(DataFrame.unionByName, parts)


def places(schema: T.StructType, skip: tuple[str, ...] = ()) -> list[Place]:
    """All nested places, outer before inner."""
    out: list[Place] = []

    def add(kind: T.DataType, here: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            out.append(Place(here, "struct", kind))
            within(kind, here)
        elif isinstance(kind, T.ArrayType):
            out.append(Place(here, "array", kind.elementType))
            within(kind.elementType, here)
        elif isinstance(kind, T.MapType):
            out.append(Place(here, "map", kind.valueType))
            within(kind.valueType, here)

    def within(kind: T.DataType, path: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                if path or f.name not in skip:
                    add(f.dataType, (*path, f.name))
        else:
            add(kind, (*path, "element"))

    within(schema, ())
    return out


def _payload(inner: T.DataType) -> list[Column]:
    if not isinstance(inner, T.StructType):
        return [] if isinstance(inner, (T.ArrayType, T.MapType)) else [F.col("_it").alias("value")]
    flat = [f for f in inner.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return [F.col("_it")[f.name].alias(f.name + ("_value" if f.name in LINKS else "")) for f in flat]


def _explode(df: DataFrame, name: str, form: str, field: bool) -> DataFrame:
    """From (root_key, self_key, _it) to the rows of the field ``name`` of ``_it``, or of ``_it`` itself."""
    links = [F.col("root_key"), F.col("self_key").alias("parent_key")]
    c = F.col("_it")[name] if field else F.col("_it")
    if form == "struct":
        d = df.where(c.isNotNull()).select(*links, F.lit(0).cast("long").alias("pos"), F.lit("").alias("child_key"), c.alias("_it"))
    elif form == "array":
        d = df.select(*links, F.posexplode(c).alias("_p", "_it")).where(F.col("_it").isNotNull()).select("root_key", "parent_key", (F.col("_p") + 1).cast("long").alias("pos"), F.lit("").alias("child_key"), "_it")
    else:
        d = df.select(*links, F.explode(c).alias("_k", "_it")).select("root_key", "parent_key", F.lit(0).cast("long").alias("pos"), F.col("_k").cast("string").alias("child_key"), "_it")
    last = F.when(F.lit(form == "map"), F.col("child_key")).otherwise(F.col("pos").cast("string"))
    return d.withColumn("self_key", F.concat_ws("/", "parent_key", F.lit(name), last))


def child_table(df: DataFrame, key: str, path: tuple[str, ...]) -> DataFrame:
    """The flat table of one nested place: link columns, then its scalar fields."""
    by_path = {p.path: p for p in places(df.schema)}
    cur = df.select(F.col(key).alias("root_key"), F.col(key).cast("string").alias("self_key"), F.struct(F.col(f"`{path[0]}`")).alias("_it"))
    inner: T.DataType = df.schema
    for k in range(len(path)):
        place = by_path[path[: k + 1]]
        cur = _explode(cur, path[k], place.form, isinstance(inner, T.StructType))
        inner = place.inner
    return cur.select(*LINKS, *_payload(inner))


def flatten(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """The root table of scalars under ``root`` and one table per nested place, by its path joined with ``_``."""
    flat = [f.name for f in df.schema.fields if f.name != key and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    out = {"root": df.select(F.col(key).alias("root_key"), *[F.col(f"`{n}`").alias(n + ("_value" if n in LINKS else "")) for n in flat])}
    return out | {p.name: child_table(df, key, p.path) for p in places(df.schema, (key,))}


def object_links(df: DataFrame, key: str, wanted: Iterable[str] | None = None) -> DataFrame:
    """The links of every object: key, child (last name of its path), place (whole path), pos, child_key, parent_key and
    self_key, from the child tables of all places, or of those whose last name is wanted."""
    names = None if wanted is None else set(wanted)
    parts = []
    for p in places(df.schema, (key,)):
        if names is None or p.path[-1] in names:
            links = child_table(df, key, p.path).select("root_key", "pos", "child_key", "parent_key", "self_key")
            parts.append(links.select(F.col("root_key").alias(key), F.lit(p.path[-1]).alias("child"), F.lit(p.name).alias("place"), "pos", "child_key", "parent_key", "self_key"))
    if not parts:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, child string, place string, pos long, child_key string, parent_key string, self_key string")
    return reduce(DataFrame.unionByName, parts)
