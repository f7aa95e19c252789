"""Rejected records, nested records and intervals: edge cases and brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import intervals, nested, rejects

LINES = "raw_id long, kind string, line string, batch_id string, reason string, fields string"
OK = 'CAND_0000001,A B,"head, line","Town, X",3.5,Dev,2020-01-01,"[{""name"": ""SQL""}]"'


def reasons(spark, lines, kind="candidate"):
    d = spark.createDataFrame([(i, kind, x, "b", "r", "f") for i, x in enumerate(lines)], LINES)
    return {r.raw_id: r.reason for r in rejects.parse_records(d).collect()}


def test_records_by_reason(spark):
    lines = [
        OK, None, "", " \t  ", OK.replace("A B", '5" desk'), OK.replace("A B", '"A B" end'), OK.replace("A B", ' "A B"'), OK.replace("A B", '"A B" '), OK.replace("A B", '"A B'), OK + ",x", "CAND_0000001,x",
        OK.replace("CAND_0000001", " CAND_0000001 "), OK.replace("CAND_0000001", "CAND_00001"), OK.replace("CAND_0000001", "CAND_١٢٣٤٥٦٧"), OK.replace("head, line", "two\nlines"), OK.replace("head, line", "two\r\n\r\nlines"), OK + "\r\n", OK.replace("[{", "{broken"),
    ]
    q, c, i = "quoting", "columns", "candidate_id"
    want = [None, "-", "-", "-", q, q, q, q, q, c, c, None, i, i, None, None, None, None]
    assert reasons(spark, lines) == {k: v for k, v in enumerate(want) if v != "-"}


def test_record_counts(spark):
    values = {"5": 1, " 7 ": 1, "000012": 1, "2147483647": 1, "2147483648": 0, "99999999999999999999": 0, "+5": 0, "-1": 0, "1.0": 0, "1e3": 0, "": 0, "12O": 0, "١": 0, "1 000": 0, '"8"': 1, "0": 1}
    got = reasons(spark, [f"src,fp,{v},csv,2024-01-01T00:00:00" for v in values], "manifest")
    assert got == {k: None if ok else "record_count" for k, ok in enumerate(values.values())}


def test_broken_neighbours_do_not_matter(spark):
    rng = random.Random(5)
    lines = [OK, OK.replace("A B", '"A B'), OK.replace("A B", 'x"y'), OK.replace("A B", '"a"b"c"'), '"', '""', '","', OK + '"'] * 20
    alone = {x: reasons(spark, [x])[0] for x in set(lines)}
    rng.shuffle(lines)
    assert reasons(spark, lines) == {k: alone[x] for k, x in enumerate(lines)}


def test_records_empty_and_unknown_and_long(spark):
    assert reasons(spark, []) == {}
    assert reasons(spark, [OK], "other") == {0: "kind"}
    assert reasons(spark, [OK.replace("A B", "x" * 3_000_000), OK]) == {0: None, 1: None}


def test_records_beyond_the_reader(spark, monkeypatch):
    import tempfile

    wide = ",".join(["x"] * 5000)
    with tempfile.TemporaryDirectory() as folder:
        r = rejects._Reader(folder)
        kinds = (rejects.CANDIDATE, rejects.MANIFEST)
        assert [g[0] for g in rejects.judge([("candidate", wide), ("candidate", wide + 'x"'), ("candidate", OK)], kinds, r)] == ["columns", "quoting", None]
        monkeypatch.setattr(r, "_read", lambda *a: (_ for _ in ()).throw(r.error("no memory")))
        got = rejects.judge([("candidate", OK), ("candidate", OK + ",x"), ("candidate", OK.replace("A B", 'x"')), ("candidate", None)], kinds, r)
    assert [g and g[0] for g in got] == [None, "columns", "quoting", None] and got[0][2][2] == "head, line"


def test_reasons_come_from_the_reader(spark):
    import tempfile

    class Silent(rejects._Reader):
        def read(self, *a):
            return {}, {}

    lines = [("candidate", OK), ("candidate", OK + ",x"), ("manifest", "s,f,x,csv,d"), ("manifest", "s,f,5,csv,d"), ("manifest", "s,f,+5,csv,d"), ("candidate", OK.replace("A B", 'x"'))]
    kinds = (rejects.CANDIDATE, rejects.MANIFEST)
    with tempfile.TemporaryDirectory() as folder:
        assert {g[0] for g in rejects.judge(lines, kinds, Silent(folder))} == {"quoting"}  # nothing loads without it
        got = rejects.judge(lines, kinds, rejects._Reader(folder))
    assert [g[:2] for g in got] == [(None, None), ("columns", "TOO MANY COLUMNS"), ("record_count", "CAST"), (None, None), ("record_count", "PATTERN"), ("quoting", "ROUND TRIP")]


def test_records_against_the_grammar():
    import re
    import tempfile

    field = r'(?:"(?:[^"]|"")*"|[^",]*)'
    well = re.compile(rf"(?s){field}(?:,{field})*")
    rng = random.Random(4)
    lines = ["".join(rng.choice(['"', '"', ",", "a", " ", "5", '""', "\n", "\uf8ff"]) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    lines += [",".join(rng.choice(['"a"', "b", '""', "", '"x,""y"', "7", " 7 ", '"a" ', '\'"\'']) for _ in range(5)) for _ in range(2000)]
    with tempfile.TemporaryDirectory() as folder:
        got = rejects.judge([("manifest", x) for x in lines], (rejects.MANIFEST,), rejects._Reader(folder))
    for line, g in zip(lines, got, strict=True):
        x = line.rstrip("\r\n")
        if not line.strip():
            assert g is None
        elif not well.fullmatch(x):
            assert g[0] == "quoting", x
        else:
            parts = [p[1:-1].replace('""', '"') if p[:1] == '"' else p for p in re.findall(rf"(?s),({field})", "," + x)]
            v = parts[2].strip() if len(parts) == 5 else ""
            assert g[0] == ("columns" if len(parts) != 5 else None if re.fullmatch("[0-9]+", v) else "record_count"), x
            if g[0] is None:
                assert g[2] == [p.strip() for p in parts]


def test_records_typed(spark):
    d = spark.createDataFrame([(1, "candidate", OK, "b", "r", "f"), (1, "candidate", OK, "b", "r", "f")], LINES)
    rows = rejects.loaded(rejects.parse_records(d), rejects.CANDIDATE).collect()
    assert len(rows) == 2 and rows[0].headline == "head, line" and rows[0].years_of_experience == 3.5 and rows[0].signup_date == dt.date(2020, 1, 1)


NEST = "id long, pos string, a struct<x:int,pos:int,inner:array<struct<v:string,m:map<string,int>>>>, tags array<string>"


def test_nested_tables_and_links(spark):
    rows = [
        (1, "p", (1, 7, [("a", {"k": 1, "l": None}), None, (None, None)]), ["t", None]),
        (2, None, (None, None, None), []), (3, None, None, None), (1, "p", (1, 7, []), None),
    ]
    d = spark.createDataFrame(rows, NEST)
    tables = nested.flatten(d, "id")
    assert set(tables) == {"root", "a", "a_inner", "a_inner_m", "tags"}
    assert tables["root"].columns == ["root_key", "pos_value"] and tables["a"].columns[-2:] == ["x", "pos_value"]
    assert sorted((r.root_key, r.x) for r in tables["a"].collect() if r.x) == [(1, 1), (1, 1)] and tables["a"].count() == 3
    inner = sorted((r.root_key, r.pos, r.v or "", r.self_key) for r in tables["a_inner"].collect())
    assert inner == [(1, 1, "a", "1/a/0/inner/1"), (1, 3, "", "1/a/0/inner/3")]
    assert sorted((r.parent_key, r.child_key, r.value) for r in tables["a_inner_m"].collect())[0] == ("1/a/0/inner/1", "k", 1)
    assert [(r.pos, r.value) for r in tables["tags"].collect()] == [(1, "t")]
    links = nested.object_links(d, "id", ["a", "inner", "m"])
    assert sorted((r.id, r.child, r.pos, r.child_key) for r in links.collect()) == [(1, "a", 0, ""), (1, "a", 0, ""), (1, "inner", 1, ""), (1, "inner", 3, ""), (1, "m", 0, "k"), (1, "m", 0, "l"), (2, "a", 0, "")]
    assert {r.parent_key for r in links.where("child = 'm'").collect()} == {"1/a/0/inner/1"}
    assert nested.object_links(d.limit(0), "id").count() == 0 and nested.object_links(d.select("id"), "id").count() == 0


def test_arrays_of_arrays_and_structs_in_maps(spark):
    d = spark.createDataFrame([(1, [[1, 2], None, [3]], {"k": (7, [("x",), None]), "l": None}, [{"a": 1}])], "id long, grid array<array<int>>, by map<string,struct<n:int,deep:array<struct<v:string>>>>, maps array<map<string,int>>")
    t = nested.flatten(d, "id")
    assert set(t) == {"root", "grid", "grid_element", "by", "by_deep", "maps", "maps_element"}
    assert sorted((r.parent_key, r.pos, r.value) for r in t["grid_element"].collect()) == [("1/grid/1", 1, 1), ("1/grid/1", 2, 2), ("1/grid/3", 1, 3)]
    assert sorted((r.child_key, r.n) for r in t["by"].collect() if r.n) == [("k", 7)] and [(r.parent_key, r.pos, r.v) for r in t["by_deep"].collect()] == [("1/by/k", 1, "x")]
    assert [(r.parent_key, r.child_key, r.value) for r in t["maps_element"].collect()] == [("1/maps/1", "a", 1)]
    parents = {r.self_key for x in t.values() if "self_key" in x.columns for r in x.collect()} | {"1"}
    assert all(r.parent_key in parents for x in t.values() if "parent_key" in x.columns for r in x.collect())


def test_merged_schemas(spark):
    a = spark.createDataFrame([(1, (1, "x"))], "id int, s struct<a:int,b:string>")
    b = spark.createDataFrame([(2, (2.5, [1]), "new")], "id long, s struct<a:double,c:array<int>>, extra string")
    d = nested.union_merged([a, b])
    assert d.schema["id"].dataType == T.LongType() and {f.name for f in d.schema["s"].dataType.fields} == {"a", "b", "c"}
    assert sorted((r.id, r.s.a, r.extra) for r in d.collect()) == [(1, 1.0, None), (2, 2.5, "new")]


def brute(rows):
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and (t is None or t >= s):
            by.setdefault(e, []).append((s.date(), t.date() if t else dt.date.max))
    out = set()
    for e, iv in by.items():
        merged = []
        for s, t in sorted(iv):
            if merged and (merged[-1][1] == dt.date.max or s <= merged[-1][1] + dt.timedelta(1)):
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        for k, (s, t) in enumerate(merged):
            out.add((e, "period", str(s), "open" if t == dt.date.max else str(t)))
            if k:
                out.add((e, "gap", str(merged[k - 1][1] + dt.timedelta(1)), str(s - dt.timedelta(1))))
    return out


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(900), hours=rng.randrange(24))
    rows = []
    for _ in range(600):
        s = day() if rng.random() > 0.05 else None
        t = None if rng.random() < 0.03 else (s or day()) + dt.timedelta(days=rng.randrange(-3, 25), hours=rng.randrange(-5, 5))
        rows.append((rng.choice(["hot"] * 6 + ["a", "b", "c", None]), s, t))
    rows += rows[:40]
    d = spark.createDataFrame(rows, "entity string, start_date timestamp, end_date timestamp").withColumn("kind", F.lit("x")).withColumn("s", F.lit(1))
    for n in (1, 3, 11):
        got = [tuple(r) for r in intervals.periods_and_gaps(d, "entity", "start_date", "end_date", partitions=n).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_intervals_empty_and_nested(spark):
    d = spark.createDataFrame([], "e string, a timestamp, b timestamp")
    assert intervals.periods_and_gaps(d, "e", "a", "b").count() == 0
    t = lambda m, x: dt.datetime(2021, m, x)
    d = spark.createDataFrame([("x", t(1, 1), t(12, 1)), ("x", t(2, 1), t(3, 1)), ("x", t(12, 2), t(12, 5)), ("x", t(12, 7), None)], "e string, a timestamp, b timestamp")
    got = sorted(tuple(r) for r in intervals.periods_and_gaps(d, "e", "a", "b").collect())
    assert got == [("x", "gap", "2021-12-06", "2021-12-06"), ("x", "period", "2021-01-01", "2021-12-05"), ("x", "period", "2021-12-07", "open")]
