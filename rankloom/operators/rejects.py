"""Delimited records that fail to parse (problem 1).

Each arriving record is one string. On the workers, the records of each kind in an Arrow batch are written as a
delimited file, each on one physical line behind its number, and read by DuckDB with reject tables: the field with a
largest value as INTEGER, all others as text. The line-level errors are joined to the records by that number. A record
loads if the reader gave its fields, if these, written out again, are the record, and if the checked field is valid.
What the reader rejects, or reads otherwise than it is written (it keeps a stray quote and skips blanks before an
enclosing one), is read once more as text padded to its width, which tells broken quoting from a wrong number of
fields or a bad value. Every field and every reason comes from what the reader returns. No shuffle: one narrow pass.

Defined results
---------------
* null, empty and white-space-only lines give no row, neither loaded nor rejected;
* repeated and late records are each judged on their own;
* a record of an unknown (or null) kind gives reason ``kind``;
* line breaks and NUL inside a record are carried through DuckDB as private-use characters that do not occur in the
  batch, and restored in the values; the null string is such a character too, so no value is taken for null;
* a record with an odd number of quotes, and one swallowed by a broken neighbour, is read in a file of its own, so the
  outcome of a record never depends on its neighbours;
* a record beyond the reader (its memory, or more than WIDEST fields) is split by the same grammar without it.

reader_error is the reader's error type; ``ROUND TRIP`` where it took a faulty record, ``PATTERN`` where only the form
of a value is wrong.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields beyond which a record isn't given to the reader.
WIDEST = 4096
_FIELD = re.compile(r',("(?:[^"]|"")*"|[^",]*)')


@dataclass(frozen=True)
class Kind:
    """Fields of one kind of record, and the field to check with the pattern and the largest value it may have."""

    name: str
    fields: tuple[str, ...]
    checked: str
    reason: str
    pattern: str
    at_most: int | None = None


CANDIDATE = Kind("candidate", ("candidate_id", "anonymized_name", "headline", "location", "years_of_experience", "current_title", "signup_date", "skills"), "candidate_id", "candidate_id", r"CAND_[0-9]{7}")
MANIFEST = Kind("manifest", ("source", "fingerprint", "record_count", "format", "cached_at"), "record_count", "record_count", r"[0-9]+", 2147483647)

OUT = T.StructType([
    T.StructField("raw_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("reader_error", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType())),
])


class _Reader:
    """DuckDB on a worker: reads the records of one kind in one batch."""

    def __init__(self, folder: str) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": folder})
        self.error = duckdb.Error
        self.folder = folder

    def read(self, columns: dict[str, str], files: list[list[tuple[int, str]]], padded: bool, null: str) -> tuple[dict[int, tuple], dict[int, str]] | None:
        """Of the numbered records in each of the files: the values of those that load, and the first error of those
        rejected; None if the reader fails, as on a record beyond its memory."""
        paths = [os.path.join(self.folder, f"{k}.csv") for k in range(len(files))]
        for path, lines in zip(paths, files, strict=True):
            with open(path, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{i},{line}\n" for i, line in lines)
        for t in ("reject_errors", "reject_scans"):
            self.con.execute(f"DROP TABLE IF EXISTS {t}")
        widest = max(len(line.encode()) for lines in files for _, line in lines) + 64
        try:
            return self._read(columns, paths, padded, null, widest)
        except self.error:
            return None
        finally:
            for path in paths:
                os.remove(path)

    def _read(self, columns: dict[str, str], paths: list[str], padded: bool, null: str, widest: int) -> tuple[dict[int, tuple], dict[int, str]]:
        spec = ", ".join(f"'{c}': '{t}'" for c, t in {"record_no": "VARCHAR", **columns}.items())
        got = self.con.execute(
            f"SELECT * FROM read_csv(?, auto_detect=false, header=false, delim=',', quote='\"', escape='\"', new_line='\\n', columns={{{spec}}}, strict_mode=true, null_padding={str(padded).lower()}, "
            f"nullstr='{null}', store_rejects=true, rejects_limit=0, parallel=false, max_line_size={max(widest, 2_000_000)}, buffer_size={max(2 * widest + 1024, 16_000_000 if len(paths) == 1 else 2_000_128)})",
            [paths],
        ).fetchall()
        errors: dict[int, str] = {}
        for text, kind_of in self.con.execute("SELECT csv_line, CAST(error_type AS VARCHAR) FROM reject_errors ORDER BY file_id, line, column_idx").fetchall():
            number = (text or "").lstrip("\n").split(",", 1)[0]
            if number.isascii() and number.isdigit():
                errors.setdefault(int(number), kind_of)
        loaded = {int(r[0]): r[1:] for r in got if r[0] and r[0].isascii() and r[0].isdigit()}
        return {i: v for i, v in loaded.items() if i not in errors}, errors


def written_as(line: str, values: tuple) -> int | None:
    """The number of fields if the line is what the values look like, each enclosed or free of quotes; else None."""
    at = 0
    for k, v in enumerate(values):
        if v is None:
            return k if at == len(line) + 1 else None
        v = str(v)
        if line.startswith('"', at):
            v = '"' + v.replace('"', '""') + '"'
        elif '"' in v:
            return None
        if not line.startswith(v, at):
            return None
        at += len(v)
        if at < len(line) and line[at] != "," or at > len(line):
            return None
        at += 1
    return len(values) if at == len(line) + 1 else None


def _split(line: str) -> tuple[str, ...] | None:
    """The fields of a record beyond the reader; None if a quote stands where none may."""
    parts = [m.group(1) for m in _FIELD.finditer("," + line)]
    if sum(map(len, parts)) + len(parts) - 1 != len(line):
        return None
    return tuple(x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in parts)


def _spare(text: str, n: int) -> list[str]:
    """n private-use characters that text doesn't hold."""
    used = set(text)
    return [c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used][:n]


def _as_text(reader: _Reader, lines: list[tuple[int, str]], null: str) -> tuple[dict[int, tuple | None], dict[int, str]]:
    """The values of each record as text, as many as it has (None if its quoting is broken), and the reader's errors."""
    values: dict[int, tuple | None] = {}
    errors: dict[int, str] = {}
    by_width: dict[int, list[tuple[int, str]]] = {}
    for i, line in lines:
        n = line.count(",") + 1
        by_width.setdefault(next((w for w in (16, 128, WIDEST) if n <= w), 0), []).append((i, line))
    for width, group in by_width.items():
        if not width:
            values |= {i: _split(line) for i, line in group}
            continue
        columns = {f"f{k}": "VARCHAR" for k in range(width)}
        alone = [[x] for x in group if x[1].count('"') % 2]
        together = [x for x in group if not x[1].count('"') % 2]
        todo = [*([together] if together else []), *alone]
        got = reader.read(columns, todo, True, null) or ({}, {})
        rest = [[x] for x in together if x[0] not in got[0]]
        for files in (rest[k : k + 500] for k in range(0, len(rest), 500)):
            more = reader.read(columns, files, True, null) or ({}, {})
            got = (got[0] | more[0], got[1] | more[1])
        for i, line in group:
            values[i] = got[0].get(i)
            if i in got[1]:
                errors[i] = got[1][i]
            elif i not in got[0]:
                one = reader.read(columns, [[(i, line)]], True, null)
                values[i] = _split(line) if one is None else one[0].get(i)
    return values, errors


def judge(records: list[tuple[str | None, str | None]], kinds: tuple[Kind, ...], reader: _Reader) -> list[tuple | None]:
    """For each (kind, line): None for a blank one, else (reason, reader's error, fields)."""
    out: list[tuple | None] = [None] * len(records)
    by_kind: dict[str, list[tuple[int, str]]] = {}
    known = {k.name: k for k in kinds}
    for i, (kind, line) in enumerate(records):
        if line is None or not line.strip():
            continue
        if kind in known:
            by_kind.setdefault(kind, []).append((i, line.rstrip("\r\n")))
        else:
            out[i] = ("kind", None, None)
    for name, lines in by_kind.items():
        kind = known[name]
        valid = re.compile(kind.pattern)
        lf, cr, nul, null = _spare("".join(line for _, line in lines), 4)
        back = str.maketrans({lf: "\n", cr: "\r", nul: "\0"})
        at, n = kind.fields.index(kind.checked), len(kind.fields)
        flat = [(i, line.replace("\n", lf).replace("\r", cr).replace("\0", nul)) for i, line in lines]
        columns = {f: "INTEGER" if f == kind.checked and kind.at_most is not None else "VARCHAR" for f in kind.fields}
        even = [x for x in flat if not x[1].count('"') % 2]
        loaded, errors = reader.read(columns, [even], False, null) or ({}, {}) if even else ({}, {})

        def accept(i: int, values: tuple, error: str | None) -> tuple:
            texts = [str(v).translate(back).strip() for v in values]
            v = texts[at]
            ok = valid.fullmatch(v) and (kind.at_most is None or len(v.lstrip("0")) <= len(str(kind.at_most)) and int(v) <= kind.at_most)
            return (None, None, texts) if ok else (kind.reason, error or "PATTERN", texts)

        unclear = []
        for i, line in flat:
            values = loaded.get(i)
            if values is not None and None not in values and written_as(line, values) == n:
                out[i] = accept(i, values, None)
            else:
                unclear.append((i, line))
        texts, more = _as_text(reader, unclear, null)
        for i, line in unclear:
            error, values = errors.get(i) or more.get(i), texts[i]
            width = None if values is None else written_as(line, values)
            if width is None:
                out[i] = ("quoting", error or "ROUND TRIP", None)
            elif width != n:
                out[i] = ("columns", error or ("TOO MANY COLUMNS" if width > n else "MISSING COLUMNS"), None)
            else:
                out[i] = accept(i, values[:n], error)
    return out


def parse_records(df: DataFrame, id_col: str = "raw_id", kind_col: str = "kind", line_col: str = "line", kinds: tuple[Kind, ...] = (CANDIDATE, MANIFEST)) -> DataFrame:
    """One row per record that isn't blank: raw_id, kind, reason (null: it loads), reader_error, fields (trimmed)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("raw_id", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("reader_error", pa.string()), ("fields", pa.list_(pa.string()))])
        # A scratch file that lives within this task only; nothing outside the task reads it.
        with tempfile.TemporaryDirectory(prefix="records-") as folder:
            reader = _Reader(folder)
            for b in batches:
                ids, ks, lines = (b.column(k).to_pylist() for k in range(3))
                rows = [(i, k, *r) for i, k, r in zip(ids, ks, judge(list(zip(ks, lines, strict=True)), kinds, reader), strict=True) if r is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(5)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("raw_id"), F.col(kind_col).alias("kind"), F.col(line_col).alias("line")).mapInArrow(run, OUT)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())


def loaded(parsed: DataFrame, kind: Kind) -> DataFrame:
    """The valid records of a kind as named columns; years, dates and counts typed, null where they aren't valid."""
    typed = {"years_of_experience": "double", "record_count": "int", "signup_date": "date", "cached_at": "timestamp"}
    cols = [F.col("raw_id")]
    for k, name in enumerate(kind.fields):
        c = F.nullif(F.col("fields")[k], F.lit(""))
        cols.append((c.try_cast(typed[name]) if name in typed else c).alias(name))
    return parsed.where((F.col("kind") == kind.name) & F.col("reason").isNull()).select(*cols)
