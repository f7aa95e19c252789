"""Template residue, filler, error pages and demands for scripts in place of content (problem 8).

Character n-gram models (orders 0 to ``ORDER``, each smoothed with the next lower one) are made for notices, filler and
unfilled slots from the grammars of ``residue_examples``, and for natural prose from every document of the corpus, whole.
Only n-grams of the grammars can speak for a class, so these alone are counted, exactly, in tables whose size doesn't
depend on the corpus. One pass counts the prose: from each text the windows that the class models alone find likely are
left out, the tables of the partitions are added up in two levels, and what is left out but comes with the same words
around it in a share of the distinct texts (``mentions``) is talked about rather than left over, and is added again. A second pass scores every text whole: for each class, the log-likelihood ratio against prose is summed over the
window that makes it largest (the maximal segment sum), which localises the residue.

A document is excluded by what its windows cover: a window above the threshold counts by itself, however little of the
document it is, since a part suffices; a weaker one, from ``weak`` of the threshold on, counts if the characters that
speak for its class are ``min_coverage`` of the text, as where a whole text is a short notice or filler.

Text that only mentions such things stays: the prose model has seen its kind of sentence, so the
ratio stays low, whatever words it holds. Models are broadcast (about 3 MB, whatever the corpus) and can be saved (``save``, ``load``).

Defined results: null and blank texts are no case; repeated texts are judged alike; long texts are
scored in overlapping parts, none is cut off.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.residue_examples import examples
from rankloom.session import checkpoint

ORDER = 6
PART = 1 << 16
OVERLAP = 1 << 10
CLASSES = ("notice", "filler", "slot")
#: Bits of the hashes by which the n-grams of the grammars are found.
BITS = 22
SINGLE = 1 << 12
#: Groups in which the tables of the partitions are added up first.
FIRST_LEVEL = 64
#: Characters a slot may have after its first.
SLOT_CHARS = 48
_OPEN = "[{<$%#@|_&"
_DELIMITER = np.zeros(256, bool)
_DELIMITER[[ord(x) for x in _OPEN]] = True
_WORD = re.compile(r"[^\W_]{2}")
_ENCLOSES = re.compile(r"[\[\]{}<>$%#@|_]|&[lg]t;")


@dataclass(frozen=True)
class Settings:
    #: Log-likelihood ratio a window must reach, by class.
    thresholds: tuple[tuple[str, float], ...] = (("notice", 10.0), ("filler", 13.0), ("slot", 5.0))
    #: Share of the threshold from which on a window counts if its class covers enough of the text, and that coverage.
    weak: float = 0.6
    min_coverage: float = 0.5
    #: Before there is a prose model: log-likelihood a character is compared with, and what windows must reach.
    first_rate: float = -1.6
    first_thresholds: tuple[tuple[str, float], ...] = (("notice", 14.0), ("filler", 12.0), ("slot", 5.0))
    #: Share of the distinct texts (and their least number) in which a window must have the same words around it to count
    #: as talked about.
    mentions: float = 0.00075
    least_mentions: int = 3
    #: The same for whole sentences: one in so many texts is a heading, part of what all documents are made of.
    headings: float = 0.01
    least_headings: int = 30
    #: Weight of the next lower order, in characters.
    smoothing_class: float = 1.0
    smoothing_prose: float = 4.0


def _codes(text: str):
    """Lower-case code points, digits as one, white space as a blank."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift all places
        low = "".join(c.lower()[:1] for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)
    return np.where((c == 10) | (c == 13) | (c == 9) | (c == 160), np.uint32(32), c)


def _hashes(c) -> Iterator[tuple]:
    """For each order k: hashes of the k characters before each place, and of these with the place's own."""
    h = np.zeros(len(c), np.uint32)
    own = (c + np.uint32(1)) * np.uint32(0x85EBCA6B)
    plain = c + np.uint32(7)
    power = 1
    for k in range(1, ORDER + 1):
        power = power * 1000003 & 0xFFFFFFFF
        h[k:] += plain[: max(len(c) - k, 0)] * np.uint32(power)
        ctx = (h + np.uint32(k)) * np.uint32(0x9E3779B1)
        ctx ^= ctx >> np.uint32(15)
        joint = (ctx ^ own) * np.uint32(0xC2B2AE35)
        joint ^= joint >> np.uint32(13)
        yield ctx * np.uint32(0x27D4EB2F), joint * np.uint32(0x165667B1)


class Grams:
    """The n-grams of the class texts: their contexts, and these with their character, by the hash that finds them."""

    def __init__(self, texts: list[str]) -> None:
        found = [(ctx, joint) for ctx, joint in _hashes(_codes("\n".join(["", *texts, ""])))]
        self.keys, self.slots = zip(*[self._index(np.unique(np.concatenate([x[k] for x in found]))) for k in (0, 1)], strict=True)

    @staticmethod
    def _index(keys) -> tuple:
        """Keys with one behind them that stands for any other, and the key of each slot; a slot keeps one key."""
        slots = np.full(1 << BITS, len(keys), np.int32)
        slots[keys >> np.uint32(32 - BITS)] = np.arange(len(keys))
        return np.append(keys, np.uint32(0)), slots

    def __getstate__(self) -> list:
        """Only the keys are sent; the slots are made of them again."""
        return [k[:-1] for k in self.keys]

    def __setstate__(self, keys: list) -> None:
        self.keys, self.slots = zip(*map(self._index, keys), strict=True)

    def places(self, hashed: tuple) -> list:
        """Of contexts and n-grams, the numbers of those known, and the number behind them for others."""
        out = []
        for keys, slots, h in zip(self.keys, self.slots, hashed, strict=True):
            at = slots.take(h >> np.uint32(32 - BITS))
            at[keys.take(at) != h] = len(keys) - 1
            out.append(at)
        return out


class Counts:
    """Counts of characters, contexts and n-grams; these can be added."""

    def __init__(self, grams: Grams) -> None:
        self.grams = grams
        self.context, self.joint = (np.zeros(len(k), np.float64) for k in grams.keys)
        self.single = np.zeros(SINGLE, np.float64)

    def add(self, texts: list[str], times: int = 1, part: int = 1 << 20) -> Counts:
        """Adds the texts' counts, a bounded part at a time."""
        whole = _codes("\n".join(["", *texts, ""]))
        for at in range(0, len(whole), part):
            c = whole[at : at + part]
            self.single += times * np.bincount(c % SINGLE, minlength=SINGLE)
            for hashed in _hashes(c):
                for table, places in zip((self.context, self.joint), self.grams.places(hashed), strict=True):
                    n = np.bincount(places)
                    table[: len(n)] += times * n
        self.context[-1] = self.joint[-1] = 0
        return self


class Bank:
    """Models side by side: a place of a table is read once for all of them."""

    def __init__(self, counts: list[Counts], smoothing: float) -> None:
        self.smoothing = np.float32(smoothing)
        side = lambda arrays: np.ascontiguousarray(np.stack(arrays, 1).astype(np.float32))
        self.joint, self.context = side([x.joint for x in counts]), side([x.context for x in counts])
        self.base = side([(x.single + 0.05) / (x.single.sum() + 200) for x in counts])

    def log_likelihood(self, c, places: list[list], known: bool):
        """Natural log of each character's probability, and whether the four characters up to it were seen; by model.

        known: whether these models have counted all n-grams they hold, so that any other is none of theirs.
        """
        s = self.smoothing
        p = self.base.take(c % SINGLE, 0)
        low = seen = None
        for k, (ctx, joint) in enumerate(places, 1):
            j, x = self.joint.take(joint, 0), self.context.take(ctx, 0)
            if not known:
                x[joint == len(self.joint) - 1] = 0
            p *= s
            p += j
            x += s
            p /= x
            if k == 2:
                low = p.copy()
            if k == 3:
                seen = j > 0
        # A small share of a low order keeps one odd character in a known context from counting for very much.
        p *= np.float32(0.97)
        p += np.float32(0.03) * low
        p += np.float32(1e-9)
        return np.log(p, out=p), seen


class Models:
    """The class models, and the prose model once there is one."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        made = examples()
        self.grams = Grams([x + " " for k in CLASSES for x in made[k]])
        self.classes = Bank([Counts(self.grams).add([x + " " for x in made[k]]) for k in CLASSES], s.smoothing_class)
        self.prose: Bank | None = None

    def with_prose(self, counts: Counts) -> Models:
        self.prose = Bank([counts], self.s.smoothing_prose)
        return self

    def ratios(self, c, begin):
        """Per class: log-likelihood ratio of each character against prose; without a prose model, against a fixed rate.

        begin: where the text of each character begins.
        """
        places = [self.grams.places(h) for h in _hashes(c)]
        base = self.prose.log_likelihood(c, places, False)[0] if self.prose else np.float32(self.s.first_rate)
        own, seen = self.classes.log_likelihood(c, places, True)
        own -= base
        # What a class hasn't seen speaks against it, however odd it is for prose; no character decides alone.
        np.copyto(own, np.minimum(own, np.float32(-1.0)), where=~seen)
        np.clip(own, -8.0, 3.0, out=own)
        out = dict(zip(CLASSES, own.T.astype(np.float64), strict=True))
        if len(c):  # a slot begins with what encloses slots
            at = np.arange(len(c))
            opened = np.maximum.accumulate(np.where(_DELIMITER[np.minimum(c, 255)], at, -(1 << 40)))
            out["slot"] = np.where((at - opened <= SLOT_CHARS) & (opened >= begin), out["slot"], -8.0)
        return out

    def need(self, k: str) -> float:
        return dict(self.s.thresholds if self.prose else self.s.first_thresholds)[k]

    def windows_of(self, texts: list[str], whole: bool = True) -> list[list[tuple[str, int, int, float]]]:
        """Of each text the (class, begin, end, ratio) of the windows that count; that of a slot begins with or holds what
        encloses it. The texts are scored together, apart by as many blanks as a context is long, so that none matters to
        another. whole: whether weaker windows count where their class covers enough of the text."""
        gap = "\n" * ORDER
        sizes = np.array([len(t) for t in texts])
        starts = ORDER + np.concatenate([[0], np.cumsum(sizes[:-1] + ORDER)])
        c = _codes(gap + gap.join(texts) + gap)
        begin = np.repeat(starts, sizes + ORDER)
        inside = np.arange(ORDER, len(c)) - begin < np.repeat(sizes, sizes + ORDER)
        inside, begin = np.concatenate([np.zeros(ORDER, bool), inside]), np.concatenate([np.zeros(ORDER, np.int64), begin])
        filled = np.maximum(1, np.array([len(t.strip()) for t in texts]))
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        for k, r in self.ratios(c, begin).items():
            r[~inside] = -1e6  # nothing reaches over a border
            total = np.cumsum(r)
            low = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
            top = np.maximum.reduceat(total - low, starts)
            need = np.full(len(texts), self.need(k))
            if self.prose and whole:
                need[np.add.reduceat(r > 0, starts) >= self.s.min_coverage * filled] *= self.s.weak
            for i in np.flatnonzero(top >= need - 1e-6):
                t, at = texts[i], starts[i]
                for b, e, x in _segments(r[at : at + sizes[i]], need[i]):
                    if k != "slot" or _ENCLOSES.search(t, max(0, b - 12), e + 4) and _WORD.search(t, b, e + 8):
                        out[i].append((k, b, e, x))
        return out

    def windows(self, text: str) -> list[tuple[str, int, int, float]]:
        """The windows of one text; a long one is scored in overlapping parts."""
        if len(text) < PART:
            return self.windows_of([text])[0]
        out = []
        for at in range(0, len(text) - OVERLAP, PART - OVERLAP):
            out += [w for k, b, e, x in self.windows_of([text[at : at + PART]], False)[0] if (w := (k, at + b, at + e, x)) not in out]
        return out

    def judge(self, text: str, found: list[tuple] | None = None) -> tuple[float, list[tuple[str, int, int, float]]] | None:
        """(coverage, windows) of a text to exclude, else None."""
        found = self.windows(text) if found is None else found
        return (min(1.0, _covered(found) / len(text.strip())), found) if found else None


def _covered(windows: list[tuple]) -> int:
    covered, last = 0, 0
    for _, b, e, _ in sorted(windows, key=lambda x: x[1]):
        covered += max(0, e - max(b, last))
        last = max(last, e)
    return covered


def _segments(r, need: float) -> list[tuple[int, int, float]]:
    """Segments whose sum reaches need: from where a running sum last was zero to its highest point, then onwards."""
    total = np.cumsum(r)
    run = total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
    above = np.concatenate([[False], run > 0, [False]])
    begins, ends = np.flatnonzero(above[1:] & ~above[:-1]), np.flatnonzero(above[:-1] & ~above[1:])
    out = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if run[b:e].max() >= need - 1e-6:  # only where the sum gets so high is it gone through place by place
            out += [(b + x, b + y, v) for x, y, v in _climbs(r[b:e].tolist(), need)]
    return out


def _climbs(r: list[float], need: float) -> list[tuple[int, int, float]]:
    out = []
    total, begin, top, end = 0.0, 0, 0.0, 0
    for i, x in enumerate(r):
        total += x
        if total > top:
            top, end = total, i + 1
        if total <= 0 or total < top - need:
            if top >= need:
                out.append((begin, end, top))
            total, begin, top, end = 0.0, i + 1, 0.0, i + 1
    if top >= need:
        out.append((begin, end, top))
    return out


def _blocks(pairs: Iterator[tuple]) -> Iterator[list[tuple]]:
    """(key, text) pairs in blocks whose texts together stay below a part's size, if they are more than one."""
    block, size = [], 0
    for i, t in pairs:
        if block and size + len(t) > PART:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t) + ORDER
    if block:
        yield block


def _found(m: Models, block: list[tuple]) -> list[list[tuple]]:
    return m.windows_of([t for _, t in block]) if len(block) > 1 or len(block[0][1]) < PART else [m.windows(t) for _, t in block]


_END = re.compile(r"[.!?](?=\s|$)|\n")


def _around(t: str, w: tuple) -> tuple[str, bool]:
    """A window with its neighbours; if it is the greater part of a sentence, the sentence, and True."""
    begin = max([m.end() for m in _END.finditer(t, max(0, w[1] - 400), w[1])], default=max(0, w[1] - 400))
    end = m.start() if (m := _END.search(t, max(w[1], w[2] - 1), w[2] + 400)) else min(len(t), w[2] + 400)
    whole = (w[2] - w[1]) * 2 >= len(t[begin:end].strip())
    return re.sub(r"[0-9]+", "0", (t[begin:end].strip() if whole else t[max(begin, w[1] - 6) : min(w[2] + 6, end)]).lower()), whole


def fit(docs: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> Models:  # noqa: B008
    """Fits the models; the prose is counted over every document in one pass, on the workers."""
    models = Models(settings)
    first = docs.sparkSession.sparkContext.broadcast(models)
    shape = "salt long, tables binary, mention string, text long"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = first.value
        counts = Counts(m.grams)
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64())

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=[x.split(" ")[0] for x in shape.split(", ")])

        salt = 0
        for b in batches:
            mentions: list[tuple] = []
            for block in _blocks((None, t) for t in b.column(0).to_pylist()):
                kept = []
                for (_, t), found in zip(block, _found(m, block), strict=True):
                    at = 0
                    if found:
                        digest = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                        salt = salt or digest % FIRST_LEVEL
                        for w in sorted(found, key=lambda w: w[1]):
                            kept.append(t[at : w[1]])
                            at = max(at, w[2])
                            key, whole = _around(t, w)
                            mentions.append((1 if whole else 0, None, key, digest))
                    kept.append(t[at:])
                counts.add([x for x in kept if x.strip()])
            yield rows(mentions)
        yield rows([(salt, np.concatenate([counts.single, counts.context, counts.joint]).astype(np.float32).tobytes(), None, None)])

    def total(t):
        import pyarrow as pa

        out = 0.0
        for v in t.column("tables"):
            out = out + np.frombuffer(v.as_py(), np.float32).astype(np.float64)
        return pa.table({"whole": pa.array([0], pa.int64()), "tables": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    t = docs.select(F.col(text_col).alias("t")).where(F.length(F.trim("t")) > 0)
    counted = checkpoint(t.mapInArrow(count, shape))
    sums = counted.where("tables IS NOT NULL").groupBy("salt").applyInArrow(total, "whole long, tables binary").groupBy("whole").applyInArrow(total, "whole long, tables binary")
    prose = Counts(models.grams)
    for r in sums.collect():  # one table of a fixed size
        whole = np.frombuffer(r.tables, np.float32).astype(np.float64)
        prose.single, prose.context, prose.joint = np.split(whole, [SINGLE, SINGLE + len(prose.context)])
    # What is talked about: bounded, as each such text holds a few windows and each must be in a share of the texts.
    texts = t.agg(F.approx_count_distinct(F.xxhash64("t"))).first()[0]
    least = F.when(F.col("salt") == 0, max(settings.least_mentions, settings.mentions * texts)).otherwise(max(settings.least_headings, settings.headings * texts))
    said = counted.where("mention IS NOT NULL").groupBy("salt", "mention").agg(F.countDistinct("text").alias("n")).where(F.col("n") >= least)
    for r in said.orderBy("salt", "mention").collect():
        prose.add([r.mention], r.n)
    return models.with_prose(prose)


def save(models: Models, spark: SparkSession, path: str) -> None:
    """Writes the prose model as a table, on any file system; the class models are made of the grammars again."""
    p = models.prose
    rows = [(name, bytearray(getattr(p, name).tobytes())) for name in ("joint", "context", "base")]
    spark.createDataFrame(rows, "name string, bytes binary").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, settings: Settings = Settings()) -> Models:  # noqa: B008
    """The models that were saved, without another pass over a corpus."""
    m = Models(settings)
    m.with_prose(Counts(m.grams))
    for r in spark.read.parquet(path).collect():
        setattr(m.prose, r.name, np.frombuffer(bytes(r.bytes), np.float32).reshape(-1, 1))
    return m


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Models | None = None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Documents to exclude: id, coverage (share of characters in residue), and the windows (class, begin, end, ratio)."""
    models = models or fit(docs, text_col, settings)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = sent.value
        schema = pa.schema([("id", pa.int64()), ("coverage", pa.float64()), ("windows", pa.list_(pa.struct([("class", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])))])
        for b in batches:
            rows = []
            for block in _blocks(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                for (i, t), windows in zip(block, _found(m, block), strict=True):
                    if found := m.judge(t, windows):
                        rows.append((i, found[0], [{"class": k, "begin": b, "end": e, "ratio": float(x)} for k, b, e, x in found[1]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(3)], schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\S"))
    return base.mapInArrow(run, "id long, coverage double, windows array<struct<class:string,begin:long,end:long,ratio:double>>").withColumnRenamed("id", id_col)
