"""Evaluation passages inside corpus documents (problem 7).

The items (a bounded table, its size is checked) are normalised to streams of letters and digits,
and every run of ``seed_words`` words of every item becomes a pattern of one Aho-Corasick automaton,
which is broadcast. Each document's stream is scanned once; because case, marks, markup, escapes,
spacing and hyphenation leave no trace in a stream, a passage matches however it was laid out.
Hits of one item are chained in order; the words between two hits are compared with the item's,
so that changed, missing and added words count as such. A document holds an item if a chain covers
at least ``min_words`` words of it (or the whole item, if shorter) and enough of them agree. In a short
passage, words that differ where the items themselves differ between the same neighbours don't count
as changed: that is a turn of phrase filled otherwise. Every chain is measured.
Offsets are mapped back to the original text. One narrow pass over the corpus, no shuffle; each worker
builds the automaton once.

Defined results: null and empty texts hold nothing; repeated documents each give their rows; an item
that is null or without letters gives none; duplicate items each give rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.normal import offsets, stream, words
from rankloom.llm.once import once

#: Items beyond this many characters aren't broadcast; they are taken in blocks of this size instead.
BLOCK_CHARS = 2_000_000


@dataclass(frozen=True)
class Rule:
    seed_words: int = 3
    seed_chars: int = 9
    min_words: int = 15
    #: (words covered, share of them that must agree), by rising words: the shorter a passage, the more alike it must be,
    #: since texts of the same kind share turns of phrase within a sentence.
    agree: tuple[tuple[int, float], ...] = ((0, 0.86), (21, 0.8), (30, 0.75))
    #: Words covered below which added words count like changed ones and a passage may not differ where the items do.
    slot_words: int = 21
    #: Item words that may be missed between two hits, and characters a missed or added word may take.
    gap_words: int = 6
    word_chars: int = 14

    @cache  # noqa: B019 - rules are few and small
    def least_seeds(self, need: int) -> int:
        """Seeds any accepted passage holds: each word that doesn't agree breaks at most ``seed_words`` of them, and a few
        seeds are too short to be looked for."""
        worst = min(c - (self.seed_words - 1) - self.seed_words * int(c - self.share(c) * c) for c in range(need, need + 40))
        return max(1, worst - 1)

    @cache  # noqa: B019
    def share(self, covered: int) -> float:
        return next(s for w, s in reversed(self.agree) if covered >= w)


class Automaton:
    def __init__(self, items: list[tuple[int, str]], rule: Rule) -> None:
        import ahocorasick

        self.rule = rule
        self.items = [(i, w) for i, w in ((i, words(t or "")) for i, t in items) if w]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            n = min(rule.seed_words, len(w))
            for j in range(len(w) - n + 1):
                s = "".join(w[j : j + n])
                if len(s) >= rule.seed_chars or len(w) == n:
                    where[s].append((k, j))
        fillers: dict[tuple[str, str], set[str]] = defaultdict(set)
        for _, w in self.items:
            for gap in (1, 2, 3):
                for j in range(1, len(w) - gap):
                    fillers[w[j - 1], w[j + gap]].add(" ".join(w[j : j + gap]))
        #: Neighbours between which the items have different words.
        self.open = {k for k, v in fillers.items() if len(v) > 1}
        self.auto = ahocorasick.Automaton()
        for s, at in where.items():
            self.auto.add_word(s, (len(s), at))
        if where:
            self.auto.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, words covered, words that agree, begin, end) of the best passage of each item held; places in the stream."""
        if self.empty:
            return []
        s = stream(text)
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for last, (size, at) in self.auto.iter(s):
            for k, j in at:
                hits[k].append((last + 1 - size, last + 1, j))
        out = []
        for k, h in hits.items():
            w = self.items[k][1]
            need = min(self.rule.min_words, len(w))
            # Cheap bound: a passage needs hits spread over enough words of the item.
            places = {j for *_, j in h}
            if len(places) < self.rule.least_seeds(need) or max(places) - min(places) + self.rule.seed_words + 2 * self.rule.gap_words < need:
                continue
            best = self._chain(s, w, h, need)
            if best:
                out.append((self.items[k][0], *best))
        return out

    def _chain(self, s: str, w: list[str], h: list[tuple[int, int, int]], need: int) -> tuple[int, int, int, int] | None:
        """Chains hits in order and gives the longest passage that agrees well enough."""
        r, n = self.rule, min(self.rule.seed_words, len(w))
        h = sorted(set(h))
        best: list[int] = []
        back: list[int] = []
        for x, (b, e, j) in enumerate(h):
            score, prev = n, -1
            for y in range(x - 1, -1, -1):
                pb, pe, pj = h[y]
                if b - pe > (r.gap_words + 4) * r.word_chars:
                    break
                step = j - pj
                if step <= 0 or step > n + r.gap_words:
                    continue
                if step < n:  # overlapping seeds must overlap in the text alike
                    if b - pb != sum(map(len, w[pj:j])):
                        continue
                    gain = step
                else:
                    between, missed = b - pe, step - n
                    if between < 0 or between > (missed + 2) * r.word_chars:
                        continue
                    gain = n - 0.3 * missed
                if best[y] + gain > score:
                    score, prev = best[y] + gain, y
            best.append(score)
            back.append(prev)
        top = None
        ends = set(range(len(h))) - {p for p in back if p >= 0}
        for x in sorted(ends, key=lambda x: -best[x]):
            chain = []
            y = x
            while y >= 0:
                chain.append(h[y])
                y = back[y]
            if h[x][2] + n - chain[-1][2] + 10 < need:  # the borders add at most five words each
                continue
            got = self._measure(s, w, chain[::-1], n, need)
            if got and (top is None or got[1] > top[1]):
                top = got
        return top

    def _measure(self, s: str, w: list[str], chain: list[tuple[int, int, int]], n: int, need: int) -> tuple[int, int, int, int] | None:
        """Agreement word by word over a chain, then its best stretch."""
        agree: dict[int, tuple[int, int]] = {}
        for b, _, j in chain:
            at = b
            for k in range(j, j + n):
                agree[k] = (at, at + len(w[k]))
                at += len(w[k])
        known = sorted(agree)
        for a, c in zip(known, known[1:], strict=False):  # words between hits that are there, in order
            at, end = agree[a][1], agree[c][0]
            for k in range(a + 1, c):
                f = s.find(w[k], at, end)
                if f >= 0 and (len(w[k]) > 2 or f == at):
                    agree[k] = (f, f + len(w[k]))
                    at = f + len(w[k])
        first, last = known[0], known[-1]
        for k in range(first - 1, max(-1, first - 5), -1):  # single words at the borders
            b = agree[min(agree)][0]
            f = s.rfind(w[k], max(0, b - len(w[k]) - self.rule.word_chars), b)
            if f >= 0 and (len(w[k]) > 2 or f + len(w[k]) == b):
                agree[k] = (f, f + len(w[k]))
        for k in range(last + 1, min(len(w), last + 5)):
            e = agree[max(agree)][1]
            f = s.find(w[k], e, e + len(w[k]) + self.rule.word_chars)
            if f >= 0 and (len(w[k]) > 2 or f == e):
                agree[k] = (f, f + len(w[k]))
        places = sorted(agree)
        changed, filled = [0], [0]  # words changed, missed or added, and turns of phrase filled otherwise, before each place
        for a, c in zip(places, places[1:], strict=False):
            missed, added = c - a - 1, agree[c][0] - agree[a][1]
            n = max(missed, -(-added // self.rule.word_chars))
            changed.append(changed[-1] + n)
            filled.append(filled[-1] + (n > 0 and (w[a], w[c]) in self.open))
        best = None
        for a in range(len(places)):
            for c in range(len(places) - 1, a, -1):
                covered = places[c] - places[a] + 1
                if covered < need or best and c - a + 1 <= best[1]:
                    break
                short = covered < self.rule.slot_words
                if short and filled[c] > filled[a]:
                    continue
                if c - a + 1 >= self.rule.share(covered) * (c - a + 1 + changed[c] - changed[a] if short else covered):
                    best = (covered, c - a + 1, agree[places[a]][0], agree[places[c]][1])
                    break
        return best


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """id, item, words covered, words that agree, and begin and end of the passage in the original text."""
    pairs = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL")
    total = pairs.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    out = None
    for n in range(blocks):  # one block unless the items outgrow a broadcast
        part = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n)
        sent = spark.sparkContext.broadcast([(r.i, r.t) for r in part.collect()])

        token = uuid.uuid4().hex

        def run(batches: Iterator, sent=sent, token=token) -> Iterator:
            import pyarrow as pa

            auto = once(token, lambda: Automaton(sent.value, rule))
            names = ["id", "item", "covered", "agreeing", "begin", "end"]
            for b in batches:
                ids, rows = [], []
                for x, t in zip(b.column(0), b.column(1), strict=True):
                    text = t.as_py()
                    if found := auto.find(text):
                        place = offsets(text)
                        ids += [x.as_py()] * len(found)
                        rows += [(i, c, m, place[s], place[e - 1] + 1) for i, c, m, s, e in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]], names=names)

        d = base.mapInArrow(run, f"id {kind}, item long, covered long, agreeing long, begin long, end long")
        out = d if out is None else out.unionByName(d)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
