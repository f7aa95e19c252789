"""Corpus encoding with a public byte-level BPE vocabulary (problem 6).

A streaming transducer instead of repeated merging. For every prefix of the bytes of a piece, the
BPE result ends in exactly one token; that token is the only one, among the vocabulary's tokens
that end there, which may follow the last token of the prefix before it ("may follow": merging the
bytes of the two gives the two back, decided from the merge list alone). So the transducer keeps one
back-pointer per byte. A token is emitted once stable: as no token is longer than ``lookahead``
bytes, only the back-pointers of the last ``lookahead`` positions can still be used, and what all
their paths share can't change any more. Memory is bounded by the lookahead, not by the text.

Text is cut into pieces by the vocabulary's pattern; long texts are taken in windows that end where
white space follows something else, which is always a piece boundary. Encodings of short pieces are
memoised per worker. One narrow pass over the corpus, no shuffle; the rank file (under 1 MB) is
broadcast.

Defined results: null and empty text give an empty list; special tokens are never produced, their
strings are ordinary text; each row is encoded on its own, so repeated rows and ties don't matter.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Tokens and merges of a rank file: a line has a token in base64 and its rank, merges by rising rank."""

    def __init__(self, rank_file: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(t) == 1:
                self.halves[r] = (r, r)
            else:
                a, b = self._last_merge(t, r)
                self.halves[r] = (a, b)
                self.joined[a, b] = r
        self._follows: dict[tuple[int, int], bool] = {}

    def _last_merge(self, t: bytes, r: int) -> tuple[int, int]:
        """The two tokens whose merge gives t: merge its bytes with the merges before rank r."""
        parts = [self.rank[t[i : i + 1]] for i in range(len(t))]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda i: self.joined.get((parts[i], parts[i + 1]), r))
            parts[k : k + 2] = [self.joined[parts[k], parts[k + 1]]]
        return parts[0], parts[1]

    @property
    def lookahead(self) -> int:
        """Bytes after which a back-pointer can't be used any more."""
        return self.longest

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b gives a, b: no merge across their border comes first.

        The two are unmerged step by step, the later merge first; a merge across the border that ranks before
        the step undone last would have been made instead.
        """
        key = (a, b)
        known = self._follows.get(key)
        if known is not None:
            return known
        before = 1 << 60
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < before:
                ok = False
                break
            left, right = self.halves[a][1], self.halves[b][0]
            a_done, b_done = left == a, right == b
            if a_done and b_done:
                ok = True
                break
            if b_done or (not a_done and a > b):
                before, a = a, left
            else:
                before, b = b + 1, right
        if len(self._follows) > 2_000_000:
            self._follows.clear()
        self._follows[key] = ok
        return ok


class Transducer:
    """Encodes one piece fed in any portions of bytes; ``feed`` gives the tokens that have become stable."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.tail = bytearray()  # bytes not emitted yet
        self.ends: list[int] = []  # for each of them, the last token of the encoding up to it
        self.previous: int | None = None  # the token emitted last

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 4 * self.v.lookahead
        for k in range(0, len(data), step):
            for byte in data[k : k + step]:
                self._push(byte)
            if len(self.ends) > step:
                out += self._stable()
        return out

    def _push(self, byte: int) -> None:
        self.tail.append(byte)
        tail, ends, rank = self.tail, self.ends, self.v.rank
        n = len(tail)
        for size in range(min(n, self.v.longest), 0, -1):
            t = rank.get(bytes(tail[n - size :]))
            if t is None:
                continue
            before = ends[n - size - 1] if size < n else self.previous
            if before is None or self.v.may_follow(before, t):
                ends.append(t)
                return
        raise ValueError("the vocabulary doesn't hold all bytes")

    def _path(self, n: int) -> list[tuple[int, int]]:
        """The tokens of the first n bytes held, each with its end."""
        out = []
        while n > 0:
            t = self.ends[n - 1]
            out.append((t, n))
            n -= len(self.v.token[t])
        return out[::-1]

    def _stable(self) -> list[int]:
        n = len(self.ends)
        paths = [self._path(k) for k in range(max(1, n - self.v.lookahead + 1), n + 1)]
        same = 0
        for steps in zip(*paths, strict=False):
            if any(s != steps[0] for s in steps):
                break
            same += 1
        out = [t for t, _ in paths[0][:same]]
        if out:
            cut = paths[0][same - 1][1]
            del self.tail[:cut]
            del self.ends[:cut]
            self.previous = out[-1]
        return out

    def finish(self) -> list[int]:
        out = [t for t, _ in self._path(len(self.ends))]
        self.__init__(self.v)
        return out


class _Memo(dict):
    """Tokens of pieces; long pieces aren't kept, and all is forgotten at the limit."""

    def __init__(self, v: Vocabulary, limit: int = 300_000) -> None:
        super().__init__()
        self.transducer, self.limit = Transducer(v), limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(chain(self.transducer.feed(piece.encode()), self.transducer.finish()))
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, rank_file: bytes, pattern: str = PATTERN, window: int = 1 << 16) -> None:
        import regex

        self.v = Vocabulary(rank_file)
        self.pieces = regex.compile(pattern).findall
        self.memo = _Memo(self.v)
        self.window = window

    def windows(self, text: str) -> Iterator[str]:
        """The text in parts of about ``window`` characters that end at piece boundaries."""
        at, n = 0, len(text)
        while n - at > self.window:
            cut = at + self.window
            while cut < n and not (text[cut].isspace() and not text[cut - 1].isspace()):
                cut += 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.window:
            return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text))))
        return [i for part in self.windows(text) for i in chain.from_iterable(map(self.memo.__getitem__, self.pieces(part)))]


class Decoder:
    """Token ids to text, one id at a time: a state machine over UTF-8 bytes that holds at most three bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.held = bytearray()
        self.need = 0

    def feed(self, token: int) -> str:
        out = []
        for byte in self.v.token[token]:
            if self.need and byte & 0xC0 == 0x80:
                self.held.append(byte)
                self.need -= 1
            else:
                if self.held:
                    out.append(self.held.decode("utf-8", "replace"))
                self.held = bytearray([byte])
                self.need = 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
            if not self.need:
                out.append(self.held.decode("utf-8", "replace"))
                self.held.clear()
        return "".join(out)

    def finish(self) -> str:
        out = self.held.decode("utf-8", "replace")
        self.held.clear()
        self.need = 0
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(chain(map(self.feed, ids), (self.finish(),)))


_ENCODERS: deque[tuple[int, Encoder]] = deque(maxlen=2)


def _encoder(rank_file: bytes) -> Encoder:
    """One encoder per worker process, kept between tasks with its memo."""
    key = hash(rank_file)
    for k, e in _ENCODERS:
        if k == key:
            return e
    _ENCODERS.append((key, e := Encoder(rank_file)))
    return e


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id and ``ids`` (array<int>), one row per row of df."""
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = _encoder(ranks.value)
        for b in batches:
            texts = b.column(1)
            for at in range(0, b.num_rows, 512):  # bounds the lists held at once
                ids = pa.array([e.encode(t.as_py()) for t in texts.slice(at, 512)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), ids], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """id and ``text``: what the ids stand for; an empty or null list gives an empty text."""
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        d = Decoder(_encoder(ranks.value).v)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d.decode(x.as_py() or ()) for x in b.column(1)], pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
