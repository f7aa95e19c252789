"""Bounded edit distances, abbreviations and the parts of organisation names, shared by matching and linking."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from rankloom.llm.normal import FOLD

#: Neighbouring keys of a Latin keyboard.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {(a, b) for r in KEYS for a, b in zip(r, r[1:], strict=False)} | {(a, b) for r, s in zip(KEYS, KEYS[1:], strict=False) for k, a in enumerate(r) for b in s[max(0, k - 1) : k + 1]}
_NEAR |= {(b, a) for a, b in _NEAR}
_VOWELS = set("aeiou")


def weighted_distance(a: str, b: str, bound: float) -> float:
    """Damerau-Levenshtein (adjacent transposition) in which slips of neighbouring keys, vowels for vowels and doubled
    letters cost less than other edits; bound + 1 as soon as the distance must exceed the bound."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > bound / 0.7:
        return bound + 1
    band = int(bound / 0.7)
    n, big = len(b), bound + 1
    before: list[float] = []
    row = [0.7 * j for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        last, row = row, [big] * (n + 1)
        least = big
        if i <= band:
            row[0] = least = 0.9 * i
        before_x = a[i - 2] if i > 1 else ""
        gone_cost = 0.7 if before_x == x else 0.9
        vowel = x in _VOWELS
        for j in range(max(1, i - band), min(n, i + band) + 1):
            y = b[j - 1]
            c = last[j - 1]
            if x != y:
                c += 0.75 if (x, y) in _NEAR or vowel and y in _VOWELS else 1.0
                v = last[j] + gone_cost
                if v < c:
                    c = v
                v = row[j - 1] + (0.7 if j > 1 and b[j - 2] == y else 0.9)
                if v < c:
                    c = v
                if j > 1 and y == before_x and x == b[j - 2]:
                    v = before[j - 2] + 0.8
                    if v < c:
                        c = v
            row[j] = c
            if c < least:
                least = c
        if least > bound and (not before or min(last) > bound):
            return big
        before = last
    return row[-1] if row[-1] <= bound else big


@lru_cache(1 << 18)
def distance(a: str, b: str, bound: int) -> int:
    """Damerau-Levenshtein with adjacent transpositions, every edit 1; bound + 1 if larger than the bound."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row2 = row, [i]
        for j, y in enumerate(b, 1):
            c = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], row2[j - 1])
            if x != y and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                c = min(c, before[j - 2] + 1)
            row2.append(c)
        if min(row2) > bound and min(last) > bound:
            return bound + 1
        before, row = last, row2
    return min(row[-1], bound + 1)


def deletions(s: str, most: int) -> set[str]:
    """s with up to ``most`` characters left out."""
    out = level = {s}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


def shortens(t: str, w: str, least: int = 3) -> bool:
    """Whether t is a shortening of the word w: a prefix, or its letters in order from the first, without too many gone."""
    if len(t) >= len(w) or len(t) < least or t[0] != w[0]:
        return False
    if w.startswith(t):
        return True
    it = iter(w)
    return len(t) >= 3 and all(c in it for c in t) and (len(t) * 2 >= len(w) or not _VOWELS & set(t[1:]))


class _Plain(dict):
    """Character -> itself in lower case without marks and look-alikes; separators stay; for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isalnum():
            out = c.translate(FOLD)
        else:
            out = "" if unicodedata.category(c) in ("Cf", "Mn", "Me") else " " if c.isspace() else c
        self[code] = out
        return out


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Lower case without marks, look-alikes and zero-width characters; separators stay."""
    return text.lower() if text.isascii() and text.isprintable() else unicodedata.normalize("NFKC", text).translate(_PLAIN)


#: Stand-ins for no value, as people and systems write them.
NO_VALUE = frozenset("na|n a|none|null|nil|nan|unknown|other|others|see resume|see cv|see profile|to be updated|to be confirmed|tbd|tba|tbc|xyz|abc|xxx|same as above|same|as above|not applicable|not available|not specified|undisclosed|confidential|test|various|misc|any|no|nothing|ditto|do|asdf|default|select|please select|blank|empty|undefined".split("|"))


def stands_for_nothing(text: str) -> bool:
    s = " ".join(re.findall(r"[^\W_]+", plain(text)))
    return not s or s in NO_VALUE or len(set(s.replace(" ", ""))) == 1 and len(s) > 1


#: Legal forms with their written forms.
LEGAL = {"limited": "ltd lmtd", "private": "pvt p", "incorporated": "inc", "corporation": "corp corpn", "llp": "", "gmbh": "", "company": "co", "llc": "", "plc": "", "pty": ""}
_LEGAL = {w: k for k, v in LEGAL.items() for w in (k, *v.split())}
#: Words that say what an organisation is or does, with written forms that no rule gives. They are hints:
#: the kinds of a table are learned from it (``Kinds``), and these only help where a table is too small to learn from.
HINTS = {
    "company": {
        "food": "", "insurance": "", "technology": "tech techs", "system": "", "telecommunication": "telco telecom telecoms", "healthcare": "health", "infrastructure": "infra", "pharmaceutical": "pharma", "logistics": "logistic", "motor": "",
        "entertainment": "", "agriculture": "agro agric", "analytics": "analytic", "textile": "", "education": "edu", "consulting": "consultancy", "robotics": "robotic", "engineering": "engg", "energy": "", "chemical": "",
    },
    "institution": {"college": "", "institute": "", "school": "", "academy": "", "university": "", "polytechnic": "", "engineering": "engg", "technology": "tech", "medical": "", "science": "", "art": "", "management": "", "design": ""},
}
#: Words that only join others.
_JOINING = frozenset("and of the fuer de et und y".split())
#: Words that may follow a kind without changing it.
_TAILS = frozenset("mills mill works group".split())
_SPELT = frozenset("llp gmbh llc plc".split())


def _stem(w: str) -> str:
    """A kind in the singular."""
    return w[:-3] + "y" if w.endswith("ies") and len(w) > 5 else w[:-1] if w.endswith("s") and not w.endswith(("ss", "ics")) and len(w) > 3 else w


class Kinds:
    """The words of one label that say what an organisation is, and what is a misspelling, shortening or acronym of them."""

    def __init__(self, label: str, learned: dict[str, int], phrases: tuple[tuple[str, ...], ...] = ()) -> None:
        """learned: frequent words with their numbers; phrases: frequent runs of such words, as they are written."""
        hints = HINTS.get(label, {})
        self.exact: dict[str, str] = {}
        self.full: list[str] = []
        for w, forms in hints.items():
            self._add(w, w)
            for x in forms.split():
                self.exact[x] = w
        for w in sorted(learned, key=lambda w: (-learned[w], w)):
            if is_legal(w) or w in _TAILS:
                continue
            k = self.find(w)
            self._add(k or _stem(w), w)
        self.acronyms: dict[str, str] = {}
        for words in phrases:
            kinds = {k for k in (self.find(w) for w in words if w not in _JOINING) if k}
            for letters in ("".join(w[0] for w in words if w not in _JOINING), "".join(w[0] for w in words if w != "and"), "".join(w[0] for w in words)):
                if 2 <= len(letters) <= 6 and len(kinds) > 1:
                    self.acronyms.setdefault(letters, " ".join(sorted(kinds)))
        self._seen: dict[str, str | None] = {}
        self._index: dict[str, list[str]] | None = None
        self._initial: dict[str, list[str]] = {}

    def _add(self, kind: str, written: str) -> None:
        self.exact.setdefault(written, kind)
        self.exact.setdefault(kind, kind)
        self.full += [w for w in dict.fromkeys((kind, written)) if w not in self.full and len(w) >= 4]
        self._seen, self._index = {}, None

    def find(self, t: str) -> str | None:
        """The kind that t is, misspells or shortens."""
        if t in self.exact:
            return self.exact[t]
        if len(t) < 3:
            return None
        if t not in self._seen:
            if len(self._seen) > 1 << 18:
                self._seen = {}
            self._seen[t] = self._near(t)
        return self._seen[t]

    def _near(self, t: str) -> str | None:
        stem = _stem(t)
        if stem in self.exact:
            return self.exact[stem]
        if self._index is None:
            self._index, self._initial = {}, {}
            for w in dict.fromkeys((*self.full, *self.exact)):
                if len(w) >= 5:
                    for v in deletions(w, self._bound(w)):
                        self._index.setdefault(v, []).append(w)
                    if w in self.full:
                        self._initial.setdefault(w[0], []).append(w)
        if len(t) >= 4:
            found = {w for v in deletions(stem, 2) for w in self._index.get(v, ())}
            close = [(w not in self.full, d, k, w) for k, w in enumerate(self.exact) if w in found and (d := distance(stem, w, self._bound(w))) <= self._bound(w)]
            if close and not min(close)[0]:
                return self.exact[min(close)[3]]
        for w in self._initial.get(t[0], ()):
            for x in (t, stem):
                if shortens(x, w, 4) or len(x) == 3 and (w.startswith(x) or not _VOWELS & set(x[1:]) and shortens(x, w)):
                    return self.exact[w]
        return self.exact[min(close)[3]] if len(t) >= 4 and close else None  # a misspelt shortening

    def _bound(self, w: str) -> int:
        return 2 if len(w) >= 7 and w in self.full else 1


@lru_cache(1 << 16)
def is_legal(t: str) -> str | None:
    """The legal form that t is or misspells."""
    if t in _LEGAL or len(t) < 6:
        return _LEGAL.get(t)
    return next((w for w in LEGAL if len(w) >= 7 and distance(t, w, 1) <= 1), None)


@dataclass(frozen=True)
class Name:
    """An organisation's name in parts: its family names (one if they are written together), kind and legal form."""

    family: tuple[str, ...]
    kind: str = ""
    legal: str = ""


_LETTERS = re.compile(r"\b(?:\w[. ]+){1,3}\w\b\.?")
_INNER = re.compile(r"([^\W\d_A-Z]{3,})(?=[A-Z][^\W\d_A-Z]{3,})")
_PLACE = re.compile(r"(?<=[\w)])[^\w()]*\([^()]{2,}\)")
_APOSTROPHE = re.compile(r"(?<=\w)['’`](?=\w)")
_P = re.compile(r"\(\s*p\s*\)")
_WORDS = re.compile(r"[^\W_]+")


def _spelt_out(s: str) -> str:
    """Letters with points or blanks between them as one word: l.l.p., g m b h, s.o.m."""

    def join(m: re.Match) -> str:
        letters = re.sub(r"\W", "", m.group())
        return letters if letters in _SPELT or re.fullmatch(r"(?:\w\.\s*)+\w\.?", m.group()) else m.group()

    return _LETTERS.sub(join, s) if "." in s or " " in s else s


def _apart(text: str) -> str:
    """Parts before and after a capital within a word are words of their own; all with swapped case is swapped back."""
    letters = [c for c in text if c.isalpha()]
    if letters and letters[0].islower() and sum(c.isupper() for c in letters) * 2 > len(letters):
        text = text.swapcase()
    return _INNER.sub(r"\1 ", text if text.isascii() else unicodedata.normalize("NFC", text))


def split_name(text: str) -> list[list[str]] | None:
    """The words of a typed name in the pieces that commas make; None if it stands for nothing. A place in brackets is left out."""
    if stands_for_nothing(text):
        return None
    s = _spelt_out(_APOSTROPHE.sub("", plain(_apart(text))))
    if "(" in s:
        s = _P.sub(" pvt ", _PLACE.sub("", s))
    return [w for w in (_WORDS.findall(p) for p in s.split(",")) if w] or None


def name_of(pieces: list[list[str]], kinds: Kinds) -> Name | None:
    """Parts of a split name; added places are left out, all other words are kept."""
    # A piece after one that ends the name (with kind or legal form, or two family names) is a place.
    family: list[str] = []
    kind: set[str] = set()
    legal: set[str] = set()
    done = False
    for k, piece in enumerate(pieces):
        f, kd, lg = _parts(piece, kinds, bool(family))
        if k and f and not (kd or lg) and (done or len(family) >= 2 or kind and family):
            continue
        family += f
        kind |= kd if not kind else set()
        legal |= lg
        done = bool(family) and bool(kind or legal) and len(f) > 0
    if "company" in legal and len(legal) > 1:
        legal -= {"company"}
    if not family:  # a name made of kinds alone
        family, kind = sorted(kind), set()
    return Name(tuple(family), " ".join(sorted(kind)), " ".join(sorted(legal))) if family else None


def _parts(words: list[str], kinds: Kinds, named: bool) -> tuple[list[str], set[str], set[str]]:
    family: list[str] = []
    kind: set[str] = set()
    legal: set[str] = set()
    words = [w for w in words if w not in _JOINING]
    k = 0
    while k < len(words):
        t = words[k]
        if (l := is_legal(t)) and (family or kind or named):
            legal.add(l)
        elif t in kinds.acronyms and (len(words) > 1 or not named):
            kind |= set(kinds.acronyms[t].split())
        elif k + 1 < len(words) and (c := kinds.exact.get(t + words[k + 1])):  # health care
            kind.add(c)
            k += 1
        elif t in _TAILS and kind:
            pass
        elif c := kinds.find(t):
            kind.add(c)
        else:
            family.append(t)
        k += 1
    return family, kind, legal


@lru_cache
def hinted(label: str) -> Kinds:
    """The kinds of a label by the hints alone."""
    phrases = ("college of arts and science", "institute of medical sciences", "school of management", "institute of technology", "college of engineering", "academy of design")
    return Kinds(label, {}, tuple(tuple(p.split()) for p in phrases) if label == "institution" else ())


def parse_name(text: str, institution: bool = False) -> Name | None:
    """Parts of a typed name by the hints alone; None if it stands for nothing."""
    pieces = split_name(text)
    return name_of(pieces, hinted("institution" if institution else "company")) if pieces else None
