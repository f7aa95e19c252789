"""Free-typed values to the entries of a reference list (problem 2).

The reference lists (their size is counted) are indexed by symmetric deletes and broadcast: every form of an entry (its
words joined; for companies also their turned order, shortened and blended forms) is entered with up to ``DELETES``
characters of its beginning left out, and a value is looked up with the same deletes of its own, so every form within
``DELETES`` edits and the weighted bound is a candidate. Values of several words are looked up in turned orders and with
shortened words written out; their words are looked up in the same way among the words of the list, and entries all of
whose words were found are aligned with the value. Candidates are ranked by weighted Damerau-Levenshtein distance, then
by how often the entry is written exactly in the data, then by ref_id. Levels, places, versions and remarks around an
entry are left out before: a fixed list of common ones, and what the data put beside many different entries
(``learn_remarks``). Of companies, the parts of the name are compared. What stays without a candidate is reported with 0.

Values are mapped where they are read: no shuffle; each worker builds an index once and remembers the values it has
seen. A list beyond ``MOST_ENTRIES`` is taken in blocks, over the distinct values only, and the best entry is kept.

Defined results: null and blank values and values written exactly as an entry give no row; stand-ins
for no value give 0; repeated rows each give a row; an empty list gives 0 for every value.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.once import once
from rankloom.llm.spelling import deletions, distance, parse_name, plain, shortens, stands_for_nothing, weighted_distance
from rankloom.session import checkpoint, when_small

#: Entries of one broadcast index; longer lists are taken in blocks of this size.
MOST_ENTRIES = 20_000
#: Edits a form may be away, however little they weigh; a form's first PREFIX letters are entered with as many left out.
DELETES = 3
PREFIX = 8
#: Different entries beside which a word must stand, and least share of the values it must stand in, to be a remark.
REMARK_ENTRIES, REMARK_SHARE = 8, 0.0005
WORST = (1e9, 0.0, 0)

#: What the trades call these skills and words of job titles, where no rule gives it.
ALIASES = {
    "skills.name": {
        "js": "javascript", "ecmascript": "javascript", "es6": "javascript", "javascript es6": "javascript", "ts": "typescript", "py": "python", "python3": "python", "pgsql": "postgresql", "psql": "postgresql", "postgres": "postgresql", "mongo": "mongodb",
        "k8s": "kubernetes", "kube": "kubernetes", "tf": "terraform", "tf2": "tensorflow", "torch": "pytorch", "sklearn": "scikit-learn", "sk learn": "scikit-learn", "spark": "apache spark", "pyspark": "apache spark", "spark sql": "apache spark",
        "kafka": "apache kafka", "kafka streams": "apache kafka", "airflow": "apache airflow", "air flow": "apache airflow", "elastic": "elasticsearch", "es": "elasticsearch", "elk": "elasticsearch", "gql": "graphql", "graph ql": "graphql", "springboot": "spring boot",
        "drf": "django", "fast api": "fastapi", "rn": "react native", "reactnative": "react native", "angularjs": "angular", "ng": "angular", "ml": "machine learning", "nlp": "natural language processing", "cv": "computer vision", "ir": "information retrieval", "info retrieval": "information retrieval",
        "recsys": "recommendation systems", "recommender systems": "recommendation systems", "gcp": "google cloud platform", "google cloud": "google cloud platform", "aws": "amazon web services", "amazon aws": "amazon web services", "azure": "microsoft azure", "ms azure": "microsoft azure", "ci": "continuous integration", "ci cd": "continuous integration", "cicd": "continuous integration",
        "dwh": "data warehousing", "pm": "project management", "project mgmt": "project management", "seo": "search engine optimisation", "search engine optimization": "search engine optimisation", "excel": "microsoft excel", "ms excel": "microsoft excel", "powerbi": "power bi", "pbi": "power bi", "ps": "photoshop", "adobe photoshop": "photoshop",
        "ai illustrator": "illustrator", "adobe illustrator": "illustrator", "sfdc": "salesforce", "copywriting": "content writing", "vector db": "vector databases", "vector dbs": "vector databases", "embedded": "embedded programming", "scm": "supply chain planning", "pentest": "penetration testing", "pentesting": "penetration testing", "pen testing": "penetration testing", "agile": "agile delivery", "data modeling": "data modelling", "financial modeling": "financial modelling",
    },
    "experience.title": {
        "sde": "software engineer", "swe": "software engineer", "sr engr": "senior software engineer", "sr eng": "senior software engineer", "sr engineer": "senior software engineer", "sse": "senior software engineer", "mle": "machine learning engineer", "sre": "site reliability engineer", "dba": "database administrator", "qa": "quality assurance engineer",
        "pm": "product manager", "ux": "user experience designer", "ca": "chartered accountant", "bdm": "business development manager", "bd manager": "business development manager", "bd mgr": "business development manager", "sysadmin": "systems administrator", "sys admin": "systems administrator", "em": "engineering manager", "recruiter": "talent acquisition specialist",
    },
}
#: Shortened words; each stands for the words of an entry that begin with it.
WORDS = {
    "sr": "senior", "snr": "senior", "sw": "software", "softw": "software", "engr": "engineer", "eng": "engineer", "engg": "engineering", "dev": "developer", "mgr": "manager", "mngr": "manager", "admin": "administrator", "arch": "architect", "sci": "scientist", "db": "database", "ops": "operations", "vp": "vice president",
    "ml": "machine learning", "nlp": "natural language processing", "qa": "quality assurance", "hr": "human resources", "ux": "user experience", "rel": "reliability", "exec": "executive", "app": "application", "cv": "computer vision", "bi": "bi", "mgmt": "management", "biz": "business", "fin": "financial", "mktg": "marketing", "cust": "customer", "supp": "support", "splst": "specialist",
    "n": "north", "nth": "north", "no": "north", "s": "south", "sth": "south", "so": "south", "e": "east", "w": "west", "wst": "west", "lwr": "lower", "upr": "upper", "ft": "fort", "pt": "port", "st": "saint", "nw": "new",
}
#: Words that only say at what level, where, on what terms or how well.
REMARKS = frozenset("senior junior sr jr lead principal staff chief associate assistant trainee intern interim acting remote hybrid onsite contract contractor permanent temporary part full time fulltime parttime freelance notice days day i ii iii iv v level grade basics basic beginner intermediate advanced expert certified certificate proficient fluent yrs yr years year exp experience v1 v2 v3 version latest city metro area town district region greater skills".split())


@dataclass(frozen=True)
class Column:
    """A typed column and the list its values belong to."""

    field: str
    table: str
    id_col: str
    value_col: str
    where: str | None = None


COLUMNS = (
    Column("experience.title", "experience", "exp_id", "title"),
    Column("experience.company", "experience", "exp_id", "company", "origin = 'form'"),
    Column("locations.city", "locations", "loc_id", "city"),
    Column("skills.name", "skills", "skill_id", "name"),
)


def _bound(n: int) -> float:
    """Weighted edits allowed in a form of n letters."""
    return 0.0 if n < 3 else 0.8 if n < 5 else 2.0 if n < 9 else 2.5 if n < 16 else 3.0


def _edits(n: int) -> int:
    """Edits allowed in a form of n letters, however little they weigh."""
    return 2 if n < 12 else DELETES


class ListIndex:
    """One list, indexed by symmetric deletes of its entries' forms."""

    def __init__(self, field: str, entries: list[tuple[int, str, int]], remarks: frozenset[str] = REMARKS) -> None:
        """entries: (ref_id, canonical, times written exactly)."""
        self.field = field
        self.remarks = remarks
        self.often = {r: n for r, _, n in entries}
        self.company = field.endswith("company")
        self.forms: dict[str, set[int]] = defaultdict(set)
        self.words: dict[int, list[str]] = {}
        self.known: set[str] = set()
        self.names: dict[int, object] = {}
        by_text = {}
        for r, text, _ in entries:
            w = re.findall(r"[^\W_]+", plain(text))
            if not w:
                continue
            self.words[r] = w
            self.known.update(w)
            by_text.setdefault(" ".join(w), r)
            if self.company:
                n = parse_name(text)
                if n:
                    self.names[r] = n
                    for f in self._families(n.family):
                        self.forms[f].add(r)
                continue
            self.forms["".join(w)].add(r)
        self.alias = {}
        for a, c in ALIASES.get(field, {}).items():
            r = by_text.get(" ".join(re.findall(r"[^\W_]+", c)))
            if r:
                self.alias[a] = self.alias[a.replace(" ", "")] = r
        self.deletes = _entered(self.forms)
        self.longest = max(map(len, self.forms), default=0)
        self.masks = {f: _letters(f) for f in self.forms}
        # The words of the list, for entries that are found word by word.
        self.holding: dict[str, set[int]] = defaultdict(set)
        for r, w in self.words.items() if not self.company else ():
            for x in w:
                self.holding[x].add(r)
        self.word_deletes = _entered(self.holding, 2)
        self.lettered: dict[tuple[str, str], set[str]] = defaultdict(set)
        for x in self.holding:
            for c in set(x):
                self.lettered[x[0], c].add(x)
        self.matched = lru_cache(1 << 16)(self._matched)

    @staticmethod
    def _families(family: tuple[str, ...]) -> set[str]:
        """How a pair of family names may be written: joined, blended from first letters, one of them shortened."""
        if len(family) != 2:
            return {"".join(family), "".join(sorted(family))}
        out = set()
        for a, b in (family, family[::-1]):
            out |= {a + b, a[:5] + b[:5], a[:3] + b, a[:4] + b, a + b[:3], a + b[:4]}
        return out

    def near(self, s: str, bound: float) -> dict[int, float]:
        """ref_id -> distance of the entries with a form within the bound and DELETES edits."""
        if s in self.forms:
            return dict.fromkeys(self.forms[s], 0.0)
        out: dict[int, float] = {}
        if bound <= 0 or len(s) > self.longest + DELETES:
            return out
        own = _letters(s)
        for f in _within(self.deletes, s, _edits(len(s) + DELETES)):
            if (own & ~self.masks[f]).bit_count() > _edits(len(f)) or (self.masks[f] & ~own).bit_count() > _edits(len(f)):
                continue  # an edit brings or takes one letter
            most = bound if self.company else min(bound, _bound(len(f) if len(s) >= 4 else len(s)))
            x = weighted_distance(s, f, most)
            if x <= most and distance(s, f, DELETES) <= _edits(len(f)):
                for r in self.forms[f]:
                    out[r] = min(x, out.get(r, 99.0))
        return out

    def _best(self, found: dict[int, float]) -> int:
        return min(found, key=lambda r: (round(found[r], 3), -self.often[r], r)) if found else 0

    def find(self, value: str) -> int:
        """ref_id of the entry meant, or 0."""
        return self.match(value)[1]

    def match(self, value: str) -> tuple[tuple[float, float, int], int]:
        """(how well, the smaller the better; ref_id of the entry meant), or (worst, 0)."""
        if stands_for_nothing(value):
            return WORST, 0
        level, found = (0, self._company(value)) if self.company else self._words(value)
        r = self._best(found)
        return ((level * 100 + round(found[r], 3), -self.often[r], r), r) if r else (WORST, 0)

    # Values made of words: titles, skills, cities.

    def _words(self, value: str) -> tuple[int, dict[int, float]]:
        """How much had to be left out, and the candidates."""
        for level, text in enumerate(self._without_remarks(plain(_split_capitals(value)))):
            w = re.findall(r"[^\W_]+", text)
            if w and (found := self._candidates(w)):
                return level, found
        return 0, {}

    def _without_remarks(self, s: str) -> list[str]:
        """The value as it is, then without what is added to it, most cautious first."""
        out = [s]
        t = re.sub(r"[\(\[\{<][^()\[\]{}<>]*[\)\]\}>]", " ", s)
        out.append(t)
        for sep in (r"\s+[-–—/|:]\s+", r"\s*[,;|]\s*", r"\s+[-–—/|:]\s*|\s*[,;|]\s*"):
            head = re.split(sep, t.strip(" -–—/|:,;."))[0]
            out.append(head)
        u = re.sub(r"#\s*\d+|\b(?:l|v|lvl|level|grade)\s*[.:]?\s*\d+(?:\.\d+)*\b|\b\d+(?:\.\d+)*\b", " ", t)
        out.append(u)
        w = re.findall(r"[^\W_]+", u)
        a, b = 0, len(w)
        while b > a and w[b - 1] in self.remarks:
            b -= 1
        out.append(" ".join(w[a:b]))
        while a < b and w[a] in self.remarks:
            a += 1
        out.append(" ".join(w[a:b]))
        return list(dict.fromkeys(x for x in out if x.strip()))

    def _candidates(self, w: list[str]) -> dict[int, float]:
        joined = "".join(w)
        r = self.alias.get(" ".join(w)) or self.alias.get(joined)
        if r:
            return {r: 0.0}
        bound = _bound(len(joined) + 2 if len(joined) >= 4 else len(joined))
        found = self.near(joined, bound)
        if found and min(found.values()) == 0:
            return found
        for k in range(1, len(w)) if len(joined) <= self.longest + DELETES else ():  # turned order: "engineer, data"
            for x, d in self.near("".join(w[k:] + w[:k]), bound).items():
                found[x] = min(d + 0.05, found.get(x, 99.0))
        for x, d in self._spelt_out(tuple(w)).items():
            found[x] = min(d + 0.1, found.get(x, 99.0))
        if not found or min(found.values()) > 0.5:
            for x, d in self._aligned(w).items():
                found[x] = min(d, found.get(x, 99.0))
        return found

    def _spelt_out(self, w: tuple[str, ...]) -> dict[int, float]:
        """Shortened words written out: by the table, in either of their senses, and single letters joined.

        More than six words of several senses are more than any entry is made of; such values are left to ``_aligned``,
        which takes each word in all its senses.
        """
        out: dict[int, float] = {}
        w = _joined_letters(w)
        senses = [[x] + ([WORDS[x]] if x in WORDS else []) + (["saint"] if x == "s" else []) + (["engineering"] if x == "eng" else []) for x in w]
        if sum(len(s) > 1 for s in senses) > 6:
            return out
        options: list[list[str]] = [[]]
        for s in senses:
            options = [o + [x] for o in options for x in s]
        for o in options[1:] if tuple(options[0]) == tuple(w) else options:
            if sum(map(len, o)) > self.longest + DELETES + len(o):
                continue
            for k in range(len(o)):
                f = "".join(o[k:] + o[:k]).replace(" ", "")
                for x, d in self.near(f, _bound(len(f)) / 2).items():
                    out[x] = min(d + 0.05 * (k > 0), out.get(x, 99.0))
        return out

    def _matched(self, x: str) -> frozenset[str]:
        """Words of the list that x is, misspells, shortens or stands for."""
        out = {y for y in WORDS.get(x, "").split() if y in self.holding} | ({"saint"} if x == "s" else set()) | {x}
        out |= {y for y in _within(self.word_deletes, x, 2) if _word_cost(x, y) < 9}
        with_all = [self.lettered.get((x[0], c), set()) for c in set(x)]
        out |= {y for y in set.intersection(*with_all) if shortens(x, y)} if len(x) >= 3 else set()
        return frozenset(y for y in out if y in self.holding)

    def _aligned(self, w: list[str]) -> dict[int, float]:
        """Entries all of whose words are there in order, each exact, misspelt, shortened or by its table; the rest must be remarks."""
        out: dict[int, float] = {}
        w = list(_joined_letters(tuple(w)))
        there = {y for x in w for y in self.matched(x)}
        often: dict[int, int] = defaultdict(int)
        for y in there:
            for r in self.holding[y]:
                often[r] += 1
        for r, n in often.items():
            words = self.words[r]
            if n < len(set(words)) or len(words) < 2:
                continue
            for k in range(len(w)):
                fit = self._fit(w, k, words)
                if fit:
                    cost, end = fit
                    rest = w[:k] + w[end:]
                    if cost <= 2.6 and all(x in self.remarks or x.isdigit() for x in rest):
                        out[r] = min(cost + 0.3 + 0.01 * len(rest), out.get(r, 99.0))
        return out

    @staticmethod
    def _fit(w: list[str], k: int, words: list[str]) -> tuple[float, int] | None:
        """(cost, where it ends) of the words read from the k-th typed word on."""
        cost, j = 0.0, 0
        while j < len(words):
            if k >= len(w):
                return None
            stands = WORDS.get(w[k], "").split()
            if len(stands) > 1 and words[j : j + len(stands)] == stands:
                cost, j = cost + 0.1, j + len(stands)
            else:
                cost, j = cost + _word_cost(w[k], words[j]), j + 1
            if cost > 2.6:
                return None
            k += 1
        return cost, k

    # Companies.

    def _company(self, value: str) -> dict[int, float]:
        n = parse_name(value)
        if n is None:
            return {}
        found: dict[int, float] = {}
        f = n.family
        tries = {"".join(f)} | ({"".join(f[::-1])} if len(f) > 1 else set())
        for s in tries:
            bound = 1.7 if len(s) <= 11 else 3.6
            for r, d in self.near(s, bound).items():
                found[r] = min(d, found.get(r, 99.0))
        # The kind must agree; without one, a legal form or the only company of these families decides.
        if n.kind:
            found = {r: d for r, d in found.items() if self.names[r].kind == n.kind}
        best = min(found.values(), default=0)
        close = [r for r, d in found.items() if d <= best + 0.5]
        if len(close) > 1 and n.legal:
            close = [r for r in close if self.names[r].legal == n.legal] or close
        return {r: found[r] for r in close}


def _letters(s: str) -> int:
    m = 0
    for c in s:
        m |= 1 << (ord(c) & 63)
    return m


def _entered(words, most: int = DELETES) -> dict[str, list[str]]:
    """The symmetric-delete dictionary of the words."""
    out: dict[str, list[str]] = defaultdict(list)
    for f in words:
        for d in deletions(f[:PREFIX], most):
            out[d].append(f)
    return out


def _within(entered: dict[str, list[str]], s: str, most: int = DELETES) -> set[str]:
    return {f for d in deletions(s[:PREFIX], most) for f in entered.get(d, ()) if abs(len(f) - len(s)) <= most}


def _split_capitals(s: str) -> str:
    return re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z]{2})", " ", s)


def _joined_letters(w: tuple[str, ...]) -> tuple[str, ...]:
    """Single letters side by side as one word: q a engineer -> qa engineer."""
    out: list[str] = []
    letters = ""
    for x in (*w, ""):
        if len(x) == 1:
            letters += x
            continue
        if letters:
            out.append(letters)
            letters = ""
        if x:
            out.append(x)
    return tuple(out)


@lru_cache(1 << 16)
def _word_cost(x: str, y: str) -> float:
    if x == y:
        return 0.0
    if WORDS.get(x) == y or x == "s" and y == "saint":
        return 0.1
    if shortens(x, y):
        return 0.2
    b = 2 if len(y) >= 5 else 1
    d = distance(x, y, b)
    return float(d) if d <= b and len(y) > 3 else 9.0


def learn_remarks(rows: DataFrame, lists: dict[str, list[tuple[int, str, int]]]) -> dict[str, frozenset[str]]:
    """Per list the words that stand beside many different entries in the values: bounded by the share they must have."""
    sent = rows.sparkSession.sparkContext.broadcast({f: {" ".join(re.findall(r"[^\W_]+", plain(t))): r for r, t, _ in e} for f, e in lists.items()})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        longest = {f: max((k.count(" ") + 1 for k in d), default=0) for f, d in sent.value.items()}

        @lru_cache(1 << 18)
        def beside(field: str, value: str) -> tuple[tuple[str, int], ...]:
            w = re.findall(r"[^\W_]+", plain(value))
            known = sent.value.get(field, {})
            for n in range(min(longest.get(field, 0), len(w) - 1), 0, -1):
                for k in range(len(w) - n + 1):
                    r = known.get(" ".join(w[k : k + n]))
                    if r is not None:
                        return tuple((x, r) for x in set(w[:k] + w[k + n :]) if not x.isdigit())
            return ()

        for b in batches:
            rows = [(f, x, r) for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x, r in beside(f, v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["field", "word", "ref_id"])

    total = F.sum("n").over(Window.partitionBy("field"))
    pairs = rows.select("field", "value").mapInArrow(run, "field string, word string, ref_id long").groupBy("field", "word", "ref_id").agg(F.count("*").alias("n"))
    words = pairs.groupBy("field", "word").agg(F.sum("n").alias("n"), F.count("*").alias("entries")).where(F.col("entries") >= REMARK_ENTRIES).withColumn("all", total).where(F.col("n") >= REMARK_SHARE * F.col("all"))
    out: dict[str, set[str]] = defaultdict(set)
    for r in words.collect():
        out[r.field].add(r.word)
    return {f: REMARKS | out[f] for f in lists}


def match_columns(tables: dict[str, DataFrame], refs: DataFrame, columns: tuple[Column, ...] = COLUMNS) -> DataFrame:
    """field, row_id, ref_id for each value of the columns that isn't written exactly as an entry."""
    spark = refs.sparkSession
    refs = refs.select("field", F.col("ref_id").cast("long").alias("ref_id"), F.col("canonical").alias("value")).where("value IS NOT NULL")
    blocks = max(1, -(-refs.count() // MOST_ENTRIES))
    typed = []
    for c in columns:
        d = tables[c.table].where(c.where) if c.where else tables[c.table]
        typed.append(d.select(F.lit(c.field).alias("field"), F.col(c.id_col).cast("long").alias("row_id"), F.col(c.value_col).cast("string").alias("value")))
    rows = typed[0]
    for d in typed[1:]:
        rows = rows.unionByName(d)
    rows = rows.where(F.col("value").rlike(r"(?U)\S"))
    exact = rows.join(when_small(refs.select("field", "value", F.lit(True).alias("same")).distinct()), ["field", "value"], "left")
    # How often each entry is written exactly: one row per entry.
    often = exact.where("same").groupBy("field", "value").agg(F.count("*").alias("n"))
    counted = refs.join(often, ["field", "value"], "left").select("field", "ref_id", "value", F.coalesce("n", F.lit(0)).alias("n"))
    others = exact.where("same IS NULL").select("field", "row_id", "value")
    shape = "field string, value string, cost double, rare double, ref_id long"
    # Of long lists, only the distinct values are taken through the blocks.
    todo = others if blocks == 1 else checkpoint(others.select("field", "value").distinct())
    found = None
    for k in range(blocks):
        part = counted if blocks == 1 else counted.where(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == k)
        lists: dict[str, list[tuple[int, str, int]]] = {c.field: [] for c in columns}
        for r in part.collect():  # a block of at most about MOST_ENTRIES
            lists.setdefault(r.field, []).append((r.ref_id, r.value, r.n))
        remarks = learn_remarks(todo, {f: e for f, e in lists.items() if not f.endswith("company")})
        sent = spark.sparkContext.broadcast((lists, remarks))
        token = uuid.uuid4().hex

        def run(batches: Iterator, sent=sent, token=token) -> Iterator:
            import pyarrow as pa

            def build():
                lists, remarks = sent.value
                index = {f: ListIndex(f, e, remarks.get(f, REMARKS)) for f, e in lists.items()}
                return lru_cache(1 << 18)(lambda f, v: index[f].match(v)[0])

            match = once(token, build)
            for b in batches:
                fields, values = b.column("field"), b.column("value")
                got = [match(f, v) for f, v in zip(fields.to_pylist(), values.to_pylist(), strict=True)]
                scores = [pa.array([g[j] for g in got], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]
                ids = [b.column("row_id"), scores[2]] if "row_id" in b.schema.names else [values, *scores]
                yield pa.RecordBatch.from_arrays([fields, *ids], names=["field", "row_id", "ref_id"] if len(ids) == 2 else [x.split(" ")[0] for x in shape.split(", ")])

        if blocks == 1:
            return todo.mapInArrow(run, "field string, row_id long, ref_id long")
        d = todo.mapInArrow(run, shape)
        found = d if found is None else found.unionByName(d)
    best = found.groupBy("field", "value").agg(F.min(F.struct("cost", "rare", "ref_id")).alias("best"))
    return others.join(best, ["field", "value"]).select("field", "row_id", F.col("best.ref_id").alias("ref_id"))
