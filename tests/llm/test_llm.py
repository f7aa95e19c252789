"""Operators on text and names: edge cases, brute force, exact round trips, held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import bpe, canon, leak, names, residue, spelling
from rankloom.llm.normal import offsets, stream, words

ODD = ["", " ", "\n\n", "a", "é", "日本語テキスト", "👩🏽‍💻🏳️‍🌈", "​ x y", "<|endoftext|> is text", "x" * 5000, "don't we'll I'VE", "  two  spaces ", "0123 ٣٤٥", "\t\r\n mixed\t", "".join(map(chr, range(1, 400)))]


# Encoding.


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Encoder(f.read(), window=300)


def test_ids_equal_a_reference_encoder(encoder):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randrange(1, 900))) for a in ("ab", "the ing", "aeiou \n", "é日本", "_-=.", "01 \t", " '\"s") for _ in range(25)]
    decoder = bpe.Decoder(encoder.v)
    for t in texts:
        ids = encoder.encode(t)
        assert ids == other.encode_ordinary(t)
        assert decoder.decode(ids) == t
    assert encoder.encode(None) == [] and encoder.encode("") == []


def test_transducer_memory_is_bounded(encoder):
    t = bpe.Transducer(encoder.v)
    most = 0
    for _ in range(60):
        t.feed(b"abcdefghij" * 100)
        most = max(most, len(t.tail))
    t.finish()
    assert most <= 12 * encoder.v.lookahead


def test_ids_over_a_table(spark):
    d = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hello", 7), (3, "hello", 7)], "doc_id long, text string, ids int")
    got = bpe.encode_column(d).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert bpe.encode_column(d.limit(0)).count() == 0
    assert {r.text for r in bpe.decode_column(bpe.encode_column(d)).collect()} == {"", "hello"}


# Leaks.

ITEM = "Given kiln temperatures through paired gateways, justify a fairness check so that eighty four gateways suffice before the audit ends and nobody asks again"


def held(text, item=ITEM):
    return bool(leak.Automaton([(1, item)], leak.Rule()).find(text))


def test_passages_and_disguises():
    w = ITEM.split()
    part = " ".join(w[3:21])
    assert held(f"x {ITEM} y") and held(part) and held(part.upper()) and held("<p>" + part.replace(" ", " </b>\n") + "</p>") and held(part.replace(" ", "   ")) and held(part.replace("e", "е"))
    assert held(part.replace("justify", "jus-\ntify").replace("gateways", "gate​ways")) and held("".join(c + "́" if c == "a" else c for c in part)) and held(part.replace(" ", "\n// "))
    changed = w[:]
    changed[8] = "defend"
    assert held(" ".join(changed)) and held(" ".join(w[:5] + w[6:])) and held(" ".join(w[:7] + ["really"] + w[7:]))
    assert not held(" ".join(w[:10])) and not held("Kilns and gateways and audits are what we work on every day in this team, and fairness matters.") and not held("") and not held("  ")
    assert not held(" ".join(reversed(w)))


def test_short_items_count_whole():
    assert held("we said: bounded error first, always", "Bounded error first") and not held("bounded error", "Bounded error first")


def test_offsets_map_back():
    t = "Ａb <i>c</i> &eacute;-ßx"
    s, o = stream(t), offsets(t)
    assert s == "abcessx" and [t[i] for i in o] == ["Ａ", "b", "c", "&", "ß", "ß", "x"]
    assert words("I'VE don't") == ["ive", "dont"]


def test_leaks_against_brute_force():
    rng = random.Random(2)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}ord" for i in range(12) for j in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 50)))) for i in range(30)]
    auto = leak.Automaton(items, leak.Rule())
    for _ in range(200):
        i, t = rng.choice(items)
        w = t.split()
        n = rng.randrange(5, len(w) + 1)
        at = rng.randrange(0, len(w) - n + 1)
        doc = " ".join(rng.choice(vocab) for _ in range(40)) + " . " + " ".join(w[at : at + n]) + " . " + " ".join(rng.choice(vocab) for _ in range(40))
        found = {x[0] for x in auto.find(doc)}
        assert (i in found) == (n >= 15), (n, found)


def test_changed_words_and_turns_of_phrase():
    rng = random.Random(12)
    word = lambda: "w" + "".join(rng.choice("bcdfghklm") for _ in range(5))
    pattern = "a returning contractor has {} minutes to {} the {} then the {} before the audit ends".split()
    fill = lambda: [word() if x == "{}" else x for x in pattern]
    items = [(k, " ".join([*(word() for _ in range(20)), *fill(), *(word() for _ in range(20))])) for k in range(6)]
    auto = leak.Automaton(items, leak.Rule())
    assert not auto.find(" ".join(fill()))  # another filling of the same sentence
    w = items[2][1].split()
    for n in (15, 16, 17):
        for at in range(0, 3):
            part = w[at : at + n]
            for k, m in ((5, 5), (5, 9)):  # one or two single words changed
                part[k] = part[m] = word()
            assert [x[0] for x in auto.find(" ".join(part))] == [2], (n, at)


def test_no_passage_is_lost_behind_near_misses():
    rng = random.Random(3)
    item = [f"v{chr(97 + i // 6)}{chr(97 + i % 6)}ord" for i in range(40)]
    near = item[:]
    for k in range(5, 40, 8):  # five words of eight agree, so these chains score more than 15 words and agree too little
        near[k : k + 3] = ["zzzzord", "yyyyord", "xxxxord"]
    odd = lambda n: " ".join(f"k{rng.randrange(10**6)}" for _ in range(n))
    before = " . ".join(" ".join(near) + " " + odd(80) for _ in range(12))
    text = " ".join(item)
    assert not held(before, text) and held(" ".join(item[10:25]), text)
    assert held(before + " " + " ".join(item[10:25]) + " " + odd(20), text) and held(" ".join(item[10:25]) + " " + odd(80) + " " + before, text)


def test_leaks_over_a_table(spark):
    docs = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "z " * 200_000 + ITEM, 0), (1, ITEM, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "..."), (10, ITEM)], "item_id long, text string")
    got = leak.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(d, i) for d in (1, 1, 4) for i in (7, 10)])
    assert leak.find_leaks(docs, items.limit(0)).count() == 0 and leak.find_leaks(docs.limit(0), items).count() == 0


# Residue.

PROSE = ["The team designs data contracts for two offices.", "Strong in Python, SQL and planning.", "Interviews take three rounds, the last one with the director.", "Notice period is 30 days.", "Cut HTTP 404 and 502 rates by 12 percent after a review of redirects.", "Maintained mail templates in which fields such as {{first_name}} or ${city} are replaced before a message leaves.", "Replaced lorem ipsum copy in 7 mockups by reviewed wording."]


def prose(rng, n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


@pytest.fixture(scope="module")
def models():
    rng = random.Random(4)
    m = residue.Models(residue.Settings())
    return m.with_prose(residue.Counts(m.grams).add([prose(rng, 8) + f" Entry {k} of the list." for k in range(400)]))


def test_held_out_residue(models):
    rng = random.Random(9)
    left = [
        "Hybrid work, {{ notice_period }} days a week.", "As [company name], designed reports.", "Page not found: the address you entered does not exist on this server.", "Kindly switch on JavaScript in your settings to view the posting.", "amet porta nibh lorem velit dolor lectus ipsum mattis", "Bitte aktivieren Sie jetzt JavaScript im Browser, um diese Stelle zu sehen.",
        "Your session timed out; please sign in once more to continue.", "Write some text about yourself here.", "<%= job_title %> at %%company%%", "Vous devez autoriser JavaScript pour voir cette offre.", "Se ha producido un error; vuelva a intentarlo.",
    ]
    made = {x.strip().lower() for v in residue.examples().values() for x in v}
    for x in left:
        assert x.lower() not in made
        assert models.windows(prose(rng, 3) + " " + x + " " + prose(rng, 3)), x
        assert models.windows(x), x
    clean = [prose(rng, 8) for _ in range(100)]
    assert not any(models.judge(t) for t in clean)


def test_residue_over_a_table(spark, models):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose(rng, 4)), (5, prose(rng, 2) + " Please enable JavaScript to view this page. "), (5, "Please enable JavaScript to view this page."), (6, prose(rng, 20_000) + " {{company_name}} "), (7, "İ" * 50 + " Please enable JavaScript to view this page.")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit(1))
    got = residue.find_residue(d, models=models).collect()
    assert sorted(r.doc_id for r in got) == [5, 5, 6, 7] and all(0 < r.coverage <= 1 for r in got)
    assert residue.find_residue(d.limit(0), models=models).count() == 0
    assert residue.find_residue(d.where("doc_id < 4")).count() == 0  # no prose to fit on


def test_segments_against_one_pass_over_all_places():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        r = rng.normal(-0.4, 1.5, rng.integers(0, 200))
        one, other = residue._segments(r, 4.0), residue._climbs(r.tolist(), 4.0)
        assert [x[:2] for x in one] == [x[:2] for x in other] and np.allclose([x[2] for x in one], [x[2] for x in other])


def test_neighbours_do_not_matter(models):
    rng = random.Random(15)
    texts = [prose(rng, 3), "404 Not Found", prose(rng, 2) + " ${", "city} " + prose(rng, 1), "", "Please enable JavaScript to view this page.", "İ " + prose(rng, 1) + " {{company_name}} "]
    assert models.windows_of(texts) == [models.windows_of([t])[0] for t in texts] == [models.windows(t) for t in texts]


def test_short_notices_by_coverage(models):
    short = "Sign in again."
    assert models.judge(short) and models.judge(short)[0] > 0.5
    assert not models.judge("The team designs data contracts for two offices. Interviews take three rounds.")


def test_models_fitted_on_the_workers_and_saved(spark, tmp_path):
    rng = random.Random(14)
    said = "Maintained mail templates in which fields such as {{first_name}} or ${city} are replaced before a message leaves."
    texts = [prose(rng, 6) + f" Entry {k} of the list." for k in range(300)] + [said + f" Number {k}." for k in range(40)] + ["Please enable JavaScript to view this page."] * 5
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for parts in (1, 3):
        m = residue.fit(d.repartition(parts))
        assert sorted(r.doc_id for r in residue.find_residue(d, models=m).collect()) == [340, 341, 342, 343, 344]
    residue.save(m, spark, str(tmp_path / "model"))
    again = residue.load(spark, str(tmp_path / "model"))
    assert all((getattr(again.prose, n) == getattr(m.prose, n)).all() for n in ("joint", "context", "base"))
    assert [again.judge(t) for t in texts[-50:]] == [m.judge(t) for t in texts[-50:]]


# Names.


def test_distances_against_brute_force():
    rng = random.Random(6)

    def osa(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    strings = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(120)]
    trie = names.Trie()
    for k, s in enumerate(strings):
        if s:
            trie.add(s, k)
    for a in strings[:40]:
        near = {p: d for d, p in trie.near(a, 2)}
        for k, b in enumerate(strings):
            true = osa(a, b)
            assert spelling.distance(a, b, 3) == min(true, 4)
            if b and a:
                assert near.get(k) == (true if true <= 2 else None), (a, b)
        assert spelling.weighted_distance(a, a, 1.0) == 0


def test_names_in_parts():
    p = spelling.parse_name
    full = p("Bafenta & Dorvorgo Technologies Private Limited")
    assert (full.family, full.kind, full.legal) == (("bafenta", "dorvorgo"), "technology", "limited private")
    for t in ("bafenta and dorvorgo techs pvt. ltd.", "BAFENTA / DORVORGO TECHNOLOG. P. LTD., South Town", "Technologies, Bafenta Dorvorgo", "Dorvorgo, Bafenta - Tech", "Bafèñta + Dorvorgo Tech (Old Town)", "bAFENTA dORVORGO tECHNOLOGIES"):
        n = p(t)
        assert sorted(n.family) == ["bafenta", "dorvorgo"] and n.kind == "technology", t
    assert p("Rompim Tolrir CAS", True).kind == p("Rompim Tolrir Coll. of Arts & Sci.", True).kind == p("College of Arts and Science, Rompim Tolrir", True).kind == "art college science"
    assert all(p(t) is None for t in ("", "  ", "n/a", "??", "see resume", "xxx", "-"))
    assert p("International Business Machines Corp").family == ("international", "business", "machines")
    assert p("Bafenta Dorvorgo Law School", True).family == ("bafenta", "dorvorgo", "law") and p("Bafenta & Dorvorgo Foods (Old Town) (North Side), Upper Vale").family == ("bafenta", "dorvorgo")


def test_spellings_linked(spark):
    texts = [
        "Bafenta & Dorvorgo Foods Limited", "bafenta dorvorgo foods ltd", "Dorvorgo, Bafenta - Foods", "Bafenat & Dorvorgo Foods", "Baf. & Dorvorgo Foods Limited", "BafentaDorvorgo Foods", "Bafendorvo Foods", "Bafenta & Dorvorgo",
        "Bafenta & Dorvorgo Motors GmbH", "Kesbahi Hesdilden Energy LLP", "Kesbahi Hesdilden Energy L.L.P.", "Unrelated Otherwise Systems", None, "", "n/a", "see resume", "Bafenta & Dorvorgo Foods Limited",
    ]
    rows = spark.createDataFrame([("company", i, t, "c") for i, t in enumerate(texts)], "label string, id long, text string, comp string")
    got = {(r.id_a, r.id_b) for r in names.find_spellings(rows.select("label", "id", "text")).collect()}
    foods = [0, 1, 2, 3, 4, 5, 6, 16]
    assert got == {(a, b) for a in foods for b in foods if a < b and texts[a] != texts[b]} | {(9, 10)}
    assert names.find_spellings(rows.select("label", "id", "text").limit(0)).count() == 0


def test_hot_family_names_are_split(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT", 5)
    base = ["galbirdil", "venmorkas", "tirzonpes", "lolsesges", "harfenbok", "mensosnon", "yudsisrar", "kospomil"]
    texts = [f"Bafenta & {b.title()} Foods" for b in base] + [f"Bafenta & {(b[:3] + b[4:]).title()} Foods Ltd" for b in base]
    rows = spark.createDataFrame([("company", i, t) for i, t in enumerate(texts)], "label string, id long, text string")
    got = {(r.id_a, r.id_b) for r in names.find_spellings(rows).collect()}
    assert got == {(i, i + len(base)) for i in range(len(base))}


def test_links_do_not_depend_on_where_shards_are_split(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ba", "fen", "tir", "mor", "gal", "ven", "kos", "dil"]) for _ in range(3))
    slip = lambda w: (lambda k: rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "q" + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]]))(rng.randrange(len(w)))
    texts = []
    for other in [word() for _ in range(30)]:
        a, b = "guptasharan", other
        for x, y in ((a, b), (b, a), (slip(a), b), (a, slip(slip(slip(b)))), (slip(a), slip(slip(b))), (a, b[:3] + "."), (a, slip(b[:4])), (slip(a), b[:4])):
            texts.append(f"{x.title()} & {y.title()} Foods")
        texts += [f"{(a + b).title()} Foods", f"{(b + slip(a)).title()} Foods", f"{(a[:5] + b[:5]).title()} Foods", f"{slip(b[:5] + a[:5]).title()} Foods", f"{a.title()} & {b.title()}", f"{a.title()} {b.title()} {word().title()} Foods"]
    rows = spark.createDataFrame([("company", i, t) for i, t in enumerate(texts)], "label string, id long, text string")

    def links():
        parsed, nodes = names._nodes(rows)
        named = {r.node: (r.family, r.kind) for r in nodes.collect()}
        return {frozenset((named[r.a], named[r.b])) for r in names._links(names._divided(names._members(nodes)), {}).collect()}

    monkeypatch.setattr(names, "HOT", 10**9)
    whole = links()
    assert len(whole) > 300
    for hot in (40, 3):
        monkeypatch.setattr(names, "HOT", hot)
        assert links() == whole, hot


def test_shards_are_streamed(spark):
    """Shards go to the workers row by row, not as lists that the JVM collects, and may go on in the next batch."""
    families = ["tamirosko belandari", "tamirosko belandori", "tamirosko velandari", "tamirasko belandari", "kolpenditu belandari", "tamirosko"]
    nodes = spark.createDataFrame([(k, "company", f, "foods") for k, f in enumerate(families)], "node long, label string, family string, kind string")

    def links():
        words = spark.createDataFrame([(f"T{w}/company", w) for w in {w for f in families for w in f.split()}], "key string, token string")
        found, near = names._links(names._divided(names._members(nodes)), {}), names._near_words(words)
        for d in (found, near):
            plan = d._jdf.queryExecution().toString()
            assert "collect_list" not in plan and "collect_set" not in plan and "ObjectHashAggregate" not in plan
        return {tuple(r) for r in found.collect()}, {frozenset((r.a, r.b)) for r in near.collect()}

    whole = links()
    assert {(0, 1, 1), (0, 2, 1), (0, 3, 1)} <= whole[0] and not any(4 in r[:2] for r in whole[0])
    assert whole[1] == {frozenset(("belandari", "belandori")), frozenset(("belandari", "velandari")), frozenset(("tamirosko", "tamirasko"))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert links() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_links_against_all_pairs():
    rng = random.Random(22)
    families = [["".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))), "".join(rng.choice("abc") for _ in range(rng.randrange(4, 9)))] for _ in range(120)]
    shards = {}
    for k, f in enumerate(families):
        for key, role, t, o in names.memberships(f):
            shards.setdefault(key, []).append((role, k, t, o, "food", 0))
    toks = sorted({t for f in families for t in f})
    for t in toks:  # every neighbour's members, as the routes bring them
        for u in toks:
            if t < u and (len(t) > 4 or len(u) > 4) and spelling.distance(t, u, 1) == 1:
                shards["T" + t] += [m for m in shards["T" + u] if m[0] == "T" and m[2] == u]
    found = set()
    for key, ms in shards.items():
        if key[0] == "T":
            found |= {(a, b) for a, b, _ in names.links_of_shard(key, ms, {})}
    for a in range(len(families)):
        for b in range(a + 1, len(families)):
            for f, g in ((families[a], families[b]), (families[a], families[b][::-1])):
                d = [spelling.distance(x, y, 4) for x, y in zip(f, g, strict=True)]
                close = min(d) == 0 or min(d) == 1 and any(spelling.distance(x, y, 1) == 1 and (len(x) > 4 or len(y) > 4) for x, y in zip(f, g, strict=True))
                short = all(e <= max(names._allowed(len(x)), names._allowed(len(y))) for e, x, y in zip(d, f, g, strict=True))
                if sum(d) <= names.BOUND and close and short and all(len(x) >= 7 for x in (*f, *g)):
                    assert (a, b) in found, (f, g)


def test_kinds_are_learned_from_the_table(spark):
    rng = random.Random(23)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(4))
    made = [(f"{word()} {word()}", k) for k in ("Breweries", "Shipyards", "Law Offices") for _ in range(80)]
    texts = [f"{f} {k}" for f, k in made] + [f"{f.upper()} {k[:5]}." for f, k in made[:20]] + [f"{made[0][0]} Shipyards", f"{made[0][0]} Brewries"]
    rows = spark.createDataFrame([("company", i, t) for i, t in enumerate(texts)], "label string, id long, text string")
    kinds = names.learn_kinds(names._mapped(rows.select("label", "text"), "label string, text string, name string", names._split))["company"]
    assert kinds.find("breweries") == kinds.find("brewries") == kinds.find("brewe") == "brewery" and kinds.find("shipyards") and kinds.find("law") and not kinds.find(made[0][0].split()[0])
    got = {(r.id_a, r.id_b) for r in names.find_spellings(rows).collect()}
    assert (0, 240) in got and (0, len(texts) - 1) in got and not any(len(texts) - 2 in p for p in got)


def test_clusters(spark):
    rows = spark.createDataFrame([("company", 5, "Bafenta & Dorvorgo Foods"), ("company", 3, "Bafenta & Dorvorgo Foods"), ("company", 9, "bafenta dorvorgo foods ltd"), ("company", 4, "Kesbahi Hesdilden Energy"), ("company", 8, None), ("institution", 1, "Bafenta Dorvorgo")], "label string, id long, text string")
    assert sorted(tuple(r) for r in names.cluster_rows(rows).collect()) == [("company", 3, 3, 1), ("company", 4, 4, 0), ("company", 5, 3, 1), ("company", 9, 3, 2), ("institution", 1, 1, 0)]
    assert names.cluster_rows(rows.limit(0)).count() == 0 and names.undecided(rows).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001)], "a long, b long")
    assert {r.comp for r in names.components(edges).where("node < 1000").collect()} == {0}


# Reference lists.

LIST = [(1, "Data Engineer"), (2, "Senior Software Engineer"), (3, "Software Engineer"), (4, "Human Resources Manager")]


def test_values_to_entries():
    ix = canon.ListIndex("experience.title", [(r, t, 1) for r, t in LIST])
    for v, want in {"data enginer": 1, "Engineer, Data": 1, "DATA_ENGINEER (remote)": 1, "Data Engineer II": 1, "Sr SW Engr": 2, "s/w engr.": 3, "HR Mgr": 4, "H.R. Manager": 4, "DataEngineer": 1, "dta enginere": 1, "Lead Data Engineer": 1, "Baker": 0, "n/a": 0, "": 0, "??": 0, "x" * 50_000: 0}.items():
        assert ix.find(v) == want, v


def test_lookup_finds_all_a_scan_finds():
    rng = random.Random(8)
    entries = [(i, "".join(rng.choice("aabbccddeefgh") for _ in range(rng.randrange(6, 18)))) for i in range(60)]
    ix = canon.ListIndex("locations.city", [(r, t, 1) for r, t in entries])

    def edit(t):
        k = rng.randrange(len(t))
        return rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice("xyz") + t[k + 1 :], t[:k] + t[k] + t[k:], t[:k] + t[k + 1 : k + 2] + t[k] + t[k + 2 :]])

    hits = 0
    for n in (1, 2, 3) * 150:
        r, t = rng.choice(entries)
        v = t
        for _ in range(n):
            v = edit(v)
        bound = canon._bound(len(v))
        scan = {x for x, e in entries if spelling.weighted_distance(v, e, bound) <= min(bound, canon._bound(len(e))) and spelling.distance(v, e, 3) <= canon._edits(len(e))}
        assert v in ix.forms or scan == set(ix.near(v, bound)), v
        hits += r in scan
    assert hits > 250
    ix = canon.ListIndex("locations.city", [(1, "aabbccddefghijklm", 1)])
    assert ix.near("abcddefghijklm", 2.5) == {1: pytest.approx(2.5)}  # three cheap edits in the beginning


def test_words_are_found_as_by_a_scan_of_the_list():
    rng = random.Random(18)
    vocab = ["software", "hardware", "senior", "data", "engineer", "manager", "analyst", "reliability", "machine", "learning", "support", "sales", "human", "resources", "quality", "assurance"]
    entries = list({" ".join(rng.sample(vocab, rng.randrange(2, 4))) for _ in range(80)})
    ix = canon.ListIndex("experience.title", [(k, e, 1) for k, e in enumerate(entries)])
    typed = ["sr", "softw", "sw", "engr", "enginer", "mgr", "anlyst", "ml", "hr", "qa", "remote", "ii", "data", "sales", "machne", "lrng", "rel", "suport", "7"]
    for _ in range(300):
        w = [rng.choice(typed + vocab) for _ in range(rng.randrange(1, 6))]
        got = ix._aligned(w)
        own = list(canon._joined_letters(tuple(w)))
        for r, e in enumerate(entries):
            fits = [f for k in range(len(own)) if (f := ix._fit(own, k, e.split())) and all(x in ix.remarks or x.isdigit() for x in own[:k] + own[f[1] :])]
            assert (r in got) == bool(fits), (w, e)


def test_many_ambiguous_words_are_not_cut():
    ix = canon.ListIndex("experience.title", [(1, "Senior Software Engineer", 1), (2, "Data Engineer", 1)])
    assert ix.find("sr jr sr jr jr sr sr jr sw engr") == 0 or ix.find("sr jr sr jr jr sr sr jr sw engr") == 1
    assert ix.find("jr jr jr jr jr jr jr data engr remote part time") == 2


def test_remarks_are_learned(spark):
    refs = [(k, f"{a} {b}", 0) for k, (a, b) in enumerate([(x, y) for x in ("alpha", "gamma", "delta") for y in ("cook", "driver", "guard", "clerk")], 1)]
    rows = spark.createDataFrame([("t", f"{e} nightshift") for _, e, _ in refs] + [("t", "alpha cook fond of fish")], "field string, value string")
    learned = canon.learn_remarks(rows, {"t": refs})["t"]
    assert "nightshift" in learned and "fish" not in learned
    assert canon.ListIndex("t", refs, learned).find("delta clrk nightshift") == refs[-1][0]


def test_long_lists_in_blocks(spark, monkeypatch):
    refs = spark.createDataFrame([("t", i, t) for i, t in enumerate(["alphabet soup", "gamma ray", "delta wing", "omega point", "kappa mode", "sigma field"], 1)], "field string, ref_id long, canonical string")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["alphabt soup", "gama ray", "delta wing (remote)", "omega piont", "cappa mode", "nothing here", "n/a", "sigma field II"])], "id long, v string")
    col = (canon.Column("t", "x", "id", "v"),)
    get = lambda: sorted(tuple(r) for r in canon.match_columns({"x": rows}, refs, col).collect())
    whole = get()
    monkeypatch.setattr(canon, "MOST_ENTRIES", 2)
    assert get() == whole and [r[2] for r in whole] == [1, 2, 3, 4, 5, 0, 0, 6]


def test_columns_over_tables(spark):
    refs = spark.createDataFrame([("t", 1, "Alpha Beta"), ("t", 2, "Gamma"), ("t", 3, None)], "field string, ref_id long, canonical string")
    col = (canon.Column("t", "x", "id", "v"),)
    rows = spark.createDataFrame([(1, "Alpha Beta", "f"), (2, "alpha  beta", "f"), (3, None, "f"), (4, " ", "f"), (5, "none", "f"), (6, "gamna", "f"), (6, "gamna", "f")], "id long, v string, field string")
    got = sorted((r.row_id, r.ref_id) for r in canon.match_columns({"x": rows}, refs, col).collect())
    assert got == [(2, 1), (5, 0), (6, 2), (6, 2)]
    assert sorted((r.row_id, r.ref_id) for r in canon.match_columns({"x": rows}, refs.limit(0), col).collect()) == [(1, 0), (2, 0), (5, 0), (6, 0), (6, 0)]
    assert canon.match_columns({"x": rows.limit(0)}, refs, col).count() == 0
