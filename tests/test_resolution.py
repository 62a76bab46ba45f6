"""Coalescing, components and ingest against brute force."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gazette.functions import unicode
from gazette.operators import coalesce, identity
from gazette.operators.components import components


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(3)).select("id", "component").collect())
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b))


STOP = {"the", "of", "and", "by", "at", "edition", "annual", "hackathon", "hack", "challenge", "online", "university", "college", "institute", "technology"}


class Profile:
    def __init__(self, r):
        self.id, self.title, self.organizer, self.day, self.format, self.location = r["id"], r["title"].lower(), (r["organizer"] or "").lower(), r["day"], r["format"], (r["location"] or "").lower()
        self.tokens = sorted({w for w in self.title.split() if w not in STOP and not w.isdigit()})[:12]
        self.org_tokens = sorted({w for w in self.organizer.split() if w not in STOP and not w.isdigit()})[:12]
        own = {w for w in self.title.split() if len(w) == 4 and w.isdigit() and w[:2] in ("19", "20", "21")}
        year = {str(self.day.year)} if self.day else set()
        self.years, self.conflicted = own or year, len(own) > 1 or bool(own and self.day and str(self.day.year) not in own)
        self.numbers = {w for w in self.title.split() if w.isdigit()} - own
        self.urls, self.ids = set(r["urls"]), {tuple(s.split("|")) for s in r["source_ids"]}

    def blocks(self):
        first = self.tokens[:8]
        pairs = [f"{a} {b}" for i, a in enumerate(first) for b in first[i + 1 :]] if len(first) > 1 else first
        windows = range(self.day.toordinal() // 14 - 1, self.day.toordinal() // 14 + 2) if self.day else ()
        return [{("o", self.organizer, w) for w in windows if self.organizer}, {("t", p, w) for p in pairs for w in windows}, {("ot", self.organizer, t) for t in self.tokens if self.organizer}]


def judge(a, b):
    """outcome, score, exact"""
    exact_id, exact = bool(a.ids & b.ids), bool(a.urls & b.urls or a.ids & b.ids)
    gap = abs((a.day - b.day).days) if a.day and b.day else None
    t, o = ratio(a.title, b.title), ratio(a.organizer, b.organizer)
    place = 100 if a.format == b.format == "online" else ratio(a.location, b.location)
    near = 0 if gap is None else next((s for most, s in ((0, 100), (3, 95), (7, 85), (14, 60), (30, 30)) if gap <= most), 0)
    score = round(0.5 * t + 0.25 * o + 0.2 * near + 0.05 * place, 3)
    if a.conflicted or b.conflicted or (a.years and b.years and not a.years & b.years) or (a.numbers and b.numbers and a.numbers != b.numbers) or (gap is not None and gap > 90):
        return ("REVIEW" if exact else "DISTINCT", score, exact)
    of = lambda p, x: {i for q, i in x.ids if q == p}
    clash = any(of(p, a).isdisjoint(of(p, b)) for p in {p for p, _ in a.ids} & {p for p, _ in b.ids})
    if exact:
        return ("REVIEW", score, True) if clash and not exact_id else ("MATCH", 100.0, True)
    bad = clash or (a.format != b.format and "unknown" not in (a.format, b.format))
    if not a.format == b.format == "online":
        bad |= not a.location or not b.location or place < 90
    bad |= not a.organizer or not b.organizer or o < 94 or a.org_tokens != b.org_tokens or gap is None or gap > 7
    left, right = set(a.tokens) - set(b.tokens), set(b.tokens) - set(a.tokens)
    bad |= bool(left) != bool(right) or any(max(ratio(x, y) for y in right) < 85 for x in left) or any(max(ratio(x, y) for x in left) < 85 for y in right)
    bad |= t < 90 or not set(a.tokens) & set(b.tokens)
    return ("MATCH" if not bad and score >= 91 else "REVIEW", score, False)


def brute_heads(rows):
    heads, out = {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        me = Profile(r)
        found = [h for h in heads.values() if h.urls & me.urls or h.ids & me.ids]
        for tier in range(3):
            if not found:
                found = [h for h in heads.values() if h.blocks()[tier] & me.blocks()[tier]]
        ranked = sorted((-s, h.id, x) for h in found for outcome, s, x in [judge(me, h)] if outcome == "MATCH")
        if ranked and not any(x[2] == ranked[0][2] and x[0] - ranked[0][0] < 5 for x in ranked[1:]):
            head = heads[ranked[0][1]]
            head.urls |= me.urls
            head.ids |= me.ids
            out[me.id] = head.id
        else:
            heads[me.id] = me
            out[me.id] = me.id
    return out


def random_listings(seed, n=140):
    import datetime as dt

    rng = random.Random(seed)
    rows = []
    for k in range(n):
        g = rng.randint(0, 25)
        title = rng.choice((f"spring relay lot{g}x", f"spring relays lot{g}x", f"spring relay lot{g}x", f"relay lot{g}x finals", f"spring relay lot{g}x 2026", "sprint"))
        rows.append({
            "id": f"{rng.choice('abc')}{k:03d}", "title": title, "organizer": rng.choice((f"guild of lot{g}x", f"guild of lot{g}x", f"guild lot{g}x", None)),
            "day": rng.choice((None, *[dt.date(2027, 1, 1) + dt.timedelta(days=g * 9 + rng.choice((0, 0, 0, 2, 6, 9)))] * 6)), "registration_day": None,
            "format": rng.choice(("online", "online", "online", "offline", "unknown")), "location": rng.choice((None, "hall", "hall one")),
            "urls": [f"https://h.example/{rng.choice((g, g + 100, k + 1000))}"] if rng.random() < 0.6 else [], "source_ids": [f"feed|{rng.choice((g, k))}"] if rng.random() < 0.3 else [],
        })
    return rows


LISTING = "id string, title string, organizer string, day date, registration_day date, format string, location string, urls array<string>, source_ids array<string>"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coalescing_equals_a_fold_over_all_listings(spark, seed):
    rows = random_listings(seed)
    want = brute_heads(rows)
    found = coalesce.groups(spark.createDataFrame([tuple(r.values()) for r in rows], LISTING).repartition(4)).collect()
    assert {r["id"]: r["head"] for r in found} == want
    assert 10 < sum(h != i for i, h in want.items()) and {"exact_conflict", "ambiguous_candidates"} & {r["reason"] for r in found}


def test_heads_gain_aliases_and_provenance(spark):
    record = "struct<platform:string,url:string,external_id:string>"
    rows = spark.createDataFrame([("b", [("p", "u", None)]), ("a", [("p", "u", None), ("q", "v", "1")]), ("c", [("q", "v", "1"), ("r", "w", None)]), ("d", [])], f"id string, provenance array<{record}>")
    found = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")], "id string, head string")
    got = {r["id"]: (r["aliases"], [tuple(p) for p in r["provenance"]]) for r in coalesce.coalesced(rows, found).collect()}
    assert got == {"a": (["b", "c"], [("p", "u", None), ("q", "v", "1"), ("r", "w", None)]), "d": ([], [])}


def test_odd_listings_and_limits(spark):
    import datetime as dt

    day = dt.date(2027, 1, 1)
    row = ("spring relay lot", "guild", day, None, "online", None, ["https://h.example/1"], [])
    rows = [(f"{k:03d}", *row) for k in range(300)] + [("x", None, None, None, None, None, None, None, None), (None, *row), ("000", *row)]
    listings = spark.createDataFrame(rows, LISTING)
    got = {r["id"]: (r["head"], r["outcome"]) for r in coalesce.groups(listings).collect()}
    assert len(got) == 301 and all(got[f"{k:03d}"][0] == "000" for k in range(300)) and got["x"] == ("x", "DISTINCT")
    got = {r["id"]: (r["head"], r["reason"]) for r in coalesce.groups(listings, most=50).collect()}
    assert all(got[f"{k:03d}"] == (f"{k:03d}", "component_limit_exceeded") for k in range(300))
    assert coalesce.groups(listings.filter("false")).isEmpty()


def test_unicode_forms_of_all_scripts(spark):
    import unicodedata

    from gazette.functions import unicode

    words = ["".join(chr(c) for c in range(start, start + 40) if chr(c).isprintable() and not 0xD800 <= c < 0xE000) for start in range(0x20, 0x1FB00, 40)]
    rows = [(k, w, w[::-1] or None) for k, w in enumerate(w for w in words if w)] + [(10**6, "Plain ASCII", None)]
    got = {r["k"]: (r["a"], r["b"]) for r in unicode.folded(spark.createDataFrame(rows, "k int, a string, b string"), ["a", "b"]).collect()}
    form = lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x).casefold()
    assert got == {k: (form(a), form(b)) for k, a, b in rows}


def test_hosts_in_ascii(spark):
    from gazette.functions import unicode

    want = {"https://bücher.example/ä?q=ü": "https://xn--bcher-kva.example/ä?q=ü", "https://plain.example": "https://plain.example", "http://..ü/": None, "no url": "no url", None: None}
    got = dict(unicode.with_ascii_hosts(spark.createDataFrame([(u, u) for u in want], "t string, u string"), "u").select("t", "u").collect())
    assert got == want


def test_listings_that_an_exact_key_decides_are_not_paired(spark, monkeypatch):
    made = {}

    def counted(df, name):
        made[name] = df.localCheckpoint().count()
        return df.localCheckpoint()

    monkeypatch.setattr(coalesce, "held", counted)
    day = dt.date(2027, 1, 1)
    rows = [(f"k{k:02d}", "Relay lot", "Org lot", day, None, "online", None, ["https://h.example/g" if k < 40 else f"https://h.example/{k}"], []) for k in range(50)]
    found = coalesce.groups(spark.createDataFrame(rows, LISTING)).collect()
    assert {r["head"] for r in found} == {"k00"} and len(found) == 50
    assert made["coalesce-pairs"] == sum(range(40, 50))  # before: of all 50


def test_pairs_without_a_score_match_alike(spark):
    rows = [(k, t, o, dt.date(2027, 1, d), None, f, p, [], []) for k, (t, o, d, f, p) in enumerate([
        ("Relay sprint one", "Org lot", 1, "online", None), ("sprint one relay", "Org lot", 2, "online", None), ("Relay sprints one", "Org lot", 1, "online", None), ("Relay sprint 2031", "Org lot", 1, "online", None),
        ("Zebra talk", "Org lot", 1, "online", None), ("Relay sprint one", "Org lots", 1, "online", None), ("Relay sprint one", None, 1, "online", None), ("Relay sprint one", "Org lot", 20, "online", None), ("Relay sprint one", "Org lot", 1, "offline", "hall"), ("Relay sprint one", "Org lot", 1, "offline", "hal"), (None, "Org lot", 1, "unknown", None),
    ])]
    x = identity.profiles(spark.createDataFrame(rows, LISTING.replace("id string", "id int")))
    pairs = spark.createDataFrame([(a, b, 1) for a in range(11) for b in range(11) if a != b], "left_id int, right_id int, tier int")
    show = lambda df: {(r["left_id"], r["right_id"]): (r["outcome"] == "MATCH", r["score"] if r["outcome"] == "MATCH" else None) for r in df.collect()}
    full = show(identity.compare(pairs, x))
    assert show(identity.compare(pairs, x, scored=False)) == full and any(m for m, _ in full.values())


def test_folding_needs_no_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "ＨＡＣＫ"), (2, "plain"), (3, None), (4, "ＨＡＣＫ")], "k int, a string")
    got = unicode.folded(rows, ["a"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # before: a distinct and a join
    assert dict(got.collect()) == {1: "hack", 2: "plain", 3: None, 4: "hack"}


def test_only_listings_that_may_match_are_paired(spark, monkeypatch):
    made = {}

    def counted(df, name):
        made[name] = df.localCheckpoint().count()
        return df.localCheckpoint()

    monkeypatch.setattr(coalesce, "held", counted)
    day = dt.date(2027, 1, 1)
    kinds = ("Relay lot{g}", "Relay lot{g}", "Relay lot{g} 2031", "Zebra talk {g}", "Relay lot{g}")  # 2 has another year, 3 another number
    rows = [(f"k{g:02d}{k}", title.format(g=g + 100 * (k == 3)), f"Org lot{g}", day, None, "online", None, [f"https://h.example/{g}/{k}"], []) for g in range(20) for k, title in enumerate(kinds)]
    found = {r["id"]: r["head"] for r in coalesce.groups(spark.createDataFrame(rows, LISTING)).collect()}
    assert found == {f"k{g:02d}{k}": f"k{g:02d}{0 if k in (1, 4) else k}" for g in range(20) for k in range(5)}
    assert made["coalesce-pairs"] == 20 * (1 + 4)  # before: 20 * 10, of all
    assert "coalesce-met" not in made  # before: the blocks of all tiers of all listings


def test_crowded_windows_abstain(spark, monkeypatch):
    for module in (coalesce, identity):
        monkeypatch.setattr(module, "CANDIDATE_CAP", 3)
    at = lambda buckets: dt.date(2027, 1, 4) + dt.timedelta(days=14 * buckets)
    listing = lambda k, title, buckets: (k, title, "Org lot", at(buckets), None, "online", None, [], [])
    rows = [listing(f"a{k}", "Relay lot", 0) for k in range(5)]  # a window of five
    rows += [listing("b0", "Fair hall", 2), listing("b1", "Fair hall", 2)]  # one of their windows is that with the five beside it
    rows += [listing("c0", "Jam den", 4), listing("c1", "Jam den", 4), listing("d0", "Jam den", 12), listing("d1", "Jam den", 12)]
    got = {r["id"]: r["head"] for r in coalesce.groups(spark.createDataFrame(rows, LISTING)).collect()}
    assert got == {**{r[0]: r[0] for r in rows}, "c1": "c0", "d1": "d0"}
