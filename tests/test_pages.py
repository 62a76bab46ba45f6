"""Markup of pages, places, pages with totals and the search's likeness."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gazette.data import SYNONYMS
from gazette.functions import dates, text
from gazette.operators import places, search
from gazette.operators.catalog import CatalogQuery
from gazette.plans import queries
from gazette.sources import structured

SF = "/root/testdata/sf0.001"


def things(html):
    return [dict(zip(structured.THING, t, strict=True)) for t in structured.parse(html)[3]]


def test_microdata_scopes():
    got = things('<div itemscope itemtype="http://schema.org/Event" href="https://x.example/1"><div itemprop="location" itemscope itemtype="http://schema.org/Place"><b itemprop="name">Hall</b> Pune</div><p itemprop="name">Sprint <i>One</i></p><meta itemprop="startDate" content="2026-05-01"></div><p itemprop="name">outside</p>')
    event = next(t for t in got if t["type"] == "Event")
    assert (event["name"], event["url"], event["start"], event["location"]) == ("SprintOne", "https://x.example/1", "2026-05-01", "Hall Pune")
    assert [t["name"] for t in got if t["type"] == "Place"] == ["Hall"]
    assert [t["name"] for t in things('<div itemscope itemtype="x/Event"><p itemprop="name">never closed') ] == ["never closed"]


def test_json_graphs():
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    got = things(block('{"@graph": [{"@type": ["Event"], "name": "A", "location": {"@type": "Place", "address": {"addressLocality": "Pune"}}}, {"x": 1}]}') + block('[{"name": "B", "image": ["i1", "i2"]}]'))
    assert [(t["type"], t["name"], t["location"], t["image"]) for t in got] == [("Event", "A", "Pune", ""), ("", "B", "", "i1")]
    assert structured.parse(block("{") + block("[1, 2") + block('{"name": "C"}'))[2] == 2
    assert structured.parse(block("[" * 100_000))[2] == 1 and structured.parse(None) == (None, {}, 0, [])


def test_metadata_precedence(spark):
    pages = [
        (1, '<title>Element title</title><meta property="og:title" content="Open graph title | Devpost">'),
        (2, '<title>Element title</title><meta name="twitter:title" content="Bird title"><meta name="description" content="plain"><meta name="twitter:description" content="bird">'),
        (3, "<title>abc</title>"),
        (4, None),
        (5, '<meta property="og:title" content=""><title>Element &amp; title</title>'),
    ]
    got = {r["id"]: (r["title"], r["description"]) for r in structured.metadata(structured.markup(spark.createDataFrame(pages, "page_id long, html string"))).collect()}
    assert got == {1: ("Open graph title", None), 2: ("Bird title", "plain"), 3: (None, None), 4: (None, None), 5: ("Element & title", None)}


def test_places(spark):
    known = spark.createDataFrame([("Pune", 18.5, 73.8), ("pune ", 1.0, 1.0), ("goa, india", 15.3, 74.1), ("Paris, France", 48.8, 2.3)], "place string, lat double, lng double")
    rows = [(1, " PUNE"), (2, "Goa"), (3, "Hall 2, Campus,pune"), (4, "Online"), (5, None), (6, "nowhere"), (7, "Room 1, Paris, France"), (8, "PUNE"), (9, "")]
    got = {r["id"]: (r["place"], r["lat"]) for r in places.geocoded(spark.createDataFrame(rows, "id int, location string"), known).collect()}
    assert got == {1: ("pune", 1.0), 2: ("goa, india", 15.3), 3: ("pune", 1.0), 4: (None, None), 5: (None, None), 6: (None, None), 7: ("paris, france", 48.8), 8: ("pune", 1.0), 9: (None, None)}


def test_a_page_and_its_totals_come_out_of_one_scan(spark):
    rows = queries.published(spark, SF)
    q = CatalogQuery(tab="missed", limit=7)
    got = q.page_with_totals(rows).collect()
    want = q.totals(rows).first()
    assert [r["id"] for r in got] == [r["id"] for r in q.results(rows).collect()] and {(r["upcoming"], r["missed"]) for r in got} == {tuple(want)}
    assert CatalogQuery(source="nobody").page_with_totals(rows).isEmpty()


def brute_match(text, query):
    """One step after the other, as described."""
    q = query.strip().lower()
    if not q or q in text.lower():
        return True
    form, norm = search.query_form(text), search.query_form(q)
    if not norm or norm in form:
        return True
    words = set(form.split())
    for w in list(words):
        words.update(SYNONYMS.get(w, "").split())
    for t in [x for given in norm.split() for x in SYNONYMS.get(given, given).split()]:
        alias = SYNONYMS.get(t)
        near = len(t) >= 4 and any(len(w) >= 4 and abs(len(w) - len(t)) <= 3 and SequenceMatcher(None, t, w).ratio() >= 0.78 for w in words)
        if not (t in words or t in form or (alias and (alias in words or alias in form)) or near):
            return False
    return True


@pytest.mark.parametrize("query", ["iiit hydrabad", "bengalru sprint", "IIT-B", "hakathon punee", "chenai, open", "robotics kolkatta", "zzzz", "nit t", "expo!"])
def test_likeness_equals_brute_force(spark, query):
    texts = ["IIIT Hyderabad hackathon", "Sprint at Bangalore", "IIT Bombay techfest", "Pune Hackathon 2026", "Open day, Madras", "Calcutta robotic league", "", "iiith meet", "Expo at NIT Trichy", "blr sprints", "hackathons in poona"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, title string")
    got = {r["id"] for r in rows.filter(search.matches(F.col("title"), query)).collect()}
    assert got == {k for k, t in enumerate(texts) if brute_match(t, query)}


def test_labelled_dates(spark):
    want = {
        "Registration deadline: 5th May 2026": "2026-05-05",
        "apply by may 5, 2026 or later": "2026-05-05",
        "Registration closes 2026-05-05\nApply by 5 May 2026": "2026-05-05",
        "Registration closes 2026-05-05\nApply by 6 May 2026": None,
        "Registration ends 5 May 2026 - 7 May 2026": None,
        "Registration ends 5 May 2026 and 7": None,
        "Registration ends soon, on 5 May 2026": None,
        "It ends 5 May 2026": None,
        "Apply by 31 February 2026": None,
        "": None,
    }
    rows = spark.createDataFrame([(t,) for t in [*want, None]], "t string").select("t", dates.labelled_registration_date(F.col("t")).cast("string").alias("d"))
    assert dict(rows.collect()) == {**want, None: None}


def test_backups_are_restored_whole_or_refused(spark, tmp_path):
    import glob

    from gazette.sources import backup

    root = f"file://{tmp_path}"
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("nation", "documents", "embeddings")} | {"none": spark.range(0)}
    made = backup.dump(tables, f"{root}/b")
    assert made["nation"]["n"] == 25 and made["none"]["n"] == 0
    with pytest.raises(FileExistsError):
        backup.restore(spark, f"{root}/b", f"{root}/b")
    restored = backup.restore(spark, f"{root}/b", f"{root}/r")
    assert {n: (m["n"], m["xor"]) for n, m in restored.items()} == {n: (m["n"], m["xor"]) for n, m in made.items()}
    assert sorted(map(tuple, backup.checked(spark, f"{root}/r")["nation"].collect())) == sorted(map(tuple, tables["nation"].collect()))
    part = glob.glob(f"{tmp_path}/b/documents/part-*.parquet")[0]
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 1
    open(part, "wb").write(data)
    for crc in glob.glob(f"{tmp_path}/b/documents/.part-*.crc"):
        open(crc, "ab").close()
    with pytest.raises(backup.BackupDamaged, match="documents"):
        backup.restore(spark, f"{root}/b", f"{root}/r2")
    assert not glob.glob(f"{tmp_path}/r2/*")
    with pytest.raises(backup.BackupDamaged):
        backup.checked(spark, f"{root}/nowhere")


def test_titles_decode_the_references_of_their_sql_only(spark):
    titles = [(1, "<title>a &quot;b&quot; &amp;lt; &lt;c&gt;</title>"), (2, "<p>x\n</p>\n <title lang='x'>Stop &amp;&amp and&amp</title>"), (3, "<title>"), (4, "none"), (5, None)]
    pages = spark.createDataFrame(titles, "page_id long, html string")
    got = dict(pages.select("page_id", text.html_title(F.col("html"), text.MARKUP_REFERENCES)).collect())
    assert got[1] == 'a &quot;b&quot; &lt; <c>' and got[2] == "Stop &&amp and&amp"
    marked = structured.markup(pages)
    assert [r["title"] for r in structured.metadata(marked, text.MARKUP_REFERENCES).orderBy("id").collect()] == ['a &quot;b&quot; &lt; <c>', "Stop &&amp and&amp", None, None, None]
    assert [r["title"] for r in structured.metadata(marked).orderBy("id").collect()][:2] == ['a "b" &lt; <c>', "Stop && and&"]
