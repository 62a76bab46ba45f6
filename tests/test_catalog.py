import datetime as dt
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gazette.functions import dates, measures, text
from gazette.operators import catalog, identity, ledger, search
from gazette.operators.catalog import CatalogQuery
from gazette import session
from gazette.plans import intake, pages, queries, resolution, services, views  # noqa: F401
from gazette.streaming import activity

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rounded(df.select(*names).collect()) == rounded(got.fetchall())


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_single_dates(spark):
    rows = [("2026-10-31",), ("Oct 31, 2026",), ("31st October 2026",), ("1 Oct - 3 Oct 2026",), ("TBA",), ("",), (None,)]
    got = one(spark, rows, "t string", dates.single_date(F.col("t")).cast("string"))
    assert [x for x, in got] == ["2026-10-31"] * 3 + [None] * 4


def test_prizes(spark):
    rows = [("₹5 Lakh",), ("$1,000",), ("2 crore",), ("99 crore",), ("US$ 20.50",), ("none",), (None,)]
    got = one(spark, rows, "t string", measures.prize_inr(F.col("t")), measures.prize_exact(F.col("t")))
    assert [x for x, _ in got] == [5e5, 87000.0, 2e7, 0.0, 20.5 * 87, 0.0, 0.0]
    assert [y for _, y in got] == ["INR 5", None, None, None, "USD 20.50", None, None]


def test_urls(spark):
    rows = [("HTTPS://Ex.com:443?b=2&utm_source=x&a=1&b=1#f",), ("http://10.0.0.1/x",), ("ftp://a.b/c",), ("http://u:p@a.b/",), (None,)]
    got = one(spark, rows, "u string", text.canonical_url(F.col("u")), text.public_url_ok(F.col("u")))
    assert got[0] == ("https://ex.com/?a=1&b=2&b=1#f", True)
    assert [ok for _, ok in got[1:]] == [False] * 4
    assert got[2][0] is None and got[4][0] is None


def test_unknown_texts(spark):
    got = one(spark, [("  a \n b ",), ("TBA",), ("-",), ("",), (None,)], "t string", text.clean(F.col("t")))
    assert [x for x, in got] == ["a b", None, None, None, None]


def test_plain_texts_of_odd_documents_equal_their_sql(spark, tmp_path):
    texts = ["tba", " N/A ", "-", "", None, "\u00a0 a\t\u3000b \u2003", "\u3000", "\u2003" * 3 + "é" * 600, "x \u0085", "x \u2028 ", "<a href=\"b\">'c' & d</a>"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = {tuple(r) for r in queries.plain_text_clean(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    assert got == set(con.execute(queries.ORACLES["plain_text_clean"]).fetchall())
    assert {(0, "tba"), (3, ""), (5, "a \u3000b"), (6, "")} <= {(k, x) for k, x, _ in got}


def test_query_options_are_checked():
    for bad in ({"page": 0}, {"limit": 101}, {"deadline_days": 31}, {"sort": "x"}, {"search": "a" * 101}):
        with pytest.raises(ValueError):
            CatalogQuery(**bad)


def test_pages_partition_the_order(spark):
    rows = catalog.published(spark.createDataFrame([(i, f"t{i % 3}", "o", "S", None, "x", "r", "c", dt.date(2026, 1, 1 + i % 20), "open", 1.0) for i in range(30)], "id long, title string, organizer string, source string, mode string, tag string, region string, city string, deadline date, status_text string, prize double"), dt.date(2026, 1, 10))
    ids = [r["id"] for p in (1, 2, 3) for r in CatalogQuery(page=p, limit=10).results(rows).collect()]
    assert sorted(ids) == list(range(30))
    t = CatalogQuery(tab="missed").totals(rows).first()
    assert t["upcoming"] + t["missed"] == 30


LISTING = "id long, title string, organizer string, day date, registration_day date, format string, location string, urls array<string>, source_ids array<string>"


def listing(id, title, organizer="Acme Labs", day=dt.date(2026, 5, 1), format="online", location="", urls=(), source_ids=(), registration=None):
    return (id, title, organizer, day, registration, format, location, list(urls), list(source_ids))


def later(n):
    return dt.date(2026, 5, 1) + dt.timedelta(days=n)


#: (left, right, outcome, a reason that is given)
PAIRS = [
    (listing(1, "Green Code Sprint"), listing(2, "green  code SPRINT!", day=later(2)), "MATCH", "weighted_evidence"),
    (listing(1, "Green Code Sprint"), listing(2, "Greeen Code Sprint"), "MATCH", "weighted_evidence"),
    (listing(1, "Green Code Sprint", "Acme Univ"), listing(2, "Green Code Sprint", "Acme University"), "MATCH", "weighted_evidence"),
    (listing(1, "Green Code Sprint 2025"), listing(2, "Green Code Sprint 2026"), "DISTINCT", "title_date_year_conflict"),
    (listing(1, "Green Code Sprint 3"), listing(2, "Green Code Sprint 4"), "DISTINCT", "numbered_edition_conflict"),
    (listing(1, "Green Code Sprint"), listing(2, "Green Code Sprint", day=later(120)), "DISTINCT", "event_dates_far_apart"),
    (listing(1, "Green Code Sprint"), listing(2, "Green Code Sprint", day=later(12)), "REVIEW", "event_dates_differ"),
    (listing(1, "Green Code Sprint"), listing(2, "Green Code Sprint", day=None), "REVIEW", "event_dates_missing"),
    (listing(1, "Green Code Sprint"), listing(2, "Green Code Sprint", format="offline", location="Pune"), "REVIEW", "format_conflict"),
    (listing(1, "Green Code Sprint", format="offline", location="Pune"), listing(2, "Green Code Sprint", format="offline", location="Delhi"), "REVIEW", "location_conflict"),
    (listing(1, "Green Code Sprint"), listing(2, "Green Code Sprint Women"), "REVIEW", "title_variant_conflict"),
    (listing(1, "Green Code Sprint"), listing(2, "Green Code Sprint", ""), "REVIEW", "organizer_missing"),
    (listing(1, "Green Code Sprint"), listing(2, "Painting for beginners", "Somebody"), "DISTINCT", "title_evidence_weak"),
    (listing(1, "Green Code Sprint", urls=["https://a.example/1"]), listing(2, "Something else", "Other", urls=["https://a.example/1"]), "MATCH", "canonical_url"),
    (listing(1, "A", source_ids=["p|7"]), listing(2, "B", source_ids=["p|7", "q|1"]), "MATCH", "source_id"),
    (listing(1, "A", urls=["https://a.example/1"], source_ids=["p|7"]), listing(2, "A", urls=["https://a.example/1"], source_ids=["p|8"]), "REVIEW", "source_id_conflict"),
    (listing(1, "A 2025", urls=["https://a.example/1"], day=None), listing(2, "A 2026", urls=["https://a.example/1"], day=None), "REVIEW", "edition_year_conflict"),
    (listing(1, "Green Code Sprint", source_ids=["p|7"]), listing(2, "Green Code Sprint", source_ids=["p|8"]), "REVIEW", "source_id_conflict"),
]


def test_labelled_pairs(spark):
    assert identity._common("signal0 constellation", "signla0 constellation") == 20
    left = identity.profiles(spark.createDataFrame([(100 * k, *x[1:]) for k, (x, _, _, _) in enumerate(PAIRS)], LISTING))
    right = identity.profiles(spark.createDataFrame([(100 * k + 1, *y[1:]) for k, (_, y, _, _) in enumerate(PAIRS)], LISTING))
    pairs = spark.createDataFrame([(100 * k, 100 * k + 1, 1) for k in range(len(PAIRS))], "left_id long, right_id long, tier int")
    got = {r["left_id"] // 100: r for r in identity.compare(pairs, left, right).collect()}
    for k, (_, _, outcome, reason) in enumerate(PAIRS):
        assert (got[k]["outcome"], reason in got[k]["reasons"]) == (outcome, True), (k, got[k])


def resolved(spark, rows, **kw):
    rows = identity.profiles(spark.createDataFrame(rows, LISTING))
    pairs, over = identity.candidate_pairs(rows, **kw)
    return {r["left_id"]: (r["right_id"], r["outcome"], r["reasons"][0]) for r in identity.resolve(rows, identity.compare(pairs, rows), over).collect()}


def test_every_id_has_an_outcome_and_near_ties_are_reviewed(spark):
    got = resolved(spark, [listing(1, "Green Code Sprint"), listing(2, "Green Code Sprint"), listing(3, "Green Code Sprint", day=later(1)), listing(4, "Quite alone", "Nobody", day=later(200)), listing(5, "Red Fair", urls=["https://a.example/1"]), listing(6, "Red Fair", urls=["https://a.example/1"]), listing(7, "Red Fair")])
    assert got[1] == (2, "REVIEW", "ambiguous_candidates") and got[3][1] == "REVIEW"
    assert got[4] == (None, "DISTINCT", "no_candidates")
    assert got[5] == (6, "MATCH", "canonical_url") and got[6] == (5, "MATCH", "canonical_url")  # the exact tier comes first, 7 is no candidate


def test_crowded_blocks_abstain_and_exact_ids_still_resolve(spark):
    crowd = [listing(k, "Same Title Here") for k in range(12)]
    got = resolved(spark, [*crowd, listing(20, "Same Title Here", source_ids=["p|1"]), listing(21, "Other", source_ids=["p|1"])], cap=10)
    assert all(got[k] == (None, "REVIEW", "candidate_limit_exceeded") for k in range(12))
    assert got[20] == (21, "MATCH", "source_id")


def test_rows_against_stored_rows(spark):
    stored = identity.profiles(spark.createDataFrame([listing(1, "Green Code Sprint"), listing(2, "Blue Fair")], LISTING))
    new = identity.profiles(spark.createDataFrame([listing(1, "Green Code Sprint", day=later(3)), listing(9, "Unseen", "Nobody")], LISTING))
    pairs, over = identity.candidate_pairs(new, stored)
    got = {r["left_id"]: (r["right_id"], r["outcome"]) for r in identity.resolve(new, identity.compare(pairs, new, stored), over).collect()}
    assert got == {1: (1, "MATCH"), 9: (None, "DISTINCT")}


def test_merge_keeps_known_values(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id long, f string, g string")
    new = spark.createDataFrame([(1, None, "z"), (3, "n", None)], "id long, f string, g string")
    got = {tuple(r) for r in ledger.changes(old, new, "id", ["f", "g"]).collect()}
    assert got == {(1, "g", "x", "z"), (3, "f", None, "n")}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i % 50), i % 3, 1.0) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in activity.rate_limited(batch, "user_id").collect()}
    got = {tuple(r) for r in activity.drained(activity.rate_limited(stream, "user_id"), "rates", str(tmp_path / "c1"), "complete").collect()}
    assert want == got and want
    seen = activity.drained(activity.first_of_visitor(stream, ["user_id"], "10 days"), "seen", str(tmp_path / "c2"))
    assert seen.count() == 3


def test_entry_works_without_the_llm_subpackage(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


def test_fuzzy_search(spark):
    from difflib import SequenceMatcher

    texts = ["Red widget", "red WIDGETS, large", "crimson gear", "blue widgte", "tiny bolt", "", None, "red"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def found(query, **more):
        return {r["id"] for r in search.search(df, ["t"], query, **more).collect()}

    aliases = {"crimson": "red"}
    assert found("") == found("!!!") == set(range(8))
    assert found("wiget crimson", synonyms=aliases) == {0, 1}
    assert found("wiget crimson", synonyms=aliases, fuzzy=False) == set()
    assert found("WIDGET") == {i for i, t in enumerate(texts) if any("widget" in w or (len(w) >= 4 and abs(len(w) - 6) <= 3 and SequenceMatcher(None, "widget", w).ratio() >= 0.78) for w in (t or "").lower().replace(",", "").split())}


def test_search_knows_places_and_campuses(spark):
    texts = ["Sprint at IIIT Hyderabad", "IIIT-H open day", "iiit hydrabad night", "IIT Bombay Techfest", "Mumbai meetup", "Code in Bangalore", "Delhi"]
    df = spark.createDataFrame([(i, t, ["a", "b"]) for i, t in enumerate(texts)], "id int, title string, tags array<string>")

    def found(query):
        return {r["id"] for r in df.filter(search.matches(search.corpus(df.columns), query)).collect()}

    assert found("iiith") == found("iiit hyderabad") == {0, 1, 2} - ({1} if "hyderabad" not in "iiith iiit h" else set()) | {1}
    assert found("hydrerabad") == {0, 1, 2}
    assert found("mumbai") == {3, 4} and found("bengaluru") == {5}
    assert found("A B") == set(range(7)) and found("nowhere") == set()


def test_nearby_and_aliases(spark):
    rows = spark.createDataFrame([(1, False, "offline", 12.9, 77.6, [7]), (2, True, "offline", 12.9, 77.6, None), (3, False, "online", 12.9, 77.6, None), (4, False, "hybrid", None, None, [8]), (5, False, "hybrid", 13.9, 77.6, [9])], "id int, past boolean, format string, lat double, lng double, aliases array<int>")
    assert [r["id"] for r in catalog.nearby(rows, 12.97, 77.59, 50).collect()] == [1]
    assert {r["id"] for r in CatalogQuery(ids=(5, 7, 8)).matches(rows).collect()} == {1, 4, 5}


def test_the_published_view_is_read_again_and_renewed(spark, tmp_path):
    import shutil

    for name in views.SOURCES:
        shutil.copyfile(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    one, two = views.published_view(spark, str(tmp_path)), views.published_view(spark, str(tmp_path))
    assert one.inputFiles() == two.inputFiles() and one.count() == 1500
    pq.write_table(pq.read_table(f"{SF}/orders.parquet").slice(0, 9), tmp_path / "orders.parquet")
    assert views.published_view(spark, str(tmp_path)).count() == 9


def test_instant_in_zone(spark):
    want = {"2024-03-10 02:30": "local", "2024-11-03T01:15": "local", "2024-07-01 09:00": "instant", "soon": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", dates.instant_in_zone(F.col("t"), "America/New_York").alias("x"))
    assert {r["t"]: r["x"] and r["x"]["kind"] for r in df.collect()} == want


def test_recipients_of_all_listings(spark):
    n = queries.listings(spark, SF).count()
    got = queries.QUERIES["recipients_all"](spark, SF)
    subs = queries.subscribers(spark, SF).filter("preference = 'all'")
    assert {r["n"] for r in got.join(subs, "subscriber").groupBy("subscriber").agg(F.sum("n").alias("n")).collect()} == {n}


def test_rows_are_spread_before_steps_that_make_many_of_one(spark):
    keyed = queries.part_profiles(spark, "/root/testdata/sf0.1")
    wide = session.spread(spark.range(100).repartition(1), 10, "id")
    assert wide.rdd.getNumPartitions() == 10 and wide.count() == 100
    assert "REPARTITION_BY_NUM" in keyed._jdf.queryExecution().executedPlan().toString()  # before: as few tasks as files
