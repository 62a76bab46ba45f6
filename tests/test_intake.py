import datetime as dt

import pytest
from pyspark.sql import functions as F

from gazette.operators import classify
from gazette.sources import feeds, generations

DAY = dt.date(2026, 7, 1)


def test_classification_tries_families_in_order(spark):
    rows = [("NIT Raipur and IIT Delhi meet", ["AI"]), ("ignite", None), (None, ["Meta"]), ("BITS Goa hiring challenge", ["FAANG", "amazon"])]
    got = classify.classified(spark.createDataFrame(rows, "title string, tags array<string>")).collect()
    assert [r["college_name"] for r in got] == ["IIT Delhi", None, None, "BITS Goa"]
    assert [r["tags"] for r in got] == [["AI"], [], ["Meta", "faang", "mango"], ["FAANG", "amazon", "mango"]]
    assert [r["opportunity_type"] for r in got] == ["Hackathon", "Hackathon", "Hackathon", "Hiring Challenge"]


def test_verification_of_empty_rows_and_duplicates(spark):
    rows = [(None, None, None, None, None), ("Great Hackathon 2026", "https://devpost.com/x", "register your team and submit a project", "Devpost", "2026-08-01")]
    df = spark.createDataFrame(rows, "title string, link string, desc string, source string, deadline_iso string")
    got = {r["title"]: r for r in classify.verified(df, DAY).collect()}
    assert got[None]["recommendation"] == "reject" and got[None]["content_relevance"] == 0
    good = got["Great Hackathon 2026"]
    assert (good["title_quality"], good["recommendation"], good["issues"]) == (80, "accept", [])
    copies = classify.verified(df, DAY, df.select("link")).filter("link is not null").collect()
    assert copies[0]["recommendation"] == "reject" and "duplicate" in copies[0]["issues"]
    assert [r["s"] for r in spark.createDataFrame([(404,), (503,), (200,), (0,)], "c int").select(classify.link_state(F.col("c")).alias("s")).collect()] == ["dead", "unknown", "alive", "unknown"]


def test_feeds_of_odd_bodies(spark):
    bodies = spark.createDataFrame([("[]",), ("{oops",), (None,), ('[{"title": " ", "url": "u"}, {"title": "A", "url": "https://a.example", "extra": 1}]',)], "body string")
    assert [r["title"] for r in feeds.from_themed(bodies, DAY, "s").collect()] == ["A"]
    states = {r["body"]: r["body_state"] for r in feeds.outcomes(bodies, feeds.THEMED).collect()}
    assert (states["[]"], states[None]) == ("empty", "malformed")
    for parse in (lambda b: feeds.from_challenges(b, DAY, "s"), lambda b: feeds.from_teams(b, DAY, "s", "https://t/"), lambda b: feeds.from_opportunities(b.withColumn("page", F.lit(1)), DAY, "s", "https://o/"), feeds.from_curated, lambda b: feeds.from_embedded(b, DAY, "s", "https://e/")):
        assert parse(bodies.limit(2)).columns == list(feeds.COLUMNS)
        assert parse(bodies.limit(2)).count() == 0
    listing = '[{"title": "A", "link": "https://a.example", "source": "own", "tags": ["x"], "min_team_size": 2}]'
    two = feeds.from_curated(spark.createDataFrame([(listing,), (listing.replace("own", "other"),)], "body string"))
    assert [(r["source"], r["min_team"]) for r in feeds.deduplicated(two).collect()] == [("other", 2)]


def test_generations_are_named_by_one_manifest(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(100).withColumn("past", F.col("id") % 2 == 0)
    assert generations.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        generations.read(spark, root)
    first = generations.publish(rows, root, None, ("past",), ("id",))
    second = generations.publish(rows.filter("id < 50"), root, generations.current(spark, root), ("past",))
    assert generations.read(spark, root).count() == 50 and second["previous"] == first["generation"]
    with pytest.raises(generations.StaleManifest):
        generations.publish(rows, root, None)
    assert generations.read(spark, root).count() == 50
    third = generations.publish(rows, root, generations.current(spark, root))
    assert third["retired"] == first["generation"]
    assert generations.fingerprint(rows).collect() == generations.fingerprint(rows.repartition(7)).collect() != generations.fingerprint(rows.limit(99)).collect()
    with pytest.raises(ValueError):
        generations.bounded(rows, 99)
    assert generations.bounded(rows, 100).count() == 100
