"""Batches of observations against a store, from resolution to one published generation."""

import datetime as dt
import threading

import pytest

from gazette import session
from gazette.operators import coalesce, identity
from gazette.operators import ingest_batch as ib
from gazette.sources import generations

T = dt.datetime(2026, 5, 1)
DAY = dt.date(2026, 6, 1)
NAMES = [c.split()[0] for c in ib.OBSERVATION.split(", ")]


def seen(k=0, **given):
    base = {"source": "feed", "link": "https://h.example/a", "title": "Spring Relay Lisbon", "organizer": "Guild of Code", "format": "online", "day": DAY, "prize": "P", "authority": 1, "observed_at": T + dt.timedelta(hours=k)}
    return tuple({**base, **given}.get(n) for n in NAMES)


@pytest.fixture
def take(spark, tmp_path):
    def run(*rows):
        made = ib.ingest_batch(spark, f"file://{tmp_path}/store", spark.createDataFrame(list(rows), ib.OBSERVATION))
        return made, {r["link"]: r for r in ib.events(spark, f"file://{tmp_path}/store").collect()}, ib.ledger(spark, f"file://{tmp_path}/store").collect()

    return run


def test_a_batch_taken_twice_changes_nothing(take):
    first = [seen(), seen(1, link="https://h.example/b", source="other"), seen(2, link="https://h.example/c", title="Winter Chess Porto", organizer="Club")]
    made, events, log = take(*first)
    assert made["serial"] == 1 and set(events) == {"https://h.example/a", "https://h.example/c"} and len(log) == 3
    assert events["https://h.example/a"]["url_aliases"] == ["https://h.example/a", "https://h.example/b"]
    assert take(*first)[0] is None
    made, again, log = take(first[1], first[1], seen(5, title="Autumn Go Faro", link="https://h.example/d"))
    assert made["serial"] == 2 and len(log) == 4 and again["https://h.example/a"] == events["https://h.example/a"]


def test_matches_are_merged_and_the_rest_of_a_batch_superseded(take):
    take(seen())
    _, events, log = take(seen(3, prize="Q"), seen(2, prize="R"), seen(4, link="https://h.example/b", source="other", prize="S"), seen(-9, prize="old"))
    e = events["https://h.example/a"]
    assert e["prize"] == "P" and e["conflicting_fields"] == ["prize"] and e["revision"] == 2  # the newest is not the primary source
    assert sorted((r["platform"], r["url"]) for r in e["records"]) == [("feed", "https://h.example/a"), ("other", "https://h.example/b")]
    assert sorted(r["ignored_reason"] or "" for r in log) == ["", "", "superseded", "superseded", "superseded"]
    _, events, log = take(seen(6, prize="T", registrations=7))
    assert events["https://h.example/a"]["prize"] == "T"
    assert [dict(r["changes"]) for r in log if r["changes"] and "prize" in r["changes"]][-1]["prize"]["after"] == "T"


def test_collisions_are_held_and_never_inserted(take):
    _, before, _ = take(seen())
    _, events, log = take(seen(1, title="Spring Relay Lisbon 2031", day=dt.date(2031, 6, 1)))  # the same URL, another edition
    assert len(events) == 1 and events["https://h.example/a"]["conflicting_fields"] == ["edition_identity"]
    assert events["https://h.example/a"]["title"] == before["https://h.example/a"]["title"]
    last = next(r for r in log if r["ignored_reason"])
    assert last["ignored_reason"] == "possible_new_edition" and "stored_identity_collision" in last["reasons"] and last["event_id"] == events["https://h.example/a"]["event_id"]


def test_new_events_of_one_batch_that_collide(take):
    _, events, log = take(seen(0), seen(1, title="Spring Relay Lisbon 2031", day=dt.date(2031, 6, 1)))
    assert len(events) == 1 and sorted(r["outcome"] for r in log) == ["NEW", "REVIEW"]


def test_a_batch_works_on_what_it_can_change(take, spark, monkeypatch):
    tables = []

    def counted(df, name):
        out = session.held(df, name)
        tables.append((name, out.count()))
        return out

    for module in (ib, identity, coalesce):
        monkeypatch.setattr(module, "held", counted)
    first = [seen(k, link=f"https://h.example/{k}", title=f"Winter Chess {w}", organizer=f"Club {w}") for k, w in enumerate(("Porto", "Faro", "Braga"))]
    take(*first)
    assert not {"incoming", "stored", "compared"} & {name for name, _ in tables}  # an empty store has nothing to be held against
    tables.clear()
    assert take(*first)[0] is None and tables == [("fresh", 0), ("log", 0)]
    second = [seen(9, link="https://h.example/1", title="Winter Chess Faro", organizer="Club Faro", prize="Q"), seen(9, link="https://h.example/d", title="Autumn Go Evora", organizer="Guild")]
    _, events, _ = take(*second)
    rows = dict(tables)
    assert rows["merged"] == 1 and rows["inexact"] == 1 and rows["before"] == 4  # one is merged, one has no exact key in common
    assert len(events) == 4 and events["https://h.example/1"]["prize"] == "Q" and events["https://h.example/0"]["revision"] == 1


def test_odd_observations(take):
    made, events, log = take(seen(title=None), seen(link="http://localhost/x"), seen(link=None), seen(organizer=None, day=None, format=None, link="https://h.example/z", prize=None), tuple([None] * len(NAMES)))
    assert set(events) == {"https://h.example/z"} and sorted(r["outcome"] for r in log) == ["NEW", "REJECTED", "REJECTED", "REJECTED", "REJECTED"]
    assert take()[0] is None


def test_of_two_writers_one_publishes(spark, tmp_path):
    root, rows = f"file://{tmp_path}/two", spark.range(50).withColumnRenamed("id", "k")
    out = []

    def write():
        try:
            out.append(generations.publish(rows, root, None)["serial"])
        except generations.StaleManifest:
            out.append("stale")

    threads = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, out)) == ["1", "stale"] and generations.read(spark, root).count() == 50


def test_a_view_expires(spark, tmp_path):
    root = f"file://{tmp_path}/view"
    held = generations.publish(spark.range(3), root, None, valid_until="2026-05-02T00:00:00")
    assert generations.read(spark, root, held, now=dt.datetime(2026, 5, 1, 23)).count() == 3
    with pytest.raises(generations.ExpiredView):
        generations.read(spark, root, now=dt.datetime(2026, 5, 2))
