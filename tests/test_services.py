import datetime as dt

from pyspark.sql import functions as F

from gazette.functions import text
from gazette.operators import canonical, ingest, ledger, outbox
from gazette.plans import services, views


def test_fan_out_is_repaired_and_reconciled(spark):
    subs = spark.createDataFrame([(1, "all", True), (2, "x", True), (3, "y", True), (4, "all", False)], "subscriber int, preference string, active boolean")
    intents = spark.createDataFrame([(10, "x"), (11, "z"), (12, None)], "intent int, kind string")
    every = outbox.fan_out(intents, subs).collect()
    assert sorted((r["intent"], r["subscriber"]) for r in every) == [(10, 1), (10, 2), (11, 1), (12, 1)]
    made = spark.createDataFrame(every[:2])
    rest = outbox.fan_out(intents, subs, made).collect()
    assert {r["job"] for r in rest} | {r["job"] for r in every[:2]} == {r["job"] for r in every} and len(rest) == 2
    jobs = spark.createDataFrame([(10, "delivered"), (10, "delivered"), (11, "failed")], "intent int, state string")
    wanted = spark.createDataFrame([(10, 2), (11, 1), (12, 1)], "intent int, wanted long")
    assert {r["intent"]: r["notified"] for r in outbox.reconciled(wanted, jobs).collect()} == {10: True, 11: False, 12: False}
    assert outbox.with_admin(subs, 4).count() == 4 and outbox.with_admin(subs, 9).count() == 5


def test_claims_take_due_jobs_and_lost_leases(spark):
    now = dt.datetime(2026, 1, 2)
    early, late = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 3)
    rows = [("a", "pending", 0, None, None), ("b", "retryable", 1, early, None), ("c", "retryable", 1, late, None), ("d", "processing", 1, early, early), ("e", "processing", 1, early, late), ("f", "pending", 5, early, None), ("g", "delivered", 1, early, None)]
    jobs = spark.createDataFrame(rows, "job string, state string, attempts int, next_attempt_at timestamp, lease_until timestamp")
    assert [r["job"] for r in outbox.claim(jobs, F.lit(now), 9).collect()] == ["a", "b", "d"]


STORED = f"event_id int, source string, source_event_id string, link string, title string, prize string, url_aliases array<string>, records array<{ingest.RECORD}>, conflicting_fields array<string>, authority int, last_seen_at timestamp, archive_reason string, revision long"
NEW = "event_id int, outcome string, reasons array<string>, source string, source_event_id string, link string, title string, prize string, authority int, observed_at timestamp, source_updated_at timestamp"


def merge(spark, new, conflicts=(), authority=1):
    day = dt.datetime(2026, 1, 1)
    stored = spark.createDataFrame([(1, "feed", "7", "l1", "Old", "TBA", ["l1"], [("feed", "l1", "7", day, day)], list(conflicts), authority, day, "stale", 1)], STORED)
    row = {"event_id": 1, "outcome": "MATCH", "reasons": [], "source": "feed", "source_event_id": "7", "link": "l1", "title": "New", "prize": "P", "authority": 1, "observed_at": dt.datetime(2026, 1, 2), "source_updated_at": None} | new
    return ingest.merged(stored, spark.createDataFrame([tuple(row.values())], NEW), ["title", "prize"]).first()


def test_field_merge(spark):
    r = merge(spark, {})
    assert (r["title"], r["prize"], r["revision"], r["archive_reason"], r["changed"]) == ("New", "P", 2, None, ["prize", "title"])
    r = merge(spark, {"source": "other", "source_event_id": "9", "link": "l2"})  # not the primary source: a known title stays
    assert (r["title"], r["prize"], r["link"], r["conflicting_fields"], r["url_aliases"], len(r["records"])) == ("Old", "P", "l1", ["title"], ["l1", "l2"], 2)
    r = merge(spark, {"link": "l2", "title": None, "prize": "TBA"})  # the same platform id may move its link
    assert (r["link"], r["title"], r["prize"]) == ("l2", "Old", "TBA")
    r = merge(spark, {"source": "desk", "source_event_id": None, "link": "l3", "authority": 3}, conflicts=["title"])
    assert (r["title"], r["conflicting_fields"], r["authority"]) == ("New", [], 3)
    assert merge(spark, {"observed_at": dt.datetime(2025, 1, 1)})["ignored"] == "older_observation"
    r = merge(spark, {"source_updated_at": dt.datetime(2025, 1, 1)})
    assert (r["ignored"], r["title"], r["revision"]) == ("older_source_version", "Old", 1)


def test_dates_of_canonical_events(spark):
    want = {
        ("2026-05-01", None): (None, "2026-05-01", "date", None, None),
        ("2026-05-01", "Asia/Kolkata"): (None, "2026-05-01", "date", "Asia/Kolkata", None),
        ("2026-05-01T10:00:00+05:30", None): ("2026-05-01 04:30", "2026-05-01", "timestamp", "+0530", None),
        ("2026-05-01T23:00:00Z", "Asia/Kolkata"): ("2026-05-01 23:00", "2026-05-02", "timestamp", "Asia/Kolkata", None),
        ("2026-05-01 10:00:00", None): (None, "2026-05-01", "local_datetime", None, "2026-05-01 10:00:00"),
        ("2026-05-01 10:00:00", "Asia/Kolkata"): ("2026-05-01 04:30", "2026-05-01", "timestamp", "Asia/Kolkata", None),
        ("2026-05-01T10:00", "+0530"): ("2026-05-01 04:30", "2026-05-01", "timestamp", "+0530", None),
        ("2026-03-08 02:30:00", "America/New_York"): (None, "2026-03-08", "local_datetime", "America/New_York", "2026-03-08 02:30:00"),  # skipped
        ("2026-11-01 01:30:00", "America/New_York"): (None, "2026-11-01", "local_datetime", "America/New_York", "2026-11-01 01:30:00"),  # repeated
        ("2026-05-01 10:00:00", "Mars/Base"): (None, "2026-05-01", "local_datetime", None, "2026-05-01 10:00:00"),
        ("2026-05-01", "+15:00"): (None, "2026-05-01", "date", None, None),
        ("TBA", "Asia/Kolkata"): (None, None, "unknown", None, None),
        (None, None): (None, None, "unknown", None, None),
    }
    rows = spark.createDataFrame(list(want), "t string, z string").select("t", "z", canonical.event_date(F.col("t"), F.col("z")).alias("d"))
    got = {(r["t"], r["z"]): (r["at"], r["date"], r["precision"], r["timezone"], r["local_value"]) for r in rows.select("t", "z", F.date_format("d.at", "yyyy-MM-dd HH:mm").alias("at"), F.col("d.date").cast("string").alias("date"), "d.precision", "d.timezone", "d.local_value").collect()}
    assert got == want


def test_a_day_ends_in_its_zone_and_a_local_time_never(spark):
    rows = [("2024-07-01", "Asia/Kolkata"), ("2024-07-01", None), ("2024-07-01", "America/New_York"), ("2024-07-01 10:00", None), ("2024-07-01 10:00", "Asia/Kolkata")]
    at = lambda now: [r[0] for r in spark.createDataFrame(rows, "t string, z string").select(canonical.over(canonical.event_date(F.col("t"), F.col("z")), now)).collect()]
    assert at(dt.datetime(2024, 7, 1, 20)) == [True, False, False, False, True]
    assert at(dt.datetime(2024, 7, 2, 1)) == [True, True, False, False, True]
    assert at(dt.datetime(2024, 7, 3, 12)) == [True, True, True, False, True]


def test_states_of_canonical_events(spark):
    now = dt.datetime(2024, 7, 1, 12)
    base = {"id": 1, "title": "T", "organizer": None, "source": "s", "link": "https://h.example/1", "mode": "On-site", "prize": None, "status": None, "tags": [], "conflicts": ["title", "city"], "seen": now, "timezone": None, "opens": None, "closes": None, "starts": None, "ends": None, "submission": None}
    schema = "id int, title string, organizer string, source string, link string, mode string, prize string, status string, tags array<string>, conflicts array<string>, seen timestamp, timezone string, opens string, closes string, starts string, ends string, submission string, min_team_size long, max_team_size long, lat double, lng double, method string, evidence string, checked timestamp, confidence double, archive_reason string, publication string"

    cases = [
        ({"closes": "2024-07-04"}, ("closing", "unknown", "published")),
        ({"closes": "2024-07-20", "opens": "2024-07-02"}, ("upcoming", "unknown", "published")),
        ({"closes": "2024-07-20", "starts": "2024-06-01T00:00Z", "ends": "2024-08-01T00:00Z"}, ("open", "live", "published")),
        ({"submission": "2024-06-30"}, ("closed", "unknown", "archived")),
        ({"status": " Canceled "}, ("cancelled", "cancelled", "archived")),
        ({"status": "upcoming", "seen": dt.datetime(2024, 6, 1)}, ("unknown", "unknown", "published")),
        ({"closes": "2024-07-20", "archive_reason": "manual"}, ("open", "unknown", "archived")),
        ({"closes": "2024-06-20", "publication": "suppressed"}, ("closed", "unknown", "suppressed")),
        ({"status": "open", "closes": "2024-06-20 10:00"}, ("open", "unknown", "published")),
    ]
    names = [c.strip().split()[0] for c in schema.replace("array<string>", "x").split(",")]
    rows = [tuple({**base, "id": k, **given}.get(c) for c in names) for k, (given, _) in enumerate(cases)]
    out = canonical.canonical(spark.createDataFrame(rows, schema), now)
    got = {r["id"]: r for r in out.collect()}
    assert [(got[k]["registration_state"], got[k]["event_status"], got[k]["publication_state"]) for k in range(len(cases))] == [want for _, want in cases]
    assert got[0]["format"] == "offline" and got[0]["conflicting_fields"] == ["title"] and got[0]["provenance"][0]["url"] == "https://h.example/1"
    later = {r["id"]: r for r in canonical.refreshed(out, dt.datetime(2024, 7, 5, 12)).collect()}
    assert (later[0]["registration_state"], later[0]["publication_state"]) == ("closed", "archived") and later[1]["registration_state"] == "open"
    odd = {"min_team_size": 4, "max_team_size": 2, "lat": 95.0, "lng": 3.0, "method": "administrator_evidence", "evidence": "seen it", "checked": now, "confidence": 1.5}
    r = canonical.canonical(spark.createDataFrame([tuple({**base, **odd}.get(c) for c in names)], schema), now).first()
    assert tuple(r["team"]) == (None, None) and r["place"]["latitude"] is None and (r["verification"]["status"], r["verification"]["confidence"]) == ("verified", None)


def test_small_samples_and_horizon(spark):
    one = spark.createDataFrame([(3.0, 1)], "v double, k int")
    assert tuple(ledger.latency_summary(one, "v", [F.col("k")]).first()) == (3.0, 3.0, 3.0, 3.0, 1)
    none = ledger.latency_summary(one.limit(0), "v", [F.col("k")]).first()
    assert none["n"] == 0 and none["p95"] is None
    now = dt.datetime(2026, 1, 2, 5)
    rows = spark.createDataFrame([(dt.datetime(2026, 1, 2, 7), dt.datetime(2025, 1, 1)), (None, None)], "at timestamp, seen timestamp")
    assert ledger.valid_until(rows, ["at"], "seen", now).first()[0] == dt.datetime(2026, 1, 2, 7)
    assert ledger.valid_until(rows.limit(0), ["at"], "seen", now).first()[0] == dt.datetime(2026, 1, 3)


def test_agents_without_a_value(spark):
    row = spark.createDataFrame([(None,)], "a string").select(text.user_agent(F.col("a")).alias("u")).first()["u"]
    assert tuple(row) == ("Unknown", "Unknown", "Unknown")


def test_fan_out_makes_each_job_once_in_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(outbox, "SHARE_JOBS", 100)
    subs = spark.createDataFrame([(k, ("all", "x", "y", "none")[k % 4], k % 5 > 0) for k in range(40)] + [(0, "x", True), (1, "all", True), (1, "x", True)], "subscriber int, preference string, active boolean")
    kinds = [(k, ("x", "y", "all", None)[k % 4]) for k in range(80)] + [(0, "y"), (0, "y"), (3, "x")]
    intents = spark.createDataFrame(kinds, "intent int, kind string")
    want = {(i, s) for i, kind in kinds for s, p, active in subs.collect() if active and p in ("all", kind)}
    every = outbox.fan_out(intents, subs)
    assert every.rdd.getNumPartitions() > 8  # before: as few as files of the size make
    rows = [tuple(r) for r in every.select("intent", "subscriber").collect()]
    assert len(rows) == len(want) and set(rows) == want
    made = every.filter("intent < 40 and (intent + subscriber) % 3 > 0").localCheckpoint()
    rest = [tuple(r) for r in outbox.fan_out(intents, subs, made).select("intent", "subscriber").collect()]
    assert len(rest) == len(set(rest)) and set(rest) == want - {(r["intent"], r["subscriber"]) for r in made.collect()}


def test_scans_that_show_no_title_do_not_read_the_lines(spark):
    shown = services.catalog_visible_scan(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in " ".join(shown.inputFiles())  # before: aggregated and joined for titles that nobody reads
    assert "lineitem" in " ".join(views.listings(spark, "/root/testdata/sf0.001").inputFiles())
    assert "closes" not in shown._jdf.queryExecution().optimizedPlan().toString()  # nor work out dates for a hold


def test_fan_out_reads_whole_jobs_once_and_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(outbox, "SHARE_JOBS", 400)
    subs = spark.createDataFrame([(k, ("all", "x")[k % 2], True) for k in range(120)], "subscriber int, preference string, active boolean")
    intents = spark.createDataFrame([(k, ("x", "y")[k % 2]) for k in range(90)], "intent long, kind string")
    seen = spark.sparkContext.accumulator(0)

    def read(k):
        seen.add(1)
        return k

    every = outbox.fan_out(intents, subs).localCheckpoint()
    made = every.filter("intent < 60").withColumn("subscriber", F.udf(read, "long")("subscriber"))
    rest = outbox.fan_out(intents, subs, made).select("intent", "subscriber")
    assert {tuple(r) for r in rest.collect()} == {(r["intent"], r["subscriber"]) for r in every.collect() if r["intent"] >= 60}
    assert seen.value == every.filter("intent < 60").count()  # before: each was read again and shuffled to meet its pair


def test_fan_out_repairs_jobs_that_only_look_whole(spark):
    subs = spark.createDataFrame([(k, "all", True) for k in range(6)] + [(7, "all", False), (None, "all", True)], "subscriber int, preference string, active boolean")
    intents = spark.createDataFrame([(k, "x") for k in range(5)] + [(None, "x")], "intent int, kind string")
    jobs = [(0, k) for k in (0, 1, 2, 3, 4, 4, None)]  # one twice, one missing
    jobs += [(1, k) for k in (0, 1, 2, 3, 4, 7, None)]  # one for a subscriber who has left, one missing
    jobs += [(2, k) for k in (0, 1, 2, 3, 4, 5, None)] + [(None, k) for k in (0, 1, 2, 3, 4, 5, None)]  # whole
    jobs += [(3, k) for k in (0, 1, 2, 3, 4, 5, 7, None)]  # whole and one more
    for kind in ("int", "long", "string"):
        made = spark.createDataFrame(jobs, "intent long, subscriber long").selectExpr("'' AS job", f"cast(intent AS {kind}) AS intent", f"cast(subscriber AS {kind}) AS subscriber")
        got = [(r["intent"], r["subscriber"]) for r in outbox.fan_out(intents, subs, made).collect()]
        assert sorted(got, key=str) == sorted([(0, 5), (1, 5)] + [(4, k) for k in (0, 1, 2, 3, 4, 5, None)], key=str)
