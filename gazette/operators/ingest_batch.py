"""One batch of observations from resolution to the store.

Observations are resolved against the stored events; those that match are merged field by field; those that
are not sure but hold a stored event's URL, platform id or edition are held for review, never inserted;
the rest are coalesced among themselves and become events. Events, ledger and reviews are written as one
generation and named once, so readers see a batch whole or not at all. Every observation has an
id (its digest) and the ledger holds the ids that have been taken in: a batch that is run again, whole or in part,
changes nothing.

Within a batch the order of arrival decides what becomes an event's first source. Of several
observations that match one event the newest is merged; of the others URLs and source records are kept,
and the ledger names them as superseded.

Cases: an observation without a title or a public URL is rejected and said so in the ledger; equal
observations count once; nulls in other columns are unknown values, which never erase known ones; an empty
batch publishes nothing; an empty store is a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.text import canonical_url, clean, public_url_ok
from gazette.functions.unicode import folded
from gazette.operators import coalesce, identity, ingest
from gazette.session import held, spread
from gazette.sources import generations

FIELDS = ["source", "source_event_id", "link", "title", "organizer", "format", "location", "day", "registration_day", "prize", "registrations"]
OBSERVATION = "source string, source_event_id string, link string, title string, organizer string, format string, location string, day date, registration_day date, prize string, registrations bigint, authority int, observed_at timestamp, source_updated_at timestamp"
STORED = f"event_id string, source string, source_event_id string, link string, title string, organizer string, format string, location string, day date, registration_day date, prize string, registrations bigint, url_aliases array<string>, records array<{ingest.RECORD}>, conflicting_fields array<string>, authority int, last_seen_at timestamp, archive_reason string, revision bigint, verification_stale boolean, review string"
LEDGER = "observation string, event_id string, observed_at timestamp, outcome string, reasons array<string>, ignored_reason string, changes map<string,struct<before:string,after:string>>"
EVENTS, LOG = "events", "ledger"
#: Compared in their Unicode forms.
NAMES = ["title", "organizer", "location"]


def observation_id(rows: DataFrame) -> Column:
    """Digest of an observation's values: the same for the same observation, whenever it comes."""
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)


def _edition() -> Column:
    """Key of the edition; null where too little is known of it."""
    online = F.col("format") == "online"
    place = F.when(online, "online").otherwise(F.col("location"))
    return identity.edition_key(F.col("title"), F.col("organizer"), F.col("day"), F.when(F.col("format") != "unknown", F.col("format")), place)


def _source_ids(source: str, own: str) -> Column:
    return F.when(F.col(own).isNotNull() & F.col(source).isNotNull(), F.array(F.concat_ws("|", F.lower(source), own)))


def _incoming_profiles(rows: DataFrame) -> DataFrame:
    rows = folded(rows, NAMES)
    return identity.profiles(rows.select(F.col("observation").alias("id"), "title", "organizer", "day", "registration_day", "format", "location", F.array("link").alias("urls"), _source_ids("source", "source_event_id").alias("source_ids"), _edition().alias("edition")))


def _stored_profiles(stored: DataFrame) -> DataFrame:
    none, stored = F.array().cast("array<string>"), folded(stored, NAMES)
    urls = F.array_distinct(F.filter(F.concat(F.array("link"), F.coalesce("url_aliases", none), F.transform("records", lambda r: r["url"])), lambda u: u.isNotNull()))
    of_records = F.transform(F.filter("records", lambda r: r["platform"].isNotNull() & r["external_id"].isNotNull()), lambda r: F.concat_ws("|", F.lower(r["platform"]), r["external_id"]))
    ids = F.array_distinct(F.concat(F.coalesce(_source_ids("source", "source_event_id"), none), of_records))
    return identity.profiles(stored.select(F.col("event_id").alias("id"), "title", "organizer", "day", "registration_day", "format", "location", urls.alias("urls"), ids.alias("source_ids"), _edition().alias("edition")))


def _least_holders(own: DataFrame, keys: DataFrame) -> DataFrame:
    """id and the least other id that holds an exact key of it: one row a key is joined, however many hold it. own
    and keys: rows with id, urls, source_ids and edition."""
    least = identity.exact_blocks(keys).groupBy("block").agg(F.min("id").alias("least"))
    return identity.exact_blocks(own).join(least, "block").groupBy("id").agg(F.min("least").alias("least"))


def resolved(observations: DataFrame, stored: DataFrame) -> DataFrame:
    """observation, event_id (null: a new event), outcome (MATCH, REVIEW, DISTINCT or HELD) and reasons. An
    observation that does not match, but has an exact key in common with a stored event, is HELD at that event."""
    if stored.isEmpty():
        return observations.select("observation", F.lit(None).cast("string").alias("event_id"), F.lit("DISTINCT").alias("outcome"), F.array(F.lit("no_candidates")).alias("reasons"))
    mine, theirs = held(_incoming_profiles(observations), "incoming"), held(_stored_profiles(stored), "stored")
    pairs, overflow = identity.candidate_pairs(mine, theirs)
    overflow = held(overflow, "overflow")
    compared = held(identity.compare(pairs, mine, theirs), "compared")
    found = held(identity.resolve(mine, compared, overflow), "found")
    tier = pairs.select("left_id", "right_id", "tier")
    unmatched = mine.join(found.filter("outcome <> 'MATCH'").select(F.col("left_id").alias("id")), "id", "left_semi")
    holders = _least_holders(unmatched, theirs).withColumnRenamed("id", "left_id")
    x = found.join(tier, ["left_id", "right_id"], "left").join(holders, "left_id", "left")
    collides = (F.col("outcome") != "MATCH") & F.col("least").isNotNull()
    at = F.when(F.col("tier") == identity.EXACT, F.col("right_id")).otherwise(F.col("least"))
    return x.select(
        F.col("left_id").alias("observation"),
        F.when(collides, at).when(F.col("outcome") == "MATCH", F.col("right_id")).alias("event_id"),
        F.when(collides, "HELD").otherwise(F.col("outcome")).alias("outcome"),
        F.when(collides, F.array_append("reasons", F.lit("stored_identity_collision"))).otherwise(F.col("reasons")).alias("reasons"),
    )


def _new_events(rows: DataFrame) -> DataFrame:
    """observation, event_id, outcome and reasons of observations that match nothing stored: NEW for those that
    become events, MATCH for those that join one of them, HELD where one shares an exact key but cannot."""
    arrival = F.concat_ws("|", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "observation")
    keyed = folded(rows.withColumn("id", arrival), NAMES)
    keyed = held(keyed.select("id", "observation", "title", "organizer", "day", "registration_day", "format", "location", F.array("link").alias("urls"), _source_ids("source", "source_event_id").alias("source_ids"), _edition().alias("edition")), "arrivals")
    groups = held(coalesce.groups(keyed.drop("observation")), "new-groups")
    doubtful = groups.filter("id = head and outcome = 'REVIEW'").select("id")
    apart = _least_holders(keyed.join(doubtful, "id", "left_semi"), keyed).filter("least < id")
    of_least = groups.select(F.col("id").alias("least"), F.col("head").alias("least_head"))
    held_at = apart.join(of_least, "least").select("id", "least_head")
    x = groups.join(held_at, "id", "left")
    own_id = lambda c: F.substring(F.sha2(c, 256), 1, 24)
    head = F.coalesce("least_head", "head")
    outcome = F.when(F.col("least_head").isNotNull(), "HELD").when(F.col("id") == F.col("head"), "NEW").otherwise("MATCH")
    return x.join(keyed.select("id", "observation"), "id").select("observation", own_id(head).alias("event_id"), outcome.alias("outcome"), F.array("reason").alias("reasons"))


def _record(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return F.struct(c("source").alias("platform"), c("link").alias("url"), c("source_event_id").alias("external_id"), c("observed_at").alias("observed_at"), c("source_updated_at").alias("source_updated_at")).cast(ingest.RECORD)


def applied(stored: DataFrame, taken: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events after a batch, and the ledger rows that it adds. taken: ids of observations (observation)
    that have been taken in before."""
    link = F.col("link")
    # few tasks read a file of few bytes: rows are dealt before digests are made of them
    named = spread(observations, 50_000).withColumn("observation", observation_id(observations)).join(taken.select("observation"), "observation", "left_anti").dropDuplicates(["observation"])
    fresh = held(named.withColumns({"title": clean(F.col("title")), "link": F.when(public_url_ok(link), canonical_url(link)), "format": F.coalesce("format", F.lit("unknown"))}), "fresh")
    if fresh.isEmpty():
        return stored, _empty(stored.sparkSession, LEDGER)
    whole = F.col("title").isNotNull() & F.col("link").isNotNull() & F.col("observed_at").isNotNull()
    usable, rejected = fresh.filter(whole), fresh.filter(~whole)
    against = held(resolved(usable, stored), "resolved")
    open_ = usable.join(against.filter("event_id is null").select("observation"), "observation", "left_semi")
    new = held(_new_events(open_), "new")
    review = against.filter("event_id is null and outcome = 'REVIEW'").select("observation", F.to_json(F.struct("outcome", "reasons")).alias("review"))
    rows = held(usable.join(against.filter("event_id is not null").unionByName(new), "observation"), "decided")

    heads = rows.filter("outcome = 'NEW'").join(review, "observation", "left").select(
        "event_id", *FIELDS, F.array("link").alias("url_aliases"), F.array(_record()).alias("records"), F.array().cast("array<string>").alias("conflicting_fields"), "authority", F.col("observed_at").alias("last_seen_at"),
        F.lit(None).cast("string").alias("archive_reason"), F.lit(1).cast("bigint").alias("revision"), F.lit(False).alias("verification_stale"), "review",
    )
    # only events that an observation matches or is held at can change
    met = rows.filter("outcome <> 'NEW'").select("event_id").distinct().withColumn("met", F.lit(True))
    before = held(stored.unionByName(heads).join(met, "event_id", "left"), "before")
    same = before.filter("met is null").withColumn("verification_stale", F.coalesce("verification_stale", F.lit(False)))
    marked = held(ingest.ranked(rows.filter("outcome = 'MATCH'")), "matching")
    newest, superseded = marked.filter("first").drop("first"), marked.filter("not first").drop("first")
    logged = [f for f in FIELDS if f not in ("day", "registration_day")]
    changing = before.filter("met").drop("met").withColumnRenamed("verification_stale", "was_stale").withColumn("was", F.struct(*logged))
    after = ingest.merged(changing, newest.drop("observation", "reasons"), FIELDS).withColumnRenamed("verification_stale", "now_stale")
    # URLs and records of what was superseded: a row for each event, platform and URL
    records = superseded.groupBy("event_id", F.col("source").alias("p"), F.col("link").alias("u")).agg(F.max_by(_record(), F.col("observed_at")).alias("record"))
    late = records.groupBy("event_id").agg(F.array_sort(F.collect_list("record")).alias("late"))
    editions = rows.filter("outcome = 'HELD'").filter(F.exists("reasons", lambda r: r.contains("year") | (r == "event_dates_far_apart"))).select("event_id").distinct().withColumn("edition", F.lit(True))
    here = lambda r: F.struct(r["platform"], r["url"])
    more = F.filter("late", lambda r: ~F.exists("records", lambda o: here(o).eqNullSafe(here(r))))
    joined = held(after.join(late, "event_id", "left").join(editions, "event_id", "left"), "merged")
    events = joined.select(
        *[c for c in stored.columns if c not in ("url_aliases", "records", "conflicting_fields", "verification_stale")],
        F.when(F.col("late").isNull(), F.col("url_aliases")).otherwise(F.array_sort(F.array_union("url_aliases", F.transform("late", lambda r: r["url"])))).alias("url_aliases"),
        F.when(F.col("late").isNull(), F.col("records")).otherwise(F.concat("records", more)).alias("records"),
        F.when(F.col("edition"), F.array_sort(F.array_union("conflicting_fields", F.array(F.lit("edition_identity"))))).otherwise(F.col("conflicting_fields")).alias("conflicting_fields"),
        (F.coalesce("was_stale", F.lit(False)) | F.coalesce("now_stale", F.lit(False))).alias("verification_stale"),
    ).unionByName(same.drop("met")).select(*stored.columns)

    none = F.lit(None).cast("map<string,struct<before:string,after:string>>")
    entry = lambda df, why, changed=none: df.select("observation", "event_id", "observed_at", "outcome", "reasons", why.alias("ignored_reason"), changed.alias("changes"))
    nothing = F.lit(None).cast("string")
    merged_rows = newest.join(joined.select("event_id", "ignored", ingest.changes(logged, "was.", "").alias("changes")), "event_id")
    log = entry(merged_rows, F.col("ignored"), F.when(F.size("changes") > 0, F.col("changes")))
    log = log.unionByName(entry(superseded, F.lit("superseded")))
    log = log.unionByName(entry(rows.filter("outcome = 'NEW'"), nothing))
    held_rows = ingest.held(rows.filter("outcome = 'HELD'").withColumn("outcome", F.lit("REVIEW")))
    log = log.unionByName(entry(held_rows.withColumn("why", F.col("ignored_reason")).drop("ignored_reason"), F.col("why")))
    log = log.unionByName(entry(rejected.withColumns({"event_id": nothing, "outcome": F.lit("REJECTED"), "reasons": F.array().cast("array<string>")}), F.lit("title_and_url_required")))
    return events, log


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def events(spark: SparkSession, root: str) -> DataFrame:
    """The stored events as of the last batch."""
    now = generations.current(spark, root)
    return generations.read(spark, root, now, EVENTS) if now else _empty(spark, STORED)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """What every observation so far came to."""
    now = generations.current(spark, root)
    return generations.read(spark, root, now, LOG) if now else _empty(spark, LEDGER)


def ingest_batch(spark: SparkSession, root: str, observations: DataFrame) -> dict | None:
    """Takes a batch in: one new generation of events and ledger, or none if all of it was taken in before.
    Another writer's generation in between makes this one fail (StaleManifest) without a trace: run it again."""
    seen = generations.current(spark, root)
    stored = generations.read(spark, root, seen, EVENTS) if seen else _empty(spark, STORED)
    before = generations.read(spark, root, seen, LOG) if seen else _empty(spark, LEDGER)
    after, log = applied(stored, before, observations)
    log = held(log, "log")
    if log.isEmpty():
        return None
    return generations.publish_tables({EVENTS: after, LOG: before.unionByName(log)}, root, seen)
