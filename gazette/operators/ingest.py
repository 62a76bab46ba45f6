"""Ingest of resolved observations as one job: field merge with authority, held reviews, ledger.

``stored``: event_id, the fields, source, source_event_id, link, url_aliases array<string>, records
array<RECORD>, conflicting_fields array<string>, authority int, last_seen_at, archive_reason,
revision bigint. ``incoming``: event_id (what the resolution matched, null for a new one), outcome,
reasons, the same fields, source, source_event_id, link, observed_at, source_updated_at, authority.
An event takes one observation a batch: the newest; the others are kept in the ledger as superseded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.data import METADATA_FIELDS, UNKNOWN_VALUES

RECORD = "struct<platform:string,url:string,external_id:string,observed_at:timestamp,source_updated_at:timestamp>"
STICKY = ("source", "link", "source_event_id")
#: An observation of this authority overrides any stored value.
REVIEWER = 3


def known(value: Column) -> Column:
    return value.isNotNull() & ~value.cast("string").isin(*UNKNOWN_VALUES)


def ranked(incoming: DataFrame) -> DataFrame:
    """incoming with first: whether it is the newest observation of its event; new events (null) are all newest."""
    order = F.struct("observed_at", "source", "link", F.xxhash64(*incoming.columns))
    last = incoming.filter("event_id is not null").groupBy("event_id").agg(F.max(order).alias("last"))
    return incoming.join(last, "event_id", "left").withColumn("first", F.col("last").isNull() | (order == F.col("last"))).drop("last")


def newest(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest observation of each event, and the others."""
    marked = ranked(incoming)
    return marked.filter("first").drop("first"), marked.filter("not first").drop("first")


def merged(stored: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """stored with what the observations (one an event, outcome MATCH) change, and of each event:
    ignored (why its observation does not count), changed (names), verification_stale. An older
    observation, or an older version of the platform's record, is ignored; an unknown value never
    erases a known one; the first source and link stay; a value that differs from a known one counts
    only with authority enough, else the field is in conflict."""
    new = incoming.filter("outcome = 'MATCH'").select("event_id", F.struct(*[c for c in incoming.columns if c != "event_id"]).alias("n"))
    x = stored.join(new, "event_id", "left")
    n = lambda c: F.col(f"n.{c}")
    same_record = lambda r: r["platform"].eqNullSafe(n("source")) & r["external_id"].eqNullSafe(n("source_event_id"))
    version = F.array_max(F.transform(F.filter("records", same_record), lambda r: r["source_updated_at"]))
    ignored = F.when(n("observed_at") < F.col("last_seen_at"), "older_observation").when(n("source_updated_at") < version, "older_source_version")
    takes = n("observed_at").isNotNull() & ignored.isNull()
    same_id = F.coalesce((F.lower(n("source")) == F.lower("source")) & (n("source_event_id") == F.col("source_event_id")), F.lit(False))
    primary = n("link").eqNullSafe(F.col("link")) | same_id
    weak = (n("authority") < F.col("authority")) | (~primary & (n("authority") < REVIEWER))
    differs = lambda f: takes & known(n(f)) & ~n(f).eqNullSafe(F.col(f))
    contested = lambda f: F.lit(False) if f in METADATA_FIELDS else differs(f) & known(F.col(f)) & weak
    changes = {f: differs(f) & ~contested(f) for f in fields if f not in STICKY}
    changes["link"] = takes & same_id & known(n("link")) & (n("link") != F.col("link"))
    names = lambda flags: F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in flags.items()]), lambda f: f.isNotNull())
    fresh = names({f: contested(f) for f in fields if f not in STICKY})
    settled = F.when(takes & (n("authority") >= REVIEWER), F.array_except("conflicting_fields", names({f: known(n(f)) for f in fields}))).otherwise(F.col("conflicting_fields"))
    conflicts = F.array_sort(F.array_union(settled, fresh))
    record = F.struct(n("source").alias("platform"), n("link").alias("url"), n("source_event_id").alias("external_id"), n("observed_at").alias("observed_at"), n("source_updated_at").alias("source_updated_at"))
    others = F.filter("records", lambda r: ~(r["platform"].eqNullSafe(n("source")) & r["url"].eqNullSafe(n("link"))))
    aliases = F.array_sort(F.array_distinct(F.filter(F.concat("url_aliases", F.array("link", n("link"))), lambda u: u.isNotNull())))
    facts = reduce(lambda a, b: a | b, [c for f, c in changes.items() if f not in METADATA_FIELDS])
    when = lambda value, old: F.when(takes, value).otherwise(F.col(old)).alias(old)
    kept = [c for c in stored.columns if c not in {*changes, "conflicting_fields", "records", "url_aliases", "authority", "last_seen_at", "archive_reason", "revision"}]
    return x.select(
        *kept,
        *[F.when(c, n(f)).otherwise(F.col(f)).alias(f) for f, c in changes.items()],
        when(conflicts, "conflicting_fields"),
        when(F.concat(others, F.array(record.cast(RECORD))), "records"),
        when(aliases, "url_aliases"),
        when(F.greatest("authority", n("authority")), "authority"),
        when(n("observed_at"), "last_seen_at"),
        when(F.when(~F.coalesce(F.col("archive_reason").isin("stale", "dead_link"), F.lit(False)), F.col("archive_reason")), "archive_reason"),
        when(F.col("revision") + 1, "revision"),
        ignored.alias("ignored"),
        F.array_sort(names(changes)).alias("changed"),
        (takes & ((F.size(conflicts) > 0) | facts)).alias("verification_stale"),
    )


def held(incoming: DataFrame) -> DataFrame:
    """Observations that are not merged: a REVIEW that points at a stored event, with the reason why it
    is held: a possible new edition (years or far dates), or a matter for review."""
    edition = F.exists("reasons", lambda r: r.contains("year") | (r == "event_dates_far_apart"))
    why = F.when(edition, "possible_new_edition").otherwise("entity_review")
    return incoming.filter("outcome = 'REVIEW' and event_id is not null").withColumn("ignored_reason", why)


def changes(fields: list[str], before: str, after: str) -> Column:
    """Map of field to before and after of the fields that differ; before and after: what their names begin with."""
    pair = lambda f: F.struct(F.col(f"{before}{f}").cast("string").alias("before"), F.col(f"{after}{f}").cast("string").alias("after"))
    every = F.create_map(*[x for f in fields for x in (F.lit(f), pair(f))])
    return F.map_filter(every, lambda _, v: ~v["before"].eqNullSafe(v["after"]))


def ledger_rows(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """event_id and changes (map of field to before and after) of events that changed."""
    both = before.alias("b").join(after.alias("a"), "event_id")
    return both.select("event_id", changes(fields, "b.", "a.").alias("changes")).filter(F.size("changes") > 0)
