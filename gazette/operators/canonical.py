"""The canonical event: what is known of a listing, with "unknown" said and never guessed, and the
states that depend on now. ``refreshed`` works those out again without the rest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.dates import epoch_auto, instant_in_zone, single_date
from gazette.functions.measures import prize_exact
from gazette.functions.text import canonical_url, clean, clean_tags, public_url_ok

#: Fields that may be named as being in conflict.
CONFLICTS = ("title", "organizer", "mode", "registration_deadline", "event_start", "event_end", "prize", "eligibility", "min_team_size", "max_team_size", "desc", "tags", "edition_identity")
#: What is known of a date, and the words for states.
TIMESTAMP, DATE, LOCAL_DATETIME, NO_DATE = "timestamp", "date", "local_datetime", "unknown"
CANCELLED, CLOSED, OPEN = ("cancelled", "canceled"), ("closed", "ended", "completed", "finished"), ("open", "live", "active", "registration open")
AWARE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$"
TIMED = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"
OFFSET = "^[+-](0[0-9]|1[0-4]):?[0-5][0-9]$"
REGION = "^[A-Z][A-Za-z_]*(/[A-Za-z0-9_+-]+)+$|^(UTC|GMT)$"
CLOSING_DAYS, STALE_DAYS = 5, 14


def stamp(text: Column) -> Column:
    """The moment of a date-time that names its offset; null without one."""
    with_seconds = F.regexp_replace(text, "^(.{10}[T ][0-9]{2}:[0-9]{2})(Z|[+-][0-9]{2}:?[0-9]{2})$", "$1:00$2")
    return F.when(text.rlike(AWARE), F.try_to_timestamp(with_seconds))


def lenient_stamp(text: Column) -> Column:
    """As stamp, but a date-time without an offset is UTC, and a number is seconds or milliseconds."""
    number = F.when(text.rlike("^[0-9]{9,14}$"), epoch_auto(text.cast("bigint")))
    return F.coalesce(number, F.try_to_timestamp(text))


def known_zone(zone: Column) -> Column:
    """A zone that exists: a region's name or an offset of at most 14 hours; else null."""
    name = F.trim(zone)
    exists = F.concat(F.lit("2000-01-01 00:00:00 "), name).try_cast("timestamp").isNotNull()
    return F.when(name.rlike(OFFSET), name).when(name.rlike(REGION) & exists, name)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


#: What event_date gives.
EVENT_DATE = "struct<at:timestamp,date:date,precision:string,timezone:string,local_value:string>"


def event_date(text: Column, zone: Column | None = None) -> Column:
    """at, date, precision (timestamp, date, local_datetime or unknown), timezone and local_value of a
    date text. A date-time with an offset is a moment; one without is a moment in the zone, if the zone
    has exactly one such; else it stays a local date-time, which is never taken for a moment."""
    given = F.lit(None).cast("string") if zone is None else zone
    own = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, "(Z|[+-][0-9]{2}:?[0-9]{2})$", 1), "^Z$", "+0000"), ":", "")
    read = F.struct(text.alias("text"), known_zone(given).alias("zone"), stamp(text).alias("moment"), F.coalesce(text.rlike(TIMED) & F.coalesce(stamp(text), F.try_to_timestamp(text)).isNotNull(), F.lit(False)).alias("timed"), single_date(text).alias("day"), own.alias("own"))

    def placed(x: Column) -> Column:
        zone = F.coalesce(x["zone"], F.lit("UTC"))
        inside = F.when(x["timed"] & x["moment"].isNull() & x["zone"].isNotNull(), instant_in_zone(x["text"], zone))
        return _let(F.struct(inside.alias("inside")), lambda y: F.struct(F.coalesce(x["moment"], F.when(y["inside"]["kind"] == "instant", F.try_to_timestamp(y["inside"]["at"]))).alias("at"), zone.alias("zone")))

    def whole(x: Column) -> Column:
        return _let(placed(x), lambda y: _let(F.when(y["at"].isNotNull(), TIMESTAMP).when(x["timed"], LOCAL_DATETIME).when(x["day"].isNotNull(), DATE).otherwise(NO_DATE), lambda p: F.struct(
            y["at"].alias("at"),
            F.when(x["moment"].isNotNull() & x["zone"].isNotNull(), F.to_date(F.from_utc_timestamp(x["moment"], y["zone"]))).when(x["timed"], F.to_date(F.substring(x["text"], 1, 10))).otherwise(x["day"]).alias("date"),
            p.alias("precision"),
            F.when(p != NO_DATE, F.coalesce(x["zone"], F.when(x["moment"].isNotNull(), x["own"]))).alias("timezone"),
            F.when(p == LOCAL_DATETIME, x["text"]).alias("local_value"),
        )))

    return _let(read, whole)


def _today(date: Column, now: dt.datetime) -> Column:
    """The day that it is at now where a date holds; UTC where its zone is not known."""
    return F.to_date(F.from_utc_timestamp(F.lit(now), F.coalesce(date["timezone"], F.lit("UTC"))))


def over(date: Column, now: dt.datetime) -> Column:
    """Whether an event_date lies behind: its moment is not after now, or its day is over in its zone. A
    local date-time names no moment and is never over."""
    return F.coalesce(F.when(date["at"].isNotNull(), date["at"] <= F.lit(now)).when(date["precision"] == DATE, date["date"] < _today(date, now)), F.lit(False))


def _ahead(date: Column, now: dt.datetime, today: Column) -> Column:
    return F.coalesce((date["at"] > F.lit(now)) | ((date["precision"] == DATE) & (date["date"] > today)), F.lit(False))


def registration(status: Column, opens: Column, closes: Column, ends: Column, submission: Column, now: dt.datetime) -> Column:
    """cancelled, closed, upcoming, closing, open or unknown; the first that holds."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    due = F.when(closes["at"].isNotNull(), F.to_date(closes["at"])).when(closes["precision"] == DATE, closes["date"])
    return (
        F.when(s.isin(*CANCELLED), "cancelled")
        .when(s.isin(*CLOSED) | over(closes, now) | over(ends, now) | over(submission, now), "closed")
        .when(_ahead(opens, now, _today(opens, now)), "upcoming")
        .when(F.datediff(due, F.lit(now.date())) <= CLOSING_DAYS, "closing")
        .when(due.isNotNull() | s.isin(*OPEN), "open")
        .when(s == "upcoming", "upcoming")
        .otherwise("unknown")
    )


def happening(status: Column, starts: Column, ends: Column, now: dt.datetime) -> Column:
    """cancelled, ended, scheduled, live or unknown: of the event itself."""
    s = F.lower(F.coalesce(status, F.lit("")))
    on = (starts["at"] <= F.lit(now)) & (ends["at"] >= F.lit(now))
    return (
        F.when(s.isin(*CANCELLED), "cancelled")
        .when(over(ends, now) | s.isin("ended", "completed", "finished"), "ended")
        .when(_ahead(starts, now, F.lit(now.date())) | (~F.coalesce(on, F.lit(False)) & (s == "upcoming")), "scheduled")
        .when(on | (s == "ongoing"), "live")
        .otherwise("unknown")
    )


def event_format(mode: Column) -> Column:
    m = F.lower(F.coalesce(mode, F.lit("")))
    return F.when(m.rlike("\\bhybrid\\b"), "hybrid").when(m.rlike("\\b(online|virtual|remote)\\b"), "online").when(m.rlike("\\b(offline|in[ _-]person|on[ -]?site)\\b"), "offline").otherwise("unknown")


#: Columns of a listing that may be missing; they count as null.
OPTIONAL = {
    "timezone": "string", "opens": "string", "closes": "string", "starts": "string", "ends": "string", "submission": "string", "event_status_source": "string", "publication": "string", "archive_reason": "string", "location": "string", "venue": "string", "city": "string", "country": "string",
    "lat": "double", "lng": "double", "min_team_size": "bigint", "max_team_size": "bigint", "eligibility": "string", "external_id": "string", "updated": "timestamp", "checked": "timestamp", "method": "string", "evidence": "string", "confidence": "double", "verification_stale": "boolean",
}
#: States of publication that keep an event from being shown, whatever its dates.
HELD_BACK = ("suppressed", "pending")
DATES = ("opens", "closes", "starts", "ends", "submission")


def canonical(rows: DataFrame, now: dt.datetime) -> DataFrame:
    """rows (id, title, organizer, source, link, mode, prize, status as texts, tags and conflicts array<string>, seen
    timestamp; dates as texts and whatever else is in OPTIONAL) as canonical events. Unsafe links become null;
    unknown texts become null; only named conflicts are kept; nothing is taken as verified without evidence."""
    full = rows.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items() if c not in rows.columns])
    dated = lambda c: event_date(F.col(c), F.col("timezone")) if c in rows.columns else F.lit(None).cast(EVENT_DATE)
    x = full.select(*[F.coalesce(dated(c), F.struct(F.lit(None), F.lit(None), F.lit(NO_DATE), F.lit(None), F.lit(None)).cast(EVENT_DATE)).alias(c) for c in DATES], *[c for c in full.columns if c not in DATES])
    link = F.when(public_url_ok(F.col("link")), canonical_url(F.col("link")))
    team = lambda c: F.when((F.col(c) > 0) & (F.col(c) <= 100_000_000), F.col(c))
    ordered = ~F.coalesce(team("min_team_size") > team("max_team_size"), F.lit(False))
    placed = F.coalesce((F.abs("lat") <= 90) & (F.abs("lng") <= 180), F.lit(False))
    evident = F.coalesce((F.col("method") == "administrator_evidence") & (F.col("checked") <= F.lit(now)) & clean(F.col("evidence")).isNotNull(), F.lit(False))
    verified = evident & ~F.coalesce("verification_stale", F.lit(False))
    own = F.struct(clean(F.col("source"), 150).alias("platform"), link.alias("url"), clean(F.col("external_id"), 150).alias("external_id"), F.col("seen").alias("observed_at"))
    said = F.coalesce("event_status_source", F.when(F.lower(F.trim("status")).isin(*CANCELLED), F.lit("cancelled")))
    kept = x.select(
        "id",
        clean(F.col("title")).alias("title"),
        clean(F.col("organizer")).alias("organizer"),
        clean(F.col("source"), 150).alias("source"),
        link.alias("registration_url"),
        F.when(link.isNotNull(), "source_reported").otherwise("unknown").alias("registration_url_status"),
        event_format(F.col("mode")).alias("format"),
        F.struct(*[clean(F.col(c), n).alias(c) for c, n in (("location", 500), ("venue", 500), ("city", 150), ("country", 150))], F.when(placed, F.col("lat")).alias("latitude"), F.when(placed, F.col("lng")).alias("longitude")).alias("place"),
        prize_exact(F.col("prize")).alias("prize"),
        F.struct(F.when(ordered, team("min_team_size")).alias("minimum"), F.when(ordered, team("max_team_size")).alias("maximum")).alias("team"),
        clean(F.col("eligibility"), 4000).alias("eligibility"),
        clean_tags("tags").alias("tags"),
        F.filter("conflicts", lambda c: c.isin(*CONFLICTS)).alias("conflicting_fields"),
        (F.col("provenance") if "provenance" in x.columns else F.array(own)).alias("provenance"),
        F.struct(F.when(verified, "verified").otherwise("unverified").alias("status"), F.when(verified & F.col("confidence").between(0, 1), F.col("confidence")).alias("confidence"), F.when(evident, F.col("checked")).alias("last_success_at"), F.when(evident, F.col("method")).alias("method")).alias("verification"),
        "status",
        said.alias("event_status_source"),
        "publication",
        "archive_reason",
        *DATES,
        "seen",
        "updated",
    )
    future = F.col("seen") > F.lit(now)
    found = _as_of(kept, now, F.when(F.col("seen").isNull() | future, "unknown"))
    shown = F.when(F.col("publication").isin(*HELD_BACK), F.col("publication")).when(F.col("registration_state").isin("closed", "cancelled") | (F.coalesce("archive_reason", F.lit("")) != ""), "archived").otherwise("published")
    hold = F.when(F.col("publication").isin(*HELD_BACK), F.col("publication"))
    return found.withColumns({"publication_state": shown, "publication_hold": hold}).drop("publication", "archive_reason")


def _as_of(events: DataFrame, now: dt.datetime, unknown: Column) -> DataFrame:
    """events with event_status, registration_state and freshness as of now; unknown: where there is no freshness."""
    col = F.col
    stale = col("seen") < F.lit(now - dt.timedelta(days=STALE_DAYS))
    state = registration(col("status"), col("opens"), col("closes"), col("ends"), col("submission"), now)
    out = events.withColumns({"event_status": happening(col("event_status_source"), col("starts"), col("ends"), now), "registration_state": state, "freshness": F.coalesce(unknown, F.when(stale, "stale").otherwise("fresh"))})
    doubtful = (col("freshness") == "stale") & (col("closes.precision") == NO_DATE) & col("registration_state").isin("open", "upcoming")
    return out.withColumn("registration_state", F.when(doubtful, "unknown").otherwise(col("registration_state")))


def refreshed(events: DataFrame, now: dt.datetime) -> DataFrame:
    """Canonical events with what depends on now worked out again, and nothing else: an event that has
    closed is archived, and one that was archived does not come back."""
    found = _as_of(events, now, F.when(F.col("seen").isNull(), F.col("freshness")))
    closed = F.col("registration_state").isin("closed", "cancelled") & ~F.col("publication_state").isin("pending", "suppressed")
    return found.withColumn("publication_state", F.when(closed, "archived").otherwise(F.col("publication_state")))


def audit(events: DataFrame) -> DataFrame:
    """One row: records, those without a known closing date, those whose link is not safe, those that are stale or unseen."""
    return events.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("closes.precision") == "unknown").alias("unknown_dates"), F.count_if(F.col("registration_url").isNull()).alias("unsafe_links"), F.count_if(F.col("freshness") != "fresh").alias("not_fresh"))


def visible(events: DataFrame) -> DataFrame:
    """Without events that are suppressed or wait for review. Where the hold is a column, nothing of the dates and
    states that publication_state depends on has to be worked out for it."""
    state = "publication_hold" if "publication_hold" in events.columns else "publication_state"
    return events.filter(~F.coalesce(F.col(state).isin(*HELD_BACK), F.lit(False)))
