"""Date parsing and the time-dependent states of a listing; "now" is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.data import DATE_RANGE, LABELLED_DATE, REGISTRATION_LABEL

CLOSING_DAYS = 5
STALE_DAYS = 14
BUCKET_DAYS = 14
#: Days from 0001-01-01 (day 1) to the epoch, so that buckets are those of a proleptic ordinal.
EPOCH_ORDINAL = 719163

FORMATS = ("yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy")


def single_date(text: Column) -> Column:
    """The date, if the text is one complete date; ranges and anything else give null."""
    x = F.trim(F.regexp_replace(text, "\\b(\\d{1,2})(st|nd|rd|th)\\b", "$1"))
    return F.coalesce(*[F.try_to_date(x, f) for f in FORMATS])


def last_iso_date(text: Column) -> Column:
    """The latest valid ISO date named in a text, from years 2000 to 2100."""
    found = F.regexp_extract_all(text, F.lit("\\b(20\\d\\d-\\d\\d-\\d\\d|2100-\\d\\d-\\d\\d)\\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: F.try_to_date(x, "yyyy-MM-dd")))


def epoch_auto(value: Column) -> Column:
    """Seconds or milliseconds since the epoch, told apart by size."""
    return F.when(value > 10**12, F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))


def day_bucket(day: Column) -> Column:
    return F.floor((F.unix_date(day) + EPOCH_ORDINAL) / BUCKET_DAYS)


def registration_state(status: Column, closes: Column, opens: Column, as_of: dt.date) -> Column:
    """cancelled, closed, upcoming, closing, open or unknown; the first that holds."""
    s, today = F.lower(F.coalesce(status, F.lit(""))), F.lit(as_of)
    return (
        F.when(s.isin("cancelled", "canceled"), "cancelled")
        .when(s.isin("closed", "ended", "completed", "finished") | (closes < today), "closed")
        .when(opens > today, "upcoming")
        .when(F.datediff(closes, today) <= CLOSING_DAYS, "closing")
        .when(closes.isNotNull(), "open")
        .when(s.isin("open", "live", "active", "registration open"), "open")
        .when(s == "upcoming", "upcoming")
        .otherwise("unknown")
    )


def event_status(status: Column, starts: Column, ends: Column, as_of: dt.date) -> Column:
    s, today = F.lower(F.coalesce(status, F.lit(""))), F.lit(as_of)
    return (
        F.when(s.isin("cancelled", "canceled"), "cancelled")
        .when(ends < today, "ended")
        .when(starts > today, "scheduled")
        .when((starts <= today) & (ends >= today), "live")
        .when(s.isin("closed", "ended", "completed", "finished"), "ended")
        .otherwise("unknown")
    )


def freshness(seen: Column, as_of: dt.datetime, stale_days: int = STALE_DAYS) -> Column:
    """fresh, stale, or unknown when never seen or seen in the future."""
    now = F.lit(as_of)
    return F.when(seen.isNull() | (seen > now), "unknown").when(seen < now - F.expr(f"INTERVAL {stale_days} DAYS"), "stale").otherwise("fresh")


def urgency(deadline: Column, as_of: dt.date) -> Column:
    left = F.datediff(deadline, F.lit(as_of))
    return F.when(deadline.isNull(), "Open").when(left < 0, "Expired").when(left == 0, "Today").when(left <= 2, "Soon").when(left <= 7, "Week").otherwise("Open")


def instant_in_zone(text: Column, zone: Column | str) -> Column:
    """(kind, at) of a date-time without an offset, read in a zone. 'instant' with the UTC time if the
    zone has exactly one such moment; 'local' with the time as given where clocks skip or repeat it;
    null if the text is no date-time."""
    local = F.try_to_timestamp(F.regexp_replace(text, "T", " "))
    utc = F.to_utc_timestamp(local, zone)
    shown = lambda shift: F.from_utc_timestamp(utc + F.expr(f"INTERVAL {shift} MINUTES"), zone)
    unique = (shown(0) == local) & (shown(60) != local) & (shown(-60) != local)
    pair = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))
    return F.when(local.isNull(), None).when(unique, pair("instant", utc)).otherwise(pair("local", local))


def local_day_end(at: Column, zone: str) -> Column:
    """The UTC time at which the zone's day that holds the moment ends."""
    return F.to_utc_timestamp(F.date_add(F.from_utc_timestamp(at, zone).cast("date"), 1).cast("timestamp"), zone)


def labelled_registration_date(text: Column) -> Column:
    """The date that a text names as the end of registration: every label has to be followed by one complete date
    that begins no range, in its line and before the next label, and all have to name the same day; else null."""
    after = lambda x: F.filter(x, lambda _, k: k > 0)
    # what follows each label, up to the next one, the line's end or a tag
    spans = F.transform(after(F.split(text, REGISTRATION_LABEL)), lambda s: F.trim(F.substring(F.split(s, "[\n<]")[0], 1, 100)))

    def day(span: Column) -> Column:
        token = F.regexp_extract(span, LABELLED_DATE, 1)
        ranged = F.substr(span, F.length(token) + 1).rlike(DATE_RANGE)
        return F.when((token != "") & ~ranged, single_date(F.initcap(F.regexp_replace(token, "(?i)(?<=\\d)(st|nd|rd|th)\\b", ""))))

    days = F.transform(spans, day)
    return F.when((F.size(F.array_distinct(days)) == 1), days[0])
