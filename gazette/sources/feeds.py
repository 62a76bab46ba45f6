"""Landed feeds to listings: each parser is a DataFrame transform over the bodies of one source.

A landing table has one row a fetched page: ``body`` (text), and where it matters ``page`` (its
number). Fetching is outside the engine. JSON is read with a schema given here, so that only the
fields used are parsed; items without a title or a link give no row. A body that is no JSON of the
expected shape gives no rows and is counted by ``outcomes``; it is told from an empty feed.
All parsers give COLUMNS, in that order; ``as_of`` is the day that decides what has ended.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = {
    "source": "string", "source_event_id": "string", "title": "string", "link": "string", "organizer": "string", "mode": "string", "location": "string",
    "status": "string", "deadline_kind": "string", "deadline_iso": "string", "tags": "array<string>", "prize": "string", "min_team": "int", "max_team": "int",
    "registrations": "bigint", "description": "string",
}

THEMED = "array<struct<id:string,title:string,url:string,displayed_location:struct<location:string>,themes:array<struct<name:string>>,submission_end:string,open_state:string,time_left_to_submission:string,prize_amount:string,organization_name:string,registrations_count:bigint>>"
CHALLENGES = "array<struct<id:string,title:string,url:string,end_date:string,status:string,challenge_type:string,college:boolean,description:string,is_online:boolean,is_own:boolean>>"
TEAMS = "array<struct<id:string,name:string,eventName:string,hackathon:string,registrationDeadline:string,openStatus:string,registrationStatus:string,status:string,location:string,prizePool:string,theme:array<string>,skillLevel:string,teamSize:string,numberOfRegistrations:bigint,organizationName:string>>"
OPPORTUNITIES = "array<struct<id:string,title:string,seo_url:string,public_url:string,region:string,regnRequirements:struct<end_regn_dt:string>,filters:array<struct<name:string>>,prizes:array<struct<cash:double>>,organisation:struct<name:string>,registerCount:bigint>>"
EMBEDDED_ITEM = "struct<uuid:string,name:string,slug:string,is_online:boolean,location:string,settings:struct<reg_ends_at:string>,themes:array<struct<name:string>>>"
EMBEDDED = f"struct<props:struct<pageProps:struct<dehydratedState:struct<queries:array<struct<state:struct<data:struct<open_hackathons:array<{EMBEDDED_ITEM}>,upcoming_hackathons:array<{EMBEDDED_ITEM}>,featured_hackathons:array<{EMBEDDED_ITEM}>>>>>>>>>"
CURATED = "array<struct<title:string,link:string,source:string,mode:string,location:string,deadline_iso:string,tags:array<string>,status:string,prize:string,min_team_size:int,max_team_size:int,total_registrations:bigint>>"


def _said(value: Column) -> Column:
    """Trimmed; null where empty."""
    return F.nullif(F.trim(value), F.lit(""))


def _day(value: Column) -> Column:
    """The ISO day a text starts with, or the day of a number of seconds; else null."""
    iso = F.regexp_extract(F.trim(value), "^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    seconds = F.when(F.trim(value).rlike("^[0-9]{9,11}$"), F.from_unixtime(F.trim(value).cast("bigint"), "yyyy-MM-dd"))
    return F.coalesce(F.when(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).isNotNull(), iso), seconds)


def _over(day: Column, as_of: dt.date) -> Column:
    return F.coalesce(day < F.lit(as_of.isoformat()), F.lit(False))


def _items(bodies: DataFrame, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return bodies.select(*keep, F.explode(F.from_json("body", schema)).alias("x"))


def _listings(items: DataFrame, by: str, keep: tuple[str, ...] = (), **values: Column) -> DataFrame:
    given = {"source": F.lit(by), **values}
    rows = items.select(*keep, *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    return rows.filter(F.col("title").isNotNull() & F.col("link").isNotNull())


def _names(items: Column) -> Column:
    return F.filter(F.transform(items, lambda t: _said(t["name"])), lambda n: n.isNotNull())


def embedded_json(html: Column, element: str = "__NEXT_DATA__") -> Column:
    """The JSON text inside the script element of that id."""
    return _said(F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{element}"[^>]*>(.*?)</script>', 1))


def from_embedded(pages: DataFrame, as_of: dt.date, source: str, base_url: str) -> DataFrame:
    """Pages (html in body) whose feed is JSON in a script element: the open, upcoming and featured
    lists of every query, each item once by its slug."""
    data = F.from_json(embedded_json(F.col("body")), EMBEDDED)["props"]["pageProps"]["dehydratedState"]["queries"]
    none = F.array().cast(f"array<{EMBEDDED_ITEM}>")

    def listed(name: str) -> Column:
        held = F.flatten(F.transform(data, lambda q: F.coalesce(q["state"]["data"][name], none)))
        return F.filter(F.coalesce(held, none), lambda item: item.isNotNull())

    lists = [listed(name) for name in ("open_hackathons", "upcoming_hackathons", "featured_hackathons")]
    x = F.col("x")
    day = _day(x["settings"]["reg_ends_at"])
    rows = _listings(
        pages.select(F.posexplode(F.concat(*lists)).alias("place", "x")), source, ("place",), source_event_id=_said(x["uuid"]), title=_said(x["name"]), link=F.concat(F.lit(base_url), _said(x["slug"])),
        mode=F.when(x["is_online"], "Online").when(~x["is_online"], "In-person").otherwise("Unknown"), location=_said(x["location"]), deadline_kind=F.lit("registration"),
        deadline_iso=day, status=F.when(_over(day, as_of), "Ended").when(day.isNotNull(), "Open").otherwise("Unknown"), tags=_names(x["themes"]),
    )
    return rows.groupBy("link").agg(F.min_by(F.struct(*COLUMNS), F.struct("place", "source_event_id")).alias("r")).select("r.*")


def from_themed(bodies: DataFrame, as_of: dt.date, source: str) -> DataFrame:
    """Items with themes and a place; what ends is the submission, so the registration day stays unknown."""
    x, place = F.col("x"), F.coalesce(F.col("x.displayed_location.location"), F.lit(""))
    ended = (F.coalesce(x["open_state"], F.lit("")) == "ended") | _over(_day(x["submission_end"]), as_of)
    org = _said(x["organization_name"])
    left = F.coalesce(x["time_left_to_submission"], F.lit(""))
    return _listings(
        _items(bodies, THEMED), source, source_event_id=x["id"], title=_said(x["title"]), link=_said(x["url"]), organizer=org, location=place,
        mode=F.when(F.lower(place).contains("online"), "Online").otherwise("Offline"), status=F.when(ended, "Ended").otherwise("Unknown"), deadline_kind=F.lit("submission"),
        tags=_names(x["themes"]), prize=_said(F.regexp_replace(F.regexp_replace(x["prize_amount"], "<[^>]*>", ""), "\\s+", " ")),
        registrations=F.coalesce(x["registrations_count"], F.lit(0)), description=F.when(org.isNotNull(), F.concat(left, F.lit(". Organized by "), org, F.lit("."))).otherwise(left),
    )


def from_challenges(bodies: DataFrame, as_of: dt.date, source: str) -> DataFrame:
    """The source's own challenges that have not ended; descriptions over 500 characters are cut to 497 and an ellipsis."""
    x = F.col("x")
    ended = (F.upper(F.coalesce(x["status"], F.lit(""))) == "ENDED") | _over(_day(x["end_date"]), as_of)
    text = F.trim(F.coalesce(x["description"], F.lit("")))
    tags = F.filter(F.array(_said(x["challenge_type"]), F.when(x["college"], "College")), lambda t: t.isNotNull())
    own = _items(bodies, CHALLENGES).filter(F.coalesce(x["is_own"], F.lit(True)) & ~ended)
    return _listings(
        own, source, source_event_id=x["id"], title=_said(x["title"]), link=_said(x["url"]), status=F.lit("Unknown"), deadline_kind=F.lit("event"), tags=tags,
        mode=F.when(x["is_online"], "Online").when(~x["is_online"], "Offline").otherwise("Unknown"),
        description=F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 497), F.lit("…"))).otherwise(text),
    )


def from_teams(bodies: DataFrame, as_of: dt.date, source: str, base_url: str) -> DataFrame:
    """Items with a team size ("2-6" or "4"), a slug for the link and up to eight tags."""
    x = F.col("x")
    day = _day(x["registrationDeadline"])
    open_ = F.upper(F.coalesce(_said(x["openStatus"]), x["registrationStatus"], F.lit("")))
    form = F.upper(F.coalesce(x["status"], F.lit("")))
    mode = F.when(form.isin("ONLINE", "VIRTUAL", "REMOTE"), "Online").when(form.isin("OFFLINE", "IN-PERSON", "ONSITE", "ON-SITE"), "Offline").when(form == "HYBRID", "Hybrid").otherwise("Unknown")
    level = F.nullif(_said(x["skillLevel"]), F.lit("All Levels"))
    tags = F.filter(F.concat(F.coalesce(F.transform(x["theme"], _said), F.array().cast("array<string>")), F.array(level)), lambda t: t.isNotNull())
    team = F.trim(F.coalesce(x["teamSize"], F.lit("")))
    low, high = (F.expr(f"try_cast(trim(split_part(x.teamSize, '-', {k})) as int)") for k in (1, 2))
    return _listings(
        _items(bodies, TEAMS), source, source_event_id=x["id"], title=_said(x["name"]), link=F.concat(F.lit(base_url), F.coalesce(_said(x["eventName"]), _said(x["hackathon"]))),
        organizer=_said(x["organizationName"]), mode=mode, location=F.coalesce(_said(x["location"]), F.when(mode == "Online", "Online")), deadline_kind=F.lit("registration"),
        deadline_iso=day, status=F.when(open_.isin("CLOSED", "ENDED") | _over(day, as_of), "Ended").when(open_ == "OPEN", "Open").otherwise("Unknown"), tags=F.slice(tags, 1, 8),
        prize=_said(x["prizePool"]), registrations=F.coalesce(x["numberOfRegistrations"], F.lit(0)), min_team=low, max_team=F.when(team.contains("-"), high).otherwise(low),
    )


def from_opportunities(bodies: DataFrame, as_of: dt.date, source: str, base_url: str) -> DataFrame:
    """Items over several pages and queries (columns body, page): of items with one link that of
    the last page counts. Field names vary, and the deadline is a text or a number of seconds."""
    x = F.col("x")
    day = _day(x["regnRequirements"]["end_regn_dt"])
    link = F.coalesce(_said(x["seo_url"]), F.concat(F.lit(base_url), _said(x["public_url"])))
    region = F.lower(F.coalesce(x["region"], F.lit("")))
    cash = F.aggregate(F.coalesce(x["prizes"], F.array().cast("array<struct<cash:double>>")), F.lit(0.0), lambda a, p: a + F.coalesce(p["cash"], F.lit(0.0)))
    rows = _listings(
        _items(bodies, OPPORTUNITIES, ("page",)), source, ("page",), source_event_id=x["id"], title=_said(x["title"]), link=link, organizer=_said(x["organisation"]["name"]),
        mode=F.when(region == "online", "Online").when(region == "offline", "In-person").when(region == "hybrid", "Hybrid").otherwise("Unknown"), deadline_kind=F.lit("registration"), deadline_iso=day,
        status=F.when(_over(day, as_of), "Ended").when(day.isNotNull(), "Open").otherwise("Unknown"), tags=_names(x["filters"]), prize=F.when(cash > 0, cash.cast("bigint").cast("string")), registrations=x["registerCount"],
    )
    last = F.max_by(F.struct(*COLUMNS), F.struct("page", "source_event_id"))
    return rows.groupBy("link").agg(last.alias("r")).select("r.*")


def from_curated(bodies: DataFrame) -> DataFrame:
    """A hand-kept list, taken as it is."""
    x = F.col("x")
    same = {c: x[c] for c in ("title", "link", "source", "mode", "location", "deadline_iso", "tags", "status", "prize")}
    values = {**same, "title": _said(x["title"]), "link": _said(x["link"]), "min_team": x["min_team_size"], "max_team": x["max_team_size"], "registrations": x["total_registrations"]}
    return _listings(_items(bodies, CURATED), "", **values)


def matching(listings: DataFrame, keywords: tuple[str, ...], columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """A row for each of the (stated) keywords that a listing names, in one pass: no join."""
    text = F.lower(F.concat_ws(" ", *columns))
    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: text.contains(F.lower(k)))
    return listings.withColumn("keyword", F.explode(hits))


def outcomes(bodies: DataFrame, schema: str, html: bool = False) -> DataFrame:
    """body_state of each landed body: malformed (no JSON of this shape), empty, or ok."""
    parsed = F.from_json(embedded_json(F.col("body")) if html else F.col("body"), schema)
    if html:
        queries = parsed["props"]["pageProps"]["dehydratedState"]["queries"]
        lists = ("open_hackathons", "upcoming_hackathons", "featured_hackathons")
        held = F.exists(queries, lambda q: reduce(lambda a, n: a | (F.coalesce(F.size(q["state"]["data"][n]), F.lit(0)) > 0), lists, F.lit(False)))
        known = F.exists(queries, lambda q: q["state"]["data"].isNotNull())
        state = F.when(F.coalesce(held, F.lit(False)), "ok").when(F.coalesce(known, F.lit(False)), "empty").otherwise("malformed")
    else:
        state = F.when(parsed.isNull(), "malformed").when(F.size(parsed) == 0, "empty").otherwise("ok")
    return bodies.withColumn("body_state", state)


def deduplicated(listings: DataFrame) -> DataFrame:
    """One listing a link: the one of the first source by name."""
    first = Window.partitionBy("link").orderBy(F.col("source").asc_nulls_last(), "title", "source_event_id")
    return listings.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
