"""The catalog query: options compiled to predicates and orderings, pages, totals and statistics."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gazette.functions.dates import registration_state
from gazette.functions.measures import distance_km
from gazette.operators import search

FORMAT_WORDS = (("hybrid", "hybrid"), ("online|virtual|remote", "online"), ("offline|in-person|in person|on-site|onsite", "offline"))
#: Categories with a meaning of their own; any other is looked for in source, mode and tag.
FIXED_CATEGORIES = {"top college": "is_top_college", "internship": "is_internship", "unique sources": "is_unique"}
OPPORTUNITIES = ("hackathon", "hiring challenge")
FAR_KM = 999999.0
PAST_TABS = ("missed", "lost", "lost_opportunities")


def published(listings: DataFrame, as_of: dt.date) -> DataFrame:
    """listings with the columns that queries read: past, missing, format, status, days_left."""
    kind = F.lit("unknown")
    for words, name in reversed(FORMAT_WORDS):
        kind = F.when(F.lower("mode").rlike(words), name).otherwise(kind)
    state = registration_state(F.col("status_text"), F.col("deadline"), F.lit(None).cast("date"), as_of)
    return listings.select(
        "*",
        F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False)).alias("past"),
        F.col("deadline").isNull().alias("missing"),
        kind.alias("format"),
        state.alias("status"),
        F.datediff("deadline", F.lit(as_of)).alias("days_left"),
    )


@dataclass(frozen=True)
class CatalogQuery:
    """The options of one request. None leaves an option out."""

    page: int = 1
    limit: int = 12
    source: str | None = None
    status: str = "all"
    category: str | None = None
    search: str | None = None
    format: str | None = None
    deadline_days: int | None = None
    ids: tuple[int, ...] = ()
    lat: float | None = None
    lng: float | None = None
    tab: str = "all"
    sort: str = "deadline"

    def __post_init__(self) -> None:
        if not (1 <= self.page <= 1000 and 1 <= self.limit <= 100):
            raise ValueError("page is 1 to 1000 and limit 1 to 100")
        if self.deadline_days is not None and not 1 <= self.deadline_days <= 30:
            raise ValueError("deadline_days is 1 to 30")
        if self.sort not in ("deadline", "name", "newest", "distance", "rank"):
            raise ValueError("unknown sort")
        if len(self.search or "") > 100 or len(self.ids) > 200:
            raise ValueError("search has up to 100 characters and ids up to 200 entries")

    def predicate(self, columns: list[str]) -> Column:
        """All conditions but the tab, on which totals do not depend, for a table of these columns."""
        c: list[Column] = []
        if self.ids:
            by_id = F.col("id").isin(*self.ids)
            c.append(by_id | F.arrays_overlap("aliases", F.array(*map(F.lit, self.ids))) if "aliases" in columns else by_id)
        if self.status == "open_all":
            c.append(~F.col("past"))
        elif self.status == "closed":
            c.append(F.col("status").isin("closed", "cancelled"))
        elif self.status != "all":
            c.append(F.col("status") == self.status)
        if self.source:
            c.append(F.lower("source") == self.source.lower())
        x = (self.category or "all").lower()
        if x in FIXED_CATEGORIES:
            c.append(F.coalesce(F.col(FIXED_CATEGORIES[x]), F.lit(False)))
        elif x in OPPORTUNITIES and "opportunity_type" in columns:
            c.append(F.lower("opportunity_type") == x)
        elif x in ("online", "offline"):
            c.append(F.col("format") == x)
        elif x != "all":
            c.append(F.coalesce(F.lower("source") == x, F.lit(False)) | F.coalesce(F.lower("mode") == x, F.lit(False)) | F.lower("tag").contains(x))
        if self.search:
            c.append(search.matches(search.corpus(columns), self.search))
        if self.format:
            c.append(F.col("format") == self.format.lower())
        if self.deadline_days:
            c.append(F.col("days_left").between(0, self.deadline_days))
        return reduce(lambda a, b: a & b, c, F.lit(True))

    @property
    def geo(self) -> bool:
        return self.lat is not None and self.lng is not None

    def order(self) -> list[Column]:
        """With a place, upcoming listings nearby come first among equals."""
        near = [F.col("past"), F.coalesce("distance_km", F.lit(FAR_KM))] if self.geo else []
        if self.sort == "name":
            return [F.lower("title").asc_nulls_last(), *near, F.col("id")]
        if self.sort == "newest":
            return [F.col("id").desc()]
        if self.sort == "distance" and self.geo:
            return [near[1], near[0], F.col("id")]
        if self.sort != "deadline":
            return [*near, F.col("id")]
        days = F.unix_date("deadline")
        return [F.col("past"), F.col("missing"), F.when(F.col("past"), -days).otherwise(days), *near[1:], F.col("id")]

    def matches(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.predicate(rows.columns))

    def results(self, rows: DataFrame) -> DataFrame:
        """The page: filter, tab, order, offset and limit (one TakeOrderedAndProject)."""
        return self._paged(self.matches(rows))

    def _paged(self, rows: DataFrame) -> DataFrame:
        if self.geo:
            rows = rows.withColumn("distance_km", distance_km(F.col("lat"), F.col("lng"), self.lat, self.lng))
        if self.tab in PAST_TABS:
            rows = rows.filter("past")
        elif self.tab != "all":
            rows = rows.filter("not past")
        return rows.orderBy(*self.order()).offset((self.page - 1) * self.limit).limit(self.limit)

    def page_with_totals(self, rows: DataFrame) -> DataFrame:
        """The page, with upcoming and missed of all that match, whatever the tab, in each of its rows. One
        scan: the totals are observed on the way to the page, which has up to limit rows. Without rows, none."""
        seen = Observation()
        found = self.matches(rows).observe(seen, F.count_if(~F.col("past")).alias("upcoming"), F.count_if("past").alias("missed"))
        page = self._paged(found).collect()
        totals = seen.get
        shown = rows.sparkSession.createDataFrame(page, self._paged(rows).schema)
        return shown.select("*", *[F.lit(totals[c]).cast("bigint").alias(c) for c in ("upcoming", "missed")])

    def totals(self, rows: DataFrame) -> DataFrame:
        """Upcoming and missed, in one pass."""
        return self.matches(rows).agg(F.count_if(~F.col("past")).alias("upcoming"), F.count_if("past").alias("missed"))


def statistics(rows: DataFrame) -> DataFrame:
    """One row of counts over published rows: all, active and lost, by state and format, prizes."""
    active = ~F.col("past")
    return rows.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(active).alias("n_active"),
        F.count_if("past").alias("n_lost"),
        F.count_if(F.col("status") == "open").alias("n_open"),
        F.count_if(F.col("status") == "closing").alias("n_closing"),
        F.count_if(active & (F.col("format") == "online")).alias("n_online"),
        F.count_if(active & (F.col("format") == "offline")).alias("n_offline"),
        F.count_distinct("source").alias("n_sources"),
        F.count_distinct("tag").alias("n_tags"),
        F.max("deadline").cast("string").alias("last_deadline"),
        F.sum(F.when(active, F.col("prize").cast("decimal(18,2)")).otherwise(0)).cast("double").alias("active_prize"),
    )


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("past")).alias("n_active"))


def nearby(rows: DataFrame, lat: float, lng: float, within_km: float) -> DataFrame:
    """Listings that are not past, take place somewhere and lie within a distance of a point."""
    found = rows.withColumn("distance_km", distance_km(F.col("lat"), F.col("lng"), lat, lng))
    return found.filter(~F.col("past") & F.col("format").isin("offline", "hybrid") & (F.col("distance_km") <= within_km))


def distance_page(rows: DataFrame, distance: Column, limit: int) -> DataFrame:
    """The nearest rows first; rows without a distance last, ties by id."""
    return rows.withColumn("distance_km", distance).orderBy(F.coalesce("distance_km", F.lit(999999.0)), "id").limit(limit)
