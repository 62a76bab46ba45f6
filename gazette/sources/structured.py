"""What a page says of itself in its markup: metadata, microdata scopes and JSON-LD graphs.

One pass of the standard library's parser over each page, in Arrow batches; everything after it is columns. A
page gives one row: title, description and image by precedence, and an array of things (events and others)
with where they were found. Malformed JSON blocks are counted and passed over; broken nesting ends with its element.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import decoded, platform_free_title

TITLE_END = re.compile("</title", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
THING = ("kind", "type", "name", "url", "start", "end", "attendance", "location", "description", "image")
SCHEMA = f"id bigint, title string, title_source string, og_title string, twitter_title string, og_description string, plain_description string, twitter_description string, og_image string, twitter_image string, malformed int, things array<struct<{','.join(f'{t}:string' for t in THING)}>>"
#: Names of metadata, and what they are kept as; the first element of a name counts.
META = {("property", "og:title"): "og_title", ("name", "twitter:title"): "twitter_title", ("property", "og:description"): "og_description", ("name", "description"): "plain_description", ("name", "twitter:description"): "twitter_description", ("property", "og:image"): "og_image", ("name", "twitter:image"): "twitter_image"}


class _Prop:
    """A property of a microdata scope; its text is what stands in its element."""

    def __init__(self, name: str, depth: int, content: str | None, within: int) -> None:
        self.name, self.depth, self.content, self.parts = name, depth, content, []
        self.within = within  # depth of the innermost location that it stands in

    def value(self, between: str = "") -> str:
        return (self.content or between.join(p for x in self.parts if (p := x.strip()))).strip()


class _Markup(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.tags = 0, []
        self.meta: dict[str, str] = {}
        self.title: list[str] | None = None
        self.title_at: tuple[int, int, int] | None = None  # line and column of its tag, and the tag's length
        self.script: list[str] | None = None
        self.blocks: list[str] = []
        self.scopes: list[tuple[int, str, str, list[_Prop]]] = []  # open: depth, type, href, properties
        self.open: list[_Prop] = []
        self.found: list[tuple[int, str, str, list[_Prop]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        if tag == "meta":
            for kind in ("property", "name"):
                name = META.get((kind, a.get(kind, "")))
                if name:
                    self.meta.setdefault(name, a.get("content", "").strip())
        elif tag == "title" and self.title is None:
            self.title, self.title_at = [], (*self.getpos(), len(self.get_starttag_text() or ""))
        elif tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            self.script = []
        prop = a.get("itemprop")
        if prop and self.scopes:
            made = _Prop(prop, self.depth if tag not in VOID else -1, a.get("content") or None, max((p.depth for p in self.open if p.name == "location"), default=-1))
            for scope in self.scopes:  # a property belongs to every scope that it stands in
                scope[3].append(made)
            if tag not in VOID:
                self.open.append(made)
        if "itemtype" in a and tag not in VOID:
            self.scopes.append((self.depth, a["itemtype"], a.get("href", ""), []))
        if tag not in VOID:
            self.tags.append(tag)
            self.depth += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            self.blocks.append("".join(self.script))
            self.script = None
        if tag not in self.tags:
            return
        while self.tags:
            last = self.tags.pop()
            self.depth -= 1
            while self.open and self.open[-1].depth >= self.depth:
                self.open.pop()
            while self.scopes and self.scopes[-1][0] >= self.depth:
                self._close()
            if last == tag:
                break

    def _close(self) -> None:
        self.found.append(self.scopes.pop())

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
            return
        if self.tags and self.tags[-1] == "title" and self.title is not None:
            self.title.append(data)
        for p in self.open:
            p.parts.append(data)

    def close(self) -> None:
        super().close()
        while self.scopes:
            self._close()


def _from_scope(depth: int, kind: str, href: str, props: list[_Prop]) -> tuple:
    first = lambda name, between="": next((p.value(between) for p in props if p.name == name), "")
    name = next((p.value() for p in props if p.name == "name" and p.within <= depth), "")
    place = next((p for p in props if p.name == "location"), None)
    where = " ".join(x.strip() for x in place.parts if x.strip()) if place else ""
    return ("microdata", kind.rsplit("/", 1)[-1], name, first("url") or href, first("startDate"), first("endDate"), first("eventAttendanceMode"), where, first("description"), first("image"))


def _text(value: object) -> str:
    """A value of JSON-LD as a text: of lists the first item, of objects their name, address or URL."""
    if isinstance(value, list):
        return _text(value[0]) if value else ""
    if isinstance(value, dict):
        return next((t for k in ("name", "address", "url", "@id", "streetAddress", "addressLocality") if (t := _text(value.get(k)))), "")
    return "" if value is None or isinstance(value, bool) else str(value).strip()


def _from_json(value: object, depth: int = 0) -> Iterator[tuple]:
    """The typed objects of a block, those of lists and graphs too."""
    if depth > 8:
        return
    if isinstance(value, list):
        for x in value:
            yield from _from_json(x, depth + 1)
    elif isinstance(value, dict):
        if "@graph" in value:
            yield from _from_json(value["@graph"], depth + 1)
        if "@type" in value or "name" in value or "description" in value:
            get = lambda *names: next((t for n in names if (t := _text(value.get(n)))), "")
            yield ("json", _text(value.get("@type")), get("name"), get("url", "@id"), get("startDate"), get("endDate"), get("eventAttendanceMode"), get("location"), get("description"), get("image"))


def _as_written(html: str, line: int, column: int, skip: int) -> str:
    """What stands behind a tag up to the title's end, with its character references."""
    at = 0
    for _ in range(line - 1):
        at = html.index("\n", at) + 1
    at += column + skip
    end = TITLE_END.search(html, at)
    return html[at : end.start() if end else len(html)]


def _parsed(html: str | None) -> tuple:
    """What parse gives, and the title as it is written."""
    page = _Markup()
    page.feed(html or "")
    page.close()
    things, malformed = [_from_scope(*x) for x in page.found], 0
    for block in page.blocks:
        try:
            things += _from_json(json.loads(block))
        except (ValueError, RecursionError):
            malformed += 1
    written = _as_written(html, *page.title_at) if page.title_at else None
    return ("".join(page.title).strip() if page.title is not None else None, page.meta, malformed, things, written)


def parse(html: str | None) -> tuple:
    """title, metadata by name, malformed blocks and things of a page."""
    return _parsed(html)[:4]


def markup(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row a page: id, what its metadata say, malformed blocks, and its things."""
    names = list(META.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [_parsed(h) for h in b.column("html").to_pylist()]
                things = pa.array([[{k: v or None for k, v in zip(THING, t, strict=True)} for t in r[3]] for r in rows], pa.list_(pa.struct([(k, pa.string()) for k in THING])))
                meta = [pa.array([r[1].get(n) or None for r in rows], pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r[0] or None for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string()), *meta, pa.array([r[2] for r in rows], pa.int32()), things], names=["id", "title", "title_source", *names, "malformed", "things"])

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)


def metadata(marked: DataFrame, references: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """id, title (og, twitter, then the title element; without the platform's name; null if it is shorter than 5),
    description (up to 500) and image of rows of markup. The title element's character references are decoded as
    browsers do, also where the semicolon is missing; with references only those are, and others stay as written."""
    own = F.col("title") if references is None else F.nullif(F.trim(decoded(F.col("title_source"), references)), F.lit(""))
    title = F.coalesce("og_title", "twitter_title", own)
    return marked.select("id", F.when(F.length(title) >= 5, platform_free_title(title)).alias("title"), F.substring(F.coalesce("og_description", "plain_description", "twitter_description"), 1, 500).alias("description"), F.coalesce("og_image", "twitter_image").alias("image"))


def _without_tracking(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "(?<=[?&])utm_[^&#]*&?", ""), "[?&](?=#|$)", "")


def events(marked: DataFrame) -> DataFrame:
    """The events among the things of rows of markup as listings: id, kind, title, link, mode, location, event_start,
    event_end; those with a title of 4 letters and a web link."""
    x = marked.select("id", F.explode("things").alias("t")).filter(F.col("t.type").rlike("Event$"))
    mode = F.lower(F.coalesce("t.attendance", F.lit("")))
    virtual = mode.contains("online") & ~mode.contains("offline") & ~mode.contains("mixed")
    link = _without_tracking(F.col("t.url"))
    rows = x.select(
        "id", "t.kind", F.col("t.name").alias("title"), link.alias("link"),
        F.when(virtual, "Virtual").when(mode.contains("mixed"), "Hybrid").otherwise("Offline").alias("mode"),
        F.when(virtual, "Online").otherwise(F.coalesce("t.location", F.when(mode.contains("mixed"), F.lit("Hybrid")).otherwise("TBA"))).alias("location"),
        F.col("t.start").alias("event_start"), F.col("t.end").alias("event_end"),
    )
    return rows.filter((F.length("title") >= 4) & F.col("link").startswith("http"))
