"""Classification and verification of listings, as columns only: one pass over the rows, no shuffle.

Points are integers (hundredths, or ten-thousandths once weighted), so that a verdict at a border
does not hang on floating-point order. Null texts count as empty.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.data import BITS_CAMPUSES, IIIT_CAMPUSES, IIT_CAMPUSES, NIT_CAMPUSES

# Institutes by family, in the order in which they are tried.
INSTITUTES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("IIT", (r"iit\b", r"iits\b", r"indian\s+institute\s+of\s+technology"), IIT_CAMPUSES),
    ("NIT", (r"nit\b", r"nits\b", r"national\s+institute\s+of\s+technology"), NIT_CAMPUSES),
    ("IIIT", (r"iiit\b", r"iiits\b", r"indian\s+institute\s+of\s+information\s+technology"), IIIT_CAMPUSES),
    ("BITS", (r"bits\b", r"birla\s+institute\s+of\s+technology\s+(?:and|&)\s+science"), BITS_CAMPUSES),
    ("IISc", (r"iisc\b", r"indian\s+institute\s+of\s+science"), ()),
    ("IIM", (r"iim\b", r"iims\b", r"indian\s+institute\s+of\s+management"), ()),
    ("CFTI", (r"coep\b", r"college\s+of\s+engineering\s+pune", r"pict\b", r"pune\s+institute\s+of\s+computer\s+technology", r"vjti\b", r"veermata\s+jijabai", r"dtu\b", r"delhi\s+technological\s+university", r"nsut\b", r"netaji\s+subhas\s+(?:university|institute)", r"dce\b", r"delhi\s+college\s+of\s+engineering"), ()),
)
# Patterns of internships, of large employers, of titles and of spam.
INTERNSHIP = r"(?i)\b(?:internship|intern\b|hiring\s+challenge|placement|job\s+offer|ppo\b|ppi\b|stipend|career\s+track|hiring|recruit)"
EMPLOYERS = r"(?i)\b(?:faang|mango|meta\b|google|apple\b|amazon\b|aws\b|netflix|microsoft)\b"
GOOD_TITLES = (r"hack(?:athon|a-thon|fest|day|night|week)", r"(?:code|coding)\s*(?:sprint|jam|challenge|fest)", r"(?:build|make|create|design|innovate)\s*(?:athon|a-thon)", r"(?:idea|data|app|game|web|ai|ml)\s*(?:thon|athon)", r"(?:challenge|competition|contest|championship)", r"(?:tech\s*fest|innovation\s*summit)")
BAD_TITLES = (r"^(?:test|example|demo|sample|placeholder)", r"(?:tutorial|course|lecture|webinar|workshop)\s*(?:on|about|for)")
SPAM = (r"(?:buy|sell|shop|discount|coupon|offer|sale)\s+(?:now|today)", r"(?:onlyfans|dating|crypto\s*pump|get\s*rich\s*quick)", r"(?:click\s+here\s+to\s+win|congratulations\s+you\s+won)", r"(?:100%\s+guaranteed|no\s+risk|limited\s+time\s+offer)", r"(?:work\s+from\s+home\s+earn|make\s+money\s+fast)", r"(?:free\s+iphone|free\s+gift\s+card|whatsapp\s+forward)")
KEYWORDS = ("hackathon", "hack", "challenge", "competition", "coding", "register", "registration", "prize", "team", "build", "innovation", "code", "develop", "project", "submit", "deadline", "application", "participate")
# Trust in domains and in sources, in hundredths; of the sources the first one contained counts.
DOMAIN_TRUST = {"devfolio.co": 95, "unstop.com": 95, "devpost.com": 95, "hackerearth.com": 90, "dare2compete.com": 90, "kaggle.com": 90, "mlh.io": 95, "lu.ma": 80, "luma.com": 80, "konfhub.com": 85, "eventbrite.com": 75, "eventbrite.in": 75, "meetup.com": 70, "techfest.org": 85, "hackon.live": 80, "hackclub.com": 85, "instagram.com": 60}
SOURCE_TRUST = {"devfolio": 100, "unstop": 100, "devpost": 100, "hackerearth": 95, "mlh": 95, "instagram": 60, "eventbrite": 75, "konfhub": 80, "web discovery": 50, "community / direct": 50, "community / auto-listed": 50}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, else null."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(None))


def institute_pattern(forms: tuple[str, ...], campuses: tuple[str, ...]) -> str:
    campus = rf"(?:\s+(?:{'|'.join(campuses)}))?" if campuses else ""
    return rf"(?i)\b(?:{'|'.join(forms)}){campus}"


def classified(rows: DataFrame, text_cols: tuple[str, ...] = ("title", "venue", "location", "city", "tagline", "desc"), tags_col: str = "tags") -> DataFrame:
    """Adds college_type and college_name (of the first family found), is_top_college,
    is_internship, opportunity_type, and the two employer tags where an employer is named. Of
    text_cols those that rows lacks are skipped; title has to be there."""
    has_tags = tags_col in rows.columns
    tags = F.coalesce(F.col(tags_col), F.array().cast("array<string>")) if has_tags else F.array().cast("array<string>")
    held = [_text(c) for c in text_cols if c in rows.columns]
    whole = F.concat_ws(" ", *held, F.array_join(tags, " "))
    named = [(F.lit(kind), F.regexp_extract("_whole", institute_pattern(forms, campuses), 0)) for kind, forms, campuses in INSTITUTES]
    title = F.lower(_text("title"))
    out = rows.withColumn("_whole", whole).withColumns(
        {
            "college_type": _first([(name != "", kind) for kind, name in named]),
            "college_name": _first([(name != "", F.trim(name)) for _, name in named]),
            "is_internship": F.col("_whole").rlike(INTERNSHIP),
            "tags": F.when(F.col("_whole").rlike(EMPLOYERS), _with_tags(tags, "faang", "mango")).otherwise(tags),
        }
    )
    kind = F.when(title.contains("hiring") | title.contains("challenge"), "Hiring Challenge").when(F.col("is_internship"), "Internship").otherwise("Hackathon")
    return out.withColumns({"is_top_college": F.col("college_type").isNotNull(), "opportunity_type": kind}).drop("_whole")


def _with_tags(tags: Column, *added: str) -> Column:
    held = F.transform(tags, F.lower)
    return F.concat(tags, *[F.when(F.array_contains(held, t), F.array().cast("array<string>")).otherwise(F.array(F.lit(t))) for t in added])


def title_points(title: Column) -> Column:
    n, any_of = F.length(title), lambda patterns: reduce(lambda a, p: a | title.rlike(f"(?i){p}"), patterns, F.lit(False))
    points = F.lit(30) + F.when(any_of(GOOD_TITLES), 30).otherwise(0)
    for p in BAD_TITLES:
        points = points - F.when(title.rlike(f"(?i){p}"), 40).otherwise(0)
    points = points + F.when(n.between(10, 100), 20).when(n > 100, 10).otherwise(0)
    points = points - F.when((title == F.upper(title)) & (title != F.lower(title)) & (n > 10), 10).otherwise(0)
    return F.when(n < 5, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points)))


def domain_points(host: Column) -> Column:
    """host: lower case, empty where the URL is not one that may be shown."""
    known = [((host == d) | host.endswith(f".{d}"), F.lit(p)) for d, p in DOMAIN_TRUST.items()]
    rest = [(host.endswith(".edu") | host.endswith(".ac.in"), F.lit(85)), (host.endswith(".org"), F.lit(65)), (host != "", F.lit(40))]
    return F.coalesce(_first(known + rest), F.lit(0))


def content_points(text: Column) -> Column:
    n = sum((F.when(text.contains(k), 1).otherwise(0) for k in KEYWORDS), F.lit(0))
    return F.when(F.trim(text) == "", 0).when(n >= 5, 100).when(n >= 3, 80).when(n >= 2, 60).when(n >= 1, 40).otherwise(10)


def date_points(iso: Column, as_of: dt.date) -> Column:
    """Unknown 50, no date 40, past 10, more than a year ahead 30, else 100."""
    day = F.try_to_timestamp(F.when(iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso), F.lit("yyyy-MM-dd")).cast("date")
    ahead = F.date_diff(day, F.lit(as_of))
    return F.when(F.coalesce(iso, F.lit("")) == "", 50).when(day.isNull(), 40).when(ahead < 0, 10).when(ahead > 365, 30).otherwise(100)


def spam_points(text: Column) -> Column:
    n = sum((F.when(text.rlike(p), 1).otherwise(0) for p in SPAM), F.lit(0))
    return F.when(n >= 3, 0).when(n >= 2, 20).when(n >= 1, 50).otherwise(100)


def source_points(source: Column) -> Column:
    low = F.lower(source)
    return F.when(low == "", 30).otherwise(F.coalesce(_first([(low.contains(k), F.lit(p)) for k, p in SOURCE_TRUST.items()]), F.lit(40)))


def liveness_points(code: Column) -> Column:
    """Of an observed HTTP status (0: the network failed; null: not observed)."""
    return F.when(code == 0, 20).when(code < 400, 100).when(code < 500, 30).when(code.isNotNull(), 10)


def link_state(code: Column) -> Column:
    """Only an explicit "not found" or "gone" is dead."""
    return F.when(code.isin(404, 410), "dead").when((code > 0) & (code < 400), "alive").otherwise("unknown")


def verified(rows: DataFrame, as_of: dt.date, known_links: DataFrame | None = None) -> DataFrame:
    """Adds the points of each signal, confidence (0 to 1), issues and recommendation.

    rows: title, link, desc, source, deadline_iso and, if links were observed, http_status.
    known_links (link): a row whose link is among them is rejected as a duplicate."""
    title, link, desc, source = (F.trim(_text(c)) for c in ("title", "link", "desc", "source"))
    both = F.lower(F.concat_ws(" ", title, desc))
    host = F.lower(F.regexp_extract(link, r"^(?i:https?)://([A-Za-z0-9.-]+\.[A-Za-z0-9-]+)(?::(?:80|443))?(?:[/?#]|$)", 1))
    out = rows.withColumns(
        {
            "title_quality": title_points(title),
            "domain_trust": domain_points(host),
            "content_relevance": content_points(both),
            "date_validity": date_points(F.col("deadline_iso"), as_of),
            "spam_check": spam_points(both),
            "source_trust": source_points(source),
            "url_liveness": liveness_points(F.col("http_status")) if "http_status" in rows.columns else F.lit(None).cast("int"),
        }
    )
    c = F.col
    total = c("title_quality") * 20 + c("domain_trust") * 25 + c("content_relevance") * 20 + c("date_validity") * 15 + c("spam_check") * 10 + c("source_trust") * 10
    total = total + F.when(c("url_liveness") < 30, -1000).when(c("url_liveness").isNotNull(), 500).otherwise(0)
    points = F.greatest(F.lit(0), F.least(F.lit(10000), total))
    out = out.withColumn("_p", points)
    if known_links is not None:
        known = known_links.select(F.col("link").alias("_known")).distinct()
        out = out.join(known, link == F.col("_known"), "left").withColumn("_copy", F.col("_known").isNotNull()).drop("_known")
    else:
        out = out.withColumn("_copy", F.lit(False))
    weak = [("title", c("title_quality") < 30), ("domain", c("domain_trust") < 30), ("content", c("content_relevance") < 30), ("spam", c("spam_check") < 50), ("unreachable", F.coalesce(c("url_liveness") < 30, F.lit(False))), ("duplicate", c("_copy"))]
    issues = F.filter(F.array(*[F.when(bad, name) for name, bad in weak]), lambda x: x.isNotNull())
    verdict = F.when(c("_copy") | (c("_p") < 3500), "reject").when(c("_p") < 5500, "review").otherwise("accept")
    confidence = F.when(c("_copy"), 0.0).otherwise(F.round(c("_p") / 10000, 3))
    return out.withColumns({"issues": issues, "recommendation": verdict, "confidence": confidence}).drop("_p", "_copy")


def exact_count(*texts: str) -> Column:
    """The first of the columns that is a whole number from 1 to 100 million ("12", "12.0"); else null."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    whole = lambda n: F.when((n > 0) & (n <= 100_000_000) & (n == F.floor(n)), n.cast("bigint"))
    return F.coalesce(*[whole(number(c)) for c in texts])


def short_number(n: Column) -> Column:
    """12,400 as 12.4k; less than a thousand as it is."""
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", F.floor(n / 100) / 10), F.lit("k"))).otherwise(n.cast("string"))


def class_counts(rows: DataFrame) -> DataFrame:
    """One row over classified rows (active boolean, total_registrations, registrations): how many are of a top college or
    internships, of all and of the active ones, the kinds of college among the active ones, and exact registrations."""
    top, intern, active = F.col("is_top_college"), F.col("is_internship"), F.col("active")
    registered = F.sum(F.coalesce(exact_count("total_registrations", "registrations"), F.lit(0)))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(top).alias("n_top"),
        F.count_if(intern).alias("n_internships"),
        F.count_if(top | intern).alias("n_kept"),
        F.count_if(top & active).alias("active_top"),
        F.count_if(intern & active).alias("active_internships"),
        F.sort_array(F.collect_set(F.when(top & active, F.col("college_type")))).alias("college_types"),  # at most a kind each
        registered.alias("registered"),
    ).withColumn("registered_short", short_number(F.col("registered")))


def notification_backlog(rows: DataFrame, most: int = 100) -> DataFrame:
    """Published rows of a top college or internships that nobody has been told of, those that were looked at longest ago first."""
    due = ~F.coalesce("notified", F.lit(False)) & (F.coalesce("publication_state", F.lit("published")) == "published") & (F.col("is_top_college") | F.col("is_internship"))
    return rows.filter(due).orderBy(F.col("checked_at").asc_nulls_first(), "id").limit(most)
