"""Queries over landed feeds, classification and verification. The feeds are laid out as JSON from
the driver's `orders` (a body for each customer), parsed back, and held against plain SQL on `orders`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators import classify
from gazette.plans.queries import register
from gazette.plans.views import AS_OF
from gazette.session import table
from gazette.sources import feeds

TITLES = ["IIT Bombay Hackathon", "Google Hiring Challenge", "Summer internship at NIT Trichy", "TEST EVENT OF THE YEAR", "Workshop on data", "Codefest", "iiit hyderabad code sprint", "Innovation Summit of COEP", "Go", "Buy now and click here to win, no risk", "Birla Institute of Technology & Science Goa hacknight", "ignite the nights"]
TEXTS = ["Register your team, build a project, submit code and win a prize", "A meeting of gardeners", "", "Free iPhone for everyone, make money fast", "Coding competition with stipend"]
LINKS = ["https://www.devpost.com/a", "https://events.unstop.com/b?x=1", "https://cs.college.edu/c", "https://club.org", "https://shop.example.net/e", "not a link", "http://www.instagram.com/g"]
SOURCES = ["Devpost", "Web Discovery (MLH)", "", "Somewhere", "Community / Direct"]
CODES = [200, 404, 503, 0]


def _pick(values: list, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _pick_sql(values: list, by: str) -> str:
    return "[" + ", ".join(repr(v) for v in values) + f"][{by} % {len(values)} + 1]"


SUBMISSIONS_SQL = f"""submissions AS (SELECT o_orderkey AS id, {_pick_sql(TITLES, "o_orderkey")} AS title, {_pick_sql(TEXTS, "o_custkey")} AS descr, {_pick_sql(LINKS, "o_orderkey")} AS link,
{_pick_sql(SOURCES, "o_orderkey")} AS source, {_pick_sql(CODES, "o_custkey")} AS http_status, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline_iso FROM orders)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    day = F.when(key % 6 == 1, "soon").when(key % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    picked = {"title": _pick(TITLES, key), "desc": _pick(TEXTS, other), "link": _pick(LINKS, key), "source": _pick(SOURCES, key), "http_status": _pick(CODES, other), "deadline_iso": day}
    return table(spark, sf_dir, "orders").select(key.alias("id"), *[v.alias(k) for k, v in picked.items()])


def _family_sql() -> tuple[str, str]:
    kinds, names = [], []
    for kind, forms, campuses in classify.INSTITUTES:
        found = f"regexp_extract(whole, '{classify.institute_pattern(forms, campuses)}', 0)"
        kinds.append(f"WHEN {found} <> '' THEN '{kind}'")
        names.append(f"WHEN {found} <> '' THEN trim({found})")
    return f"CASE {' '.join(kinds)} END", f"CASE {' '.join(names)} END"


KIND_SQL, NAME_SQL = _family_sql()


@register(f"""WITH {SUBMISSIONS_SQL}, s AS (SELECT *, title || ' ' || descr AS whole FROM submissions), c AS (SELECT *, {KIND_SQL} AS college_type, {NAME_SQL} AS college_name, regexp_matches(whole, '{classify.INTERNSHIP}') AS is_internship FROM s)
SELECT id, college_type, college_name, college_type IS NOT NULL AS is_top_college, is_internship, CASE WHEN regexp_matches(whole, '{classify.EMPLOYERS}') THEN 'faang,mango' ELSE '' END AS tags,
CASE WHEN lower(title) LIKE '%hiring%' OR lower(title) LIKE '%challenge%' THEN 'Hiring Challenge' WHEN is_internship THEN 'Internship' ELSE 'Hackathon' END AS opportunity_type FROM c""")
def classify_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.classified(submissions(spark, sf_dir))
    return rows.select("id", "college_type", "college_name", "is_top_college", "is_internship", F.array_join("tags", ",").alias("tags"), "opportunity_type")


def _count_sql(text: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, '{p}')::INT" for p in patterns) + ")"


def _domain_sql() -> str:
    known = " ".join(f"WHEN host = '{d}' OR ends_with(host, '.{d}') THEN {p}" for d, p in classify.DOMAIN_TRUST.items())
    return f"CASE {known} WHEN ends_with(host, '.edu') OR ends_with(host, '.ac.in') THEN 85 WHEN ends_with(host, '.org') THEN 65 WHEN host <> '' THEN 40 ELSE 0 END"


VERIFY_SQL = f"""WITH {SUBMISSIONS_SQL}, s AS (SELECT *, lower(title || ' ' || descr) AS whole, lower(regexp_extract(link, '^https?://([^/?#]+)', 1)) AS host, TRY_CAST(try_strptime(deadline_iso, '%Y-%m-%d') AS DATE) - DATE '{AS_OF}' AS ahead FROM submissions),
p AS (SELECT *, CASE WHEN length(title) < 5 THEN 0 ELSE greatest(0, least(100, 30 + 30 * ({_count_sql("lower(title)", classify.GOOD_TITLES)} > 0)::INT - 40 * {_count_sql("lower(title)", classify.BAD_TITLES)}
  + CASE WHEN length(title) BETWEEN 10 AND 100 THEN 20 WHEN length(title) > 100 THEN 10 ELSE 0 END - CASE WHEN title = upper(title) AND length(title) > 10 THEN 10 ELSE 0 END)) END AS title_quality,
  {_domain_sql()} AS domain_trust,
  list_sum([contains(whole, k)::INT FOR k IN {list(classify.KEYWORDS)}]) AS n, {_count_sql("whole", classify.SPAM)} AS bad,
  CASE WHEN deadline_iso IS NULL THEN 50 WHEN ahead IS NULL THEN 40 WHEN ahead < 0 THEN 10 WHEN ahead > 365 THEN 30 ELSE 100 END AS date_validity,
  CASE WHEN source = '' THEN 30 {" ".join(f"WHEN contains(lower(source), '{k}') THEN {v}" for k, v in classify.SOURCE_TRUST.items())} ELSE 40 END AS source_trust,
  CASE WHEN http_status = 0 THEN 20 WHEN http_status < 400 THEN 100 WHEN http_status < 500 THEN 30 ELSE 10 END AS url_liveness FROM s),
q AS (SELECT *, CASE WHEN n >= 5 THEN 100 WHEN n >= 3 THEN 80 WHEN n >= 2 THEN 60 WHEN n >= 1 THEN 40 ELSE 10 END AS content_relevance, CASE WHEN bad >= 3 THEN 0 WHEN bad = 2 THEN 20 WHEN bad = 1 THEN 50 ELSE 100 END AS spam_check FROM p),
t AS (SELECT *, greatest(0, least(10000, title_quality * 20 + domain_trust * 25 + content_relevance * 20 + date_validity * 15 + spam_check * 10 + source_trust * 10 + CASE WHEN url_liveness < 30 THEN -1000 ELSE 500 END)) AS points FROM q)
SELECT id, title_quality, domain_trust, content_relevance, date_validity, spam_check, source_trust, url_liveness, CASE WHEN points < 3500 THEN 'reject' WHEN points < 5500 THEN 'review' ELSE 'accept' END AS recommendation, points,
concat_ws(',', CASE WHEN title_quality < 30 THEN 'title' END, CASE WHEN domain_trust < 30 THEN 'domain' END, CASE WHEN content_relevance < 30 THEN 'content' END, CASE WHEN spam_check < 50 THEN 'spam' END, CASE WHEN url_liveness < 30 THEN 'unreachable' END) AS issues FROM t"""
_INTS = ("title_quality", "domain_trust", "content_relevance", "date_validity", "spam_check", "source_trust", "url_liveness")


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = classify.classified(submissions(spark, sf_dir))
    total = F.when(k % 4 == 0, "12").when(k % 4 == 1, "3.0").when(k % 4 == 2, "2.5")
    return rows.withColumns({"active": k % 3 > 0, "total_registrations": total, "registrations": F.when(k % 2 == 0, 7), "notified": F.when(k % 5 == 0, True), "publication_state": F.when(k % 7 == 0, "pending"), "checked_at": F.when(k % 2 == 0, F.timestamp_seconds(k % 1000))})


FOLLOWED_SQL = f"""WITH {SUBMISSIONS_SQL}, s AS (SELECT *, title || ' ' || descr AS whole FROM submissions), c AS (SELECT *, {KIND_SQL} AS kind, regexp_matches(whole, '{classify.INTERNSHIP}') AS intern, id % 3 > 0 AS active, CASE id % 4 WHEN 0 THEN 12 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 0 END AS reg FROM s)"""


@register(f"""{FOLLOWED_SQL} SELECT count(*) AS n, count(*) FILTER (kind IS NOT NULL) AS n_top, count(*) FILTER (intern) AS n_internships, count(*) FILTER (intern OR kind IS NOT NULL) AS n_kept, count(*) FILTER (active AND kind IS NOT NULL) AS active_top, count(*) FILTER (active AND intern) AS active_internships,
(SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM c WHERE active) AS college_types, sum(reg)::BIGINT AS registered, CASE WHEN sum(reg) >= 1000 THEN printf('%.1fk', floor(sum(reg) / 100) / 10) ELSE sum(reg)::VARCHAR END AS registered_short FROM c""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.class_counts(_followed(spark, sf_dir)).withColumn("college_types", F.array_join("college_types", ","))


@register(f"{FOLLOWED_SQL} SELECT id FROM c WHERE id % 5 > 0 AND id % 7 > 0 AND (intern OR kind IS NOT NULL) ORDER BY CASE WHEN id % 2 = 0 THEN id % 1000 END NULLS FIRST, id LIMIT 100")
def notification_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.notification_backlog(_followed(spark, sf_dir)).select("id")


@register(f"SELECT id, {', '.join(f'{c}::BIGINT AS {c}' for c in _INTS)}, recommendation, issues FROM ({VERIFY_SQL})")
def verify_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.verified(submissions(spark, sf_dir), AS_OF)
    return rows.select("id", *[F.col(c).cast("bigint").alias(c) for c in _INTS], "recommendation", F.array_join("issues", ",").alias("issues"))


@register(f"SELECT recommendation, count(*) AS n, (sum(points) // 10)::BIGINT AS points FROM ({VERIFY_SQL}) WHERE recommendation <> 'reject' GROUP BY ALL")
def verify_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.verified(submissions(spark, sf_dir), AS_OF).filter("recommendation <> 'reject'")
    return rows.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(sum(F.col(c) * w for c, w in zip(_INTS[:6], (20, 25, 20, 15, 10, 10), strict=True)) + F.when(F.col("url_liveness") < 30, -1000).otherwise(500)) / 10).cast("bigint").alias("points"))


def _landed(spark: SparkSession, sf_dir: str, **fields: Column) -> DataFrame:
    """A body for each customer: the JSON list of that customer's orders."""
    item = F.struct(*[v.alias(k) for k, v in fields.items()])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(item)).alias("body"))


def _key() -> Column:
    return F.col("o_orderkey")


def _day() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


DAY_SQL = "strftime(o_orderdate, '%Y-%m-%d')"
OVER_SQL = f"o_orderdate::DATE < DATE '{AS_OF}'"


@register(f"""SELECT o_orderkey::VARCHAR AS source_event_id, 'Sprint ' || o_orderkey AS title, 'https://h.example/' || o_orderkey AS link, CASE WHEN o_orderkey % 5 > 0 THEN 'Org ' || o_orderkey % 7 END AS organizer,
CASE WHEN o_orderkey % 3 = 0 THEN 'Online' ELSE 'Offline' END AS mode, CASE o_orderkey % 3 WHEN 0 THEN 'Online' WHEN 1 THEN 'Pune' ELSE '' END AS location, CASE WHEN o_orderstatus = 'F' OR {OVER_SQL} THEN 'Ended' ELSE 'Unknown' END AS status,
o_orderpriority AS tags, '$ ' || o_orderkey || ' in prizes' AS prize, o_custkey AS registrations, '3 days left' || CASE WHEN o_orderkey % 5 > 0 THEN '. Organized by Org ' || o_orderkey % 7 || '.' ELSE '' END AS description FROM orders WHERE o_orderkey % 17 > 0""")
def feed_themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    place = F.struct(F.when(k % 3 == 0, "Online").when(k % 3 == 1, "Pune").alias("location"))
    landed = _landed(
        spark, sf_dir, id=k.cast("string"), title=F.when(k % 17 > 0, F.concat(F.lit(" Sprint "), k)).otherwise(" "), url=F.concat(F.lit("https://h.example/"), k), displayed_location=place,
        themes=F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit(" ").alias("name"))), submission_end=_day(), open_state=F.when(F.col("o_orderstatus") == "F", "ended").otherwise("open"),
        time_left_to_submission=F.lit("3 days left"), prize_amount=F.concat(F.lit("$ <span data-x='1'>"), k, F.lit("</span>  in prizes")), organization_name=F.when(k % 5 > 0, F.concat(F.lit("Org "), k % 7)), registrations_count=F.col("o_custkey"),
    )
    rows = feeds.from_themed(landed, AS_OF, "themed")
    return rows.withColumn("tags", F.array_join("tags", ",")).select("source_event_id", "title", "link", "organizer", "mode", "location", "status", "tags", "prize", "registrations", "description")


@register(f"""SELECT o_orderkey::VARCHAR AS source_event_id, CASE o_orderkey % 3 WHEN 0 THEN 'Online' WHEN 1 THEN 'Offline' ELSE 'Unknown' END AS mode, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ',College' ELSE o_orderpriority END AS tags,
length(CASE WHEN o_orderkey % 4 = 0 THEN repeat('ab', 300)[1:497] || '…' ELSE 'short' END)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'F' AND NOT {OVER_SQL} AND o_orderkey % 7 > 0""")
def feed_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    landed = _landed(
        spark, sf_dir, id=k.cast("string"), title=F.concat(F.lit("Challenge "), k), url=F.concat(F.lit("https://c.example/"), k), end_date=F.concat(_day(), F.lit("T10:00:00")), status=F.when(F.col("o_orderstatus") == "F", "Ended").otherwise("ongoing"),
        challenge_type=F.col("o_orderpriority"), college=k % 2 == 0, description=F.when(k % 4 == 0, F.repeat(F.lit("ab"), 300)).otherwise(" short "), is_online=F.when(k % 3 == 0, True).when(k % 3 == 1, False), is_own=k % 7 > 0,
    )
    rows = feeds.from_challenges(landed, AS_OF, "challenges")
    return rows.select("source_event_id", "mode", F.array_join("tags", ",").alias("tags"), F.length("description").cast("bigint").alias("n"))


@register(f"""SELECT 'https://t.example/e' || o_orderkey AS link, CASE o_orderkey % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'Offline' WHEN 2 THEN 'Hybrid' ELSE 'Unknown' END AS mode, CASE WHEN o_orderkey % 4 = 0 THEN 'Online' END AS location, {DAY_SQL} AS deadline_iso,
CASE WHEN o_orderstatus = 'F' OR {OVER_SQL} THEN 'Ended' WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Unknown' END AS status, 'a,b,c,d,e,f,g,' || o_orderpriority AS tags,
CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS min_team, CASE o_orderkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 4 END AS max_team FROM orders""")
def feed_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, state = _key(), F.col("o_orderstatus")
    landed = _landed(
        spark, sf_dir, id=k.cast("string"), name=F.concat(F.lit("Team "), k), eventName=F.concat(F.lit("e"), k), registrationDeadline=_day(), openStatus=F.when(state == "F", "closed").when(state == "O", "open").otherwise("later"),
        status=F.when(k % 4 == 0, "virtual").when(k % 4 == 1, "onsite").when(k % 4 == 2, "hybrid"), theme=F.array(*map(F.lit, "abc"), F.lit(" "), *map(F.lit, "defg"), F.col("o_orderpriority"), F.lit("over")), skillLevel=F.lit("All Levels"), teamSize=F.when(k % 5 == 0, "2-6").when(k % 5 == 1, "4").when(k % 5 == 2, "few"),
    )
    rows = feeds.from_teams(landed, AS_OF, "teams", "https://t.example/")
    return rows.select("link", "mode", "location", "deadline_iso", "status", F.array_join("tags", ",").alias("tags"), "min_team", "max_team")


@register(f"""WITH o AS (SELECT *, 'https://o.example/' || o_orderkey // 3 AS link, CASE WHEN o_orderkey % 2 = 0 THEN {DAY_SQL} ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') END AS day FROM orders)
SELECT link, arg_max(o_orderkey::VARCHAR, (o_custkey, o_orderkey::VARCHAR)) AS source_event_id, arg_max(day, (o_custkey, o_orderkey::VARCHAR)) AS deadline_iso, arg_max(CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4 * 100)::VARCHAR ELSE '' END, (o_custkey, o_orderkey::VARCHAR)) AS prize FROM o GROUP BY link""")
def feed_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    end = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.unix_timestamp(F.col("o_orderdate").cast("date").cast("timestamp")).cast("string"))
    cash = F.array(F.struct((k % 4 * 60).cast("double").alias("cash")), F.struct((k % 4 * 40).cast("double").alias("cash")))
    landed = _landed(spark, sf_dir, id=k.cast("string"), title=F.concat(F.lit("Opportunity "), k), seo_url=F.concat(F.lit("https://o.example/"), F.floor(k / 3)), regnRequirements=F.struct(end.alias("end_regn_dt")), prizes=cash)
    rows = feeds.from_opportunities(landed.withColumnRenamed("o_custkey", "page"), AS_OF, "opportunities", "https://o.example/")
    return rows.select("link", "source_event_id", "deadline_iso", F.coalesce("prize", F.lit("")).alias("prize"))


def _embedded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key()
    item = F.struct(k.cast("string").alias("uuid"), F.concat(F.lit("Build "), k).alias("name"), F.concat(F.lit("b"), k).alias("slug"), (k % 2 == 0).alias("is_online"), F.struct(_day().alias("reg_ends_at")).alias("settings"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(k % 3 > 0, item)).alias("open_hackathons"), F.collect_list(F.when(k % 3 < 2, item)).alias("upcoming_hackathons"))
    data = F.struct(F.struct(F.struct("open_hackathons", "upcoming_hackathons").alias("data")).alias("state"))
    feed = F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(data).alias("queries")).alias("dehydratedState")).alias("pageProps")).alias("props")))
    script = F.concat(F.lit('<html><body><script id="__NEXT_DATA__" type="application/json">'), feed, F.lit("</script><p>x</p></body></html>"))
    empty = F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"dehydratedState":{"queries":[{"state":{"data":{"open_hackathons":[]}}}]}}}}</script>')
    c = F.col("o_custkey")
    return lists.select("o_custkey", F.when(c % 7 == 0, empty).when(c % 7 == 1, "<p>nothing here</p>").when(c % 7 == 2, '<script id="__NEXT_DATA__">{broken</script>').otherwise(script).alias("body"))


@register(f"""SELECT o_orderkey::VARCHAR AS source_event_id, 'Build ' || o_orderkey AS title, 'https://b.example/b' || o_orderkey AS link, CASE WHEN o_orderkey % 2 = 0 THEN 'Online' ELSE 'In-person' END AS mode, {DAY_SQL} AS deadline_iso,
CASE WHEN {OVER_SQL} THEN 'Ended' ELSE 'Open' END AS status FROM orders WHERE o_custkey % 7 > 2""")
def feed_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.from_embedded(_embedded_pages(spark, sf_dir), AS_OF, "embedded", "https://b.example/")
    return rows.select("source_event_id", "title", "link", "mode", "deadline_iso", "status")


@register("SELECT o_custkey, CASE o_custkey % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'malformed' WHEN 2 THEN 'malformed' ELSE 'ok' END AS body_state FROM (SELECT DISTINCT o_custkey FROM orders)")
def feed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.outcomes(_embedded_pages(spark, sf_dir), feeds.EMBEDDED, html=True).select("o_custkey", "body_state")


@register("SELECT doc_id, unnest(list_filter(['data', 'water', 'xyz', 'the'], lambda k: contains(lower(text), k))) AS keyword FROM documents")
def feed_keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.matching(table(spark, sf_dir, "documents"), ("data", "water", "xyz", "the"), ("text",)).select("doc_id", "keyword")
