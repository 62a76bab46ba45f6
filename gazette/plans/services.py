"""Queries over ingest, the outbox, lifecycle and the smaller text functions, each beside its SQL."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text
from gazette.operators import canonical, ingest, ledger, outbox
from gazette.plans.queries import observations, register
from gazette.plans.views import AS_OF, LISTINGS_SQL, listings
from gazette.session import table
from gazette.sources import generations
from gazette.streaming import outbox as outbox_stream

FIELDS = ["source", "source_event_id", "link", "title", "prize", "registrations"]
CUSTOMERS_SQL = """o AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg FROM customer),
x AS (SELECT k, 'T' || k AS old_title, CASE WHEN k % 3 = 0 THEN 'TBA' ELSE 'P' || n END AS old_prize, 1 + k % 2 AS old_auth, n AS old_reg, 'https://h.example/' || k AS old_link,
'T' || (k + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) AS title, CASE WHEN k % 7 = 0 THEN 'TBA' ELSE 'Q' || n END AS prize, 1 + k % 3 AS auth, n + k % 2 AS reg, 'https://h.example/' || (k + CASE WHEN k % 4 = 0 THEN 1000000 ELSE 0 END) AS link,
TIMESTAMP '2024-01-01' + to_days(CAST(k % 10 AS INT)) AS seen_at, k % 11 = 0 AS held FROM o),
m AS (SELECT *, NOT held AND seen_at >= TIMESTAMP '2024-01-03' AND NOT (k % 13 = 0) AS takes, link = old_link AS own FROM x),
c AS (SELECT *, takes AND auth < old_auth OR takes AND NOT own AND auth < 3 AS weak,
takes AND title <> old_title AS d_title, takes AND prize <> 'TBA' AND prize <> old_prize AS d_prize, takes AND reg <> old_reg AS d_reg FROM m)
"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    link = F.concat(F.lit("https://h.example/"), k)
    record = F.struct(F.lit("feed").alias("platform"), link.alias("url"), F.lit(None).cast("string").alias("external_id"), F.lit(dt.datetime(2024, 1, 1)).alias("observed_at"), F.when(k % 13 == 0, F.lit(dt.datetime(2024, 2, 1))).alias("source_updated_at"))
    return table(spark, sf_dir, "customer").select(
        k.alias("event_id"), F.lit("feed").alias("source"), F.lit(None).cast("string").alias("source_event_id"), link.alias("link"), F.concat(F.lit("T"), k).alias("title"), F.when(k % 3 == 0, "TBA").otherwise(F.concat(F.lit("P"), n)).alias("prize"),
        n.alias("registrations"), F.array(link).alias("url_aliases"), F.array(record.cast(ingest.RECORD)).alias("records"), F.array().cast("array<string>").alias("conflicting_fields"), (k % 2 + 1).cast("int").alias("authority"),
        F.lit(dt.datetime(2024, 1, 3)).alias("last_seen_at"), F.when(k % 6 == 0, "stale").when(k % 6 == 1, "manual").alias("archive_reason"), F.lit(1).cast("bigint").alias("revision"),
    )


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("event_id"), F.when(k % 11 == 0, "REVIEW").otherwise("MATCH").alias("outcome"), F.when(k % 22 == 0, F.array(F.lit("edition_year_conflict"))).otherwise(F.array(F.lit("location_conflict"))).alias("reasons"), F.lit("feed").alias("source"),
        F.lit(None).cast("string").alias("source_event_id"), F.concat(F.lit("https://h.example/"), k + F.when(k % 4 == 0, 1000000).otherwise(0)).alias("link"), F.concat(F.lit("T"), k + F.when(k % 5 == 0, 1).otherwise(0)).alias("title"),
        F.when(k % 7 == 0, "TBA").otherwise(F.concat(F.lit("Q"), n)).alias("prize"), (n + k % 2).cast("int").alias("registrations"), (k % 3 + 1).cast("int").alias("authority"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (k % 10).cast("int")).cast("timestamp").alias("observed_at"), F.lit(dt.datetime(2024, 1, 15)).alias("source_updated_at"),
    )


@register(f"""WITH {CUSTOMERS_SQL} SELECT k AS event_id, CASE WHEN held THEN NULL WHEN seen_at < TIMESTAMP '2024-01-03' THEN 'older_observation' WHEN k % 13 = 0 THEN 'older_source_version' END AS ignored,
CASE WHEN d_title AND NOT weak THEN title ELSE old_title END AS title, CASE WHEN d_prize AND (NOT weak OR old_prize = 'TBA') THEN prize ELSE old_prize END AS prize, CASE WHEN d_reg THEN reg ELSE old_reg END::INT AS registrations, old_link AS link,
concat_ws(',', CASE WHEN d_prize AND weak AND old_prize <> 'TBA' THEN 'prize' END, CASE WHEN d_title AND weak THEN 'title' END) AS conflicts,
CASE WHEN takes AND NOT own THEN least(old_link, link) || ',' || greatest(old_link, link) ELSE old_link END AS aliases, CASE WHEN takes AND NOT own THEN 2 ELSE 1 END::INT AS n_records,
concat_ws(',', CASE WHEN d_prize AND (NOT weak OR old_prize = 'TBA') THEN 'prize' END, CASE WHEN d_reg THEN 'registrations' END, CASE WHEN d_title AND NOT weak THEN 'title' END) AS changed, takes AND (d_title OR d_prize) AS verification_stale,
CASE WHEN takes THEN greatest(auth, old_auth) ELSE old_auth END::INT AS authority, CASE WHEN k % 6 = 1 THEN 'manual' WHEN k % 6 = 0 AND NOT takes THEN 'stale' END AS archive_reason, CASE WHEN takes THEN 2 ELSE 1 END::BIGINT AS revision FROM c""")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.merged(_stored(spark, sf_dir), _incoming(spark, sf_dir), FIELDS)
    joined = lambda c: F.array_join(c, ",")
    return out.select("event_id", "ignored", "title", "prize", "registrations", "link", joined("conflicting_fields").alias("conflicts"), joined("url_aliases").alias("aliases"), F.size("records").alias("n_records"), joined("changed").alias("changed"), "verification_stale", "authority", "archive_reason", "revision")


@register("SELECT c_custkey AS event_id, CASE WHEN c_custkey % 22 = 0 THEN 'possible_new_edition' ELSE 'entity_review' END AS ignored_reason FROM customer WHERE c_custkey % 11 = 0")
def held_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.held(_incoming(spark, sf_dir)).select("event_id", "ignored_reason")


@register(f"WITH {CUSTOMERS_SQL}, r AS (SELECT k AS event_id, d_title AND NOT weak AS t, d_prize AND (NOT weak OR old_prize = 'TBA') AS p, * FROM c) SELECT event_id, concat_ws(',', CASE WHEN p THEN 'prize:' || old_prize || '>' || prize END, CASE WHEN t THEN 'title:' || old_title || '>' || title END) AS changes FROM r WHERE p OR t")
def ledger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _stored(spark, sf_dir)
    out = ingest.ledger_rows(before, ingest.merged(before, _incoming(spark, sf_dir), FIELDS), ["prize", "title"])
    shown = F.transform(F.array_sort(F.map_entries("changes")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["before"], F.lit(">"), e["value"]["after"]))
    return out.select("event_id", F.array_join(shown, ",").alias("changes"))


@register("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, count(*) - 1 AS superseded FROM (SELECT user_id, ts FROM events) GROUP BY user_id")
def newest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select(F.col("user_id").alias("event_id"), F.col("ts").alias("observed_at"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("link"))
    first, rest = ingest.newest(rows)
    return first.select(F.col("event_id").alias("user_id"), F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("newest")).join(rest.groupBy(F.col("event_id").alias("user_id")).agg(F.count(F.lit(1)).alias("superseded")), "user_id", "left").fillna(0, ["superseded"])


SUBS_SQL = "s AS (SELECT s_suppkey AS subscriber, CASE s_suppkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN '1-URGENT' WHEN 2 THEN '5-LOW' ELSE 'none' END AS preference, s_suppkey % 5 > 0 AS active FROM supplier)"


def _subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("subscriber"), F.when(k % 4 == 0, "all").when(k % 4 == 1, "1-URGENT").when(k % 4 == 2, "5-LOW").otherwise("none").alias("preference"), (k % 5 > 0).alias("active"))


@register(f"WITH {SUBS_SQL} SELECT sha256(c_custkey || '|' || subscriber) AS job, c_custkey AS intent, subscriber FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE '3-MEDIUM' END AS kind FROM customer) JOIN s ON active AND (preference = 'all' OR preference = kind) WHERE c_mktsegment <> 'BUILDING'")
def outbox_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    intents = table(spark, sf_dir, "customer").select(k.alias("intent"), F.when(k % 3 == 0, "1-URGENT").when(k % 3 == 1, "5-LOW").otherwise("3-MEDIUM").alias("kind"), F.col("c_mktsegment").alias("segment"))
    made = outbox.fan_out(intents.filter("segment = 'BUILDING'"), _subscribers(spark, sf_dir))  # a fan-out that broke off
    return outbox.fan_out(intents, _subscribers(spark, sf_dir), made)


@register(f"WITH {SUBS_SQL} SELECT preference, count(*) FILTER (active) AS active, count(*) AS total FROM (SELECT * FROM s UNION ALL SELECT -1, 'all', true) GROUP BY preference")
def subscriber_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.preference_counts(outbox.with_admin(outbox.with_admin(_subscribers(spark, sf_dir), -1), 1))


@register(f"WITH {SUBS_SQL} SELECT subscriber FROM s WHERE active AND preference IN ('all', '5-LOW')")
def subscribers_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.reached(_subscribers(spark, sf_dir), "5-LOW").select("subscriber")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "delivered").when(kind == "error", "failed").when(kind == "view", "pending").when(kind == "click", "processing").otherwise("retryable")
    return observations(spark, sf_dir).select(F.col("event_id").alias("job"), F.col("user_id").alias("intent"), state.alias("state"), (F.col("event_id") % 7).alias("attempts"), F.when(F.col("event_id") % 9 > 0, F.col("ts")).alias("next_attempt_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("lease_until"))


JOBS_SQL = "j AS (SELECT event_id AS job, user_id AS intent, CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' ELSE 'retryable' END AS state, event_id % 7 AS attempts, CASE WHEN event_id % 9 > 0 THEN ts END AS next_at, ts + INTERVAL 1 DAY AS lease FROM events)"
CLAIM_SQL = "attempts < 5 AND (state IN ('pending', 'retryable') AND coalesce(next_at, TIMESTAMP '2024-01-15') <= TIMESTAMP '2024-01-15' OR state = 'processing' AND lease <= TIMESTAMP '2024-01-15')"


@register(f"WITH {JOBS_SQL} SELECT job, state FROM j WHERE {CLAIM_SQL}")
def outbox_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.claimable(_jobs(spark, sf_dir), F.lit(dt.datetime(2024, 1, 15))).select("job", "state")


@register(f"WITH {JOBS_SQL} SELECT job FROM j WHERE {CLAIM_SQL} ORDER BY next_at NULLS FIRST, job LIMIT 100")
def outbox_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.claim(_jobs(spark, sf_dir), F.lit(dt.datetime(2024, 1, 15)), 100).select("job")


@register(f"WITH {JOBS_SQL}, i AS (SELECT DISTINCT user_id AS intent, 1 + user_id % 90 AS wanted FROM events), d AS (SELECT intent, count(*) AS jobs, count(*) FILTER (state = 'delivered') AS delivered FROM j WHERE state <> 'pending' GROUP BY intent) SELECT i.intent, wanted::BIGINT AS wanted, coalesce(jobs, 0) AS jobs, coalesce(delivered, 0) AS delivered, coalesce(jobs, 0) = wanted AND coalesce(delivered, 0) = wanted AS notified FROM i LEFT JOIN d USING (intent)")
def intent_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    intents = jobs.select("intent", (F.col("intent") % 90 + 1).alias("wanted")).distinct()
    return outbox.reconciled(intents, jobs.filter("state <> 'pending'"))  # jobs that were never made


@register(f"WITH {JOBS_SQL} SELECT greatest((SELECT count(DISTINCT intent) FROM j WHERE intent % 3 > 0), (SELECT count(*) FROM j WHERE state IN ('pending', 'retryable', 'processing'))) AS pending")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    return outbox.pending(jobs.select("intent", (F.col("intent") % 3 == 0).alias("notified")).distinct(), jobs)


#: What happened to each user's job: made by the first event, then claimed and finished by the others in turn (by the
#: hour of the day): two seconds after the claim, delivered by a purchase, refused by an error, to be retried otherwise.
#: The recursion has the state as (state, attempts, due, lease) and takes a claim and its finish in one step each.
OUTBOX_SQL = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS job, epoch(date_trunc('second', ts))::BIGINT AS mo, event_id, event_type FROM events),
h AS (SELECT job, min(mo) AS mo, 0 AS o, '' AS token, 'create' AS kind, NULL::VARCHAR AS outcome FROM e GROUP BY job
UNION ALL SELECT job, mo, 2, event_id::VARCHAR, 'claim', NULL FROM e
UNION ALL SELECT job, mo + 2, 1, event_id::VARCHAR, 'finish', CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'refused' ELSE 'retryable' END FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY mo, o, token) AS n FROM h),
s AS (SELECT job, 0::BIGINT AS n, NULL::VARCHAR AS state, 0 AS attempts, NULL::VARCHAR AS own, NULL::BIGINT AS due, NULL::BIGINT AS lease FROM (SELECT DISTINCT job FROM r)
UNION ALL SELECT r.job, r.n,
CASE WHEN r.kind = 'create' AND f.state IS NULL THEN 'pending' WHEN r.kind = 'claim' AND f.state IN ('pending', 'retryable') AND f.due <= r.mo AND s.attempts < 5 THEN 'processing'
     WHEN r.kind = 'finish' AND f.state = 'processing' AND s.own = r.token THEN CASE WHEN r.outcome = 'delivered' THEN 'delivered' WHEN r.outcome = 'retryable' AND s.attempts < 5 THEN 'retryable' ELSE 'failed' END ELSE f.state END,
s.attempts + CASE WHEN r.kind = 'claim' AND f.state IN ('pending', 'retryable') AND f.due <= r.mo AND s.attempts < 5 THEN 1 ELSE 0 END,
CASE WHEN r.kind = 'claim' AND f.state IN ('pending', 'retryable') AND f.due <= r.mo AND s.attempts < 5 THEN r.token WHEN f.state = 'processing' AND NOT (r.kind = 'finish' AND s.own = r.token) THEN s.own END,
CASE WHEN r.kind = 'create' AND f.state IS NULL THEN r.mo WHEN r.kind = 'finish' AND f.state = 'processing' AND s.own = r.token THEN CASE WHEN r.outcome = 'retryable' AND s.attempts < 5 THEN r.mo + least(3600, (2 ** s.attempts)::BIGINT) END
     WHEN r.kind = 'claim' AND f.state IN ('pending', 'retryable') AND f.due <= r.mo AND s.attempts < 5 THEN NULL ELSE f.due END,
CASE WHEN r.kind = 'claim' AND f.state IN ('pending', 'retryable') AND f.due <= r.mo AND s.attempts < 5 THEN r.mo + 60 WHEN f.state = 'processing' AND NOT (r.kind = 'finish' AND s.own = r.token) THEN s.lease END
FROM s JOIN r ON r.job = s.job AND r.n = s.n + 1, LATERAL (SELECT CASE WHEN s.state = 'processing' AND s.lease <= r.mo THEN CASE WHEN s.attempts >= 5 THEN 'failed' ELSE 'retryable' END ELSE s.state END AS state, CASE WHEN s.state = 'processing' AND s.lease <= r.mo AND s.attempts < 5 THEN s.lease ELSE s.due END AS due) f)
SELECT job, state, attempts, due AS due_at FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC) AS z FROM s) WHERE z = 1"""


@register(OUTBOX_SQL)
def outbox_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's job after all of their events."""
    e = observations(spark, sf_dir).select(F.col("user_id").cast("string").alias("job"), F.date_trunc("second", "ts").alias("at"), F.col("event_id").cast("string").alias("token"), "event_type")
    none = F.lit(None).cast("string")
    happening = lambda df, kind, at, token, outcome=none: df.select("job", at.alias("at"), F.lit(kind).alias("kind"), token.alias("token"), outcome.alias("outcome"), none.alias("code"), F.lit(None).cast("int").alias("retry_after"))
    outcome = F.when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "error", "refused").otherwise("retryable")
    made = happening(e.groupBy("job").agg(F.min("at").alias("at")), "create", F.col("at"), none)
    told = made.unionByName(happening(e, "claim", F.col("at"), F.col("token"))).unionByName(happening(e, "finish", F.col("at") + F.expr("INTERVAL 2 SECONDS"), F.col("token"), outcome))
    return outbox_stream.job_states(told, dt.datetime(2100, 1, 1)).select("job", "state", "attempts", F.unix_timestamp("due").alias("due_at"))


@register(f"WITH {JOBS_SQL}, {SUBS_SQL}, e AS (SELECT c_custkey AS event, CASE c_custkey % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS kind FROM customer WHERE c_acctbal > 0) SELECT job, CASE WHEN e.event IS NULL THEN 'event_gone' WHEN NOT coalesce(s.active, false) THEN 'unsubscribed' WHEN s.preference <> 'all' AND s.preference <> e.kind THEN 'not_wanted' ELSE 'send' END AS verdict FROM j LEFT JOIN e ON e.event = j.job % 1000 LEFT JOIN s ON s.subscriber = j.intent")
def outbox_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    events = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(k.alias("event"), F.when(k % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("kind"))
    jobs = _jobs(spark, sf_dir).select("job", (F.col("job") % 1000).alias("event"), F.col("intent").alias("subscriber"))
    return outbox.rechecked(jobs, events, _subscribers(spark, sf_dir))


@register(f"""WITH {LISTINGS_SQL}, l AS (SELECT id, CASE WHEN id % 3 > 0 THEN deadline END AS deadline, CASE WHEN id % 50 = 0 THEN 'Community / X' ELSE source END AS source, deadline::TIMESTAMP AS seen FROM listings), f AS (SELECT *, coalesce(deadline < DATE '{AS_OF}' - 3, false) AS expired,
deadline IS NULL AND NOT starts_with(lower(source), 'community') AND seen < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS stale FROM l),
g AS (SELECT count(*) AS n, count(*) FILTER (expired) AS e, count(*) FILTER (stale) AS s FROM f) SELECT id, CASE WHEN expired AND e <= greatest(25, floor(n * 0.6)) THEN 'expired' WHEN stale AND s <= greatest(25, floor(n * 0.6)) THEN 'stale' END AS archived FROM f, g""")
def archive_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, titled=False).select("id", F.when(F.col("id") % 3 > 0, F.col("deadline")).alias("deadline"), F.when(F.col("id") % 50 == 0, "Community / X").otherwise(F.col("source")).alias("source"), F.col("deadline").cast("timestamp").alias("seen"))
    return ledger.archived_guarded(rows, AS_OF).select("id", "archived")


@register(f"WITH {LISTINGS_SQL} SELECT id FROM listings ORDER BY CASE WHEN id % 3 > 0 THEN deadline END NULLS FIRST, id LIMIT 60")
def link_check_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.least_recent(listings(spark, sf_dir, titled=False).withColumn("checked", F.when(F.col("id") % 3 > 0, F.col("deadline"))), "checked", "id", 60).select("id")


@register("WITH s AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), l AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM s) SELECT round(list_median(v), 1) AS median, v[greatest(1, floor(n * 0.95)::INT)] AS p95, v[1] AS least, v[n] AS most, n FROM l".replace("list_median(v)", "list_aggregate(v, 'median')"))
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latency_summary(observations(spark, sf_dir), "value", [F.desc("ts"), F.desc("event_id")])


@register(f"WITH {LISTINGS_SQL}, t AS (SELECT unnest([deadline::TIMESTAMP, deadline::TIMESTAMP + INTERVAL 14 DAY]) AS t FROM listings) SELECT CAST(least(TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY, min(t)) AS VARCHAR) AS valid_until FROM t WHERE t > TIMESTAMP '{AS_OF} 05:00:00'")
def snapshot_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, titled=False).withColumn("at", F.col("deadline").cast("timestamp"))
    out = ledger.valid_until(rows, ["at"], "at", dt.datetime.combine(AS_OF, dt.time(5)))
    return out.select(F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss").alias("valid_until"))


CAPTIONS = ["Join the biggest sprint of the year! Prize pool: ₹5,00,000 #hack", "short. then a prize worth $2,000 for all @club", "Nothing to win here at all", "Win up to ₹50k today\nregister now", "a total of 3 lakhs in prizes", "2.5 crore fund for founders?"]
CAPTION_OUT = [("Join the biggest sprint of the year", "₹5,00,000"), ("short. then a prize worth $2,000 for all", "$2,000"), ("Nothing to win here at all", "TBA"), ("Win up to ₹50k today", "₹50k"), ("a total of 3 lakhs in prizes", "₹3 Lakh"), ("2.5 crore fund for founders", "₹2.5 Cr")]
LINKS = ["https://devfolio.co/hackathons/code-relay?x=1#y", "https://code-relay.devfolio.co/", "https://www.devfolio.co", "https://other.example/a?b"]
SLUGS = [("https://devfolio.co/hackathons/code-relay", "code-relay"), ("https://code-relay.devfolio.co/", "code-relay"), ("https://www.devfolio.co", ""), ("https://other.example/a", "")]
AGENTS = ["Mozilla/5.0 (iPhone; CPU iPhone OS 17) Safari/604", "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120", "Mozilla/5.0 (X11; Linux) Firefox/118", "", "Mozilla/5.0 (iPad) Safari/1", "curl/8"]
AGENT_OUT = ["Mobile|iOS|Safari", "Desktop|Windows|Edge", "Desktop|Linux|Firefox", "Unknown|Unknown|Unknown", "Tablet|iOS|Safari", "Desktop|Other|Other"]


def _listed(values: list, key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


@register(f"SELECT event_id, {_listed([t for t, _ in CAPTION_OUT], 'event_id')} AS title, {_listed([p for _, p in CAPTION_OUT], 'event_id')} AS prize, {_listed([u for u, _ in SLUGS], 'event_id')} AS bare, {_listed([s for _, s in SLUGS], 'event_id')} AS slug, {_listed(AGENT_OUT, 'event_id')} AS agent, 'Sprint' || event_id AS page_title FROM events")
def caption_and_agent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    agent = text.user_agent(pick(AGENTS))
    return table(spark, sf_dir, "events").select(
        k, text.caption_title(pick(CAPTIONS), F.lit("club")).alias("title"), text.prize_in_prose(pick(CAPTIONS)).alias("prize"), text.bare_url(pick(LINKS)).alias("bare"), text.url_slug(pick(LINKS), "devfolio").alias("slug"),
        F.concat_ws("|", agent["device"], agent["os"], agent["browser"]).alias("agent"), text.platform_free_title(F.concat(F.lit("Sprint"), k, F.lit(" | Devfolio page"))).alias("page_title"),
    )


@register("SELECT source, count(*) AS n FROM (SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY source")
def newest_of_each_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.newest_of_each(observations(spark, sf_dir), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return rows.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))


NOW = dt.datetime.combine(AS_OF, dt.time(20))
LATER = NOW + dt.timedelta(days=3)
#: The closing date by id % 8: a date; one in a zone where the next day has begun; a moment; a local date-time; one that is a
#: moment in its zone; one in a zone in the east; a date in a zone that does not exist; nothing.
EVENTS_SQL = f"""WITH {LISTINGS_SQL}, e AS (SELECT id, id % 8 AS f, id % 7 AS g, deadline AS d, CASE WHEN id % 3 = 0 THEN 'pending' END AS held, status_text AS status, deadline::TIMESTAMP AS seen, n.* FROM listings,
(VALUES ('now', TIMESTAMP '{NOW}'), ('later', TIMESTAMP '{LATER}')) n(point, now)),
s AS (SELECT *, CASE WHEN f IN (0, 1, 6) THEN 'date' WHEN f IN (2, 4, 5) THEN 'timestamp' WHEN f = 3 THEN 'local_datetime' ELSE 'unknown' END AS precision,
CASE f WHEN 2 THEN d::TIMESTAMP + INTERVAL 270 MINUTE WHEN 4 THEN d::TIMESTAMP + INTERVAL 14 HOUR WHEN 5 THEN d::TIMESTAMP + INTERVAL 30 MINUTE END AS moment FROM e),
t AS (SELECT *, CASE WHEN moment IS NOT NULL THEN moment <= now WHEN f = 1 THEN d < (now + INTERVAL 330 MINUTE)::DATE WHEN f IN (0, 6) THEN d < now::DATE ELSE false END AS behind, CASE WHEN f IN (0, 1, 6) THEN d ELSE moment::DATE END AS due FROM s),
v AS (SELECT *, CASE WHEN status = 'closed' OR behind THEN 'closed' WHEN due - now::DATE <= 5 THEN 'closing' WHEN due IS NOT NULL OR status = 'open' THEN 'open' ELSE 'upcoming' END AS plain, seen < now - INTERVAL 14 DAY AS stale FROM t),
w AS (SELECT *, CASE WHEN stale AND f = 7 AND plain IN ('open', 'upcoming') THEN 'unknown' ELSE plain END AS state FROM v)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("id"), F.date_format("deadline", "yyyy-MM-dd")
    f = k % 8
    closes = F.when(f.isin(0, 1, 6), d).when(f == 2, F.concat(d, F.lit("T10:00:00+05:30"))).when(f.isin(3, 5), F.concat(d, F.lit(" 10:00:00"))).when(f == 4, F.concat(d, F.lit("T10:00"))).otherwise("TBA")
    zone = F.when(f == 1, "Asia/Kolkata").when(f == 4, "-04:00").when(f == 5, "+0930").when(f == 6, "Mars/Base")
    none = F.lit(None).cast("string")
    rows = listings(spark, sf_dir, titled=False).select(
        k, F.when(k % 5 == 0, " tba ").otherwise(F.concat(F.lit(" Sprint  "), k)).alias("title"), "organizer", "source", F.when(k % 7 == 0, none).when(k % 7 == 1, "http://localhost/x").otherwise(F.concat(F.lit("HTTPS://H.example/"), k, F.lit("?utm_a=1"))).alias("link"),
        "mode", "city", F.concat(F.lit("₹"), k).alias("prize"), F.col("status_text").alias("status"), closes.alias("closes"), zone.alias("timezone"), F.array("tag", F.lit(" ")).alias("tags"),
        F.col("deadline").cast("timestamp").alias("seen"), F.when(k % 3 == 0, "pending").alias("publication"), F.array(F.lit("title"), F.lit("secret"), F.lit("edition_identity")).alias("conflicts"),
    )
    return canonical.canonical(rows, NOW)


@register(f"""{EVENTS_SQL} SELECT id, CASE WHEN id % 5 > 0 THEN 'Sprint ' || id END AS title, CASE WHEN g > 1 THEN 'https://h.example/' || id END AS registration_url, CASE WHEN g > 1 THEN 'source_reported' ELSE 'unknown' END AS url_status,
precision, strftime(moment, '%Y-%m-%d %H:%M') AS closes_at, CASE WHEN f < 7 THEN d END AS closes_date, CASE f WHEN 1 THEN 'Asia/Kolkata' WHEN 2 THEN '+0530' WHEN 4 THEN '-04:00' WHEN 5 THEN '+0930' END AS zone, 'INR ' || id AS prize, 'title,edition_identity' AS conflicts, state AS registration_state,
CASE WHEN seen > now THEN 'unknown' WHEN stale THEN 'stale' ELSE 'fresh' END AS freshness, CASE WHEN held IS NOT NULL THEN held WHEN state = 'closed' THEN 'archived' ELSE 'published' END AS publication_state FROM w WHERE point = 'now'""")
def canonical_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("id", "title", "registration_url", F.col("registration_url_status").alias("url_status"), "closes.precision", F.date_format("closes.at", "yyyy-MM-dd HH:mm").alias("closes_at"), F.col("closes.date").alias("closes_date"), F.col("closes.timezone").alias("zone"), "prize", F.array_join("conflicting_fields", ",").alias("conflicts"), "registration_state", "freshness", "publication_state")


@register(f"""{EVENTS_SQL} SELECT b.id, b.state AS registration_state, CASE WHEN b.stale THEN 'stale' ELSE 'fresh' END AS freshness, CASE WHEN b.held IS NOT NULL THEN b.held WHEN a.state = 'closed' OR b.state = 'closed' THEN 'archived' ELSE 'published' END AS publication_state
FROM w a JOIN w b ON a.id = b.id AND a.point = 'now' AND b.point = 'later'""")
def canonical_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of canonical_event, three days on."""
    return canonical.refreshed(_events(spark, sf_dir), LATER).select("id", "registration_state", "freshness", "publication_state")


@register(f"{EVENTS_SQL} SELECT count(*) AS records, count(*) FILTER (f = 7) AS unknown_dates, count(*) FILTER (g < 2) AS unsafe_links, count(*) FILTER (seen > now OR stale) AS not_fresh FROM w WHERE point = 'now'")
def event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.audit(_events(spark, sf_dir))


@register(f"{EVENTS_SQL} SELECT id FROM w WHERE point = 'now' AND held IS NULL")
def catalog_visible_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.visible(_events(spark, sf_dir)).select("id")


@register("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') END AS aware, strftime(CASE event_id % 3 WHEN 0 THEN ts - INTERVAL 330 MINUTE ELSE ts END, '%Y-%m-%d %H:%M') AS lenient FROM events")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, iso = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(k % 3 == 0, F.concat(iso, F.lit("+05:30"))).when(k % 3 == 1, iso).otherwise(F.unix_timestamp("ts").cast("string"))
    show = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    return observations(spark, sf_dir).select(k, show(canonical.stamp(shown)).alias("aware"), show(canonical.lenient_stamp(shown)).alias("lenient"))


def _digest_sql(name: str, columns: str) -> str:
    return f"SELECT '{name}' AS name, count(*) AS n, sum(CAST('0x' || md5({columns})[1:8] AS BIGINT))::BIGINT AS digest FROM {name}"


@register(" UNION ALL ".join([_digest_sql("nation", "n_nationkey || '|' || n_name || '|' || n_regionkey"), _digest_sql("customer", "c_custkey || '|' || c_mktsegment || '|' || c_name || '|' || c_nationkey"), _digest_sql("orders", "o_custkey || '|' || o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus"), _digest_sql("documents", "doc_id || '|' || lang || '|' || source || '|' || text")]))
def backup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a table: how many rows, and a digest that does not depend on their order."""
    columns = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_mktsegment", "c_name", "c_nationkey"), "orders": ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "documents": ("doc_id", "lang", "source", "text")}
    return reduce(DataFrame.unionByName, [generations.digest(table(spark, sf_dir, name), name, cols) for name, cols in columns.items()])
