"""Queries over coalescing and ingest against stored events, each beside its SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text, unicode
from gazette.operators import coalesce, ingest_batch as batches
from gazette.plans.queries import _form_sql, _tokens_sql, register
from gazette.session import shared_dir, table

#: Orders as listings: those of a customer are one organizer's, on one day. Kinds by key: 0 and 4 share the
#: customer's URL (0 online, 4 in a hall), 1 is like 0 under a URL of its own, 2 names another year, 3 another title.
KINDS_SQL = "r AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderkey % 5 AS kind, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'https://h.example/g/' || o_custkey ELSE 'https://h.example/o/' || o_orderkey END AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR) AS rn FROM orders)"
#: Recursion over each customer's listings in order: u is the head that holds the shared URL, t the online head of the title.
COALESCED_SQL = f"""WITH RECURSIVE {KINDS_SQL},
z AS (SELECT g, 0::BIGINT AS rn, NULL::BIGINT AS k, NULL::BIGINT AS head, NULL::BIGINT AS u, NULL::BIGINT AS t FROM r GROUP BY g
UNION ALL SELECT r.g, r.rn, r.k, CASE r.kind WHEN 0 THEN coalesce(u, t, r.k) WHEN 4 THEN coalesce(u, r.k) WHEN 1 THEN coalesce(t, r.k) ELSE r.k END,
CASE WHEN r.kind = 0 THEN coalesce(u, t, r.k) WHEN r.kind = 4 THEN coalesce(u, r.k) ELSE u END,
CASE WHEN r.kind = 1 OR r.kind = 0 AND u IS NULL THEN coalesce(t, r.k) ELSE t END FROM z JOIN r ON r.g = z.g AND r.rn = z.rn + 1),
m AS (SELECT z.k, z.head, r.kind, r.url FROM z JOIN r ON r.k = z.k)"""


def order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = k % 5
    shared = kind.isin(0, 4)
    url = F.when(shared, F.concat(F.lit("https://h.example/g/"), c)).otherwise(F.concat(F.lit("https://h.example/o/"), k))
    title = F.concat(F.lit("Relay lot"), c)
    record = F.struct(F.concat(F.lit("feed"), kind).alias("platform"), url.alias("url"), F.lit(None).cast("string").alias("external_id"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(kind == 2, F.concat(title, F.lit(" 2031"))).when(kind == 3, F.concat(F.lit("Zebra talk z"), k)).otherwise(title).alias("title"),
        F.concat(F.lit("Org lot"), c).alias("organizer"),
        F.date_add(F.lit(dt.date(2027, 1, 1)), (c * 7 % 180).cast("int")).alias("day"),
        F.lit(None).cast("date").alias("registration_day"),
        F.when(kind == 4, "offline").otherwise("online").alias("format"),
        F.when(kind == 4, "Hall").alias("location"),
        F.array(url).alias("urls"),
        F.lit(None).cast("array<string>").alias("source_ids"),
        F.array(record).alias("provenance"),
    )


@register(f"{COALESCED_SQL} SELECT head AS id, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k::VARCHAR) FILTER (k <> head), '') AS aliases, count(DISTINCT (kind, url)) AS n_provenance FROM m GROUP BY head")
def coalesced_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_listings(spark, sf_dir)
    shown = coalesce.coalesced(rows.select("id", "title", "provenance"), coalesce.groups(rows.drop("provenance")))
    return shown.select(F.col("id").cast("bigint").alias("id"), F.array_join("aliases", ",").alias("aliases"), F.size("provenance").cast("bigint").alias("n_provenance"))


@register(f"{COALESCED_SQL} SELECT k AS id, head FROM m")
def shown_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that a bookmark of any id leads to."""
    return coalesce.groups(order_listings(spark, sf_dir).drop("provenance")).select(F.col("id").cast("bigint").alias("id"), F.col("head").cast("bigint").alias("head"))


def _observations(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    """Each customer's event: as it is first seen, and a second time. By key % 6 the second time brings 0 a new prize,
    1 another edition under the same URL, 2 the same event under another URL, 3 an older page, 4 another event, 5 no title."""
    k = F.col("c_custkey")
    kind = F.when(F.lit(second), k % 6).otherwise(-1)
    lot = F.concat(F.lit("lot"), k + F.when(kind == 4, 10_000_000).otherwise(0))
    link = F.concat(F.lit("https://h.example/"), F.when(kind.isin(2, 4), "b/").otherwise("a/"), k)
    day = F.date_add(F.lit(dt.date(2027, 1, 1)), (k * 7 % 180).cast("int"))
    known = {
        "source": F.when(kind == 2, "other").otherwise("feed"),
        "link": link,
        "title": F.when(kind != 5, F.concat(F.lit("Sprint "), lot, F.when(kind == 1, " 2031").otherwise(""))),
        "organizer": F.concat(F.lit("Org "), lot),
        "format": F.lit("online"),
        "day": F.when(kind == 1, F.lit(dt.date(2031, 1, 1))).otherwise(day),
        "prize": F.concat(F.lit("Q" if second else "P"), F.col("c_nationkey")),
        "authority": F.lit(1),
        "observed_at": F.when(kind == -1, F.lit(dt.datetime(2026, 1, 2))).when(kind == 3, F.lit(dt.datetime(2026, 1, 1))).otherwise(F.lit(dt.datetime(2026, 1, 3))),
    }
    fields = [f.split() for f in batches.OBSERVATION.split(", ")]
    return table(spark, sf_dir, "customer").select(*[known.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in fields])


@register("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 6 AS kind FROM customer)
SELECT 'https://h.example/a/' || k AS link, CASE WHEN kind = 0 THEN 'Q' ELSE 'P' END || n AS prize, CASE kind WHEN 1 THEN 'edition_identity' WHEN 2 THEN 'prize' ELSE '' END AS conflicts,
CASE WHEN kind = 2 THEN 2 ELSE 1 END::INT AS n_aliases, CASE WHEN kind IN (0, 2) THEN 2 ELSE 1 END::BIGINT AS revision, CASE kind WHEN 0 THEN 'MATCH:,NEW:' WHEN 1 THEN 'NEW:,REVIEW:possible_new_edition' WHEN 2 THEN 'MATCH:,NEW:' WHEN 3 THEN 'MATCH:older_observation,NEW:' ELSE 'NEW:' END AS log FROM c
UNION ALL SELECT 'https://h.example/b/' || k, 'Q' || n, '', 1, 1, 'NEW:' FROM c WHERE kind = 4""")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after two batches and a replay of the second, each with what the ledger says of it."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    batches.ingest_batch(spark, root, _observations(spark, sf_dir, second=False))
    batches.ingest_batch(spark, root, _observations(spark, sf_dir, second=True))
    batches.ingest_batch(spark, root, _observations(spark, sf_dir, second=True))
    said = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "outcome", F.coalesce("ignored_reason", F.lit(""))))), ",")
    log = batches.ledger(spark, root).groupBy("event_id").agg(said.alias("log"))
    shown = batches.events(spark, root).join(log, "event_id")
    return shown.select("link", "prize", F.array_join("conflicting_fields", ",").alias("conflicts"), F.size("url_aliases").alias("n_aliases"), "revision", "log")


@register(f"SELECT p_partkey, {_form_sql(chr(39) + 'hack strasse ' + chr(39) + ' || p_name || ' + chr(39) + ' final 1 ' + chr(39) + ' || p_partkey')} AS form, array_to_string({_tokens_sql(_form_sql(chr(39) + 'hack strasse ' + chr(39) + ' || p_name || ' + chr(39) + ' final 1' + chr(39)))}, ',') AS tokens FROM part")
def unicode_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in full-width letters, with a sharp s, a ligature and a ringed number compare as plain ones."""
    name = F.col("p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("ＨＡＣＫ Straße "), name, F.lit(" ﬁnal ① "), F.col("p_partkey")).alias("whole"), F.concat(F.lit("ＨＡＣＫ STRAẞE "), name, F.lit(" ﬁnal ①")).alias("short"))
    x = unicode.folded(rows, ["whole", "short"])
    return x.select("p_partkey", text.identity_form(F.col("whole")).alias("form"), F.array_join(text.title_tokens(text.identity_form(F.col("short"))), ",").alias("tokens"))
