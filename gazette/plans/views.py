"""The catalog's base view over the driver's tables, as a DataFrame and as the same SQL."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators import catalog
from gazette.session import shared_dir, table
from gazette.sources import files, generations

AS_OF = dt.date(1998, 7, 1)
OBSERVED_TO = dt.datetime(2024, 1, 31)

LISTINGS_SQL = """listings AS (
SELECT o.o_orderkey AS id, t.title, c.c_name AS organizer, c.c_mktsegment AS source,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'In-person' WHEN 2 THEN 'Hybrid' END AS mode,
  o.o_orderpriority AS tag, r.r_name AS region, n.n_name AS city, CAST(o.o_orderdate AS DATE) AS deadline,
  CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'upcoming' END AS status_text, o.o_totalprice AS prize
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT f.l_orderkey, p.p_name AS title FROM (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY l_orderkey) f JOIN part p ON p.p_partkey = f.k) t ON t.l_orderkey = o.o_orderkey)"""


def listings(spark: SparkSession, sf_dir: str, titled: bool = True) -> DataFrame:
    """One row a listing. The dimension joins are left to the optimizer: it broadcasts by size. The titles are most of
    the work, as they come from the lines; without titled they are null."""
    t = lambda name: table(spark, sf_dir, name)
    first = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    titles = first.join(t("part"), "p_partkey").select("l_orderkey", F.col("p_name").alias("title"))
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("o_orderkey")
    rows = t("orders").join(place, F.col("o_custkey") == F.col("c_custkey"))
    return (
        (rows.join(titles, key == F.col("l_orderkey"), "left") if titled else rows.withColumn("title", F.lit(None).cast("string")))
        .select(
            key.alias("id"),
            "title",
            F.col("c_name").alias("organizer"),
            F.col("c_mktsegment").alias("source"),
            F.when(key % 4 == 0, "Online").when(key % 4 == 1, "In-person").when(key % 4 == 2, "Hybrid").alias("mode"),
            F.col("o_orderpriority").alias("tag"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("city"),
            F.col("o_orderdate").cast("date").alias("deadline"),
            F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("upcoming").alias("status_text"),
            F.col("o_totalprice").alias("prize"),
        )
    )


#: Raised when what is published changes, so that no older generation is taken for it.
VIEW = 3
SOURCES = ("orders", "lineitem", "part", "customer", "nation", "region")


def published_view(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF, now: dt.datetime | None = None) -> DataFrame:
    """The published generation of the listings that requests read: narrow, partitioned by past and
    sorted as pages are. It is published anew when a file of its sources has changed, or at its end (the day's,
    as "past" depends on the day). Of requests that find none at once one publishes, and all read that."""
    now = now or dt.datetime.combine(as_of, dt.time())
    listed = [f for name in SOURCES for f in files.listed(spark, f"{sf_dir}/{name}.parquet")]
    root = f"{shared_dir(spark)}/views/{hashlib.sha256(repr((listed, VIEW)).encode()).hexdigest()[:32]}"
    held = generations.current(spark, root)
    if held is None or generations.expired(held, now) or held["as_of"] != now.date().isoformat():
        until = dt.datetime.combine(now.date() + dt.timedelta(days=1), dt.time())
        try:
            new = generations.publish(catalog.published(listings(spark, sf_dir), now.date()), root, held, ("past",), ("missing", "deadline", "id"), as_of=now.date().isoformat(), valid_until=until.isoformat())
            if new["retired"]:
                files.removed(spark, f"{root}/{new['retired']}")
            held = new
        except generations.StaleManifest:
            held = generations.current(spark, root)
    return generations.read(spark, root, held)
