"""URL filters (native): a blocked Bloom filter in front of an exact hash join.

A list entry is a host and a path prefix. An entry fits a URL whose host is the entry's host or a
subdomain of it and whose path starts with the entry's path; of several that fit, the longest wins
(then the longer host, then block). For each URL the possible keys are made (every host suffix with
every path length that occurs in the list), the Bloom filter drops nearly all of them inside the
scan, and what is left meets the list in a hash join, which removes the false positives.

Cases: a null URL or one without ``://`` has host and path '' and fits nothing; an empty host fits
nothing; repeated rows give repeated rows; an empty table gives an empty result; an empty list lets
everything pass. Only the id and URL columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys for each 64-bit block of the filter, the bounds of the number of blocks (32 KB to 512 KB: it is a constant
#: of the plan), and the bits set in a block by each key. A fuller filter lets more through to the exact join.
BLOCK_KEYS = 4
LEAST_BLOCKS, MOST_BLOCKS = 1 << 12, 1 << 16
BITS = 4
#: A list up to this many rows is broadcast in the exact join; a longer one is shuffled.
BROADCAST_ROWS = 50_000

RULE_SCHEMA = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _mask(h: Column) -> Column:
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 16 + 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(BITS)])


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def blocks_for(n: int) -> int:
    """Blocks of the filter of a list of n rows: a power of two."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (n // BLOCK_KEYS).bit_length()))


def bloom(rules: DataFrame, blocks: int) -> Column:
    """The filter as a constant array of words. Built by an aggregation on the executors; at most blocks
    rows come back, whatever the length of the list."""
    h = _hash(F.col("host"), F.col("path"))
    rows = rules.select(_block(h, blocks).alias("b"), _mask(h).alias("m")).groupBy("b").agg(F.bit_or("m").alias("m")).collect()
    words = [0] * blocks
    for r in rows:
        words[r["b"]] = r["m"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict for every row of pages. rules: RULE_SCHEMA."""
    rules = rules.filter("host is not null and host <> '' and path is not null").select("host", "path", F.coalesce("verdict", F.lit("block")).alias("verdict"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    n_rules = rules.count()
    blocks = blocks_for(n_rules)
    filter_words = bloom(rules, blocks)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())

    none = F.array().cast("array<struct<h:string,p:string>>")

    def keys(labels: Column) -> Column:
        suffixes = F.transform(labels, lambda _, k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
        starts = lambda n: F.transform(suffixes, lambda s: F.struct(s.alias("h"), F.substring(F.col("path"), 1, n).alias("p")))
        whole = [F.when(F.length("path") >= n, starts(n)).otherwise(none) for n in lengths]
        return F.concat(none, *whole)

    def possible(c: Column) -> Column:
        h = _hash(c["h"], c["p"])
        return (c["h"] != "") & (F.get(filter_words, _block(h, blocks)).bitwiseAND(_mask(h)) == _mask(h))

    labels = F.split(F.col("host"), "\\.")
    hits = F.filter(F.transform(F.array(labels), keys)[0], possible)
    probes = rows.select("row", "id", "host", "path", F.explode(hits).alias("c")).select("*", F.col("c.h").alias("h"), F.col("c.p").alias("p"))
    # what the filter clears, nearly all rows, is neither joined nor grouped
    clear = rows.filter(F.size(hits) == 0).select("id", "host", "path", F.lit(None).cast("bigint").alias("order"))
    order = (F.length("host") + F.length("path")).cast("long") * (1 << 21) + F.length("host") * 2 + F.when(F.col("verdict") == "block", 1).otherwise(0)
    listed = rules.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(order).alias("order"))
    if n_rules <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    best = probes.join(listed, ["h", "p"], "left").groupBy("row", "id", "host", "path").agg(F.max("order").alias("order"))
    best = best.drop("row").unionByName(clear)
    found = F.col("order").isNotNull()
    return best.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(found, F.concat(F.expr("right(host, cast(floor(order % 2097152 / 2) as int))"), F.expr("left(path, cast(floor(order / 2097152) - floor(order % 2097152 / 2) as int))"))).alias("rule"),
        F.when(~found, F.lit(default)).when(F.col("order") % 2 == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list from Python tuples (host, path, verdict)."""
    return spark.createDataFrame(rules, RULE_SCHEMA)
