"""Importance resampling towards a target distribution of hashed n-grams.

Identical texts are collapsed first, by grouping full texts, with their number of copies. Features of a
distinct text are computed once and stored as bucket numbers; corpus counts multiply them by the
copies. The gain of a bucket is the log ratio of its smoothed shares in the target and in the
corpus; the weight of a text is the sum over its features. Weights go back to the rows by the
text's digest, and only then noise that depends on the row's id (Gumbel, from a hash) is added:
the highest scores are a sample without replacement, in proportion to exp(weight).

The rank is made without all rows in one task: rows are dealt by ranges of their scores, sorted and
numbered within each, written, and the counts of the ranges before are added.

Cases: a null or empty text has no features and weight 0; a null id draws the noise of an empty id
and ranks last among ties; repeated rows are scored and ranked each; very long texts are read whole,
as one row; without documents or target texts all counts are 0 and no gain is undefined; an empty
table gives an empty result. Only id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import lists, mapped, materialize, text_of

WORD_CACHE = 200_000


@dataclass(frozen=True)
class Draw:
    """Features (runs of 1 to ngrams words, hashed into buckets), and how much is drawn of the rows with least_words."""

    ngrams: int = 1
    buckets: int = 10_000
    scale: int = 1000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


#: A-Z become a-z; ASCII that is no letter or digit parts words; other bytes stay.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class _Buckets(dict):
    """Bucket of each feature met so far; emptied at a fixed size."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        at = self[feature] = zlib.crc32(feature) % self.n
        return at


def _features(text: bytes, plan: Draw, known: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature, repeats included."""
    words = text.translate(_FOLDED).split()
    found = [np.fromiter(map(known.__getitem__, words), np.int32, len(words))]
    for size in range(2, plan.ngrams + 1):
        runs = max(0, len(words) - size + 1)
        found.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + size])) % plan.buckets for i in range(runs)), np.int32, runs))
    return len(words), np.concatenate(found)


def _distinct(rows: DataFrame, plan: Draw) -> DataFrame:
    """key (SHA-256), copies, n_words and buckets of each distinct text."""
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    known = _Buckets(plan.buckets)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [_features(t, plan, known) for t in b.column("text").cast(pa.binary()).to_pylist()]
        buckets = lists([x for _, x in found], pa.int32())
        return pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), pa.array([n for n, _ in found], pa.int64()), buckets], names=["key", "copies", "n_words", "buckets"])

    return mapped(texts, run, "key binary, copies bigint, n_words bigint, buckets array<int>")


def _counts(distinct: DataFrame, name: str) -> DataFrame:
    """Features of all rows by bucket: at most as many rows as there are buckets."""
    return distinct.select(F.explode("buckets").alias("bucket"), "copies").groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(corpus: DataFrame, target: DataFrame, plan: Draw) -> DataFrame:
    """bucket, s, t and gain for every bucket, from distinct rows of both."""
    spark = corpus.sparkSession
    counted = _counts(corpus, "s").join(_counts(target, "t"), "bucket", "full").withColumn("bucket", F.col("bucket").cast("bigint"))
    rows = spark.range(0, plan.buckets, 1, 8).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = materialize(rows, "buckets")
    total = rows.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    share = lambda n, other: (F.col(n) + 1).cast("double") * F.lit(float((total[other] or 0) + plan.buckets))
    return rows.withColumn("gain", F.floor(F.lit(float(plan.scale)) * F.log(share("t", "S") / share("s", "T"))).cast("bigint"))


def _weighed(distinct: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features and weight; gain has an entry a bucket."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column("buckets")
        ends = column.offsets.to_numpy().astype(np.int64)
        total = np.concatenate([[0], np.cumsum(gain[column.values.to_numpy()[ends[0] : ends[-1]]])])
        ends -= ends[0]
        weight = total[ends[1:]] - total[ends[:-1]]
        return pa.RecordBatch.from_arrays([b.column("key"), b.column("n_words"), pa.array(np.diff(ends), pa.int64()), pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    return mapped(distinct.select("key", "n_words", "buckets"), run, "key binary, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, plan: Draw) -> Column:
    """Gumbel noise of a row, scaled and rounded down, from a hash of its id."""
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(float(-plan.scale)) * F.log(-F.log(u))).cast("bigint")


def ranked(rows: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """rows with their rank (1, 2, 3, ...) in the order given, null beyond most. Dealt by ranges and
    sorted within them: no task holds all rows, and the driver gets one count a range."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id's upper bits are the number of the range, the lower ones the place in it
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges").withColumn("_range", F.shiftright("_at", 33))
    before, seen = [], 0
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        before.append((r["_range"], seen))
        seen += r["count"]
    shifts = spark.createDataFrame(before, "_range bigint, _before bigint")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(shifts), "_range").select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, plan: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn), one row a document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    corpus = materialize(_distinct(rows.select("text"), plan), "texts", "zstd")
    aimed = materialize(_distinct(target.select(text_of(target_col).alias("text")), plan), "target")
    found = gains(corpus, aimed, plan).select("bucket", "gain").toArrow()  # a row a bucket
    gain = np.zeros(plan.buckets, np.int64)
    gain[found.column("bucket").to_numpy()] = found.column("gain").to_numpy()
    # written, so that the join deals it anew and AQE can split the rows of a text with many copies
    weights = materialize(_weighed(corpus, gain), "weights")
    keyed = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    scored = keyed.join(weights, "key", "left").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), plan)).alias("score"))
    scored = materialize(scored, "scored")
    enough = scored.filter(F.col("n_words") >= plan.least_words)
    drawn = ranked(enough, plan.percent * enough.count() // 100, [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features")])
    rest = scored.filter(F.col("n_words") < plan.least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def shares(corpus: DataFrame, target: DataFrame, plan: Draw = Draw(), text_col: str = "text", target_col: str = "text") -> DataFrame:
    """bucket, s, t and gain of two tables of texts: what draws towards the target, for inspection."""
    return gains(materialize(_distinct(corpus.select(text_of(text_col).alias("text")), plan), "texts"), materialize(_distinct(target.select(text_of(target_col).alias("text")), plan), "target"), plan)
