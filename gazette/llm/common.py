"""What the operators of this subpackage share: tables, shared storage and small column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazette.session import shared_dir

#: White space that separates words in every operator here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost
    executors, and gives later joins exchanges of their own, whose skewed partitions AQE can split."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row. Inside a lambda a plain column expression would
    be evaluated for every element; the variable of a one-element transform is not."""
    return F.transform(F.array(value), body)[0]


def bitmap(hashes: DataFrame, column: str, least_bits: int = 1 << 20, most_bits: int = 1 << 27) -> np.ndarray:
    """One-hash Bloom filter of a bigint column, as 64-bit words. About 16 bits a row, at most
    most_bits (16 MB): what the driver gets and sends is bounded, and a fuller filter only lets
    more false positives through to the exact join behind it."""
    bits = least_bits
    wanted = 16 * hashes.count()
    while bits < wanted and bits < most_bits:
        bits *= 2
    h = F.pmod(F.col(column), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    got = hashes.select(F.floor(h / 64).cast("long").alias("w"), one.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return words.view(np.uint64)


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64 hashes may be in the filter."""
    h = hashes.view(np.uint64) & np.uint64(len(words) * 64 - 1)  # the remainder: the number of bits is a power of two
    return ((words[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)


def cleared(rows: DataFrame, keys: DataFrame, on: list[str], least_bits: int = 1 << 20, most_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """rows that are not in keys for certain, and those that may be. A one-hash Bloom filter of keys is joined to
    the rows as a broadcast table of its words: at most most_bits / 64 = 2 million rows of two numbers, whatever
    the keys. So wide rows are shuffled to meet the keys only where it is likely that they do."""
    bits = least_bits
    wanted = 16 * keys.count()
    while bits < wanted and bits < most_bits:
        bits *= 2
    place = lambda: F.pmod(F.xxhash64(*on), F.lit(bits))
    one = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), (place() % 64).cast("int"))
    words = keys.select(F.floor(place() / 64).cast("long").alias("_w"), one().alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_m"))
    met = rows.withColumn("_w", F.floor(place() / 64).cast("long")).join(F.broadcast(materialize(words, "words")), "_w", "left")
    maybe = F.coalesce(F.col("_m").bitwiseAND(one()) != 0, F.lit(False))
    return met.filter(~maybe).select(*rows.columns), met.filter(maybe).select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows that are not in keys; nulls are equal."""
    sure, open_ = cleared(rows, keys, on)
    named = keys.select(*[F.col(c).alias(f"_{c}") for c in on])
    same = [open_[c].eqNullSafe(named[f"_{c}"]) for c in on]
    return sure.unionByName(open_.join(named, same, "left_anti"))


#: Bytes of an Arrow batch sent to a Python worker, unless the session says otherwise, and rows
#: taken from it at a time. Long texts then come a few at a time and a worker's memory is bounded.
BATCH_BYTES = "8m"
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
CHUNK_ROWS = 512


def mapped(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, with run called on chunks of at most CHUNK_ROWS rows."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BYTES_KEY):
        spark.conf.set(BYTES_KEY, BATCH_BYTES)
    rows = CHUNK_ROWS

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield run(b.slice(at, rows))

    return df.mapInArrow(chunks, schema)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array a row."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
