"""Published generations: written whole, then named by one small manifest.

A generation is a folder of Parquet tables that never change; readers follow the manifest. A write that
fails leaves the manifests as they were. Manifests are numbered, and the file of a number can be created
once: of several writers that start from the same manifest one publishes and the others are told
(StaleManifest), so no generation is lost or named twice. The generation before is kept for readers that
still follow it; older ones are returned for the caller to remove.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazette.sources import files

ROWS = "rows"


class StaleManifest(RuntimeError):
    """Somebody else has published since."""


class ExpiredView(RuntimeError):
    """The generation is no longer valid; it has to be published anew."""


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: n and an order-free digest of all rows (sum and xor of row hashes)."""
    cols = sorted(rows.columns)
    h = F.xxhash64(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    return rows.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("xor"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("total"))


def current(spark: SparkSession, root: str) -> dict | None:
    """The last manifest: serial, generation, previous, n, layouts and what the publisher noted; None before the first."""
    for path, _, _ in reversed(files.listed(spark, f"{root}/manifests")):
        try:
            return json.loads(files.read_text(spark, path))
        except json.JSONDecodeError:  # just being written: not yet published
            continue
    return None


def publish_tables(tables: dict[str, DataFrame], root: str, seen: dict | None, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), **notes: str | None) -> dict:
    """Writes tables as one new generation, partitioned and sorted so that filters skip files and row groups,
    and names it in the manifest after the one in seen (else StaleManifest). notes are kept in the manifest;
    valid_until (ISO, UTC) among them lets readers refuse it when it has expired. The new manifest's
    ``retired`` is the generation that no reader needs any more, or None."""
    spark = next(iter(tables.values())).sparkSession
    generation = f"generations/{uuid.uuid4().hex}"
    counts, layouts = {}, {}
    for name, rows in tables.items():
        counted = Observation()
        laid = rows.hint("rebalance", *partition_by)  # files of the advisory size, whatever the values' shares
        laid = laid.sortWithinPartitions(*partition_by, *sort_by) if partition_by or sort_by else laid
        laid.observe(counted, F.count(F.lit(1)).alias("n")).write.partitionBy(*partition_by).parquet(f"{root}/{generation}/{name}")
        counts[name], layouts[name] = counted.get["n"], rows.schema.json()
    manifest = {"serial": ((seen or {}).get("serial") or 0) + 1, "generation": generation, "previous": (seen or {}).get("generation"), "n": sum(counts.values()), "counts": counts, "layouts": layouts, **notes}
    if not files.create_text(spark, f"{root}/manifests/{manifest['serial']:012d}.json", json.dumps(manifest)):
        files.removed(spark, f"{root}/{generation}")
        raise StaleManifest(f"manifest {manifest['serial']} is another writer's")
    return manifest | {"retired": (seen or {}).get("previous")}


def publish(rows: DataFrame, root: str, seen: dict | None, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), **notes: str | None) -> dict:
    """publish_tables for one table."""
    return publish_tables({ROWS: rows}, root, seen, partition_by, sort_by, **notes)


def read(spark: SparkSession, root: str, held: dict | None = None, name: str = ROWS, now: dt.datetime | None = None) -> DataFrame:
    """A table of the generation that a manifest names, the present one if none is given. With now, a
    generation whose time has run out is refused."""
    held = held or current(spark, root)
    if held is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    if now is not None and expired(held, now):
        raise ExpiredView(f"valid until {held['valid_until']}")
    layout = StructType.fromJson(json.loads(held["layouts"][name]))  # columns that files are partitioned by keep their types
    return spark.read.schema(layout).parquet(f"{root}/{held['generation']}/{name}").select(*layout.names)


def expired(manifest: dict, now: dt.datetime) -> bool:
    until = manifest.get("valid_until")
    return until is not None and dt.datetime.fromisoformat(until) <= now


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows, refused (never cut) where there are more than most: at most most + 1 are looked at."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def digest(rows: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """One row: name, n and the sum of the first 32 bits of each row's md5, for backups: two tables of
    the same rows in any order have the same."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("bigint")
    return rows.select(h.alias("h")).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("h").alias("digest"))
