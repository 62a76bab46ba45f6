"""Logical backups: tables with a manifest of their counts and digests, refused as a whole if anything differs.

The digest does not depend on the order of rows and covers every column. It is taken while a table is written, by
the same job; a reader takes it again before any row is used, and a restore once more over what it has written. A
restore goes into an empty place only, and leaves nothing there if it fails.
"""

from __future__ import annotations

import json
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazette.sources import files

MANIFEST = "manifest.json"


class BackupDamaged(RuntimeError):
    """A table is missing or not what was written."""


def _measures(rows: DataFrame) -> list[Column]:
    h = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("total")]


def _written(rows: DataFrame, path: str) -> dict:
    seen = Observation()
    rows.observe(seen, *_measures(rows)).write.parquet(path)
    return dict(seen.get)


def dump(tables: dict[str, DataFrame], root: str) -> dict[str, dict]:
    """Writes tables and their manifest, name to n, xor, total and layout; a backup is there once its manifest is."""
    spark = next(iter(tables.values())).sparkSession
    made = {name: _written(rows, f"{root}/{name}") | {"layout": rows.schema.json()} for name, rows in tables.items()}
    if not files.create_text(spark, f"{root}/{MANIFEST}", json.dumps(made)):
        raise FileExistsError(f"there is a backup in {root}")
    return made


def checked(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a backup, each read once and found to be what the manifest says; else BackupDamaged."""
    try:
        said = json.loads(files.read_text(spark, f"{root}/{MANIFEST}"))
    except Exception as e:
        raise BackupDamaged(f"no manifest in {root}") from e
    tables, wrong = {}, []
    for name, m in said.items():
        try:
            rows = spark.read.schema(StructType.fromJson(json.loads(m["layout"]))).parquet(f"{root}/{name}")
            found = rows.agg(*_measures(rows)).first().asDict()
        except (PySparkException, Py4JJavaError):  # a file that cannot be read
            found = None
        if found is None or any(found[k] != m[k] for k in ("n", "xor", "total")):
            wrong.append(name)
        else:
            tables[name] = rows
    if wrong:
        raise BackupDamaged(f"not as written: {', '.join(wrong)}")
    return tables


def restore(spark: SparkSession, root: str, target: str) -> dict[str, dict]:
    """Writes the tables of a checked backup into an empty place, and checks what has been written."""
    if files.listed(spark, target):
        raise FileExistsError(f"{target} is not empty")
    tables = checked(spark, root)
    try:
        made = dump(tables, target)
        said = json.loads(files.read_text(spark, f"{root}/{MANIFEST}"))
        if any(made[name][k] != said[name][k] for name in said for k in ("n", "xor", "total")):
            raise BackupDamaged("what was restored differs from the backup")
    except Exception:
        files.removed(spark, target)
        raise
    return made


def summary(spark: SparkSession, root: str) -> DataFrame:
    """name, n and n_columns of each table of a checked backup."""
    tables = checked(spark, root)
    one = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).withColumn("n_columns", F.lit(len(t.columns))) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, one)
