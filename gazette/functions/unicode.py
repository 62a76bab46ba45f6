"""Unicode forms that the JVM has no function for: compatibility forms with folded case, and host names in ASCII.
They are worked out row by row, once for each value of a batch that needs them, so nothing is shuffled or held; ASCII
values never leave the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nfkc_folded(value: str) -> str:
    return unicodedata.normalize("NFKC", value).casefold()


def ascii_host(value: str) -> str | None:
    """A host name's ASCII form (xn--...); null if it has none."""
    try:
        return value.encode("idna").decode()
    except UnicodeError:
        return None


def _replaced(rows: DataFrame, names: list[str], form: Callable[[str], str | None], suffix: str) -> DataFrame:
    @F.pandas_udf("string")
    def formed(values: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}  # of this batch
        return pd.Series([None if v is None else known[v] if v in known else known.setdefault(v, form(v)) for v in values], dtype=object)

    other = lambda n: F.col(n).rlike("[^\\x00-\\x7F]")
    return rows.withColumns({f"{n}{suffix}": F.when(other(n), formed(F.when(other(n), F.col(n)))).otherwise(F.col(n)) for n in names})


def folded(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with the named columns in compatibility form with folded case where they are not ASCII (there lower() does
    as well): full-width letters, ligatures, sharp s, ringed numbers and the like compare as what they stand for."""
    return _replaced(rows, names, nfkc_folded, "")


def with_ascii_hosts(rows: DataFrame, url: str) -> DataFrame:
    """rows whose URLs have their host in ASCII; a URL whose host has no such form becomes null."""
    host = F.regexp_extract(url, "^[A-Za-z]+://([^/?#:@]*)", 1)
    x = _replaced(rows.withColumn("_host", host), ["_host"], ascii_host, "_ascii")
    moved = F.concat(F.regexp_extract(url, "^([A-Za-z]+://)", 1), F.col("_host_ascii"), F.regexp_extract(url, "^[A-Za-z]+://[^/?#:@]*(.*)$", 1))
    return x.withColumn(url, F.when(F.col("_host") == "", F.col(url)).otherwise(moved)).drop("_host", "_host_ascii")
