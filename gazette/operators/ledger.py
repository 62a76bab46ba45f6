"""Merging observations, lifecycle sweeps, source freshness and the notification outbox."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GUARD_LEAST, GUARD_ROWS, GUARD_PERCENT = 20, 25, 60
STRIKES = 3


def latest_wins(obs: DataFrame, key: str, order: str, tie: str, fields: list[str]) -> DataFrame:
    """The fields of the newest observation of each key; a tie goes to the larger tie column."""
    newest = F.max_by(F.struct(*fields), F.struct(order, tie))
    return obs.groupBy(key).agg(newest.alias("x")).select(key, "x.*")


def accept_in_order(obs: DataFrame, key: str, arrival: str, seen: str) -> DataFrame:
    """obs with accepted: false where an earlier arrival of the key was seen later (out of order)."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return obs.withColumn("accepted", F.coalesce(F.col(seen) >= F.max(seen).over(before), F.lit(True)))


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer merge: one row for each key and field whose known new value differs; an unknown new
    value never erases a known one."""
    both = old.select(key, *[F.col(f).cast("string").alias(f"old_{f}") for f in fields]).join(new.select(key, *[F.col(f).cast("string").alias(f"new_{f}") for f in fields]), key, "full_outer")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("before"), F.col(f"new_{f}").alias("after")) for f in fields]))
    out = both.select(key, rows.alias("c")).select(key, "c.*")
    return out.filter(F.col("after").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))


def archive(rows: DataFrame, as_of: dt.date, keep_days: int = 3) -> DataFrame:
    """rows with archived: past the deadline by more than keep_days; undated rows stay."""
    return rows.withColumn("archived", F.coalesce(F.col("deadline") < F.date_sub(F.lit(as_of), keep_days), F.lit(False)))


def safe_to_archive(rows: DataFrame) -> DataFrame:
    """One row: how many of how many, and whether the guard allows it."""
    n, total = F.col("n_archived"), F.col("total")
    refused = (total >= GUARD_LEAST) & (n > F.greatest(F.lit(GUARD_ROWS), F.floor(total * GUARD_PERCENT / 100)))
    return rows.agg(F.count_if("archived").alias("n_archived"), F.count(F.lit(1)).alias("total")).withColumn("safe", ~refused)


def dead_strikes(probes: DataFrame, key: str, order: list[str], dead: Column, strikes: int = STRIKES) -> DataFrame:
    """Trailing run of dead probes of each key, and whether it reaches the limit."""
    w = Window.partitionBy(key).orderBy(*order)
    run = probes.withColumn("d", dead.cast("int")).withColumn("alive", F.sum(1 - F.col("d")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = run.groupBy(key).agg(F.max("alive").alias("alive"))
    out = run.groupBy(key, "alive").agg(F.sum("d").alias("strikes")).join(last, [key, "alive"])
    return out.select(key, F.col("strikes").cast("bigint").alias("strikes"), (F.col("strikes") >= strikes).alias("removed"))


def last_success(runs: DataFrame, source: str, order: list[str], at: str, ok: Column, within: int = 50) -> DataFrame:
    """Each run with the time of the last earlier success of its source, among up to within runs."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(-within, -1)
    return runs.withColumn("last_success", F.last(F.when(ok, F.col(at)), ignorenulls=True).over(w))


def failing(runs: DataFrame, source: str, order: list[Column], bad: Column, streak: int = 3) -> DataFrame:
    """Sources whose last streak runs all failed."""
    n = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return runs.withColumn("n", n).filter(F.col("n") <= streak).groupBy(source).agg(F.every(bad).alias("bad"), F.count(F.lit(1)).alias("k")).filter((F.col("k") == streak) & F.col("bad")).select(source)


def recipient_counts(events: DataFrame, subscribers: DataFrame, shard: Column) -> DataFrame:
    """(shard, subscriber, n): how many events of a shard reach a subscriber, whose preference is 'all' or
    the event's source. Events are counted by what reaches them; only the counts meet the subscribers, by an
    equality of keys."""
    counts = events.groupBy(shard.alias("shard"), F.col("source").alias("preference")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.lit("all").alias("preference"), "n")
    return subscribers.join(counts.filter("preference <> 'all'").unionByName(every), "preference").select("shard", "subscriber", "n")


def backoff(attempts: Column, retry_after: Column) -> Column:
    """Seconds until the next attempt: 2^attempts up to an hour, or what the channel asks for if longer."""
    return F.greatest(F.least(F.lit(3600.0), F.pow(F.lit(2.0), attempts)), F.coalesce(retry_after.cast("double"), F.lit(0.0)))


def job_state(attempts: DataFrame, key: str, order: list[str], result: str, budget: int = 5) -> DataFrame:
    """Outbox jobs replayed from their ordered attempts: delivered at the first delivery, failed after
    budget attempts without one, else retryable; with the number of attempts that counted."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    counted = attempts.withColumn("n", n).filter(F.col("n") <= budget)
    won = F.min(F.when(F.col(result) == "delivered", F.col("n")))
    out = counted.groupBy(key).agg(won.alias("won"), F.max("n").alias("tried"))
    state = F.when(F.col("won").isNotNull(), "delivered").when(F.col("tried") >= budget, "failed").otherwise("retryable")
    return out.select(key, state.alias("state"), F.coalesce("won", "tried").cast("bigint").alias("attempts"))


def archived_guarded(rows: DataFrame, as_of: dt.date, keep_days: int = 3, stale_days: int = 30) -> DataFrame:
    """rows (deadline, source, seen) with archived: 'expired' beyond the days that are kept, or 'stale'
    where undated and not seen for long (never community entries); null else. Each is refused as a
    whole when it would take too many of all rows; nothing is deleted."""
    expired = F.coalesce(F.col("deadline") < F.date_sub(F.lit(as_of), keep_days), F.lit(False))
    own = F.coalesce(F.lower("source").startswith("community"), F.lit(False))
    stale = F.col("deadline").isNull() & ~own & F.coalesce(F.col("seen") < F.date_sub(F.lit(as_of), stale_days).cast("timestamp"), F.lit(False))
    marked = rows.withColumn("expired", expired).withColumn("stale", stale)
    n = marked.agg(F.count(F.lit(1)).alias("total"), F.count_if("expired").alias("n_expired"), F.count_if("stale").alias("n_stale"))
    fits = lambda c: (F.col("total") < GUARD_LEAST) | (F.col(c) <= F.greatest(F.lit(GUARD_ROWS), F.floor(F.col("total") * GUARD_PERCENT / 100)))
    x = marked.crossJoin(F.broadcast(n))  # one row
    archived = F.when(F.col("expired") & fits("n_expired"), "expired").when(F.col("stale") & fits("n_stale"), "stale")
    return x.withColumn("archived", archived).drop("expired", "stale", "total", "n_expired", "n_stale")


def least_recent(rows: DataFrame, checked: str, key: str, most: int) -> DataFrame:
    """The rows that were checked longest ago, never checked ones first."""
    return rows.orderBy(F.col(checked).asc_nulls_first(), key).limit(most)


def newest_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """Up to most rows of each key, in order. The window keeps no more than that of a key in a task."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def latency_summary(rows: DataFrame, value: str, newest: list[Column], sample: int = 500) -> DataFrame:
    """Of the last sample values: median (one decimal), p95 (the value at the place int(0.95 n), not
    between two), least, most and n."""
    last = rows.orderBy(*newest).limit(sample)
    v = F.col("v")
    x = last.agg(F.sort_array(F.collect_list(value)).alias("v"), F.percentile(value, 0.5).alias("m"))  # up to sample values
    place = F.greatest(F.lit(1), F.floor(F.size(v) * 0.95).cast("int"))
    return x.select(F.round("m", 1).alias("median"), F.try_element_at(v, place).alias("p95"), F.try_element_at(v, F.lit(1)).alias("least"), F.try_element_at(v, F.lit(-1)).alias("most"), F.size(v).cast("bigint").alias("n"))


def valid_until(rows: DataFrame, instants: list[str], seen: str, now: dt.datetime, fresh_days: int = 14) -> DataFrame:
    """One row: when a snapshot taken now has to be renewed. The next UTC midnight, or before it the
    first of the instants to come or the moment at which a row is no longer fresh."""
    fresh = F.when(F.col(seen) > F.lit(now), F.col(seen)).otherwise(F.col(seen) + F.expr(f"INTERVAL {fresh_days} DAYS"))
    ahead = F.array_min(F.filter(F.array(*instants, fresh), lambda t: t > F.lit(now)))
    midnight = F.lit(dt.datetime.combine(now.date() + dt.timedelta(days=1), dt.time()))
    return rows.agg(F.least(midnight, F.min(ahead)).alias("valid_until"))
