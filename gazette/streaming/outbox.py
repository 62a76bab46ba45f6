"""The state of outbox jobs from a stream of what happened to them, and the same in batch.

A job's happenings (job, at, kind, token, outcome, code, retry_after) are: ``create``; ``claim``, by a worker
with a token; ``finish``, with the outcome of the attempt (delivered, retryable or refused). They may arrive in
any order within the watermark's delay: a job keeps what has arrived until the watermark has passed it, and
takes it in the order of time (ties: create, finish, claim, then token).

    pending -> processing -> delivered | retryable | failed

A claim takes a job that is due, or whose lease has run out, and holds it for LEASE seconds; a finish counts
only with the token that holds the job, so a worker that comes late changes nothing. A retryable outcome makes
the job due again after 2^attempts seconds (an hour at most, retry_after at least), until ATTEMPTS are used up.
A lease that runs out frees the job, or fails it when no attempts are left; a timer sees to that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gazette.operators.outbox import ATTEMPTS

LEASE = 60
HOUR = 3600
HAPPENING = "job string, at timestamp, kind string, token string, outcome string, code string, retry_after int"
#: What is kept of a job; times in seconds since the epoch.
KEPT = "state string, attempts int, token string, due bigint, lease bigint, code string"
STATES = "job string, at timestamp, state string, attempts int, due timestamp, code string"
ORDER = {"create": 0, "finish": 1, "claim": 2}
NOTHING = (None, 0, None, None, None, None)


def _freed(kept: tuple, at: int) -> tuple:
    """The job when a lease may have run out."""
    state, attempts, token, due, lease, code = kept
    if state == "processing" and lease <= at:
        if attempts >= ATTEMPTS:
            return ("failed", attempts, None, None, None, "lease_budget_exhausted")
        return ("retryable", attempts, None, lease, None, code)
    return kept


def step(kept: tuple, at: int, kind: str, token: str | None, outcome: str | None, code: str | None, retry_after: int | None) -> tuple:
    """The job after one happening."""
    state, attempts, own, due, lease, _ = kept = _freed(kept, at)
    if kind == "create" and state is None:
        return ("pending", 0, None, at, None, None)
    if kind == "claim" and state in ("pending", "retryable") and due <= at and attempts < ATTEMPTS:
        return ("processing", attempts + 1, token, None, at + LEASE, None)
    if kind == "finish" and state == "processing" and own is not None and own == token:
        if outcome == "delivered":
            return ("delivered", attempts, None, None, None, None)
        if outcome == "retryable" and attempts < ATTEMPTS:
            return ("retryable", attempts, None, at + max(min(HOUR, 2**attempts), retry_after or 0), None, code)
        return ("failed", attempts, None, None, None, code)
    return kept


def _seconds(t: pd.Timestamp) -> int:
    return int(t.timestamp())


class _Jobs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)
        self.waiting = handle.getListState("waiting", "at bigint, kind string, token string, outcome string, code string, retry_after int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for part in rows:
            for r in part.itertuples(index=False):
                clean = [None if pd.isna(v) else v for v in (r.kind, r.token, r.outcome, r.code, r.retry_after)]
                at = _seconds(r.at)
                self.waiting.appendValue((at, *clean[:4], None if clean[4] is None else int(clean[4])))
                self.handle.registerTimer(at * 1000)
        yield pd.DataFrame(columns=["job", "at", "state", "attempts", "due", "code"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() // 1000  # all that happened until then has arrived
        every = [tuple(w) for w in self.waiting.get()]
        ready = sorted((w for w in every if w[0] <= now), key=lambda w: (w[0], ORDER[w[1]], w[2] or ""))
        late = [w for w in every if w[0] > now]
        before = kept = tuple(self.kept.get()) if self.kept.exists() else NOTHING
        for at, kind, token, outcome, code, retry_after in ready:
            kept = step(kept, at, kind, token, outcome, code, retry_after)
        kept = _freed(kept, now)
        if late:
            self.waiting.put(late)
        else:
            self.waiting.clear()
        if kept[0] is not None:
            self.kept.update(kept)
            if kept[4] is not None:
                self.handle.registerTimer(kept[4] * 1000)
        if kept != before and kept[0] is not None:
            utc = lambda s: None if s is None else dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None)
            yield pd.DataFrame({"job": [key[0]], "at": [utc(now)], "state": [kept[0]], "attempts": [kept[1]], "due": pd.Series([utc(kept[3])], dtype="datetime64[ns]"), "code": [kept[5]]})
        else:
            yield pd.DataFrame(columns=["job", "at", "state", "attempts", "due", "code"])

    def close(self) -> None:
        pass


def job_changes(happenings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of a job's states, a row whenever one has changed, in the order of time. Needs the RocksDB state store."""
    return happenings.withWatermark("at", delay).groupBy("job").transformWithStateInPandas(statefulProcessor=_Jobs(), outputStructType=STATES, outputMode="Append", timeMode="EventTime")


def job_states(happenings: DataFrame, now: dt.datetime) -> DataFrame:
    """The states as of now from a table of happenings: job, state, attempts, due and code. Folded in the JVM, over
    each job's own happenings (attempts are few; what a job was told twice counts once)."""
    x = happenings.filter(F.col("at") <= F.lit(now))
    kind = F.when(F.col("kind") == "create", 0).when(F.col("kind") == "finish", 1).otherwise(2)
    one = F.struct(F.unix_timestamp("at").alias("at"), kind.alias("order"), F.coalesce("token", F.lit("")).alias("token"), "kind", "outcome", "code", "retry_after")
    own = x.groupBy("job").agg(F.array_sort(F.collect_set(one)).alias("happened"))
    kept = lambda state, attempts, token, due, lease, code: F.struct(state, attempts, token, due, lease, code).cast(f"struct<{KEPT.replace(' ', ':').replace(',:', ',')}>")
    none = F.lit(None)

    def freed(k: Column, at: Column) -> Column:
        gone = (k["state"] == "processing") & (k["lease"] <= at)
        spent = k["attempts"] >= ATTEMPTS
        return F.when(gone & spent, kept(F.lit("failed"), k["attempts"], none, none, none, F.lit("lease_budget_exhausted"))).when(gone, kept(F.lit("retryable"), k["attempts"], none, k["lease"], none, k["code"])).otherwise(k)

    def after(k: Column, h: Column) -> Column:
        made = (h["kind"] == "create") & k["state"].isNull()
        taken = (h["kind"] == "claim") & k["state"].isin("pending", "retryable") & (k["due"] <= h["at"]) & (k["attempts"] < ATTEMPTS)
        own = (h["kind"] == "finish") & (k["state"] == "processing") & (k["token"] == h["token"])
        again = (h["outcome"] == "retryable") & (k["attempts"] < ATTEMPTS)
        pause = F.greatest(F.least(F.lit(HOUR), F.pow(F.lit(2), k["attempts"]).cast("bigint")), F.coalesce(h["retry_after"], F.lit(0)))
        return (
            F.when(made, kept(F.lit("pending"), F.lit(0), none, h["at"], none, none))
            .when(taken, kept(F.lit("processing"), k["attempts"] + 1, h["token"], none, h["at"] + LEASE, none))
            .when(own & (h["outcome"] == "delivered"), kept(F.lit("delivered"), k["attempts"], none, none, none, none))
            .when(own & again, kept(F.lit("retryable"), k["attempts"], none, h["at"] + pause, none, h["code"]))
            .when(own, kept(F.lit("failed"), k["attempts"], none, none, none, h["code"]))
            .otherwise(k)
        )

    once = lambda value, body: F.transform(F.array(value), body)[0]
    start = kept(none, F.lit(0), none, none, none, none)
    end = F.aggregate("happened", start, lambda k, h: once(freed(k, h["at"]), lambda f: after(f, h)))
    last = once(end, lambda k: freed(k, F.lit(int(now.replace(tzinfo=dt.UTC).timestamp()))))
    return own.select("job", last.alias("k")).filter("k.state is not null").select("job", "k.state", "k.attempts", F.timestamp_seconds("k.due").alias("due"), "k.code")
