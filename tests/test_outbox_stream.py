"""The outbox's states: stream and batch against one step at a time."""

import datetime as dt
import random

from gazette.streaming import outbox

START = dt.datetime(2026, 5, 1)
NOW = START + dt.timedelta(hours=8)


def happenings(seed, jobs=40):
    rng = random.Random(seed)
    rows = []
    for j in range(jobs):
        at, n = rng.randint(0, 600), 0
        if rng.random() < 0.95:
            rows.append((f"j{j}", at, "create", None, None, None, None))
        for n in range(rng.randint(0, 9)):
            at += rng.choice((0, 1, 5, 30, 61, 90, 700))
            token = f"t{n}"
            rows.append((f"j{j}", at, "claim", token, None, None, None))
            if rng.random() < 0.8:
                at += rng.choice((1, 5, 59, 60, 61, 100))
                outcome = rng.choice(("retryable", "retryable", "retryable", "delivered", "refused"))
                rows.append((f"j{j}", at, "finish", rng.choice((token, token, token, "stale")), outcome, None if outcome == "delivered" else "busy", rng.choice((None, 20, 400))))
    rows += rng.sample(rows, 10)  # told twice
    rng.shuffle(rows)
    return [(j, START + dt.timedelta(seconds=at), *rest) for j, at, *rest in rows]


def by_steps(rows):
    sec = lambda t: int(t.replace(tzinfo=dt.UTC).timestamp())
    kept = {}
    for j, at, kind, token, outcome, code, retry in sorted(set(rows), key=lambda r: (r[1], outbox.ORDER[r[2]], r[3] or "")):
        kept[j] = outbox.step(kept.get(j, outbox.NOTHING), sec(at), kind, token, outcome, code, retry)
    kept = {j: outbox._freed(k, sec(NOW)) for j, k in kept.items()}
    return {j: (k[0], k[1], k[5]) for j, k in kept.items() if k[0] is not None}


def test_steps_of_a_job():
    k = outbox.step(outbox.NOTHING, 0, "create", None, None, None, None)
    k = outbox.step(k, 5, "claim", "a", None, None, None)
    assert k[0] == "processing" and outbox.step(k, 10, "claim", "b", None, None, None) == k  # held
    assert outbox.step(k, 10, "finish", "b", "delivered", None, None) == k  # not its token
    assert outbox.step(k, 65, "finish", "a", "delivered", None, None)[0] == "retryable"  # too late
    r = outbox.step(k, 10, "finish", "a", "retryable", "busy", 30)
    assert r[0] == "retryable" and r[3] == 40 and outbox.step(r, 39, "claim", "c", None, None, None) == r
    for n in range(2, 6):
        r = outbox.step(r, 10_000 * n, "claim", f"c{n}", None, None, None)
    assert r[1] == 5 and outbox.step(r, 10**6, "claim", "d", None, None, None)[:2] == ("failed", 5)


def test_batch_equals_steps(spark):
    for seed in (1, 2):
        rows = happenings(seed)
        got = outbox.job_states(spark.createDataFrame(rows, outbox.HAPPENING).repartition(3), NOW).collect()
        assert {r["job"]: (r["state"], r["attempts"], r["code"]) for r in got} == by_steps(rows)
    assert outbox.job_states(spark.createDataFrame([], outbox.HAPPENING), NOW).isEmpty()


def test_stream_equals_batch_on_shuffled_arrivals(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = happenings(3, 25)
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3], outbox.HAPPENING).coalesce(1).write.mode("append").parquet(source)
    last = [("end", NOW + dt.timedelta(hours=9), "create", None, None, None, None)]
    stream = spark.readStream.schema(outbox.HAPPENING).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: outbox.job_changes(stream, "8 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q = run()
    q.awaitTermination(240)
    spark.createDataFrame(last, outbox.HAPPENING).coalesce(1).write.mode("append").parquet(source)  # the watermark passes the rest
    q = run()
    q.awaitTermination(240)
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["at"]):
        got[r["job"]] = (r["state"], r["attempts"], r["code"])
    got.pop("end", None)
    assert got == by_steps(rows)
