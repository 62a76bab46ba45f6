"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or nothing on each document. How often each
pattern of votes occurs is counted over all documents (at most 3^labellers rows, whatever the
input); on these counts expectation-maximisation estimates the share of good documents and each
labeller's accuracy on good and on bad ones, with the labellers independent given the class. The
posterior of a pattern is the soft label of its documents. A linear scorer over hashed words and
word shapes learns these labels by logistic regression on a bounded sample (SAMPLE rows, drawn by
the hash of the id), and scores every whole text. The verdict averages the scorer's and the
labellers' log-odds, the latter with what the votes alone say.

Cases: null and empty texts have no words: every labeller but the length one abstains, they score
as their votes do, and are not kept; a null doc_id passes through; repeated rows get equal rows; an
empty table gives an empty result. Very long texts are scored whole; those in the sample come to the
driver whole, so SAMPLE has to fit the longest. Only the id and text columns are read, so extra columns
of any name do no harm.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import mapped, materialize
from gazette.llm.quality_rules import measurements

SAMPLE = 6000
DIMENSIONS = 1 << 16
ROUNDS = 200
TOKEN_CACHE = 250_000
WORD = re.compile(r"\S+")

LABELLERS = ("length", "symbols", "upper_case", "repetition", "duplicate_lines", "letters", "word_length")


def votes() -> dict[str, Column]:
    """Each labeller as a column over quality_rules.measurements: 1 good, 0 bad, null abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    some = n > 0
    return {
        "length": vote(n >= 40, n < 10),
        "symbols": vote(some & (F.col("n_symbols") * 50 <= n), some & (F.col("n_symbols") * 5 > n)),
        "upper_case": vote(some & (F.col("n_upper") * 8 <= F.col("n_letters")), some & (F.col("n_upper") * 2 > F.col("n_letters"))),
        "repetition": vote(some & (F.col("n_repeat_words") * 20 <= n), some & (F.col("n_repeat_words") * 4 > n)),
        "duplicate_lines": vote(F.col("n_lines") >= 4, some & (F.col("n_dup_lines") * 4 > F.col("n_lines"))),
        "letters": vote(some & (F.col("n_letters") * 100 >= chars * 94), some & (F.col("n_letters") * 100 < chars * 88)),
        "word_length": vote(some & chars.between(n * 3, n * 9), some & ((chars < n * 2) | (chars > n * 15))),
    }


def pattern() -> Column:
    """The votes as one number in base 3 (0 bad, 1 good, 2 none)."""
    v = votes()
    return reduce(lambda a, k: a * 3 + F.coalesce(v[k], F.lit(2)), LABELLERS, F.lit(0)).cast("int")


def _digits(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, P(vote good | class, voted) for classes (bad, good), and the posterior of
    each pattern. Starts from the majority of votes, so that class 1 is the good one."""
    v = _digits(patterns)
    good, bad = (v == 1), (v == 0)
    post = np.clip((good.sum(1) + 1.0 - 1.5 * bad.sum(1)) / (good.sum(1) + bad.sum(1) + 2.0), 0.02, 0.98)
    share, says = 0.5, np.zeros((2, v.shape[1]))
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        share = float(np.clip(w[1].sum() / max(1.0, counts.sum()), 0.01, 0.99))
        # a Beta prior: a labeller agrees with its class rather than not
        prior = np.array([[1.0], [9.0]])
        says = (w @ good + prior) / (w @ (good | bad) + 10.0)
        logs = np.log(share / (1 - share)) + good @ (np.log(says[1]) - np.log(says[0])) + bad @ (np.log(1 - says[1]) - np.log(1 - says[0]))
        new = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return share, says, post


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (DIMENSIONS // 2 - 1)


def _shape(word: str) -> str:
    return "".join(sorted({"A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word}))


class _Hashed:
    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Bucket of each word and, in the upper half, of each word's shape."""
        if len(self.known) > TOKEN_CACHE:
            self.known.clear()
        out: list[int] = []
        known = self.known
        for w in WORD.findall(text or ""):
            got = known.get(w)
            if got is None:
                got = known[w] = (_bucket(w.lower()), DIMENSIONS // 2 + _bucket(_shape(w)))
            out += got
        return np.array(out, np.int64)


def _score(weights: np.ndarray, bias: float, buckets: np.ndarray) -> float:
    return float(weights[buckets].mean() * 2 + bias) if len(buckets) else bias


def train(texts: list[str | None], soft: np.ndarray, epochs: int = 8, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Logistic regression on mean bucket weights by stochastic gradient steps with a decaying rate."""
    hashed = _Hashed()
    rows = [hashed.of(t) for t in texts]
    weights, bias = np.zeros(DIMENSIONS), 0.0
    order = np.random.default_rng(7)
    step = 0
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            step += 1
            lr = rate / (1 + step / 4000)
            g = soft[i] - 1 / (1 + np.exp(-np.clip(_score(weights, bias, rows[i]), -30, 30)))
            if len(rows[i]):
                np.add.at(weights, rows[i], lr * g * 2 / len(rows[i]))
            bias += 0.02 * lr * g
    return weights, bias


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), weak_label (posterior of the votes) and kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # the labellers read each text once; repeated rows agree, so one vote per id and text is enough
    votes_of = measurements(rows.withColumn("h", _row_key()), keep=("h",)).select("doc_id", "h", "n_words", pattern().alias("p"))
    voted = materialize(votes_of, "votes")
    got = voted.groupBy("p").count().collect()  # at most 3^labellers rows
    patterns = np.array(sorted(r["p"] for r in got), np.int64)
    counts = np.array([r["count"] for r in sorted(got, key=lambda r: r["p"])], np.float64)
    if not len(patterns):
        patterns, counts = np.array([3 ** len(LABELLERS) - 1]), np.array([0.0])
    _, _, post = expectation_maximisation(patterns, counts)
    soft = dict(zip(patterns.tolist(), post.tolist(), strict=True))

    # the sample's last hash is found on ids alone, so that no other text is sorted
    placed = rows.withColumn("h", F.xxhash64("doc_id"))
    last = placed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = placed.filter(F.col("h") <= F.lit(last).cast("bigint")).orderBy("h", "doc_id").limit(sample)
    learnt = _with_pattern(drawn).select("text", "p").collect() if counts.sum() else []  # at most sample rows
    weights, bias = train([r["text"] for r in learnt], np.array([soft.get(r["p"], 0.5) for r in learnt])) if learnt else (np.zeros(DIMENSIONS), 0.0)
    weights = weights.astype(np.float32)
    hashed = _Hashed()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        logits = [_score(weights, bias, hashed.of(t)) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "h": b.column("h"), "linear": pa.array(logits, pa.float64())})

    linear = mapped(rows.withColumn("h", _row_key()), run, "doc_id bigint, h bigint, linear double")
    once = voted.dropDuplicates(["doc_id", "h"]).withColumnsRenamed({"doc_id": "d", "h": "k"})
    scored = linear.join(once, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")))
    table = spark.createDataFrame([(int(k), float(v)) for k, v in soft.items()], "p int, weak_label double")
    out = scored.join(F.broadcast(table), "p", "left").withColumn("weak_label", F.coalesce("weak_label", F.lit(0.5)))
    odds = F.log(F.greatest(F.lit(1e-6), F.col("weak_label")) / F.greatest(F.lit(1e-6), 1 - F.col("weak_label")))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("linear") + odds) / 2))
    return out.withColumn("score", score).select("doc_id", "score", "weak_label", ((F.col("score") >= threshold) & (F.col("n_words") > 0)).alias("kept"))


def _row_key() -> Column:
    """A key of the whole text beside the id: rows that share both have equal votes."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _with_pattern(rows: DataFrame) -> DataFrame:
    """doc_id, text, n_words and the vote pattern of each row, in one pass and without a join."""
    return measurements(rows, keep=("text",)).select("doc_id", "text", "n_words", pattern().alias("p"))
