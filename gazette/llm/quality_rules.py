"""Quality rules as a bitmask ledger (native).

Each rule is evaluated once a document; the failure bits and the measurements are stored, and
versioned policies are applied to the bits afterwards. Changing a policy or asking which rule
decides a rejection never touches the text again.

Cases: a null or empty text has no words and all counts 0, so it fails ``too_few_words``; a null
doc_id passes through; repeated rows give repeated rows; an empty table gives an empty ledger.
Only the id and text columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import SPACE, SPACE_CLASS, bind, materialize, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Bit order of the ledger. A new rule takes the next free bit; bits are never reused.
RULES: tuple[str, ...] = (
    "too_few_words",
    "repeated_windows",
    "symbol_heavy",
    "mean_word_length",
    "duplicate_lines",
    "mostly_upper_case",
    "few_letters",
)


@dataclass(frozen=True)
class Policy:
    """A named version: the rules whose failure rejects a document."""

    version: str
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rejects)


BASE_POLICY = Policy("base", ("too_few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE_POLICY, Policy("v1", RULES))}


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text.

    The window hashes are sorted, O(n log n) in the text. Where two neighbours are equal, the
    starts of all repeated windows are found by a second sort of (hash, start), and how far they
    reach is added up; each word counts once.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def any_equal(s: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.get(s, k) == F.get(s, k - 1))

    def starts(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = bind(placed, lambda s: F.filter(s, lambda x, k: ((k > 0) & same(s, x, F.greatest(k - 1, F.lit(0)))) | same(s, x, k + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        return F.when(bind(F.sort_array(h), any_equal), bind(starts(h), covered)).otherwise(F.lit(0))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, bind(hashes, lambda h: bind(windows(h), counted))).otherwise(F.lit(0)).cast("long")


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: the id, every figure that a rule needs, and the columns in keep."""
    text = text_of(text_col)
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed != "", F.split(trimmed, f"{SPACE_CLASS}+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        *keep,
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("_w"),
        F.length(F.regexp_replace(text, f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_l"),
        only("A-Z").alias("n_upper"),
        F.length(F.regexp_replace(text, "\\P{L}+", "")).cast("long").alias("n_letters"),
    ).select(
        "doc_id",
        *keep,
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.d").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
        "n_upper",
        "n_letters",
    )


def rule_bits() -> Column:
    """Failure bits, in integer arithmetic only, so that every engine gives the same ones."""
    n, chars = F.col("n_words"), F.col("word_chars")
    failed = {
        "too_few_words": n < 10,
        "repeated_windows": F.col("n_repeat_words") * 100 > n * 20,
        "symbol_heavy": F.col("n_symbols") * 10 > n * 3,
        "mean_word_length": (n > 0) & ((chars < n * 2) | (chars > n * 15)),
        "duplicate_lines": F.col("n_dup_lines") * 2 > F.col("n_lines"),
        "mostly_upper_case": F.col("n_upper") * 2 > F.col("n_letters"),
        "few_letters": F.col("n_letters") * 2 < chars,
    }
    bits = [F.when(failed[r], F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``failed_bits`` (bit k: RULES[k] failed), one row a document."""
    return measurements(docs, id_col, text_col, keep).withColumn("failed_bits", rule_bits())


def stored(rows: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations then read bits and never a text."""
    return materialize(rows, "ledger")


def apply_policy(rows: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """Adds base_failed and kept; kept is false whenever the base rules fail."""
    hit = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return (
        rows.withColumn("base_failed", hit(BASE_POLICY.mask))
        .withColumn("kept", ~hit(policy.mask | BASE_POLICY.mask))
        .withColumn("policy", F.lit(policy.version))
    )


def ablations(rows: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many would be kept without
    it. Counts once by distinct mask (at most 2^rules rows), then works on the masks."""
    masks = rows.groupBy("failed_bits").count()
    by_rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rejects]))
    seen = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return (
        masks.select("failed_bits", "count", by_rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(seen == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only_this_rule"),
        )
    )
