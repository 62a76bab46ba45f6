"""Entity resolution: blocking keys, candidate pairs, comparison and resolution."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from gazette.functions.dates import day_bucket
from gazette.functions.text import identity_form, search_form, title_tokens
from gazette.session import held, spread

CANDIDATE_CAP = 100
MATCH_SCORE, REVIEW_SCORE, NEAR_TIE = 91.0, 65.0, 5.0
#: Tiers of candidates, in the order they are tried: shared URLs and platform ids, organizer and
#: window, title and window, organizer and title word.
EXACT, BY_ORGANIZER, BY_TITLE, BY_WORD = 0, 1, 2, 3


def profiles(rows: DataFrame) -> DataFrame:
    """rows (id, title, organizer, day, registration_day, format, location, urls array<string>,
    source_ids array<string> of the form "platform|id"; edition, if there is one, is a key of its own)
    brought to the forms that are compared."""
    # forms and years are columns of their own, so that they are worked out once for all that follows from them
    formed = rows.withColumns({"title": identity_form(F.col("title")), "organizer": identity_form(F.col("organizer"), organizer=True)})
    title, organizer, own_years = F.col("title"), F.col("organizer"), F.col("own_years")
    dated = formed.withColumn("own_years", F.array_distinct(F.regexp_extract_all(title, F.lit("\\b(?:19|20|21)[0-9]{2}\\b"), F.lit(0))))
    day_year = F.date_format("day", "yyyy")
    none = F.array().cast("array<string>")
    return dated.select(
        "id",
        "title",
        "organizer",
        title_tokens(title).alias("tokens"),
        title_tokens(organizer).alias("organizer_tokens"),
        "day",
        "registration_day",
        F.when(F.size(own_years) > 0, own_years).when(F.col("day").isNotNull(), F.array(day_year)).otherwise(none).alias("years"),
        ((F.size(own_years) > 1) | ((F.size(own_years) > 0) & F.coalesce(~F.array_contains(own_years, day_year), F.lit(False)))).alias("conflicted"),
        F.sort_array(F.array_except(F.regexp_extract_all(title, F.lit("[0-9]+"), F.lit(0)), own_years)).alias("numbers"),
        identity_form(F.col("location")).alias("location"),
        "format",
        F.coalesce("urls", none).alias("urls"),
        F.coalesce("source_ids", none).alias("source_ids"),
        *(["edition"] if "edition" in rows.columns else []),
    )


def edition_key(title: Column, organizer: Column, day: Column, format: Column, place: Column) -> Column:
    """Digest of what makes two listings the same edition; null if any of it is missing."""
    parts = [search_form(title), search_form(organizer), day.cast("string"), format, F.lower(place)]
    missing = title.isNull() | organizer.isNull() | day.isNull() | format.isNull() | place.isNull()
    return F.when(~missing, F.sha2(F.concat_ws("|", *parts), 256))


def _key(tier: int, block: Column, place: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), block.alias("block"), place.cast("int").alias("place"))


def _keys(tier: int, prefix: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: _key(tier, F.concat(F.lit(prefix), k), F.lit(-1)))


def _exact_keys(rows: DataFrame) -> list[Column]:
    editions = [_keys(EXACT, "e:", F.filter(F.array("edition"), lambda e: e.isNotNull()))] if "edition" in rows.columns else []
    given = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return [_keys(EXACT, "u:", given("urls")), _keys(EXACT, "s:", given("source_ids")), *editions]


def exact_blocks(rows: DataFrame) -> DataFrame:
    """(id, tier, block, place) of the exact keys alone: only urls, source_ids and edition of rows are read."""
    return rows.select("id", F.explode(F.array_distinct(F.concat(*_exact_keys(rows)))).alias("k")).select("id", "k.tier", "k.block", "k.place")


def placed_blocks(rows: DataFrame) -> DataFrame:
    """(id, tier, block, place) of profiles. A window is a bucket of 14 days or one beside it; a title with
    one informative word is blocked by that word, others by the pairs of their first eight. place: the window's
    distance from the id's own bucket, -1 to 1, and -1 for blocks without one. Two ids that meet by a key meet
    in each window that they have in common, and in the first of those the lesser of their places is -1."""
    own_day = F.coalesce("day", "registration_day")
    editions = ["edition"] if "edition" in rows.columns else []
    x = rows.select("id", "organizer", "tokens", "urls", "source_ids", *editions, F.slice("tokens", 1, 8).alias("first"), day_bucket(own_day).alias("bucket"))
    first = F.col("first")
    pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.lit(8)), lambda b: F.concat_ws("+", a, b))))
    x = x.withColumns({"titles": F.when(F.size("tokens") > 1, pairs).otherwise(first), "near": F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)})
    by_day = lambda tier, prefix, keys: F.flatten(F.transform("near", lambda w, i: F.transform(keys, lambda k: _key(tier, F.concat(F.lit(prefix), k, F.lit("@"), w.cast("string")), i - 1))))
    named, none = F.col("organizer") != "", F.array().cast("array<struct<tier:int,block:string,place:int>>")
    keys = F.concat(
        *_exact_keys(x),
        F.coalesce(F.when(named, by_day(BY_ORGANIZER, "o:", F.array("organizer"))), none),
        F.coalesce(by_day(BY_TITLE, "t:", F.col("titles")), none),
        F.when(named, _keys(BY_WORD, "ot:", F.transform("tokens", lambda t: F.concat_ws("+", "organizer", t)))).otherwise(none),
    )
    return x.select("id", F.explode(F.array_distinct(keys)).alias("k")).select("id", "k.tier", "k.block", "k.place")


def blocks(rows: DataFrame) -> DataFrame:
    """(id, tier, block) of profiles."""
    return placed_blocks(rows).drop("place")


def candidate_pairs(rows: DataFrame, stored: DataFrame | None = None, cap: int = CANDIDATE_CAP) -> tuple[DataFrame, DataFrame]:
    """(left_id, right_id, tier): the candidates in stored of each row, from the first tier in which
    it has any; and the ids that abstain, because a block of that tier has more than cap others, or
    all its blocks together have. Without stored, rows are held against each other. Block sizes are
    counted before anything is paired, so crowded blocks are never joined."""
    # dealt once for the sizes and both joins, in tasks by the number of rows
    dealt = lambda df, name: spread(held(df, name), 250_000, "tier", "block")
    if stored is None:
        own = dealt(placed_blocks(rows), "blocks")
        return _paired(own, own, True, cap)[:2]
    # ids that meet by an exact key have no need of blocks of other tiers, which are the most
    pairs, over, met = _paired(dealt(exact_blocks(rows), "exact"), dealt(exact_blocks(stored), "stored-exact"), False, cap)
    rest = held(rows.join(met, "id", "left_anti"), "inexact")
    if rest.isEmpty():
        return pairs, over
    fuzzy = lambda df: placed_blocks(df).filter(F.col("tier") != EXACT)
    more, more_over, _ = _paired(dealt(fuzzy(rest), "blocks"), dealt(fuzzy(stored), "stored-blocks"), False, cap)
    return pairs.unionByName(more), over.union(more_over)


def _paired(own: DataFrame, others_blocks: DataFrame, same: bool, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidate_pairs of blocks, and the ids that meet others in any."""
    others = F.col("size") - 1 if same else F.col("size")
    sizes = others_blocks.groupBy("tier", "block").agg(F.count(F.lit(1)).alias("size")).filter(others > 0).withColumn("size", others)
    met = own.join(sizes, ["tier", "block"])
    tiers = met.groupBy("id", "tier").agg(F.max("size").alias("most"))
    first = tiers.groupBy("id").agg(F.min(F.struct("tier", "most")).alias("x")).select("id", "x.*")
    first = held(first, "first-tiers")
    fit = met.join(first.filter(F.col("most") <= cap), ["id", "tier"]).select("tier", "block", F.col("id").alias("left_id"), F.col("place").alias("left_place"))
    pairs = fit.join(others_blocks.select("tier", "block", F.col("id").alias("right_id"), "place"), ["tier", "block"])
    pairs = pairs.filter(F.least("left_place", "place") == -1)  # all blocks of the tier are joined, so the first common window is
    if same:
        pairs = pairs.filter("left_id <> right_id")
    pairs = held(pairs.groupBy("left_id", "right_id").agg(F.min("tier").alias("tier")), "pairs")
    many = pairs.groupBy("left_id").count().filter(F.col("count") > cap).select(F.col("left_id").alias("id"))
    return pairs.join(many, F.col("left_id") == F.col("id"), "left_anti"), first.filter(F.col("most") > cap).select("id").union(many), first.select("id")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: twice the longest common subsequence over both lengths; 0 for a null or empty side."""
    return pd.Series([200.0 * _common(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def token_sort(text: Column) -> Column:
    return F.array_join(F.sort_array(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def day_score(gap: Column) -> Column:
    return F.when(gap == 0, 100).when(gap <= 3, 95).when(gap <= 7, 85).when(gap <= 14, 60).when(gap <= 30, 30).otherwise(0)


@F.pandas_udf(BooleanType())
def far_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether a word of either list is like none of the other (less than 85 of 100); false for nulls."""
    like = lambda x, y: 200.0 * _common(x, y) / (len(x) + len(y)) >= 85
    lone = lambda xs, ys: any(not any(like(x, y) for y in ys) for x in xs)
    return pd.Series([x is not None and y is not None and (lone(x, y) or lone(y, x)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _either(c: str, value: str) -> Column:
    return (F.col(f"l.{c}") == value) | (F.col(f"r.{c}") == value)


def _some(c: str) -> Column:
    return (F.size(f"l.{c}") > 0) & (F.size(f"r.{c}") > 0)


# What is known of a pair (l and r, profiles) without holding its texts against each other.


def _online() -> Column:
    return (F.col("l.format") == "online") & (F.col("r.format") == "online")


def _other_years() -> Column:
    return _some("years") & ~F.arrays_overlap("l.years", "r.years")


def _other_numbers() -> Column:
    return _some("numbers") & (F.col("l.numbers") != F.col("r.numbers"))


def _other_format() -> Column:
    return (F.col("l.format") != F.col("r.format")) & ~_either("format", "unknown")


def _other_words() -> Column:
    return ~F.arrays_overlap("l.tokens", "r.tokens")


def _other_names() -> Column:
    return F.col("l.organizer_tokens") != F.col("r.organizer_tokens")


def _gap() -> Column:
    return F.abs(F.datediff("l.day", "r.day"))


def _weighable(gap: Column) -> Column:
    """Whether l and r can be a MATCH by evidence, whatever their texts come to."""
    apart = [F.col("l.conflicted"), F.col("r.conflicted"), gap.isNull(), gap > 7, _other_format(), ~_online() & _either("location", ""), _either("organizer", ""), _other_numbers(), _other_years(), _other_names(), _other_words()]
    return ~reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in apart])


def _score(t: Column, o: Column, gap: Column, place: Column) -> Column:
    return F.bround(0.5 * t + 0.25 * o + 0.2 * F.coalesce(day_score(gap), F.lit(0)) + 0.05 * place, 3)


def evident(pairs: DataFrame) -> DataFrame:
    """pairs of l and r (profiles) with match and score, as compare has them without scored for sides that share no URL or platform
    id; null where that depends on texts that differ, so that compare has to tell."""
    same = (F.col("l.title") == F.col("r.title")) & (F.col("l.organizer") == F.col("r.organizer")) & (F.coalesce(_online(), F.lit(False)) | (F.col("l.location") == F.col("r.location")) & (F.col("l.location") != ""))
    x = pairs.withColumn("gap", _gap()).withColumn("match", F.when(~_weighable(F.col("gap")), False).when(same, True))
    full = F.lit(100.0)
    return x.withColumn("score", F.when(F.col("match"), _score(full, full, F.col("gap"), full)).when(~F.col("match"), 0.0)).drop("gap")


def compare(pairs: DataFrame, rows: DataFrame, stored: DataFrame | None = None, scored: bool = True) -> DataFrame:
    """Outcome, score, reasons and exact of each pair. Conflicting editions are DISTINCT, or REVIEW
    where a URL or platform id is shared; else what is shared is a MATCH; else evidence is weighed,
    and any reason against turns a MATCH into a REVIEW. Only texts that differ are held against each other;
    without scored, not those of pairs that cannot be a MATCH by evidence either: their score means nothing."""
    side = lambda df, name, key: df.select(F.col("id").alias(key), F.struct(*[c for c in df.columns if c != "id"]).alias(name))
    x = pairs.join(side(rows, "l", "left_id"), "left_id").join(side(rows if stored is None else stored, "r", "right_id"), "right_id")
    either, no_name, no_place, online = _either, _either("organizer", ""), _either("location", ""), _online()
    other_years, other_numbers, other_format, other_words, other_names = _other_years(), _other_numbers(), _other_format(), _other_words(), _other_names()
    x = x.withColumn("gap", _gap())
    x = x.withColumn("weighed", F.lit(True) if scored else _weighable(F.col("gap")))

    def ratio(c: str, wanted: Column) -> Column:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        differ = wanted & (a != b)
        return F.when(either(c, ""), 0.0).when(a == b, 100.0).otherwise(indel_ratio(F.when(differ, token_sort(a)), F.when(differ, token_sort(b))))

    weighed = F.col("weighed")
    x = x.withColumn("t", ratio("title", weighed)).withColumn("o", ratio("organizer", weighed))
    x = x.withColumn("place", F.when(online, 100.0).otherwise(ratio("location", weighed & ~F.coalesce(online, F.lit(False)))))
    x = x.withColumn("only_l", F.array_except("l.tokens", "r.tokens")).withColumn("only_r", F.array_except("r.tokens", "l.tokens"))
    both = (F.size("only_l") > 0) & (F.size("only_r") > 0)
    x = x.withColumn("far", F.when(both, far_words(F.when(weighed & both, F.col("only_l")), F.when(weighed & both, F.col("only_r")))).otherwise((F.size("only_l") > 0) | (F.size("only_r") > 0)))
    score = _score(F.col("t"), F.col("o"), F.col("gap"), F.col("place"))
    by_url, by_id = F.arrays_overlap("l.urls", "r.urls"), F.arrays_overlap("l.source_ids", "r.source_ids")
    platform = lambda c: F.transform(c, lambda s: F.split_part(s, F.lit("|"), F.lit(1)))
    shared = F.array_intersect(platform("l.source_ids"), platform("r.source_ids"))
    of = lambda c, p: F.filter(c, lambda s: F.split_part(s, F.lit("|"), F.lit(1)) == p)
    id_conflict = F.exists(shared, lambda p: ~F.arrays_overlap(of("l.source_ids", p), of("r.source_ids", p)))

    def reasons(**found: Column) -> Column:
        named = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in found.items()])
        return F.filter(named, lambda r: r.isNotNull())

    editions = reasons(
        title_date_year_conflict=F.col("l.conflicted") | F.col("r.conflicted"),
        edition_year_conflict=other_years,
        numbered_edition_conflict=other_numbers,
        event_dates_far_apart=F.col("gap") > 90,
    )
    against = reasons(
        source_id_conflict=F.col("id_conflict"),
        format_conflict=other_format,
        physical_location_missing=~online & no_place,
        location_conflict=~online & ~no_place & (F.col("place") < 90),
        organizer_missing=no_name,
        organizer_conflict=~no_name & ((F.col("o") < 94) | other_names),
        event_dates_missing=F.col("gap").isNull(),
        event_dates_differ=F.col("gap") > 7,
        title_variant_conflict=F.col("far"),
        title_evidence_weak=(F.col("t") < 90) | other_words,
    )
    x = x.withColumn("score", score).withColumn("by_url", by_url).withColumn("by_id", by_id).withColumn("exact", by_url | by_id).withColumn("id_conflict", id_conflict)
    x = x.withColumn("editions", editions).withColumn("against", against)
    edition, exact, fine = F.size("editions") > 0, F.col("exact"), F.size("against") == 0
    split = exact & F.col("id_conflict") & ~F.col("by_id")
    review = F.when((F.col("score") >= REVIEW_SCORE) & (F.col("t") >= REVIEW_SCORE), "REVIEW").otherwise("DISTINCT")
    outcome = F.when(edition, F.when(exact, "REVIEW").otherwise("DISTINCT")).when(split, "REVIEW").when(exact, "MATCH").when(fine & (F.col("score") >= MATCH_SCORE), "MATCH").otherwise(review)
    said = lambda *r: F.array(*map(F.lit, r))
    why = F.when(edition, F.col("editions")).when(split, said("source_id_conflict")).when(exact, F.when(F.col("by_url"), said("canonical_url")).otherwise(said("source_id")))
    why = why.when(~fine, F.col("against")).when(outcome == "MATCH", said("weighted_evidence")).otherwise(said("score_below_match_threshold"))
    final = F.when(exact & ~edition & ~split, 100.0).otherwise(F.col("score"))
    return x.select("left_id", "right_id", "tier", "exact", final.alias("score"), outcome.alias("outcome"), why.alias("reasons"))


def resolve(ids: DataFrame, compared: DataFrame, overflow: DataFrame) -> DataFrame:
    """A row for each of ids: its best candidate (exact matches first, then by score, then by id), the
    outcome and why. A second MATCH of the same exactness within 5 points makes it a REVIEW; ids of
    overflow abstain as a REVIEW; ids without candidates are DISTINCT."""
    sure = F.col("exact") & (F.col("outcome") == "MATCH")
    kind = F.when(F.col("outcome") == "MATCH", 0).when(F.col("outcome") == "REVIEW", 1).otherwise(2)
    order = F.struct(kind.alias("kind"), (~sure).alias("later"), (-F.col("score")).alias("down"), "right_id", "exact", "outcome", "reasons")
    best = compared.groupBy("left_id").agg(F.min(order).alias("b"))
    matched = compared.filter("outcome = 'MATCH'").join(best.filter("b.kind = 0"), "left_id")
    rival = (F.col("right_id") != F.col("b.right_id")) & (F.col("exact") == F.col("b.exact")) & (-F.col("b.down") - F.col("score") < NEAR_TIE)
    tied = matched.groupBy("left_id").agg(F.count_if(rival).alias("rivals"))
    over = overflow.distinct().select(F.col("id").alias("left_id"), F.lit(True).alias("over"))
    x = ids.select(F.col("id").alias("left_id")).join(best, "left_id", "left").join(tied, "left_id", "left").join(over, "left_id", "left")
    said = lambda r: F.array(F.lit(r))
    pick = lambda over, none, tie, other: F.when(F.col("over"), over).when(F.col("b").isNull(), none).when(F.col("rivals") > 0, tie).otherwise(other)
    return x.select(
        "left_id",
        F.when(F.col("over").isNull(), F.col("b.right_id")).alias("right_id"),
        pick(F.lit(0.0), F.lit(0.0), -F.col("b.down"), -F.col("b.down")).alias("score"),
        pick(F.lit("REVIEW"), F.lit("DISTINCT"), F.lit("REVIEW"), F.col("b.outcome")).alias("outcome"),
        pick(said("candidate_limit_exceeded"), said("no_candidates"), said("ambiguous_candidates"), F.col("b.reasons")).alias("reasons"),
    )


def resolution(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """resolve for all of rows against stored (or each other), from profiles: every step is worked out once."""
    mine = held(rows, "profiles")
    theirs = None if stored is None else held(stored, "stored-profiles")
    pairs, overflow = candidate_pairs(mine, theirs)
    return resolve(mine, held(compare(pairs, mine, theirs), "compared"), overflow)


def same_exact(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Baseline: left_id, right_id and outcome of pairs, a MATCH where a URL or platform id is shared."""
    side = lambda name, key: rows.select(F.col("id").alias(key), F.struct("urls", "source_ids").alias(name))
    x = pairs.join(side("l", "left_id"), "left_id").join(side("r", "right_id"), "right_id")
    hit = F.arrays_overlap("l.urls", "r.urls") | F.arrays_overlap("l.source_ids", "r.source_ids")
    return x.select("left_id", "right_id", F.when(hit, "MATCH").otherwise("DISTINCT").alias("outcome"))


def same_edition(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Baseline: a MATCH where the edition keys (edition of rows) are equal."""
    side = lambda name, key: rows.select(F.col("id").alias(key), F.col("edition").alias(name))
    x = pairs.join(side("l", "left_id"), "left_id").join(side("r", "right_id"), "right_id")
    return x.select("left_id", "right_id", F.when(F.coalesce(F.col("l") == F.col("r"), F.lit(False)), "MATCH").otherwise("DISTINCT").alias("outcome"))


def typos(text: Column, seed: Column, every: int = 3) -> Column:
    """text with one letter of about one in every words doubled, dropped or swapped with the next, by a hash of the
    seed, the word and its place: the same on every run."""

    def one(word: Column, k: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), word, k.cast("string"))), 1, 6), 16, 10).cast("int")
        at = (F.pmod(F.floor(h / 16), F.length(word) - 1) + 1).cast("int")
        head, a, b, tail = F.substr(word, F.lit(1), at - 1), F.substr(word, at, F.lit(1)), F.substr(word, at + 1, F.lit(1)), F.substr(word, at + 2)
        kind = F.pmod(h, F.lit(3))
        wrong = F.when(kind == 0, F.concat(head, a, a, b, tail)).when(kind == 1, F.concat(head, b, tail)).otherwise(F.concat(head, b, a, tail))
        return F.when((F.pmod(F.floor(h / 4), F.lit(every)) == 0) & (F.length(word) >= 5), wrong).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def quality(judged: DataFrame) -> DataFrame:
    """One row over judged (expected_same boolean, outcome): counts of a MATCH against the truth, with
    precision, recall, F1 and the share of different pairs that were merged."""
    same, match = F.col("expected_same"), F.col("outcome") == "MATCH"
    n = judged.agg(F.count_if(same & match).alias("tp"), F.count_if(~same & match).alias("fp"), F.count_if(same & ~match).alias("fn"), F.count_if(~same & ~match).alias("tn"))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("*", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), part(fp, fp + F.col("tn")).alias("false_merge_rate"))
