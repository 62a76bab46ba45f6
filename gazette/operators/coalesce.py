"""Read-time coalescing: listings of one event are shown as one, and every id stays addressable.

The rule depends on the order: by id (as text), each listing joins the one earlier head that it
matches, or becomes a head itself. A head keeps its own title, organizer and dates, and gains the URLs
and platform ids of those that join it. Candidates come from the first tier in which there are any:
shared URLs and platform ids, then organizer, title and organizer-word blocks. Two candidates that match alike
are ambiguous, and the listing stays apart.

As Spark does it: a listing without an exact key or a fuzzy match in common with an earlier one is a
head whatever happens to others, so only the rest has to be worked out in order. What nothing earlier can match, by what a
match needs of both, makes no pairs and is `no_match`, crowded or not; where a listing meets such a head by its
organizer, it gets no further, and the blocks of the later tiers are made for the others only. Those that wait are split into
the connected components of what they depend on (stars of shared keys, never all pairs), and each
component is folded by itself, as rows of a task that come one after the other. What the fold needs of a pair is computed before, in columns.

Limits: a fuzzy block with more than CANDIDATE_CAP listings is crowded and its listings abstain in that
tier, as they do in resolution; a component of more than COMPONENT_CAP listings is not folded in one task:
its listings stay apart, as `component_limit_exceeded`. Shared URLs of any number are no limit by themselves.

Cases: listings without a title, URLs or ids are heads; a null id is refused (it could not be
addressed); of repeated ids the least row counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions.dates import day_bucket
from gazette.operators.components import components
from gazette.operators.identity import BY_ORGANIZER, CANDIDATE_CAP, NEAR_TIE, compare, evident, exact_blocks, placed_blocks, profiles
from gazette.session import held, parts, spread

COMPONENT_CAP = 20_000
#: Buckets that are joined as one key: with more, fewer listings are sent to two; with fewer, fewer that do not meet are tried.
SPAN = 16
#: Listings that a task is dealt, about.
TASK_ROWS = 50_000
FOLDED = "id string, head string, outcome string, reason string"


def _hopeful(own: DataFrame) -> DataFrame:
    """Ids that an earlier one may match, by what a MATCH needs of both sides: the words of the organizer, the year and
    numbers that are equal, if both have any. Digests may only add ids."""
    placed = F.coalesce((F.col("format") == "online") | (F.col("location") != ""), F.lit(True))
    fit = own.filter(~F.col("conflicted") & (F.col("organizer") != "") & F.col("day").isNotNull() & (F.size("tokens") > 0) & placed)
    x = fit.select("id", F.xxhash64("organizer_tokens", "years").alias("g"), F.when(F.size("numbers") > 0, F.xxhash64("numbers")).otherwise(0).alias("n"))
    least = x.groupBy("g", "n").agg(F.min("id").alias("least"))
    of = least.groupBy("g").agg(F.min("least").alias("any"), F.min(F.when(F.col("n") == 0, F.col("least"))).alias("bare"))
    first = least.join(of, "g").select("g", "n", F.when(F.col("n") == 0, F.col("any")).otherwise(F.least("least", "bare")).alias("first"))
    return x.join(first, ["g", "n"]).filter("id > first").select("id")


def _crowded_windows(rows: DataFrame) -> DataFrame:
    """(organizer, window) of more than CANDIDATE_CAP + 1 rows (organizer, bucket). One of its three buckets has a third of
    them, so only windows beside such a bucket are counted."""
    counts = held(rows.groupBy("organizer", "bucket").agg(F.count(F.lit(1)).alias("n")), "coalesce-buckets")
    beside = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    near = counts.filter(3 * F.col("n") > CANDIDATE_CAP + 1).select("organizer", beside("bucket").alias("window")).distinct()
    sizes = near.select("organizer", "window", beside("window").alias("bucket")).join(counts, ["organizer", "bucket"]).groupBy("organizer", "window").agg(F.sum("n").alias("size"))
    return held(sizes.filter(F.col("size") > CANDIDATE_CAP + 1).select("organizer", "window"), "coalesce-crowded")


def _organizer_pairs(own: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tier of organizers and windows, whose blocks have a row a listing: (id, other, tier, match, score, sure) for ids
    that are hopeful and not settled, sure if the other is a head in any case; and (id, tier) where an id abstains. match is null
    where texts have to be compared. Profiles go with the blocks, and are not looked up for every pair."""
    lists = ("tokens", "years", "numbers")  # of words, so they go as texts, and organizers that meet are equal
    names = ["id", "title", "day", "conflicted", "location", "format", *lists]
    rows = own.filter("organizer <> ''").withColumn("bucket", day_bucket(F.coalesce("day", "registration_day"))).filter("bucket is not null")
    crowded = _crowded_windows(rows)
    over = crowded.select("organizer", "window", F.explode(F.sequence(F.col("window") - 1, F.col("window") + 1)).alias("bucket")).groupBy("organizer", "bucket").agg(F.collect_set("window").alias("over"))
    x = rows.select("organizer", "bucket", *[F.array_join(c, " ").alias(c) if c in lists else c for c in names]).join(flags, "id", "left").join(over, ["organizer", "bucket"], "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumn("pairs", is_("hopeful") & ~is_("settled"))
    windows = lambda side: F.when(F.col(f"{side}_over").isNull(), around(side)).otherwise(F.array_except(around(side), f"{side}_over"))
    around = lambda side: F.sequence(F.col(f"{side}_bucket") - 1, F.col(f"{side}_bucket") + 1)
    words = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    as_side = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("bucket", "over", *names)]
    profile = lambda side: F.struct("organizer", F.array().cast("array<string>").alias("organizer_tokens"), *[(words(c) if n in lists else c).alias(n) for n in names for c in [F.col(f"{side}_{n}")]])
    n = parts(own, TASK_ROWS)
    span = lambda by: F.floor((F.col("bucket") + by) / SPAN)
    fit = x.filter("over is null or size(over) < 3")
    mine = fit.filter("pairs").select("organizer", F.explode(F.array_distinct(F.array(span(-2), span(2)))).alias("span"), *as_side("l"))
    others = fit.select("organizer", span(0).alias("span"), (~is_("hopeful") & ~is_("starred")).alias("sure"), *as_side("r"))
    met = mine.repartition(n, "organizer", "span").join(others.repartition(n, "organizer", "span"), ["organizer", "span"])
    open_ = F.col("l_over").isNull() & F.col("r_over").isNull()
    met = met.filter((F.col("r_id") < F.col("l_id")) & (F.abs(F.col("l_bucket") - F.col("r_bucket")) <= 2) & (open_ | F.arrays_overlap(windows("l"), windows("r"))))
    # most that meet are told apart without their words
    apart = F.col("l_conflicted") | F.col("r_conflicted") | ((F.col("l_numbers") != "") & (F.col("r_numbers") != "") & (F.col("l_numbers") != F.col("r_numbers")))
    met = met.withColumn("apart", apart)
    side = lambda name: F.when(~F.col("apart"), profile(name)).alias(name)
    pairs = evident(met.select(F.col("l_id").alias("id"), F.col("r_id").alias("other"), "sure", "apart", side("l"), side("r")))
    no = lambda c, value: F.when(F.col("apart"), value).otherwise(F.col(c)).alias(c)
    pairs = pairs.select("id", "other", F.lit(BY_ORGANIZER).alias("tier"), no("match", F.lit(False)), no("score", F.lit(0.0)), "sure")
    return held(pairs, "coalesce-pairs"), x.filter("pairs and over is not null").select("id", F.lit(BY_ORGANIZER).alias("tier"))


def _other_pairs(own: DataFrame, mine: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, other, tier) of the tiers that follow, for the ids of mine, without the pairs of before; and (id, tier) where
    an id abstains. Of the blocks of all listings only those of mine are counted and joined."""
    keys = placed_blocks(own).filter(F.col("tier") > BY_ORGANIZER)
    asked = held(keys.join(mine, "id", "left_semi"), "coalesce-asked")
    theirs = held(keys.join(asked.select("tier", "block").distinct(), ["tier", "block"], "left_semi"), "coalesce-keys")
    sizes = spread(theirs, 500_000, "tier", "block").groupBy("tier", "block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = held(theirs.join(sizes, ["tier", "block"]), "coalesce-met")
    crowded = held(met.filter(F.col("size") > CANDIDATE_CAP + 1).select("id", "tier").distinct().join(mine, "id", "left_semi"), "coalesce-crowded")
    fit = met.filter(F.col("size") <= CANDIDATE_CAP + 1).select("tier", "block", "place", "id")
    left = fit.join(mine, "id", "left_semi").join(crowded.withColumn("over", F.lit(True)), ["id", "tier"], "left")
    others = fit.select("tier", "block", F.col("id").alias("other"), F.col("place").alias("other_place"))
    # in the first common window only, but for ids of which a window is crowded: that may be the one
    first = F.col("over").isNotNull() | (F.least("place", "other_place") == -1)
    pairs = left.join(others, ["tier", "block"]).filter((F.col("other") < F.col("id")) & first)
    pairs = pairs.groupBy("id", "other").agg(F.min("tier").alias("tier"))
    return held(pairs.join(before.select("id", "other"), ["id", "other"], "left_anti"), "coalesce-more-pairs"), crowded


def _judged(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """pairs (id, other, tier) with match and score, by their texts."""
    none = F.array().cast("array<string>")
    bare = own.withColumns({"urls": none, "source_ids": none})  # exactness depends on the head's members and is the fold's matter
    judged = compare(pairs.select(F.col("id").alias("left_id"), F.col("other").alias("right_id"), "tier"), bare, scored=False)
    return judged.select(F.col("left_id").alias("id"), F.col("right_id").alias("other"), "tier", (F.col("outcome") == "MATCH").alias("match"), "score")


def _fuzzy_pairs(own: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, other, tier, match, score) with others that are earlier, for ids with a match among them; and
    (id, tier) where an id abstains. own: profiles; stars (id, decides): ids with an exact key in common with an earlier one.
    Ids that an exact key decides need no pairs, nor do those that nothing earlier can match. An id that meets a sure head by its
    organizer gets no further than that tier."""
    yes, no = F.lit(True), F.lit(False)
    marks = _hopeful(own).select("id", yes.alias("hopeful"), no.alias("starred"), no.alias("settled")).union(stars.select("id", no, yes, "decides"))
    flags = held(marks.groupBy("id").agg(*[F.max(c).alias(c) for c in ("hopeful", "starred", "settled")]), "coalesce-flags")
    pairs, crowded = _organizer_pairs(own, flags)
    crowded = held(crowded, "coalesce-abstains")
    done = pairs.filter("sure").select("id").distinct().join(crowded, "id", "left_anti")
    further = held(flags.filter("hopeful and not settled").select("id").join(done, "id", "left_anti"), "coalesce-further")
    columns = ("id", "other", "tier", "match", "score")
    judged = pairs.filter("match is not null").select(*columns)
    texts = pairs.filter("match is null").select("id", "other", "tier")
    if not further.isEmpty():
        more, more_crowded = _other_pairs(own, further, pairs)
        texts, crowded = texts.union(more), crowded.union(more_crowded)
    if not texts.isEmpty():
        judged = held(judged.union(_judged(texts, own)), "coalesce-judged")
    able = judged.filter("match").select("id").distinct()
    many = judged.groupBy("id", "tier").count().filter(F.col("count") > CANDIDATE_CAP).select("id", "tier")
    return judged.join(able, "id", "left_semi"), crowded.union(many).distinct()


class _Pair(NamedTuple):
    tier: int
    other: str
    match: bool
    score: float


class _Listing(NamedTuple):
    component: str
    id: str
    urls: list[str]
    source_ids: list[str]
    years: list[str]
    numbers: list[str]
    conflicted: bool
    ordinal: int | None
    pairs: list[_Pair]
    abstains: list[int]


class _Head:
    def __init__(self, row) -> None:  # noqa: ANN001
        self.row, self.urls, self.ids = row, set(row.urls), defaultdict(set)
        self.add(row)

    def add(self, row) -> None:  # noqa: ANN001
        self.urls.update(row.urls)
        for s in row.source_ids:
            platform, _, own = s.partition("|")
            self.ids[platform].add(own)


def _split(source_ids) -> dict[str, set[str]]:  # noqa: ANN001
    found = defaultdict(set)
    for s in source_ids:
        platform, _, own = s.partition("|")
        found[platform].add(own)
    return found


def _editions_differ(a, b) -> bool:  # noqa: ANN001
    if a.conflicted or b.conflicted:
        return True
    if len(a.years) and len(b.years) and not set(a.years) & set(b.years):
        return True
    if len(a.numbers) and len(b.numbers) and set(a.numbers) != set(b.numbers):
        return True
    return a.ordinal is not None and b.ordinal is not None and abs(a.ordinal - b.ordinal) > 90


def _fold(part: list[_Listing]) -> list[tuple]:
    """One component, in the order of ids."""
    heads: dict[str, _Head] = {}
    by_key: dict[tuple[str, str], set[str]] = defaultdict(set)
    members = {row.id for row in part}
    out = []
    for row in sorted(part, key=lambda r: r.id):
        keys = [("u", u) for u in row.urls] + [("s", s) for s in row.source_ids]
        own = _split(row.source_ids)
        clash = lambda h: any(own[p].isdisjoint(h.ids[p]) for p in own if p in h.ids)  # noqa: B023, E731
        met = [by_key[k] for k in keys if k in by_key]
        found = set().union(*met)
        matched: list[tuple[float, str]] = []
        review = None
        if len(found) > CANDIDATE_CAP:  # a key's are among them
            review = "candidate_limit_exceeded"
        elif found:
            for h in found:
                head = heads[h]
                same_id = any(own[p] & head.ids[p] for p in own if p in head.ids)
                if not _editions_differ(row, head.row) and (same_id or not clash(head)):
                    matched.append((100.0, h))
            review = None if matched else "exact_conflict"
        else:
            for tier in sorted({p.tier for p in row.pairs} | set(row.abstains)):
                if tier in row.abstains:
                    review = "candidate_limit_exceeded"
                    break
                # an id outside the component is a head in any case
                here = [p for p in row.pairs if p.tier == tier and (p.other in heads or p.other not in members)]
                if here:
                    matched = [(p.score, p.other) for p in here if p.match and not clash(heads[p.other])]
                    break
        matched.sort(key=lambda m: (-m[0], m[1]))
        if len(matched) > 1 and matched[0][0] - matched[1][0] < NEAR_TIE:
            review, matched = "ambiguous_candidates", []
        if matched:
            h = matched[0][1]
            heads[h].add(row)
            out.append((row.id, h, "MATCH", "exact" if found else "weighted_evidence"))
        else:
            h = row.id
            heads[h] = _Head(row)
            out.append((row.id, h, "REVIEW" if review else "DISTINCT", review or "no_match"))
        for k in keys:
            by_key[k].add(h)
    return out


def _lists(column: pa.ListArray, of: Callable[[pa.Array], list] = pa.Array.to_pylist) -> list[list]:
    """The lists of a column, its values read as one array."""
    at = column.offsets.to_pylist()
    values = of(column.values.slice(at[0], at[-1] - at[0]))
    return [values[a - at[0] : b - at[0]] for a, b in pairwise(at)]


def _listings(rows: pa.RecordBatch) -> Iterator[_Listing]:
    pairs = lambda xs: list(map(_Pair, *[xs.field(k).to_pylist() for k in range(len(_Pair._fields))]))
    read = lambda name: _lists(c, *[pairs] * (name == "pairs")) if pa.types.is_list((c := rows.column(name)).type) else c.to_pylist()
    return map(_Listing, *map(read, _Listing._fields))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task, that come one after the other, each folded when it is whole."""
    done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["id", "head", "outcome", "reason"])
    part: list[_Listing] = []
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            out = []
            for row in _listings(whole.slice(at, 1024)):
                if part and part[0].component != row.component:
                    out += _fold(part)
                    part = []
                part.append(row)
            if out:
                yield done(out)
    if part:
        yield done(_fold(part))


def groups(rows: DataFrame, most: int = COMPONENT_CAP) -> DataFrame:
    """id, head (the id it is shown under), outcome and reason, for each id of rows (as for
    identity.profiles)."""
    once = rows.withColumn("id", F.col("id").cast("string")).filter("id is not null")
    names = [c for c in once.columns if c != "id"]
    # dealt by the number of rows, as they have few bytes for the work that they make
    once = spread(once, TASK_ROWS, "id").groupBy("id").agg(F.min(F.struct(*names)).alias("x")).select("id", "x.*")
    own = held(profiles(once), "coalesce-profiles")
    n = parts(own, TASK_ROWS)
    exact = exact_blocks(own).select("id", "block").filter("id is not null and block is not null").repartition(n, "block")  # once for both uses
    least = exact.groupBy("block").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = exact.join(least, "block").filter("id <> least").select("id", F.col("least").alias("other"), (~F.col("block").startswith("e:")).alias("decides"))
    stars = held(stars, "coalesce-stars")
    # the fold decides by URLs and platform ids; an edition in common only links
    pairs, abstains = _fuzzy_pairs(own, stars)
    pairs = held(pairs, "coalesce-fuzzy")
    # who may join another: has an exact key in common with an earlier one, or a fuzzy match
    able = held(stars.select("id").union(pairs.filter("match").select("id")).distinct(), "coalesce-able")
    waits = pairs.join(able.select(F.col("id").alias("other"), F.lit(True).alias("open")), "other", "left")
    links = stars.select("id", "other").union(waits.filter(F.col("match") | F.col("open").isNotNull()).select("id", "other"))
    placed = held(components(links.select(F.col("id").alias("a"), F.col("other").alias("b"))), "coalesce-components")
    over = held(placed.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most).select("component"), "coalesce-large")
    inside = own.join(placed, "id")
    none = F.array().cast("array<struct<tier:int,other:string,match:boolean,score:double>>")
    own_pairs = pairs.groupBy("id").agg(F.collect_list(F.struct("tier", "other", "match", "score")).alias("pairs"))  # at most CANDIDATE_CAP a tier
    own_abstains = abstains.groupBy("id").agg(F.collect_set("tier").alias("abstains"))
    work = (
        inside.join(over, "component", "left_anti")
        .join(own_pairs, "id", "left")
        .join(own_abstains, "id", "left")
        .select("component", "id", "urls", "source_ids", "years", "numbers", "conflicted", F.unix_date("day").alias("ordinal"), F.coalesce("pairs", none).alias("pairs"), F.coalesce("abstains", F.array().cast("array<int>")).alias("abstains"))
    )
    folded = work.repartition(n, "component").sortWithinPartitions("component", "id").mapInArrow(_folded, FOLDED)
    whole = lambda df, outcome, why: df.select("id", F.col("id").alias("head"), F.lit(outcome).alias("outcome"), F.lit(why).alias("reason"))
    large = whole(placed.join(over, "component", "left_semi"), "REVIEW", "component_limit_exceeded")
    alone = whole(own.join(placed, "id", "left_anti"), "DISTINCT", "no_match")
    return folded.unionByName(large).unionByName(alone)


def coalesced(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The heads of rows (id, provenance array<struct<platform,url,external_id,...>>, any others), each with
    aliases (ids shown under it, sorted, its own left out) and the union of provenance by platform, url and
    external id, in the order of ids. found: what groups gives."""
    found = held(found, "coalesce-found")  # else it is folded anew for aliases, records and heads
    keyed = rows.withColumn("id", F.col("id").cast("string"))
    named = [c for c in keyed.columns if c != "id"]
    keyed = keyed.groupBy("id").agg(F.min(F.struct(*named)).alias("x")).select("id", "x.*")
    joining = found.filter("id <> head")
    records = keyed.select("id", F.posexplode("provenance").alias("at", "record")).join(found.select("id", "head"), "id")
    key = F.struct(*[F.col("record")[c].alias(c) for c in ("platform", "url", "external_id")])
    place = F.struct((F.col("id") != F.col("head")).alias("late"), "id", "at")
    first = records.groupBy("head", key.alias("key")).agg(F.min(F.struct(place.alias("place"), "record")).alias("x"))
    united = first.groupBy("head").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.col("head").alias("id"), F.transform("xs", lambda x: x["record"]).alias("united"))
    aliases = joining.groupBy(F.col("head").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("aliases"))
    heads = keyed.join(found.filter("id = head").select("id"), "id", "left_semi")
    return heads.join(aliases, "id", "left").join(united, "id", "left").select(
        *[c for c in rows.columns if c != "provenance"],
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("united", "provenance").alias("provenance"),
    )
