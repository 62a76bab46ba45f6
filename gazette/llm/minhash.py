"""Near-duplicates by bottom-k sketches of one hash function.

1. A text's set of word shingles is hashed with one 64-bit function. Kept are the set's size, a
   128-bit digest of the whole set and its bottom-k sketch (the K smallest hashes).
2. Documents with the same digest have the same set: they form a class, and its smallest doc_id
   stands for it from here on. Copies are never expanded into pairs.
3. Inverted lists of retained values generate overlaps. Values held by one class only are dropped;
   of the rest each class enters the lists of its rarest values only. Two sketches with at least
   ``K - prefix + 1`` values in common must meet in one of those lists (prefix filter, see _prefix).
4. In a list, classes meet a pivot (the class with the fewest values of its own) and not each
   other. Components so far are found, and lists that are of one component are done. What is left
   in short lists is compared pair by pair across components; classes in long lists are listed
   again by the rarest fifth of their *full* sets, which is exact for the similarity asked for,
   meet pivots again, and then all that is left is compared, but for pairs that cannot reach the
   similarity by where they first meet. Nothing is capped, dropped or sampled.
5. A pair's similarity is estimated on the union sketch (the K smallest of both), and dropped when
   it lies 6 standard errors under the threshold; what passes is confirmed on the full sets.
6. Components are found by star contraction.

Bottom-k of size 64 misses a link of similarity exactly 0.8 with a probability of about 1e-7.

Cases: a null or empty text, or one of white space, has an empty set and is linked with nothing;
its component is itself. A text with fewer words than a shingle is one shingle. Repeated rows get
the same result each; rows of one doc_id with different texts are classes of their own, linked each
by its own set. A row with a null doc_id is linked with nothing, and has a null component and kept
false. ``survivors`` goes by rows: of the rows of a group one stays, also where a doc_id repeats. An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import bitmap, cleared, in_bitmap, lists, mapped, materialize, without
from gazette.llm.graph import components

K = 64
#: Values of a full sketch that a class is listed under: overlaps of K - PREFIX + 1 = 33 are found.
PREFIX = 32
#: A list with up to this many classes left is compared pair by pair at once.
SHORT = 16
#: Words hashed so far in this worker; emptied at this size.
WORD_CACHE = 200_000

_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles of size words, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, both
    if not words:
        return np.empty(0, np.int64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        x = _words.get(w)
        if x is None:
            x = _words[w] = xxhash.xxh3_64_intdigest(w)
        h[i] = x
    n = max(1, len(words) - size + 1)
    acc = np.full(n, np.uint64(min(size, len(words))), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique((acc >> np.uint64(1)).view(np.int64))


def _digest(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        u = x.view(np.uint64)
        return int(_mix(u + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), int(_mix(u ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64))


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and t (digest of the text) with the size, digest and sketch of the text's set."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, h1, h2, sketches = [], [], [], []
        for text in b.column("text").to_pylist():
            x = shingle_hashes(text, size)
            a, c = _digest(x) if len(x) else (0, 0)
            n.append(len(x))
            h1.append(a)
            h2.append(c)
            sketches.append(x[:K].copy())
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "t": b.column("t"), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "sketch": lists(sketches, pa.int64())})

    return mapped(docs.withColumn("t", F.xxhash64("text")), run, "doc_id bigint, t bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>")


def _full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(cls, members): the full sets of the texts that stand for nodes (cls, doc_id, t). A Bloom
    filter of the ids is applied where the texts are read, so no text is shuffled."""
    held = bitmap(nodes, "doc_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        b = b.filter(pa.compute.is_valid(b.column("doc_id")))
        b = b.filter(pa.array(in_bitmap(held, b.column("doc_id").to_numpy())))
        sets = [shingle_hashes(x, size) for x in b.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "t": b.column("t"), "members": lists(sets, pa.int64())})

    sets = mapped(docs.withColumn("t", F.xxhash64("text")), run, "doc_id bigint, t bigint, members array<bigint>")
    return sets.join(nodes, ["doc_id", "t"]).dropDuplicates(["cls"]).select("cls", "members")


def _prefix(n: Column, percent: int) -> Column:
    """How many of its rarest retained values a class of n shingles is listed under.

    A link leaves at most (100 - percent) % of a set outside the other. Where the sketch is the
    whole set that bound holds in it; the other set may be up to 100 / percent larger, and what it
    has beyond K may be missing from its sketch. PREFIX is what bottom-k sampling needs.
    """
    missing = F.floor(n * (100 - percent) / 100) + 1 + F.greatest(F.lit(0), F.floor(n * 100 / percent) - K)
    return F.least(F.lit(PREFIX), missing)


def _rare_lists(values: DataFrame, held: Column, prefix: Column) -> DataFrame:
    """values: cls, n, v; held: how many a class has. Gives the lists as rows v, cls, n, alone
    (how many of the class's values no other class has) and at (the rank of v among its values)."""
    shared = materialize(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    met = values.join(shared, "v").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("x"))
    alone = (held - F.size("x")).cast("bigint")
    # values of one class alone come first in the order and take their part of the prefix
    room = (prefix - alone).cast("int")
    listed = met.filter(room > 0).select("cls", "n", alone.alias("alone"), F.posexplode(F.slice("x", F.lit(1), room)).alias("k", "x"))
    return listed.select(F.col("x.v").alias("v"), "cls", "n", "alone", (F.col("alone") + F.col("k") + 1).alias("at"))


def _labelled(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """lists with the component of each class so far."""
    if comp is None:
        return lists.withColumn("comp", F.col("cls"))
    return lists.join(comp, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component")


def _open_lists(lists: DataFrame) -> DataFrame:
    """Only lists with two components or more, with the number of their classes."""
    open_ = lists.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("v", "size")
    return lists.join(materialize(open_, "open"), "v")


def _fits(whole: bool, percent: int) -> Column:
    """Whether the sizes n and pn allow a link. With whole sets listed, also whether v can be the
    first value in common: then no more than v and what follows it in either set is shared. A link
    passes in the list of its first common value, so none is lost."""
    fits = (F.col("n") * 100 >= F.col("pn") * percent) & (F.col("pn") * 100 >= F.col("n") * percent)
    needed = F.col("n") + F.col("pn")
    return fits & (F.least(F.col("n") - F.col("at") + 1, F.col("pn") - F.col("pat") + 1) * (100 + percent) >= needed * percent) if whole else fits


def _pivot_pairs(lists: DataFrame, whole: bool, percent: int) -> DataFrame:
    """Each class with the first class of each of its lists, where they are not yet of one
    component. First is the class with the fewest values of its own: the least changed copy."""
    first = F.struct("alone", F.xxhash64("cls").alias("h"), "cls", "n", "comp", "at")
    pivots = lists.groupBy("v").agg(F.min(first).alias("x"))
    pivots = materialize(pivots.select("v", F.col("x.cls").alias("p"), F.col("x.n").alias("pn"), F.col("x.comp").alias("pc"), F.col("x.at").alias("pat")), "pivots")
    met = lists.join(pivots, "v").filter((F.col("comp") != F.col("pc")) & _fits(whole, percent))
    return met.select(F.greatest("cls", "p").alias("a"), F.least("cls", "p").alias("b")).distinct()


def _all_pairs(lists: DataFrame, whole: bool, percent: int) -> DataFrame:
    """Every pair of a list whose classes are of two components: the exact rest."""
    left = materialize(lists.select("v", "cls", "n", "comp", "at"), "rest")
    right = left.select(F.col("v").alias("w"), F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"), F.col("at").alias("pat"))
    met = left.join(right, (F.col("v") == F.col("w")) & (F.col("cls") > F.col("p")) & (F.col("comp") != F.col("pc")) & _fits(whole, percent))
    return met.select(F.col("cls").alias("a"), F.col("p").alias("b")).distinct()


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that are links: estimated on union sketches, then confirmed on full sets."""
    sketch = lambda c: reps.select(F.col("cls").alias(c), F.col("sketch").alias(f"s{c}"))
    least = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    t = percent / 100
    slack = 6 * (t * (1 - t)) ** 0.5
    near = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) / F.size("u") >= F.lit(t) - F.lit(slack) / F.sqrt(F.size("u"))
    likely = pairs.join(sketch("a"), "a").join(sketch("b"), "b").withColumn("u", least).filter(near).select("a", "b")
    likely = materialize(likely, "likely")
    nodes = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct()
    sets = materialize(_full_sets(docs, materialize(nodes.join(reps.select("cls", "doc_id", "t"), "cls"), "nodes"), size), "sets")
    full = lambda c: sets.select(F.col("cls").alias(c), F.col("members").alias(f"m{c}"))
    both = F.size(F.array_intersect("ma", "mb"))
    linked = both * 100 >= (F.size("ma") + F.size("mb") - both) * percent
    return likely.join(full("a"), "a").join(full("b"), "b").filter(linked).select("a", "b").distinct()


def _grouped(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """rows: doc_id, text. Gives doc_id, t, n, grp (the same for rows that links connect; null without
    a set or a doc_id) and component (the smallest doc_id of the group)."""
    drawn = materialize(_sketched(rows, size), "sketches")
    some = drawn.filter("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "t")).alias("first")
    classes = some.groupBy("h1", "h2", "n").agg(first, F.count(F.lit(1)).alias("copies")).select("h1", "h2", "n", "copies", "first.*")
    classes = materialize(classes.withColumn("cls", F.col("doc_id")), "classes")
    # where texts of one doc_id differ, classes after the first get a number of their own
    again = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("h1", "h2", "n")).alias("own")).filter("k > 1")
    again = materialize(again.select("doc_id", "own"), "again")
    several = not again.isEmpty()
    if several:
        number = F.shiftrightunsigned(F.xxhash64("doc_id", "h1", "h2", "n"), 2) + F.lit(1 << 62)
        other = F.col("own").isNotNull() & (F.struct("h1", "h2", "n") != F.col("own"))
        classes = materialize(classes.join(again, "doc_id", "left").withColumn("cls", F.when(other, number).otherwise(F.col("doc_id"))).drop("own"), "classes")
    reps = some.select("doc_id", "t", "sketch").join(classes, ["doc_id", "t"]).select("cls", "doc_id", "t", "n", "sketch")
    reps = materialize(reps.dropDuplicates(["cls"]), "reps")

    def relisted(listed: DataFrame, comp: DataFrame | None) -> DataFrame:
        return materialize(_open_lists(_labelled(listed.select("v", "cls", "n", "alone", "at"), comp)), "open")

    def joined(comp: DataFrame | None, pairs: DataFrame) -> DataFrame:
        links = _confirmed(pairs, reps, rows, size, percent)
        if comp is not None:
            links = links.union(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return materialize(components(links).filter("node <> component"), "comp")

    values = reps.select("cls", "n", F.explode("sketch").alias("v"))
    n = F.col("n")
    listed = materialize(_rare_lists(values, F.least(n, F.lit(K)), _prefix(n, percent)), "lists")
    rest = relisted(listed, None)
    comp = joined(None, _pivot_pairs(rest, False, percent))

    rest = relisted(rest, comp)
    pairs = _all_pairs(rest.filter(F.col("size") <= SHORT), False, percent)
    crowded = rest.filter(F.col("size") > SHORT).select("cls").distinct()
    crowded = materialize(crowded.join(reps.select("cls", "doc_id", "t"), "cls"), "crowded")
    sets = _full_sets(rows, crowded, size)
    values = materialize(sets.select("cls", F.size("members").cast("bigint").alias("n"), F.explode("members").alias("v")), "values")
    exact = materialize(_rare_lists(values, n, F.floor(n * (100 - percent) / 100) + 1), "exact")
    rest = relisted(exact, comp)
    comp = joined(comp, pairs.union(_pivot_pairs(rest, True, percent)).distinct())

    rest = relisted(rest, comp)
    comp = joined(comp, _all_pairs(rest, True, percent))

    comp = materialize(comp.withColumnRenamed("component", "grp"), "groups")
    if several:
        met = comp.select("node", "grp").union(comp.select(F.col("grp").alias("node"), "grp")).distinct()
        least = met.join(reps.select("cls", "doc_id"), F.col("node") == F.col("cls")).groupBy("grp").agg(F.min("doc_id").alias("component"))
        comp = comp.join(least, "grp")
    else:
        comp = comp.withColumn("component", F.col("grp"))
    named = materialize(classes.filter("copies > 1 or cls <> doc_id").select("h1", "h2", "n", "cls", F.col("doc_id").alias("least")), "named")
    own = drawn.select("doc_id", "t", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    own = own.withColumn("cls", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("cls", "doc_id")))
    heads = comp.select("grp", F.col("component").alias("head")).distinct()
    out = own.join(comp, F.col("cls") == F.col("node"), "left").withColumn("grp", F.coalesce("grp", "cls"))
    if several:  # the class that names a group has no row in comp
        out = out.join(heads, "grp", "left")
    else:
        out = out.withColumn("head", F.lit(None).cast("bigint"))
    return out.select("doc_id", "t", "n", "grp", F.coalesce("component", "head", "least", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id that can be reached
    by links of at least percent % Jaccard similarity on shingles of size words) and kept."""
    found = _grouped(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), size, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def survivors(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text and more) without all rows but one of each group of near-duplicates: the
    row with the smallest doc_id stays, whatever its other rows. Rows without words or id all stay."""
    found = _grouped(docs.select("doc_id", "text"), size, percent).filter("grp is not null")
    texts = materialize(found.groupBy("grp", "doc_id", "t").agg(F.count(F.lit(1)).alias("rows")), "group_rows")
    groups = texts.groupBy("grp").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("grp", "first")
    groups = materialize(groups, "firsts")  # so that the join deals texts anew, and a crowded group can be split
    placed = texts.join(groups, "grp", "left")
    stays = F.col("first").isNull() | (F.struct("doc_id", "t") == F.col("first"))
    gone = materialize(placed.filter(~stays).select("doc_id", "t").distinct(), "gone")
    repeated = materialize(placed.filter(stays & (F.col("rows") > 1)).select("doc_id", "t"), "repeated")
    # whole rows go into one column, so that no name of theirs clashes
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), F.struct(*docs.columns).alias("whole_row"))
    left = without(keyed, gone, ["doc_id", "t"])
    if not repeated.isEmpty():
        single, open_ = cleared(left, repeated, ["doc_id", "t"])
        once = open_.join(repeated, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
        left = single.unionByName(open_.join(repeated, ["doc_id", "t"], "left_anti")).unionByName(once)
    return left.select("whole_row.*")
