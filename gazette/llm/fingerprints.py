"""Document fingerprints: a Merkle tree over paragraphs and sections (native).

A text is cut, without loss, into pieces (up to a mark of punctuation or a line's end), its lines are
the paragraphs, and runs of paragraphs are the sections. A section ends where the text itself says so:
after a paragraph whose digest begins with one of SECTION_ENDS (one in eight), or that is blank; an
inserted paragraph therefore changes the section it stands in and no other. A piece's digest is its
SHA-256, a paragraph's that of its text, a section's that of its paragraphs' digests, the root's that of
its sections' digests. The fingerprint writes the tree: the root in full, then every section, its
paragraphs and their pieces with the first digits of their digests. Roots test equality; sections that
differ lead to the paragraphs that differ (`changed_paragraphs`), and the share of nodes that two trees have
in common is their likeness, from the fingerprints alone.

Cases: a null text counts as empty; an empty text has one section with one empty paragraph; equal
texts have equal fingerprints, whatever their ids; a text of one very long line is one paragraph of many
pieces; repeated rows give repeated rows; an empty table gives an empty result. Only id and text
are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import bind, text_of

#: A piece ends with punctuation or the line, at most 64 characters on; both are read by SQL's expressions too.
PIECE = r"[^.,;:!?\n]{0,63}[.,;:!?\n]+ *|[^.,;:!?\n]{1,64}"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
SECTION_ENDS = "[01]"
#: Hexadecimal digits of a node's digest in the fingerprint, and what stands before a node.
NODE, LEAF = 16, 8
#: Ranges of ids for each shuffle partition, so that partitions come out alike.
RANGES = 8
SECTION_MARK, PARAGRAPH_MARK, PIECE_MARK = "/", ":", "."


def _sha(value: Column) -> Column:
    return F.sha2(value, 256)


def _paragraphs(text: Column) -> Column:
    """Of each line: its digest, whether a section ends with it, and its part of the fingerprint."""

    def one(line: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: F.substring(_sha(p), 1, LEAF))
        return bind(_sha(line), lambda d: F.struct(d.alias("digest"), (d.rlike(f"^{SECTION_ENDS}") | (line == "\n")).alias("ends"), F.concat(F.lit(PARAGRAPH_MARK), F.substring(d, 1, NODE), F.lit(PIECE_MARK), F.array_join(pieces, PIECE_MARK)).alias("node")))

    lines = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)))
    return F.transform(lines, one)


def _sections(paragraphs: Column) -> Column:
    """Of each section: its digest and its part of the fingerprint."""
    n = F.size(paragraphs)
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (k == n) | F.get(paragraphs, k - 1)["ends"])

    def one(own: Column) -> Column:
        digest = _sha(F.array_join(F.transform(own, lambda p: p["digest"]), ""))
        return F.struct(digest.alias("digest"), F.concat(F.lit(SECTION_MARK), F.substring(digest, 1, NODE), F.array_join(F.transform(own, lambda p: p["node"]), "")).alias("node"))

    def cut(at: Column) -> Column:
        before = lambda k: F.coalesce(F.get(at, k - 1), F.lit(0))
        return F.transform(at, lambda end, k: bind(F.slice(paragraphs, before(k) + 1, end - before(k)), one))

    return bind(ends, cut)


def fingerprint(text: Column) -> Column:
    """root, then /section, :paragraph and .piece digests in the order of the text."""
    whole = lambda s: F.concat(_sha(F.array_join(F.transform(s, lambda x: x["digest"]), "")), F.array_join(F.transform(s, lambda x: x["node"]), ""))
    return bind(F.coalesce(text, F.lit("")), lambda t: bind(_paragraphs(t), lambda p: bind(_sections(p), whole)))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def _nodes(print_: Column) -> Column:
    return F.array_distinct(F.split(print_, "[/:.]"))


def likeness(a: Column, b: Column) -> Column:
    """Twice the nodes in common, over the nodes of both: 1 if and only if the roots are equal."""
    dice = bind(F.struct(_nodes(a).alias("a"), _nodes(b).alias("b")), lambda x: F.lit(2.0) * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"])))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(root(a) == root(b), F.lit(1.0)).otherwise(dice))


def _differing(a: Column, b: Column) -> Column:
    """Digests of the paragraphs in those sections of a that b does not hold."""
    sections = lambda x: F.filter(F.split(x, SECTION_MARK), lambda s, k: k > 0)
    return F.flatten(F.transform(F.array_except(sections(a), sections(b)), _inner))


def _inner(section: Column) -> Column:
    return F.transform(F.filter(F.split(section, PARAGRAPH_MARK), lambda p, k: k > 0), lambda p: F.substring(p, 1, NODE))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Digests, each once and in order, of the paragraphs by which a differs from b: those of a's differing
    sections that b's differing sections do not hold. Sections that both have are not entered."""
    return F.when(root(a) == root(b), F.array().cast("array<string>")).otherwise(F.array_except(_differing(a, b), _differing(b, a)))


def place(print_: Column, digest: Column) -> Column:
    """Number (from 0) of the first paragraph with a digest; null if there is none."""
    at = F.array_position(_inner(F.regexp_replace(print_, SECTION_MARK + "[0-9a-f]*", "")), digest)
    return F.when(at > 0, at - 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, text and fingerprint, one row a document."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n_chars"), text.alias("text"), fingerprint(text).alias("fingerprint"))


def _longs(values: list[int | None]) -> Column:
    """A constant array, however long, as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def with_next(rows: DataFrame, carried: list[str], order: str = "doc_id") -> DataFrame:
    """rows with the struct `next` of the carried columns of the row that follows by descending order
    (ties by the carried columns), the first row's after the last; null where order is null.

    Rows are dealt once, by ranges of the order. The driver holds the bounds of the ranges, a multiple
    of the session's shuffle partitions. The first rows of a range also visit the range before, as
    the followers of its last row, so that no window spans more than a range."""
    spark = rows.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order)
    cuts = rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], F.lit(max(10_000, 10 * ranges)))).first()[0]
    bounds = sorted(set(cuts or ()))
    powers = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    higher = lambda at, w: (at + w <= len(bounds)) & (F.get(_longs(bounds), at + w - 1) <= key)
    # how many bounds are not above the key, by halving
    number = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda at, w: F.when(higher(at, w), at + w).otherwise(at)) if bounds else F.lit(0)
    placed = rows.filter(key.isNotNull()).withColumn("_own", number.cast("int"))
    tops = dict(placed.groupBy("_own").agg(F.max(order)).collect())
    full = sorted(tops)
    before = {own: full[(k + 1) % len(full)] for k, own in enumerate(full)}  # the range that is read just before, in descending order
    dense = lambda found: _longs([found.get(k) for k in range(len(bounds) + 1)])
    at = lambda own, guest: F.struct(own.cast("int").alias("own"), F.lit(guest).alias("guest"))
    both = F.when(key == F.get(dense(tops), F.col("_own")), F.array(at(F.col("_own"), False), at(F.get(dense(before), F.col("_own")), True))).otherwise(F.array(at(F.col("_own"), False)))
    dealt = placed.withColumn("_at", F.explode(both)).select(*rows.columns, F.col("_at.own").alias("_own"), F.col("_at.guest").alias("_guest"))
    follow = Window.partitionBy("_own").orderBy("_guest", F.desc(order), *carried)
    followed = dealt.withColumn("next", F.lead(F.struct(*carried)).over(follow)).filter("not _guest").select(*rows.columns, "next")
    lone = rows.filter(key.isNull()).withColumn("next", F.lit(None).cast(followed.schema["next"].dataType))
    return followed.unionByName(lone)


def half_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edit of it, the last half of its code points replaced by as many (or all) of
    the next document's, in descending order of ids: doc_id, n_chars, edited, the fingerprints of both,
    likenesses to the edit and to the next document, how many paragraphs the edit changed and the first
    of them. A row without an id has no next document: its edit is cut short and near_next is null."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n_chars"), text.alias("text"))
    found = with_next(rows, ["text"])  # texts alone are shuffled: fingerprints are worked out behind it
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.coalesce(F.substr(F.col("next.text"), F.lit(1), half), F.lit("")))
    rows = found.select("doc_id", "n_chars", edited.alias("edited"), fingerprint(F.col("text")).alias("fingerprint"), F.when(F.col("next").isNotNull(), fingerprint(F.col("next.text"))).alias("next_fingerprint"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    mine, other = F.col("fingerprint"), F.col("edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(mine, other).alias("near_edited"),
        likeness(mine, F.col("next_fingerprint")).alias("near_next"),
        bind(changed_paragraphs(mine, other), lambda c: F.struct(F.size(c).cast("bigint").alias("n"), place(mine, F.get(c, F.lit(0))).cast("bigint").alias("first"))).alias("_changed"),
    ).select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("_changed.n").alias("n_changed"), F.col("_changed.first").alias("first_changed"))
