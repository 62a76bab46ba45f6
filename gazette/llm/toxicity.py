"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

Fit (a bounded, stated sample of labelled rows; everything else covers all documents): of each
label up to EXAMPLES rows and EXAMPLE_CHARS characters are drawn by the hash of their id; rows of
one text and label are one example. Features are all words of a text and the beginnings of 4, 5 and
6 letters of longer words; the space is that of all features of all examples, none is left out.
Document frequencies of these features are counted over the whole corpus.

Weight: (1 + log tf) * idf * lean. The lean of a feature is how far its rate of label 1 among
examples lies from theirs as a whole, damped by its standard error, and FLOOR at least: a metric
learnt from the sample, in which every word keeps a part. Plain TF-IDF (FLOOR = 1) finds the same
topic rather than the same tone; README has the figures of both.

Index: examples are sorted by their heaviest common feature and cut into blocks of BLOCK. Inverted
lists hold the features of examples; lists with COMMON of all examples or more are kept dense by
block, with each block's largest weight. A query's bound for a block is its sum over the short
lists, which is exact, and its weights times the block's maxima. Blocks with the highest bounds are
scored first; then only those whose bound reaches the NEIGHBOURS-th best cosine so far, so the
neighbours are exact. Queries go through the index a chunk at a time.

Score: cosine-weighted votes of the neighbours, calibrated by monotone regression on the votes of
the examples, from which an example's own text and near copies (cosine COPY or more) are left out,
weighted to the label shares of the labelled rows. Evidence is the ids of the nearest examples.

Cases: null, empty and wordless texts, and texts that share no feature with any example, get the
smoothed rate of such examples; very long texts are read whole, and as examples only while they fit
into EXAMPLE_CHARS; a null label or a null doc_id in labels is not used; without any usable label of
either kind the score is 0 for all; ties among neighbours go to the lower example number; repeated
documents are scored each; labels repeated for one doc_id with different values count once, with the
larger value; a doc_id with different texts is an example by each; an empty table of documents gives
an empty result; only the named columns are read, so extra columns may have any name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import CHUNK_ROWS, lists, mapped, materialize

EXAMPLES = 2000
EXAMPLE_CHARS = 16_000_000
NEIGHBOURS = 15
BLOCK = 64
#: Blocks of a query that are scored before the rest is ruled out.
FIRST = 4
#: A list of this share of the examples or more is kept dense.
COMMON = 0.0625
#: Least lean of a feature; standard errors from which a lean counts, and over which it rises to 1.
FLOOR, LEAN_FROM, LEAN_OVER = 0.1, 2.0, 4.0
COPY = 0.9
#: Queries that go through the index together.
TOGETHER = 128
#: Pieces of text that a worker knows; emptied at this size.
PIECES = 200_000
WORD = re.compile(r"[^\W_]+")
#: Marks at the ends of a piece that are no part of a word.
OUTER = ".,;:!?\"'()[]{}#$%&*|_"
#: Letters of a longer word that make a feature of its own, in rising order.
BEGINNINGS = (4, 5, 6)


Sparse = tuple[np.ndarray, np.ndarray]


def features(word: str) -> list[str]:
    return [word, *[word[:k] + "~" for k in BEGINNINGS if len(word) > k]]


class Vectors:
    """Turns texts into (feature numbers, term frequencies) over a list of features."""

    def __init__(self, names: list[str]) -> None:
        self.n = len(names)
        self.words: dict[str, int] = {}
        self.starts: dict[int, dict[str, int]] = {k: {} for k in BEGINNINGS}
        for i, f in enumerate(names):
            if f.endswith("~"):
                self.starts[len(f) - 1][f[:-1]] = i
            else:
                self.words[f] = i
        # pieces between white space met so far, and the features of each: flat[ends[k - 1] : ends[k]]
        self.pieces: dict[str, int] = {}
        self.size = self.flat = np.empty(0, np.int64)

    def _read(self, pieces: list[str]) -> None:
        words = [p.lower().strip(OUTER) for p in pieces]
        one = np.fromiter(map(str.isalnum, words), bool, len(words))  # isalnum: one word
        owner = np.arange(len(words))
        if not one.all():
            parts = [WORD.findall(words[k]) for k in np.flatnonzero(~one)]
            owner = np.concatenate([owner[one], np.repeat(owner[~one], [len(x) for x in parts])])
            words = [*compress(words, one), *chain.from_iterable(parts)]
            order = np.argsort(owner, kind="stable")
            owner, words = owner[order], [words[k] for k in order]
        length = np.fromiter(map(len, words), np.int64, len(words))
        found = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int64)
        found[:, 0] = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        for c, k in enumerate(BEGINNINGS, 1):
            start = np.fromiter(map(self.starts[k].get, [w[:k] for w in words], repeat(-1)), np.int64, len(words))
            found[:, c] = np.where(length > k, start, -1)
        self.pieces.update(zip(pieces, range(len(self.pieces), len(self.pieces) + len(pieces)), strict=True))
        self.flat = np.concatenate([self.flat, found[found >= 0]])
        self.size = np.concatenate([self.size, np.bincount(owner, weights=(found >= 0).sum(axis=1), minlength=len(pieces)).astype(np.int64)])

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, how often) of the texts, in that order."""
        if len(self.pieces) > PIECES:
            self.pieces.clear()
            self.size = self.flat = np.empty(0, np.int64)
        split = [t.split() if t else [] for t in texts]
        self._read([p for p in set(chain.from_iterable(split)) if p not in self.pieces])
        number = self.pieces.__getitem__
        n = [len(x) for x in split]
        row, piece, times = _summed(np.repeat(np.arange(len(n)), n), np.fromiter(map(number, chain.from_iterable(split)), np.int64, sum(n)), len(self.size))
        n = self.size[piece]
        return _summed(np.repeat(row, n), self.flat[_runs(np.cumsum(self.size)[piece] - n, n)], self.n, np.repeat(times, n))


#: Steps from one feature number to the next, and how often each is in the text: small numbers.
VECTORS = "step array<int>, tf array<int>"


def _vectors(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with the vectors of their texts in place of text."""
    kept = [c for c in docs.columns if c != "text"]
    held: list[Vectors] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Vectors(names))
        row, f, tf = held[0].of(b.column("text").to_pylist())
        ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
        step = np.diff(f, prepend=0)
        first = ends[:-1][ends[:-1] < ends[1:]]
        step[first] = f[first]
        found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (step, tf)]
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *found], names=[*kept, "step", "tf"])

    return mapped(docs, run, ", ".join([*[f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept], VECTORS]))


def _sparse(b: pa.RecordBatch) -> list[Sparse]:
    """The vectors of a batch."""
    times, step = b.column("tf").flatten().to_numpy().astype(float), b.column("step").flatten().to_numpy()
    ends = b.column("step").offsets.to_numpy()
    ends = ends - ends[0]
    return [(np.cumsum(step[i:j], dtype=np.int64), times[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n places, one run after the other."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _summed(row: np.ndarray, column: np.ndarray, columns: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of one place added up, in the order of row and column, by one sort of packed numbers."""
    columns = max(1, columns)
    key = row * columns + column
    if not len(key):
        return key, key, key
    if times is None:
        key = np.sort(key)
    else:
        bits = int(times.max()).bit_length()
        key = np.sort(key << bits | times)
        times, key = key & ((1 << bits) - 1), key >> bits
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.diff(np.append(first, len(key))) if times is None else np.add.reduceat(times, first)
    row = key[first] // columns
    return row, key[first] - row * columns, total


@dataclass
class Index:
    """Examples as unit vectors in block-max inverted lists. Features are numbered from 0."""

    weight: np.ndarray  # idf * lean of each feature of the examples
    n: int  # examples, in blocks of BLOCK
    ends: np.ndarray  # lists of features: examples[ends[f] : ends[f + 1]] ascending
    examples: np.ndarray
    weights: np.ndarray
    label: np.ndarray
    vote_weight: np.ndarray
    ids: np.ndarray
    bare_rate: float
    steps: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # calibration: votes, ascending
    rates: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def unpacked(self) -> tuple[np.ndarray, ...]:
        """place of a feature among the common ones (-1: none), common lists as example x feature,
        and the largest weight of each block of them."""
        size = np.diff(self.ends)
        common = np.flatnonzero(size >= max(2.0, COMMON * self.n))
        place = np.full(len(self.weight), -1, np.int64)
        place[common] = np.arange(len(common))
        blocks = -(-self.n // BLOCK)
        dense = np.zeros((blocks * BLOCK, len(common)), np.float32)
        for k, f in enumerate(common):
            dense[self.examples[self.ends[f] : self.ends[f + 1]], k] = self.weights[self.ends[f] : self.ends[f + 1]]
        return place, dense, dense.reshape(blocks, BLOCK, len(common)).max(axis=1)

    def unit(self, row: Sparse) -> Sparse:
        ids, tf = row
        w = (1.0 + np.log(tf)) * self.weight[ids]
        size = np.sqrt((w * w).sum())
        return ids, w / size if size > 0 else w

    def nearest(self, rows: list[Sparse], most: float = np.inf) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector the NEIGHBOURS examples with the highest cosine under most, best first,
        and their cosines (only those over 0)."""
        if not rows or not self.n:
            return [(np.empty(0, np.int64), np.empty(0))] * len(rows)
        if len(rows) > TOGETHER:
            return [x for at in range(0, len(rows), TOGETHER) for x in self.nearest(rows[at : at + TOGETHER], most)]
        place, dense, tops = _unpacked(self)
        blocks = len(tops)
        cos = np.zeros((len(rows), blocks * BLOCK), np.float32)
        query = np.zeros((len(rows), dense.shape[1]), np.float32)
        for k, (ids, w) in enumerate(rows):
            at = place[ids]
            query[k, at[at >= 0]] = w[at >= 0]
            rare, own = ids[at < 0], w[at < 0]
            size = self.ends[rare + 1] - self.ends[rare]
            got = _runs(self.ends[rare], size)
            cos[k] = np.bincount(self.examples[got], weights=self.weights[got] * np.repeat(own, size), minlength=blocks * BLOCK)
        bound = query @ tops.T + cos.reshape(len(rows), blocks, BLOCK).max(axis=2)
        scored = np.zeros((len(rows), blocks), bool)

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                who, at = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                found = cos[who, at] + query[who] @ dense[at].T
                cos[who, at] = np.where(found >= most, 0.0, found)
            scored[wanted] = True

        first = np.zeros_like(scored)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        score(first)
        least = min(NEIGHBOURS, cos.shape[1])
        seen = np.where(np.repeat(scored, BLOCK, axis=1), cos, 0.0)
        level = -np.partition(-seen, least - 1, axis=1)[:, least - 1]
        score(~scored & (bound >= level[:, None] - 1e-5))
        cos[~np.repeat(scored, BLOCK, axis=1)] = 0.0
        level = -np.partition(-cos, least - 1, axis=1)[:, least - 1]
        out = []
        for row, low in zip(cos, level, strict=True):
            near = np.flatnonzero((row >= low) & (row > 1e-6))
            near = near[np.argsort(-row[near], kind="stable")][:NEIGHBOURS]
            out.append((near, row[near].astype(np.float64)))
        return out

    def vote(self, found: np.ndarray, cos: np.ndarray) -> float:
        w = cos * self.vote_weight[found]
        return float((w * self.label[found]).sum() / w.sum())

    def score(self, rows: list[Sparse]) -> list[tuple[float, np.ndarray]]:
        out = []
        for found, cos in self.nearest([self.unit(r) for r in rows]):
            rate = float(np.interp(self.vote(found, cos), self.steps, self.rates)) if len(found) else self.bare_rate
            out.append((rate, self.ids[found[:3]]))
        return out


# of the index in use: its key, and what unpacked() gave
_held: dict[str, tuple[np.ndarray, ...]] = {}


def _unpacked(index: Index) -> tuple[np.ndarray, ...]:
    if index.key not in _held:
        _held.clear()
        _held[index.key] = index.unpacked()
    return _held[index.key]


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x; each step is drawn half an example towards 0.5."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []  # weighted sum, weight, sum of x times weight
    for i in order:
        pools.append([y[i] * w[i], w[i], x[i] * w[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    small = 0.5 * float(np.min(w))
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + small * 0.5) / (p[1] + small) for p in pools])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _drawn(docs: DataFrame, usable: DataFrame, examples: int, chars: int) -> tuple[DataFrame, dict[bool, int]]:
    """Examples as doc_id, copy (digest of the text), toxic; and how many texts each label has."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.length("text").alias("chars"))
    texts = narrow.join(usable, "doc_id").groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id"), F.max(F.coalesce("chars", F.lit(0))).alias("chars"))
    texts = materialize(texts, "texts")
    shares = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    some = [texts.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "copy").limit(examples) for label in (True, False)]
    so_far = F.sum("chars").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "copy"))  # over at most 2 * examples rows
    some = some[0].union(some[1]).withColumn("so_far", so_far).filter(F.col("so_far") <= chars)
    return materialize(some.select("doc_id", "copy", "toxic"), "drawn"), shares


def _lean(number: np.ndarray, toxic: np.ndarray, n_features: int, n_toxic: int, n: int) -> np.ndarray:
    """FLOOR to 1 by feature, from one entry of number for each feature of each example."""
    count = np.bincount(number, minlength=n_features)
    among = np.bincount(number, weights=toxic, minlength=n_features)
    rate = n_toxic / n
    z = np.abs(among - count * rate) / np.sqrt(count * (rate * (1 - rate)))
    return np.maximum(FLOOR, np.clip((z - LEAN_FROM) / LEAN_OVER, 0, 1) * np.abs(among / count - rate))


def _frequencies(vectors: DataFrame, n_features: int) -> tuple[np.ndarray, int]:
    """In how many documents each of the features is, and how many documents there are. Each task
    adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(n_features, np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, CHUNK_ROWS):
                rows = _sparse(b.slice(at, CHUNK_ROWS))
                count += np.bincount(np.concatenate([f for f, _ in rows]), minlength=n_features)
                n += len(rows)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"f": pa.array([-1, *some.tolist()], pa.int64()), "n": pa.array([n, *count[some].tolist()], pa.int64())})

    got = vectors.select("step", "tf").mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = got.column("f").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(n_features, np.int64)
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> tuple[Index, DataFrame] | None:
    """docs: doc_id, text; labels: doc_id, toxic, of which held-out rows are not used. Gives the
    index, and the vectors of all docs by doc_id, whose texts are read once for both uses."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    drawn, shares = _drawn(docs, usable, examples, chars)
    sample = docs.withColumn("copy", F.xxhash64("text")).join(F.broadcast(drawn), ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy", "toxic"])  # at most 2 * examples rows

    sample = materialize(sample.select("doc_id", "toxic", "text"), "sample")

    def occurring(b: pa.RecordBatch) -> pa.RecordBatch:
        words = {w for t in b.column("text").to_pylist() if t for w in WORD.findall(t.lower())}
        return pa.RecordBatch.from_pydict({"f": pa.array(sorted({f for w in words for f in features(w)}), pa.string())})

    names = sorted(r["f"] for r in mapped(sample.select("text"), occurring, "f string").distinct().toLocalIterator())  # bounded by examples and chars

    rows = materialize(_vectors(sample, names), "examples")
    got = rows.orderBy("doc_id", "toxic", F.xxhash64("step", "tf")).toArrow().combine_chunks()  # so is this
    if len(set(got.column("toxic").to_pylist())) < 2:
        return None
    toxic, doc_ids = got.column("toxic").to_numpy(zero_copy_only=False).astype(float), got.column("doc_id").to_numpy()
    vectors = materialize(_vectors(docs, names), "vectors", "zstd")
    given = [v for b in got.to_batches() for v in _sparse(b)]
    size, n_features = np.array([len(f) for f, _ in given]), len(names)
    number, tf = np.concatenate([f for f, _ in given]).astype(np.int32), np.concatenate([t for _, t in given]).astype(np.float32)
    del got, given
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    in_docs, n_docs = _frequencies(vectors, n_features)
    weight = np.log((2.0 + n_docs) / (1.0 + in_docs)) * _lean(number, toxic[owner], n_features, int(toxic.sum()), len(toxic))
    w = (1.0 + np.log(tf)) * weight.astype(np.float32)[number]
    norm = np.sqrt(np.bincount(owner, weights=w * w, minlength=len(size)))
    w /= np.where(norm > 0, norm, 1.0).astype(np.float32)[owner]

    share = {k: shares[k] / max(1.0, (toxic > 0).sum() if k else (toxic == 0).sum()) for k in (True, False)}
    vote_weight = np.where(toxic > 0, share[True], share[False])
    rate = float((vote_weight * toxic).sum() / vote_weight.sum())
    bare = size == 0
    bare_rate = float(((vote_weight * toxic)[bare].sum() + rate) / (vote_weight[bare].sum() + 1.0))

    # examples in the order of their heaviest common feature, bare ones left out
    count = np.bincount(number, minlength=n_features)
    common = np.flatnonzero(count[number] >= COMMON * len(size))
    common = common[np.argsort(w[common], kind="stable")]
    heaviest = np.zeros(len(size), np.int64)
    heaviest[owner[common]] = number[common] + 1  # the last one written, the heaviest, stays
    kept = np.flatnonzero(~bare)
    order = kept[np.argsort(heaviest[kept], kind="stable")]
    new = np.full(len(size), -1, np.int32)
    new[order] = np.arange(len(order), dtype=np.int32)
    by_list = np.argsort(number.astype(np.int64) * len(size) + new[owner], kind="stable")
    ends = np.concatenate([[0], np.cumsum(count)])
    index = Index(weight, len(order), ends, new[owner[by_list]], w[by_list], toxic[order], vote_weight[order], doc_ids[order], bare_rate)

    del number, tf, owner, w, by_list, common

    def own_votes(b: pa.RecordBatch) -> pa.RecordBatch:
        own = index.nearest([index.unit(r) for r in _sparse(b)], COPY)
        votes = [(index.vote(*x), t) for x, t in zip(own, b.column("toxic").to_pylist(), strict=True) if len(x[0])]
        return pa.RecordBatch.from_pydict({"vote": pa.array([v for v, _ in votes], pa.float64()), "toxic": pa.array([t for _, t in votes], pa.bool_())})

    votes = mapped(rows, own_votes, "vote double, toxic boolean").toArrow()
    if len(votes):
        x, y = votes.column("vote").to_numpy(), votes.column("toxic").to_numpy(zero_copy_only=False).astype(float)
        index.steps, index.rates = _monotone(x, y, np.where(y > 0, share[True], share[False]))
    return index, vectors


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples), a row a document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    fitted = fit(rows, labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("bigint").alias("toxic")), examples)
    if fitted is None:
        out = rows.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<bigint>").alias("evidence"))
    else:
        index, vectors = fitted

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            got = index.score(_sparse(b))
            return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array([min(1.0, max(0.0, s)) for s, _ in got], pa.float64()), "evidence": lists([e for _, e in got], pa.int64())})

        out = mapped(vectors, run, "doc_id bigint, score double, evidence array<bigint>")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
