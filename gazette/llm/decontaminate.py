"""Benchmark decontamination by template canonicalisation.

Every word is brought to a literal form (lower case, outer punctuation dropped) and a template form,
in which numbers (digits or words) become <num>, units <unit> and names (runs of capitalised words) <name>. A capitalised word at
the beginning of a sentence may be a name or not, so its windows have a template for either reading.
Windows of SIZE words of all forms are hashed. Document windows meet the benchmark's in a hash
join; what a Bloom filter of the benchmark's windows rules out never leaves the scan. An item leaks
into a document when at least SHARE % of the item's windows are found in it, or when the windows found
in one occurrence cover SHARE % of its words, so that one changed word costs one word and not SIZE
windows; equal words in line with a found window, up to SIZE - 1 of them, count as covered. Windows that meet only
as templates are aligned first: an occurrence is a run of windows whose places in the document and
in the item differ by one shift, give or take SLACK % of the item's words. Such windows count if the
slots of the occurrence are consistent: the same number, name or unit of the item has to stand for
one and the same value wherever the occurrence repeats it, for SHARE % of the item's slot values, so
re-parameterised questions are caught and chance likenesses are not. One occurrence that passes is
enough, whatever else the document holds. Literal windows count wherever in the document they stand.

Cases: null or empty texts have no windows and nothing leaks into or from them; an item shorter
than a window is one window of all its words and is compared as such, so it is found in documents
only where its words stand together; repeated items give a row each by item_id; of repeated documents
each distinct text under an id gives a row, whatever others share the id; a document without an id is judged
like any other, an item without one is left out; very long texts are read whole, and what they have in
common with one item (their hits) is judged in one row; empty tables give an empty result. Only ids and
texts are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import bitmap, in_bitmap, lists, mapped, materialize, without

SIZE = 5
SHARE = 80
SLACK = 20
WORD_CACHE = 200_000

#: Units of measure and money in their literal form.
UNITS = frozenset("kg g mg km m cm mm mi mile miles inch inches ft feet yard yards l ml litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degrees kmh mph".split())
#: Numbers as words, each alone or tens and ones with a hyphen.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = frozenset([*ONES, *TENS, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million half dozen".split(), *(f"{t}-{o}" for t in TENS for o in ONES)])
OUTER = ".,;:!?\"'()[]{}<>*#%$&|«»„“”‘’¿¡…-–—_~`"
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
NUMBER_UNIT = re.compile(r"[+-]?\d+(?:[.,]\d+)*([a-z]+)")
SENTENCE_END = (".", "!", "?", ":", ";", ".\"", ".'", ".)", "?\"", "!\"")
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3

#: Hash of a slot by its kind.
_SLOT = np.array([0, *(xxhash.xxh3_64_intdigest(f"<{k}>") for k in (NUM, UNIT, NAME))], np.uint64)


def _read(word: str) -> tuple[int, int, int, int]:
    """literal hash, kind of slot, kind of slot inside a sentence, whether it ends a sentence"""
    if word.isalpha() and word.islower():  # most words
        kind = NUM if word in NUMBER_WORDS else UNIT if word in UNITS else LITERAL
        return (xxhash.xxh3_64_intdigest(word) or 1, kind, kind, 0)
    core, ends = word, 0
    if not word.isalnum():
        core, ends = word.strip(OUTER), int(word.endswith(SENTENCE_END))
    if not core:
        return (0, LITERAL, LITERAL, ends)
    low = core.lower()
    h = xxhash.xxh3_64_intdigest(low) or 1
    if low in NUMBER_WORDS:
        kind = NUM
    elif (low[0].isdigit() or low[0] in "+-") and (NUMBER.fullmatch(low) or ((m := NUMBER_UNIT.fullmatch(low)) and m[1] in UNITS)):
        kind = NUM
    elif low in UNITS:
        kind = UNIT
    else:
        kind = LITERAL
    inside = NAME if kind == LITERAL and core[0].isupper() and not core.isupper() else kind
    return (h, kind, inside, ends)


class _Words(dict):
    """Place of each word met so far in the columns literal (hash) and marks (what else _read gives)."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[tuple[int, int]] = []  # not yet in the columns
        self.literal, self.marks = np.empty(0, np.uint64), np.empty(0, np.int8)

    def __missing__(self, word: str) -> int:
        h, kind, inside, ends = _read(word)
        self.fresh.append((h, kind | inside << 2 | ends << 4))
        at = self[word] = len(self)
        return at

    def columns(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > WORD_CACHE:
            self.__init__()
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            end = len(self)
            if end > len(self.literal):
                self.literal, self.marks = np.resize(self.literal, 2 * end), np.resize(self.marks, 2 * end)
            h, marks = zip(*self.fresh, strict=True)
            self.literal[end - len(h) : end], self.marks[end - len(h) : end] = np.array(h, np.uint64), np.array(marks, np.int8)
            self.fresh.clear()
        return self.literal[at], self.marks[at]


_words = _Words()


class Form(NamedTuple):
    """One reading of a text. In a template a run of name words is one token; begins then has the first word
    of each token, and at last the number of words. Without such runs it is None: tokens are words."""

    templ: bool
    hashes: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    begins: np.ndarray | None = None

    def place(self, at: int, n: int) -> tuple[int, int]:
        """The words from which and before which the window of n tokens stands."""
        return (at, at + n) if self.begins is None else (int(self.begins[at]), int(self.begins[at + n]))


def _folded(form: Form, runs: np.ndarray) -> Form:
    """runs: which words go on with the name before."""
    begins = np.flatnonzero(~runs)
    ends = np.append(begins[1:], len(runs))
    own = form.values[begins].copy()
    for k in np.flatnonzero(ends - begins > 1).tolist():
        own[k] = xxhash.xxh3_64_intdigest(form.values[begins[k] : ends[k]].tobytes())
    return Form(True, form.hashes[begins], form.kinds[begins], own, np.append(begins, len(runs)))


def _canonical(text: str | None) -> tuple[np.ndarray, list[Form]]:
    """Literal hashes of the words, words without a letter or digit left out; and the readings: as it is, as
    a template, and as a template with names at the beginnings of sentences."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64), []
    literal, marks = _words.columns(words)
    first = np.empty(len(marks), bool)
    first[0] = True
    np.not_equal(marks[:-1] & 16, 0, out=first[1:])
    keep = np.flatnonzero(literal)
    literal, marks, first = literal[keep], marks[keep], first[keep]
    plain, inside = marks & 3, marks >> 2 & 3
    kinds = (np.where(first, plain, inside), inside)
    forms = [Form(False, literal, plain, literal), *(Form(True, np.where(k == LITERAL, literal, _SLOT[k]), k, literal) for k in kinds)]
    named = inside == NAME
    follows = named[1:] & named[:-1] & ~first[1:]  # a name ends with its sentence
    if follows.any():
        for n in (1, 2):
            named = forms[n].kinds == NAME
            runs = np.concatenate([[False], named[1:] & named[:-1] & follows])
            if runs.any():
                forms[n] = _folded(forms[n], runs)
    return literal, forms


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of size words, a row a form; all words as one window if there are fewer."""
    forms, words = x.shape
    n = min(size, words)
    if not n:
        return np.empty((forms, 0), np.int64)
    acc = np.full((forms, words - n + 1), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[:, k : words - n + 1 + k]
        acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((acc ^ (acc >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def _slots(form: Form, at: int, n: int) -> np.ndarray:
    """The values in the slots of the window of n tokens at a place, in order."""
    return form.values[at : at + n][form.kinds[at : at + n] != LITERAL].view(np.int64)


def _form_windows(forms: list[Form], size: int) -> list[tuple[list[Form], np.ndarray, np.ndarray]]:
    """The forms of each length that have size tokens, and a row a form: the hashes of its windows, and which
    of these differ from the form before."""
    found = []
    for n in dict.fromkeys(len(f.hashes) for f in forms):
        if n >= size:
            alike = [f for f in forms if len(f.hashes) == n]
            w = _windows(np.stack([f.hashes for f in alike]), size)
            found.append((alike, w, np.concatenate([np.ones((1, w.shape[1]), bool), w[1:] != w[:-1]])))
    return found


WINDOW_SCHEMA = "id bigint, n_words int, pos int, span int, h bigint, templ boolean, slots array<bigint>"


def _item_windows(items: DataFrame, size: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        slots = []
        for item, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            literal, forms = _canonical(text)
            n = min(size, len(literal))
            for alike, hashes, fresh in _form_windows(forms, n) if n else ():
                for k, at in np.argwhere(fresh).tolist():
                    form = alike[k]
                    own = _slots(form, at, n) if form.templ else np.empty(0, np.int64)
                    if form.templ and (not len(own) or len(own) == n):
                        continue  # the same as the literal window, or slots only, which say nothing
                    pos, end = form.place(at, n)
                    for c, v in zip(out, (item, len(literal), pos, end - pos, int(hashes[k, at]), form.templ), strict=True):
                        c.append(v)
                    slots.append(own)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        cols = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, lists(slots, pa.int64())], names=["id", "n_words", "pos", "span", "h", "templ", "slots"])

    return mapped(items, run, WINDOW_SCHEMA)


def _doc_hits(docs: DataFrame, held: np.ndarray, sizes: list[int]) -> DataFrame:
    """Windows of documents that may be an item's: one row for each place and form."""

    beside = max(sizes) - 1

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, at, hs, ts, slots, near = [], [], [], [], [], []
        for row, text in enumerate(b.column("text").to_pylist()):
            literal, forms = _canonical(text)
            for size in sizes:
                for alike, w, fresh in _form_windows(forms, size):
                    for f, k in np.argwhere(in_bitmap(held, w) & fresh).tolist():
                        form = alike[f]
                        own = _slots(form, k, size) if form.templ else np.empty(0, np.int64)
                        if form.templ and not len(own):
                            continue
                        pos, end = form.place(k, size)
                        rows.append(row)
                        at.append(pos)
                        hs.append(int(w[f, k]))
                        ts.append(form.templ)
                        slots.append(own)
                        near.append(literal[max(0, pos - beside) : end + beside].view(np.int64))
        cols = [pa.array(c, t) for c, t in zip((at, hs, ts), (pa.int32(), pa.int64(), pa.bool_()), strict=True)]
        own = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("text_hash").take(own), *cols, lists(slots, pa.int64()), lists(near, pa.int64())], names=["doc_id", "text_hash", "doc_pos", "h", "templ", "slots", "near"])

    return mapped(docs, run, "doc_id bigint, text_hash bigint, doc_pos int, h bigint, templ boolean, slots array<bigint>, near array<bigint>")


def _steady(pairs: list[tuple[int, int]], share: int) -> bool:
    """Whether SHARE % of the item's values stand for one value each."""
    meant: dict[int, set[int]] = {}
    for own, other in pairs:
        meant.setdefault(own, set()).add(other)
    return sum(len(x) == 1 for x in meant.values()) * 100 >= len(meant) * share


def _occurrences(places: dict[int, list[int]], slack: int) -> list[list[tuple[int, int]]]:
    """Ways to lay an item over a document: for each shift that occurs, the windows of the item in
    order, each at its place in the document nearest to the shift so far, at most slack off."""
    found: dict[tuple[tuple[int, int], ...], None] = {}
    order = sorted(places)
    for shift in {d - p for p in order for d in places[p]}:
        laid, now = [], shift
        for p in order:
            at = places[p]
            i = bisect_left(at, p + now)
            near = min(at[max(0, i - 1) : i + 1], key=lambda d: abs(d - p - now))
            if abs(near - p - shift) <= slack:
                laid.append((p, near))
                now = near - p
        found[tuple(laid)] = None
    return [list(x) for x in found]


def _covered(laid: list[tuple[int, int]], words: list[int], near: dict[int, list[int]], spans: dict[tuple[int, int], int], size: int) -> int:
    """Words of the item in the windows of an occurrence, and equal words in line with one of them."""
    seen: set[int] = set()
    for pos, at in laid:
        seen.update(range(pos, min(pos + spans.get((pos, at), size), len(words))))
        first = at - max(0, at - size + 1)  # words before the window in near
        seen.update(i for k, x in enumerate(near[at]) if 0 <= (i := pos + k - first) < len(words) and words[i] == x)
    return len(seen)


def _verdict(hits: list[dict], words: list[int], n_windows: int, size: int, share: int) -> tuple[int, int, bool]:
    """n_literal, n_found and whether the item leaks, from the windows of one item met in one document."""
    places: dict[int, set[int]] = {}
    plain, slots, near, spans = set(), {}, {}, {}
    for x in hits:
        key = (x["pos"], x["doc_pos"])
        places.setdefault(x["pos"], set()).add(x["doc_pos"])
        near[x["doc_pos"]] = max(near.get(x["doc_pos"], ()), x["near"], key=len)
        spans[key] = max(spans.get(key, 0), x["span"])
        if x["templ"]:
            slots.setdefault(key, []).extend(zip(x["item_slots"], x["slots"], strict=True))
        else:
            plain.add(key)
    n_literal = n_found = len({p for p, _ in plain})
    leak = n_literal * 100 >= n_windows * share
    if n_literal < n_windows:
        for laid in _occurrences({p: sorted(d) for p, d in places.items()}, len(words) * SLACK // 100):
            if (leak and len(laid) <= n_found) or not _steady([v for x in laid for v in slots.get(x, ())], share):
                continue
            n_found = max(n_found, len(laid))
            leak = leak or _covered(laid, words, near, spans, size) * 100 >= len(words) * share
    return n_literal, n_found, leak


JUDGED = ("doc_id", "text_hash", "item_id", "n_windows")


def _judged(pairs: DataFrame, size: int, share: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_verdict(r["hits"], r["words"], r["n_windows"], size, share) for r in b.to_pylist()]
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*map(b.column, JUDGED), *cols], names=[*JUDGED, "n_literal", "n_found", "contaminated"])

    return mapped(pairs, run, "doc_id bigint, text_hash bigint, item_id bigint, n_windows bigint, n_literal bigint, n_found bigint, contaminated boolean")


def _item_words(items: DataFrame) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words = [_canonical(t)[0].view(np.int64) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("id"), lists(words, pa.int64())], names=["item_id", "words"])

    return mapped(items, run, "item_id bigint, words array<bigint>")


def leaking_texts(docs: DataFrame, items: DataFrame, size: int = SIZE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """As leaks, a row for each distinct id and text, with text_hash, the text's xxhash64, to tell texts of one
    id apart. Rows without an id are judged like others."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text")).filter("id is not null")
    windows = materialize(_item_windows(bench, size).withColumnRenamed("id", "item_id"), "items")
    held = bitmap(windows, "h", least_bits=1 << 24)
    short = [r[0] for r in windows.filter(F.col("n_words") < size).select("n_words").distinct().collect()]  # at most size - 1
    hits = materialize(_doc_hits(rows, held, sorted({size, *short})), "hits")
    met = hits.join(windows.withColumnRenamed("slots", "item_slots"), ["h", "templ"])
    hit = F.struct("pos", "span", "doc_pos", "templ", "item_slots", "slots", "near")
    pairs = met.groupBy("doc_id", "text_hash", "item_id").agg(F.max("n_words").alias("n_words"), F.collect_set(hit).alias("hits"))
    # a window covers its span and at most size - 1 words to either side: fewer hits can't be a leak
    reach = F.aggregate("hits", F.lit(0), lambda n, x: n + x["span"] + 2 * (size - 1))
    pairs = pairs.filter(reach * 100 >= F.col("n_words") * share)
    total = windows.groupBy("item_id").agg(F.count_distinct("pos").alias("n_windows"))
    words = _item_words(bench).groupBy("item_id").agg(F.first("words").alias("words"))
    pairs = pairs.join(total, "item_id").join(words, "item_id")
    return _judged(pairs.select("doc_id", "text_hash", "item_id", "words", "n_windows", "hits"), size, share).filter("contaminated")


def leaks(docs: DataFrame, items: DataFrame, size: int = SIZE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_literal, n_found, contaminated): one row for each document and
    item that leaks into it; contaminated is true in each."""
    return leaking_texts(docs, items, size, share, id_col, text_col, item_col, item_text_col).drop("text_hash")


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows into whose text an item leaks; other texts under the same id stay."""
    found = materialize(leaking_texts(docs, items, id_col=id_col, text_col=text_col).select("doc_id", "text_hash").distinct(), "leaking")
    # whole rows go into one column, so that no name of theirs clashes
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.struct(*docs.columns).alias("whole_row"))
    return without(keyed, found, ["doc_id", "text_hash"]).select("whole_row.*")
