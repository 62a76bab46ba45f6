"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

The distinct new words of a chunk are grouped by length, and words of one length advance together,
one character a step. At each place the hashes of all substrings that end there probe the sorted
piece keys; the maximum over the admissible pieces is taken for all words at once and stored as a
backpointer. In unigram models every piece is admissible and scores add up; in BPE models a piece
is admissible after another if the two are stable neighbours (see sp_model), which leaves one path,
the library's encoding. Words over LONG_WORD characters take the same pass one place at a time.

Cases: a null or empty text has no ids and decodes to ''; U+2581 counts as a space, as in the
library; characters outside the vocabulary become byte pieces; a null id passes through; repeated
rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import lists, mapped
from gazette.llm.sp_model import BASE, BPE, NONE, SPACE, START, Model, key_of

LONG_WORD = 40
WORD_CACHE = 250_000


def _same_length(model: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chars: code points, a row a word. Gives the piece that ends best at each place (unknown for
    a character outside the vocabulary) and its length."""
    n, length = chars.shape
    prefix = np.zeros((n, length + 1), np.uint64)
    power = np.ones(model.longest + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * np.uint64(BASE) + chars[:, i]
        for k in range(model.longest):
            power[k + 1] = power[k] * np.uint64(BASE)
    last = np.full((n, length + 1), NONE, np.int32)
    last[:, 0] = START
    size = np.zeros((n, length + 1), np.int8)
    total = np.full((n, length + 1), -np.inf)
    total[:, 0] = 0.0
    for i in range(1, length + 1):
        most = min(i, model.longest)
        keys = np.empty((n, most), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, most + 1):
                keys[:, k - 1] = key_of(prefix[:, i] - prefix[:, i - k] * power[k], k)
        piece = model.probe(keys)
        piece[:, 0] = np.where(piece[:, 0] == NONE, model.unknown, piece[:, 0])
        before = last[:, i - most : i][:, ::-1]
        row, col = np.nonzero((piece != NONE) & (before != NONE))
        score = np.full((n, most), -np.inf)
        if model.kind == BPE:
            ok = model.stable(before[row, col], piece[row, col])
            score[row[ok], col[ok]] = 0.0
        else:
            score[row, col] = total[row, i - 1 - col] + model.scores[piece[row, col]]
        best = most - 1 - score[:, ::-1].argmax(axis=1)  # of equal scores the longest piece, as in the library
        every = np.arange(n)
        found = score[every, best] > -np.inf
        total[:, i] = score[every, best]
        last[:, i] = np.where(found, piece[every, best], NONE)
        size[:, i] = np.where(found, best + 1, 0)
    return last, size


def one_long(model: Model, word: str) -> list[tuple[int, int]]:
    """The same pass for one word of any length: (piece, length) at each place."""
    out: list[tuple[int, int]] = [(START, 0)]
    total = [0.0]
    for i in range(1, len(word) + 1):
        best, score = (NONE, 0), -np.inf
        for k in range(min(i, model.longest), 0, -1):
            piece = model.words.get(word[i - k : i], model.unknown if k == 1 else NONE)
            before = out[i - k][0]
            if piece == NONE or before == NONE:
                continue
            if model.kind == BPE:
                new = 0.0 if model.stable_pair(before, piece) else -np.inf
            else:
                new = total[i - k] + model.scores[piece]
            if new > score:
                best, score = (piece, k), new
        out.append(best)
        total.append(score)
    return out


def encode_words(model: Model, words: list[str]) -> dict[str, tuple[int, ...]]:
    """Ids of each word; words have their space as U+2581."""
    out: dict[str, tuple[int, ...]] = {}
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)

    def traced(word: str, piece, size) -> tuple[int, ...]:
        ids, i = [], len(word)
        while i > 0:
            p = int(piece[i])
            ids += reversed(model.spelled(word[i - 1])) if p == model.unknown else [p]
            i -= int(size[i])
        return tuple(ids[::-1])

    for length, group in groups.items():
        if length > LONG_WORD:
            for w in group:
                steps = one_long(model, w)
                out[w] = traced(w, [p for p, _ in steps], [k for _, k in steps])
            continue
        for at in range(0, len(group), 8192):
            part = group[at : at + 8192]
            chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length).astype(np.uint64)
            last, size = _same_length(model, chars)
            for w, p, k in zip(part, last.tolist(), size.tolist(), strict=True):
                out[w] = traced(w, p, k)
    return out


class Encoder:
    """Encodes texts and keeps a bounded table of words between them."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        model, split = self.model, [self.model.pretokens(t) for t in texts]
        distinct = set(chain.from_iterable(split))
        if len(self.known) + len(distinct) > WORD_CACHE:
            self.known.clear()
        known = self.known
        fresh = [w for w in distinct if w not in known]
        words = {w: w.replace(" ", SPACE) for w in fresh if w.strip(" ")}
        got = encode_words(model, list(words.values()))
        for w in fresh:
            known[w] = got[words[w]] if w in words else tuple(model.spaces(len(w)))
        return [self._joined(words, text) for words, text in zip(split, texts, strict=True)]

    def _joined(self, words: list[str], text: str | None) -> np.ndarray:
        parts = list(map(self.known.__getitem__, words))
        if text and (text[0] in (" ", SPACE) or "  " in text.replace(SPACE, " ")):
            alone = self.model.ids.get(SPACE)
            for k in range(len(words) - 1):
                # a run of spaces takes in the next word's space if that merges with nothing in the word
                if words[k][-1] == " " and words[k + 1][0] == " " and parts[k + 1][0] == alone:
                    parts[k], parts[k + 1] = tuple(self.model.spaces(len(words[k]) + 1)), parts[k + 1][1:]
        return np.fromiter(chain.from_iterable(parts), np.int32)


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, and round_trip: whether the ids decode to the text again."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    held: list[Encoder] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Encoder(model))
        texts = b.column("text").to_pylist()
        ids = held[0].encode(texts)
        same = [model.decode(x.tolist()) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": lists(ids, pa.int32()), "round_trip": pa.array(same, pa.bool_())})

    return mapped(rows, run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text; null ids give ''."""
    rows = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array([model.decode(x or ()) for x in b.column("ids").to_pylist()], pa.string())})

    return mapped(rows, run, "doc_id bigint, text string")
