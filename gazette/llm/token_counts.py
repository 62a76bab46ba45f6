"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens go into a trie. A node stands for a prefix and holds its forward state: the
best score and last piece of the prefix's segmentation and how many tokens it has. The state of a
prefix depends on the prefix alone, so it is computed once however many words share it, and a
word's count is read off its last node. New words enter together, a level of the trie at a time:
the level's new nodes find their pieces by substring hashes and their states by one maximum. A
text's count is the sum over its pre-tokens. With a BPE model the state follows the one stable
segmentation (see sp_model), so counts are the library's. Words over LONG_WORD characters take the
same pass one place at a time and share nothing.

Cases: as in sentencepiece_codec; a null or empty text counts 0.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import mapped
from gazette.llm.sentencepiece_codec import LONG_WORD, one_long
from gazette.llm.sp_model import BASE, BPE, NONE, SPACE, START, Model, key_of

#: The trie is emptied before a chunk when it has this many nodes, the table of words likewise.
TRIE_NODES = 700_000
WORD_CACHE = 400_000
CHAR_BITS = 21


class Trie:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.alone = model.ids.get(SPACE, NONE)
        self.words: dict[str, int] = {}
        #: Words whose first token is a lone space.
        self.spaced: set[str] = set()
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.array([1, *[BASE] * model.longest], np.uint64))
        self.clear()

    def clear(self) -> None:
        """Empties the trie; counts of words that are known stay."""
        self.size = 1
        self.parent, self.hash = np.zeros(1, np.int64), np.zeros(1, np.uint64)
        self.last, self.count = np.full(1, START, np.int32), np.zeros(1, np.int64)
        self.score, self.lone = np.zeros(1), np.zeros(1, bool)
        #: For each level, (parent, character) keys in order, and the nodes they lead to.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _grow(self, n: int) -> None:
        room = len(self.parent)
        if self.size + n > room:
            more = max(self.size + n - room, room)
            for name in ("parent", "hash", "last", "count", "score", "lone"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros(more, held.dtype)]))

    def _add(self, level: int, keys: np.ndarray) -> np.ndarray:
        """New nodes for keys on a level (its characters' places count from 1), with their states."""
        model, n = self.model, len(keys)
        self._grow(n)
        nodes = np.arange(self.size, self.size + n)
        self.size += n
        chars = (keys & ((1 << CHAR_BITS) - 1)).astype(np.uint64)
        parent = keys >> CHAR_BITS
        self.parent[nodes] = parent
        with np.errstate(over="ignore"):
            self.hash[nodes] = self.hash[parent] * np.uint64(BASE) + chars
        most = min(level, model.longest)
        before = np.empty((n, most), np.int64)  # the node k + 1 characters up
        found = np.empty((n, most), np.uint64)
        up = parent
        for k in range(most):
            before[:, k] = up
            with np.errstate(over="ignore"):
                found[:, k] = key_of(self.hash[nodes] - self.hash[up] * self.power[k + 1], k + 1)
            up = self.parent[up]
        piece = model.probe(found)
        piece[:, 0] = np.where(piece[:, 0] == NONE, model.unknown, piece[:, 0])
        row, col = np.nonzero((piece != NONE) & (self.last[before] != NONE))
        score = np.full((n, most), -np.inf)
        if model.kind == BPE:
            ok = model.stable(self.last[before[row, col]], piece[row, col])
            score[row[ok], col[ok]] = 0.0
        else:
            score[row, col] = self.score[before[row, col]] + model.scores[piece[row, col]]
        best = most - 1 - score[:, ::-1].argmax(axis=1)  # of equal scores the longest piece, as in the library
        every = np.arange(n)
        reached = score[every, best] > -np.inf
        chosen, source = piece[every, best], before[every, best]
        cost = np.ones(n, np.int64)
        for k in np.flatnonzero(reached & (chosen == model.unknown)):
            cost[k] = len(model.spelled(chr(int(chars[k]))))
        self.last[nodes] = np.where(reached, chosen, NONE)
        self.score[nodes] = score[every, best]
        self.count[nodes] = self.count[source] + cost
        self.lone[nodes] = np.where(source == 0, chosen == self.alone, self.lone[source])
        return nodes

    def _step(self, level: int, at: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """From nodes one level up, the nodes that characters lead to; those not there are made."""
        keys, back = np.unique((at << CHAR_BITS) | chars, return_inverse=True)
        if level > len(self.levels):
            self.levels.append((np.empty(0, np.int64), np.empty(0, np.int64)))
        known, nodes = self.levels[level - 1]
        place = np.searchsorted(known, keys)
        there = np.zeros(len(keys), bool)
        inside = place < len(known)
        there[inside] = known[place[inside]] == keys[inside]
        out = np.empty(len(keys), np.int64)
        out[there] = nodes[place[there]]
        if not there.all():
            new = self._add(level, keys[~there])
            out[~there] = new
            self.levels[level - 1] = (np.insert(known, place[~there], keys[~there]), np.insert(nodes, place[~there], new))
        return out[back]

    def insert(self, word: str) -> tuple[int, bool]:
        """The word's token count, and whether its first token is a lone space."""
        if word not in self.words:
            self.insert_all([word])
        return self.words[word], word in self.spaced

    def insert_all(self, words: list[str]) -> None:
        """Puts new words (with a leading space as U+2581) in the trie and their counts in the table."""
        plain = sorted((w for w in words if len(w) <= LONG_WORD), key=len, reverse=True)
        for w in words:
            if len(w) > LONG_WORD:
                self._insert_long(w)
        if not plain:
            return
        length = np.array([len(w) for w in plain])
        chars = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.zeros(len(plain), np.int64)
        for level in range(1, length[0] + 1):
            n = int(np.searchsorted(-length, -level, side="right"))  # words with a character here
            at[:n] = self._step(level, at[:n], chars[start[:n] + level - 1])
        self.words.update(zip(plain, self.count[at].tolist(), strict=True))
        self.spaced.update(plain[k] for k in np.flatnonzero(self.lone[at]))

    def _insert_long(self, word: str) -> None:
        steps, i, total, piece = one_long(self.model, word), len(word), 0, NONE
        while i > 0:
            piece, k = steps[i]
            total += len(self.model.spelled(word[i - 1])) if piece == self.model.unknown else 1
            i -= k
        self.words[word] = total
        if piece == self.alone:
            self.spaced.add(word)

    def count_text(self, text: str | None) -> tuple[int, int]:
        return self.count_texts([text])[0]

    def count_texts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Tokens and pre-tokens of each text."""
        model = self.model
        split = [[w.replace(" ", SPACE) for w in model.pretokens(t)] for t in texts]
        distinct = set(chain.from_iterable(split))
        if self.size > TRIE_NODES:
            self.clear()
        if len(self.words) + len(distinct) > WORD_CACHE:
            self.words.clear()
            self.spaced.clear()
        fresh = [w for w in distinct if w not in self.words]
        self.insert_all([w for w in fresh if w.strip(SPACE)])
        self.words.update((w, len(model.spaces(len(w)))) for w in fresh if not w.strip(SPACE))
        return [(self._total(words, text), len(words)) for words, text in zip(split, texts, strict=True)]

    def _total(self, words: list[str], text: str | None) -> int:
        known = self.words
        total = sum(map(known.__getitem__, words))
        if text and (text[0] in (" ", SPACE) or "  " in text.replace(SPACE, " ")):
            for w, after in zip(words, words[1:], strict=False):
                # a run of spaces takes in the next word's space if that merges with nothing in the word
                if w[-1] == SPACE and after in self.spaced:
                    total += len(self.model.spaces(len(w) + 1)) - known[w] - 1
        return total


def count_tokens(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pretokens and n_chars, one row a document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    held: list[Trie] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Trie(model))
        texts = b.column("text").to_pylist()
        got = held[0].count_texts(texts)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array([x for x, _ in got], pa.int64()), "n_pretokens": pa.array([x for _, x in got], pa.int64()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})

    return mapped(rows, run, "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_chars bigint")
