"""A SentencePiece vocabulary as arrays: piece keys, and which pieces may stand side by side.

Unigram models need no more than their scores. In a BPE model the encoding is fixed by the order of
merges, and scores along a path do not give it. It is still a path through the lattice of pieces:
the one on which every two neighbours are stable, that is, on which no merge across their border
would have come before the merges that made them. Whether a pair is stable is found by undoing the
later of the two merges until only characters are left, and checking the border before each step.
With stability as the condition for an edge, the forward pass finds exactly the BPE encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

UNIGRAM, BPE = 1, 2
SPACE = "▁"
NONE, START = -2, -1
FAR = np.int64(1) << np.int64(40)
BASE = 0x100000001B3
#: Slots of the table of pairs whose stability is known.
PAIR_SLOTS = 1 << 19


def key_of(hashes: np.ndarray, length: int) -> np.ndarray:
    x = (hashes + np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Model:
    """From pieces, scores and types as in the model file (1 normal, 2 unknown, 3 control, 4 user, 6 byte)."""

    def __init__(self, kind: int, pieces: list[str], scores: list[float], types: list[int]) -> None:
        self.kind, self.pieces = kind, pieces
        v = self.unknown = len(pieces)  # stands for a character outside the vocabulary
        self.byte_ids = [-1] * 256
        self.unk_id = types.index(2)
        self.raw = [p.encode() for p in pieces]
        for i, (p, t) in enumerate(zip(pieces, types, strict=True)):
            if t == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif t in (2, 3):
                self.raw[i] = b""
        self.ids = {p: i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t in (1, 4)}
        self.scores = np.array([*scores, min(scores[i] for i in self.ids.values()) - 10.0])
        self.order = np.full(v + 1, -1, np.int64)  # when a piece's merge comes; -1: a character
        for r, i in enumerate(sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-scores[i], i))):
            self.order[i] = r
        self.left, self.right = np.full(v + 1, -1, np.int32), np.full(v + 1, -1, np.int32)
        self.run_ids: dict[int, list[int]] = {}
        words = {p: i for p, i in self.ids.items() if len(p) == 1 or p.strip(SPACE)}
        if kind == BPE:
            merges = {(self.ids[p[:k]], self.ids[p[k:]]): int(self.order[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
            known = sorted((a * (v + 1) + b, r) for (a, b), r in merges.items())
            self.pair_keys, self.pair_order = np.array([k for k, _ in known], np.int64), np.array([r for _, r in known], np.int64)
            self.merges = merges
            for p, i in list(words.items()):
                if len(p) > 1:
                    made = self._merged(p)
                    if made is None:
                        del words[p]  # never the outcome of merges
                    else:
                        self.left[i], self.right[i] = made
        self.words = words
        self.longest = max(map(len, words))
        keys = np.empty(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for j, p in enumerate(words):
                h = 0
                for c in p:
                    h = (h * BASE + ord(c)) & (1 << 64) - 1
                keys[j] = key_of(np.array([h], np.uint64), len(p))[0]
        # A text's pre-tokens: cut in front of a space, around a line feed, and between a letter and
        # marks that follow a letter in no piece. No piece crosses these places.
        pairs = {(a, b) for p in words for a, b in zip(p, p[1:], strict=False)}
        after = {b for a, b in pairs if a.isalpha()}
        marks = "".join(re.escape(c) for c in ".,;:!?#$%&*|)(\"" if c not in after)
        if any("\n" in p and len(p) > 1 for p in words) or any(b == SPACE and a != SPACE for a, b in pairs):
            raise ValueError("a piece crosses a space or a line feed")
        word = f"(?:[^ \n{marks}]+|(?<![^\\W\\d_])[{marks}])" if marks else "[^ \n]"
        start = f"[{marks}]{word}*|" if marks else ""
        self.pattern = re.compile(f" ?{word}+|{start}\n| +(?= [^ \n])| +")
        by = np.argsort(keys)
        self.keys, self.key_ids = keys[by], np.array(list(words.values()), np.int32)[by]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys & np.uint64((1 << 20) - 1)] = True
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have the same key")
        self.forget()

    def forget(self) -> None:
        self.pair_seen = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)
        self.pair_memo: dict[int, bool] = {}

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k not in ("pair_seen", "pair_ok", "pair_memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def pretokens(self, text: str | None) -> list[str]:
        return self.pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The pieces with these keys, NONE where there is none. A table of key bits spares most searches."""
        out = np.full(keys.shape, NONE, np.int32)
        some = np.nonzero(self.maybe[keys & np.uint64((1 << 20) - 1)])
        key = keys[some]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == key, self.key_ids[at], NONE)
        return out

    def by_merging(self, text: str) -> list[tuple[int, int, int]]:
        """Plain BPE by definition, for short strings of known characters: (id, left, right) of each
        piece of the result; left and right are what its last merge joined."""
        parts = [(self.ids[c], -1, -1) for c in text]
        while True:
            best = min(((self.merges.get((parts[k][0], parts[k + 1][0]), FAR), k) for k in range(len(parts) - 1)), default=(FAR, 0))
            if best[0] >= FAR:
                return parts
            k = best[1]
            a, b = parts[k][0], parts[k + 1][0]
            parts[k : k + 2] = [(self.ids[self.pieces[a] + self.pieces[b]], a, b)]

    def _merged(self, piece: str) -> tuple[int, int] | None:
        if any(c not in self.ids for c in piece):
            return None
        got = self.by_merging(piece)
        return got[0][1:] if len(got) == 1 else None

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of n spaces. All merges of spaces rank alike, so the leftmost comes first; from
        64 spaces on the run's beginning repeats whole longest pieces."""
        if n not in self.run_ids:
            if self.kind == BPE:
                scores = lambda x: self.scores[self.ids[SPACE * x]] if SPACE * x in self.ids else None
                parts = [1] * n
                while True:
                    best = None
                    for k in range(len(parts) - 1):
                        s = scores(parts[k] + parts[k + 1])
                        if s is not None and (best is None or s > best[0]):
                            best = (s, k)
                    if best is None:
                        break
                    parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
                self.run_ids[n] = [self.ids[SPACE * x] for x in parts]
            else:
                best = [(0.0, 0)] + [(-np.inf, 0)] * n
                for i in range(1, n + 1):
                    for k in range(1, i + 1):
                        if SPACE * k in self.ids and best[i - k][0] + self.scores[self.ids[SPACE * k]] > best[i][0]:
                            best[i] = (best[i - k][0] + self.scores[self.ids[SPACE * k]], k)
                out = []
                while n:
                    out.append(self.ids[SPACE * best[n][1]])
                    n -= best[n][1]
                return out[::-1]
        return self.run_ids[n]

    # stability of pairs

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = np.int64(self.unknown + 1)
        ok = np.ones(len(a), bool)
        a, b, at = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
        limit = np.full(len(a), FAR)
        while len(at):
            key = a * v + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossing = np.where(self.pair_keys[k] == key, self.pair_order[k], FAR)
            bad = crossing < limit
            ok[at[bad]] = False
            ra, rb = self.order[a], self.order[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, at, ra, rb = a[go], b[go], at[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of neighbours: whether each pair is stable. START and unknown go with anything."""
        ok = np.ones(len(a), bool)
        real = np.flatnonzero((a >= 0) & (a != self.unknown) & (b != self.unknown))
        key = a[real].astype(np.int64) * (self.unknown + 1) + b[real]
        slot = ((key * np.int64(0x9E3779B1)) >> np.int64(7)) & np.int64(PAIR_SLOTS - 1)
        hit = self.pair_seen[slot] == key
        ok[real[hit]] = self.pair_ok[slot[hit]]
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            found = self._undo(new // (self.unknown + 1), new % (self.unknown + 1))
            ok[real[~hit]] = found[back]
            s = slot[~hit]
            self.pair_seen[s], self.pair_ok[s] = key[~hit], found[back]
            # where two new keys share a slot the last one written stands, with its own answer
            self.pair_ok[s] = found[np.searchsorted(new, self.pair_seen[s])]
        return ok

    def stable_pair(self, a: int, b: int) -> bool:
        if a < 0 or a == self.unknown or b == self.unknown:
            return True
        key = a * (self.unknown + 1) + b
        known = self.pair_memo.get(key)
        if known is None:
            if len(self.pair_memo) > 300_000:
                self.pair_memo.clear()
            known = self.pair_memo[key] = self._undo_pair(a, b)
        return known

    def _undo_pair(self, a: int, b: int) -> bool:
        limit, order, merges = FAR, self.order, self.merges
        while True:
            if merges.get((a, b), FAR) < limit:
                return False
            ra, rb = order[a], order[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, int(self.right[a])
            else:
                limit, b = rb + 1, int(self.left[b])

    def spelled(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary: its bytes, or the unknown piece."""
        ids = [self.byte_ids[x] for x in char.encode("utf-8", "replace")]
        return ids if min(ids) >= 0 else [self.unk_id]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; of the leading dummy space nothing is left."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")[1:]


def load(path: str) -> Model:
    """Reads a model file. The file is read on the driver; workers get the arrays."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind = BPE if proto.trainer_spec.model_type == 2 else UNIGRAM
    return Model(kind, [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces])
