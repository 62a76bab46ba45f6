"""Fill-in-the-middle transformation by a table-driven byte automaton.

One scan of the UTF-8 bytes of a text counts what the automaton emits: code points (a byte that
continues none), units (the byte after a unit's last one) and sentinels (their last byte). The tables
are built from the sentinels and the kind of unit: a state is how much of a sentinel has just been
read, and whether the next byte begins a unit. As no state looks back further than the longest
sentinel, the scan runs over all bytes of a batch together: each byte's state is reached from the
root by the transitions of the last few bytes. The counts give the cuts; a second pass over
the emitted units finds their places. Restoring runs the same automaton over the output.

The cuts of a text depend on its id and the seed only, so a task that runs again gives the same
rows. Rows are independent: no shuffle, and a hot key or a very long text is one row like another.

Cases: a null text counts as empty, and an empty text is plain; a text that contains a sentinel is
plain; a null id is drawn as an empty id; repeated rows give repeated rows; very long texts are
read whole; an empty table gives an empty result. Only the id and text columns are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import mapped, text_of

#: What the automaton emits at a byte.
POINT, UNIT, SENTINEL = 1, 2, 4
#: A byte that UTF-8 never uses; stands before each text and takes every state to the root.
RESET = 0xFF
UNITS = ("line", "word", "char")
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Plan:
    """What is cut, how often, and the marks of prefix, suffix and middle."""

    unit: str = "line"
    seed: int = 7
    rate: int = 100  # % of the texts that are transformed
    spm: int = 50  # % of those whose suffix comes first
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"unit has to be one of {UNITS}")
        if len(set(self.marks)) < 3 or any(a in b for a in self.marks for b in self.marks if a != b) or not all(self.marks):
            raise ValueError("sentinels have to be three, and none may be part of another")
        if any(a[0] in b[1:] for a in self.marks for b in self.marks):  # else a text beside a sentinel could make up a fourth
            raise ValueError("a sentinel's first character may stand nowhere else in a sentinel")

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(self.unit, tuple(m.encode() for m in self.marks))


class Automaton:
    """Transitions and emissions by state and byte. State 2 * p + f: p is the longest beginning of a
    sentinel that has just been read, f is 1 where the next byte begins a unit."""

    def __init__(self, unit: str, sentinels: tuple[bytes, ...]) -> None:
        prefixes = sorted({s[:k] for s in sentinels for k in range(len(s) + 1)}, key=lambda p: (len(p), p))
        at = {p: k for k, p in enumerate(prefixes)}
        self.reach = max(2, *map(len, sentinels))
        self.ends = {at[s]: k for k, s in enumerate(sentinels)}
        self.next = np.empty((2 * len(prefixes), 256), np.uint16)
        self.emit = np.zeros((2 * len(prefixes), 256), np.uint8)
        for p in prefixes:
            for byte in range(256):
                read = p + bytes([byte])
                while read not in at:
                    read = read[1:]
                for fresh in (0, 1):
                    state = 2 * at[p] + fresh
                    if byte == RESET:
                        self.next[state, byte] = 1  # nothing read, a unit begins
                        continue
                    continues = 0x80 <= byte < 0xC0
                    begins = {"line": bool(fresh), "char": not continues, "word": bool(fresh) and byte not in b" \t\n\x0b\x0c\r"}[unit]
                    then = {"line": byte == 0x0A, "char": False, "word": byte in b" \t\n\x0b\x0c\r"}[unit]
                    self.next[state, byte] = 2 * at[read] + then
                    self.emit[state, byte] = POINT * (not continues) | UNIT * begins | SENTINEL * (at[read] in self.ends)
        self.flat_next = self.next.ravel()
        self.flat_emit = self.emit.ravel()

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What is emitted at each byte. data: texts, a RESET before each."""
        n, low = len(data), data.astype(np.int32)
        states = np.zeros(n, np.int32)  # before the byte: by the transitions of the last reach bytes
        for back in range(self.reach, 0, -1):
            if back < n:
                states[back:] = self.flat_next[(states[back:] << 8) + low[: n - back]]
        return self.flat_emit[(states << 8) + low]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a RESET before each, and where each text begins; its end is the next
    beginning less one."""
    data = np.frombuffer(b"".join(b"\xff" + t for t in texts), np.uint8)
    return data, np.cumsum([1, *(len(t) + 1 for t in texts)])


def _draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def _cut(texts: list[bytes], ids: list[int | None], plan: Plan) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """n, form, code points of prefix and middle, output; one a text."""
    data, starts = _joined(texts)
    emitted = plan.automaton.scan(data)
    units = np.flatnonzero(emitted & UNIT)
    first = np.searchsorted(units, starts)  # each text's first unit; the last is the end of all
    marked = np.searchsorted(np.flatnonzero(emitted & SENTINEL), starts)
    p, s, m = (x.encode() for x in plan.marks)
    rows = []
    for k, (text, doc_id) in enumerate(zip(texts, ids, strict=True)):
        n = int(first[k + 1] - first[k])
        h1, h2, h3, h4 = _draws(plan.seed, doc_id)
        if not text or marked[k + 1] > marked[k] or h3 % 100 >= plan.rate:
            rows.append((n, PLAIN, None, None, text))
            continue
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        start = int(starts[k])
        # what stands before the first unit (white space, for words) goes with the prefix unless that is empty
        a, b = (0 if not c else len(text) if c == n else int(units[first[k] + c]) - start for c in (low, high))
        points = emitted[start : start + b] & POINT
        n_prefix = int(np.count_nonzero(points[:a]))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        form = SPM if h4 % 100 < plan.spm else PSM
        output = s + suffix + p + prefix + m + middle if form == SPM else p + prefix + s + suffix + m + middle
        rows.append((n, form, n_prefix, int(np.count_nonzero(points)) - n_prefix, output))
    return rows


def _restore(outputs: list[bytes], forms: list[str], plan: Plan) -> list[bytes]:
    data, starts = _joined(outputs)
    ends = np.flatnonzero(plan.automaton.scan(data) & SENTINEL) + 1
    first = np.searchsorted(ends, starts)
    sizes = [len(x.encode()) for x in plan.marks]
    texts = []
    for k, (output, form) in enumerate(zip(outputs, forms, strict=True)):
        if form == PLAIN:
            texts.append(output)
            continue
        found = ends[first[k] : first[k + 1]] - starts[k]
        if len(found) != 3:
            raise ValueError("not an output of this plan: it has to hold three sentinels")
        order = (1, 0, 2) if form == SPM else (0, 1, 2)
        stops = [*(int(e) - sizes[i] for e, i in zip(found[1:], order[1:], strict=True)), len(output)]
        part = {i: output[int(e) : stop] for i, e, stop in zip(order, found, stops, strict=True)}
        texts.append(part[0] + part[2] + part[1])
    return texts


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def transform(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and
    output, one row a document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = _cut(_bytes(b.column("text")), b.column("doc_id").to_pylist(), plan)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return mapped(rows, run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Rows of transform with the column text, rebuilt from output and form alone."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = _restore(_bytes(b.column("output")), b.column("form").to_pylist(), plan)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return mapped(rows, run, f"{fields}, text string")
