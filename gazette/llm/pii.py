"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``://``, digit shapes that begin a
number, and cue words in front of identifiers. A small deterministic parser then expands each
anchor to the span around it and validates it.

Base kinds (leftmost, non-overlapping per kind, failing matches dropped without a retry): email,
ip, card, phone. Added kinds: url (scheme up to white space, trailing punctuation left out),
secret (value after a cue word, = or :, in quotes or bare, and access key ids), account (IBAN by mod 97, or
6 to 20 digits and letters after an account cue). Added spans never replace base ones.

Cases: a null or empty text has no spans; positions are code points, end exclusive; a null doc_id
passes through; repeated rows give repeated rows; an empty table gives an empty result. Texts of
any length are searched whole, in one linear pass. Detection reads the id and text columns only;
redaction replaces the text column and keeps the others, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import mapped

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "secret", "account")
KINDS = BASE_KINDS + ADDED_KINDS

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"://[^\s<>\"']+")
#: Behind a secret cue: a sign between blanks (the cue may be a quoted key), then a value in quotes or a bare one.
SECRET = re.compile(r"""["']?[ \t]*(?::=|=>|[=:])[ \t]*(?:"(?![ \t])([^"\r\n]{6,})"|'(?![ \t])([^'\r\n]{6,})'|["']?([^\s"'<>,;]{6,}))""")
ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[\s:#.]{0,3}((?:[A-Z]{2}[0-9]{2}[\x20]?)?[A-Z0-9](?:[\x20-]?[A-Z0-9]){5,33})")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"

#: Cue words in front of a value; the search finds them in any case.
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")
ACCOUNT_CUES = ("iban", "account no", "account number", "acct", "konto")


@cache
def _anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ("@", "://", "AKIA", "ASIA"):
        a.add_word(word, (word, len(word)))
    for x in DIGITS:
        a.add_word(f"+{x}", ("phone", 2))
        for y in DIGITS:
            a.add_word(f"{x}.{y}", ("ip", 3))
            for sep in ("", " ", "-"):
                a.add_word(f"{x}{sep}{y}", ("card", 2 + len(sep)))
    for cues, kind in ((SECRET_CUES, "secret"), (ACCOUNT_CUES, "account")):
        for cue in cues:
            for form in product(*({c, c.upper()} for c in cue)):
                a.add_word("".join(form), (kind, len(cue)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = re.sub(r"[\x20-]", "", text)
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their starts."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)
    for end, (what, size) in _anchors().iter(text):
        at = end - size + 1
        if what == "card":
            if at >= past["card"]:
                m = CARD.match(text, at)
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(m.span())
        elif what == "@":
            s = at
            while s > past["email"] and text[s - 1] in LOCAL:
                s -= 1
            m = DOMAIN.match(text, at + 1) if s < at else None
            if m:
                past["email"] = m.end()
                found["email"].append((s, m.end()))
        elif what == "ip":
            s = at
            if s < past["ip"]:
                continue
            while s > past["ip"] and text[s - 1] in DIGITS:
                s -= 1
            m = IP.match(text, s)
            if m:
                past["ip"] = m.end()
                if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                    found["ip"].append(m.span())
        elif what == "phone":
            m = PHONE.match(text, at) if at >= past["phone"] else None
            if m:
                past["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "://":
            s = at
            while s > past["url"] and text[s - 1].isascii() and text[s - 1].isalpha():
                s -= 1
            m = URL.match(text, at) if s < at else None
            if m:
                e = at + len(m[0].rstrip(".,;:!?)]}"))
                past["url"] = m.end()
                if e > at + 3:
                    found["url"].append((s, e))
        elif what in ("AKIA", "ASIA"):
            m = ACCESS_KEY.match(text, at) if at >= past["secret"] and not (at and text[at - 1].isalnum()) else None
            if m:
                past["secret"] = m.end()
                found["secret"].append(m.span())
        elif what == "secret":
            m = SECRET.match(text, end + 1) if end + 1 >= past["secret"] else None
            if m:
                past["secret"] = m.end()
                found["secret"].append(m.span(m.lastindex))
        else:
            m = ACCOUNT.match(text, end + 1) if end + 1 >= past["account"] and not (at and text[at - 1].isalnum()) else None
            if m and sum(c in DIGITS for c in m[1]) >= 6:
                # an IBAN may be followed by further capitals: take the longest valid beginning
                stop = next((k for k in range(m.end(1), m.start(1) + 14, -1) if _iban(text[m.start(1) : k])), None)
                tail = re.match(r"[A-Z0-9]{6,20}(?![A-Za-z0-9])", text[m.start(1) : m.start(1) + 21])
                stop = stop or (m.start(1) + tail.end() if tail else None)
                if stop:
                    past["account"] = stop
                    found["account"].append((m.start(1), stop))
    return found


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in capitals; overlapping spans become one, named
    after the kind that comes first in KINDS among those that start first."""
    spans = sorted((s, KINDS.index(k), e) for k, v in found.items() for s, e in v)
    out, at, i = [], 0, 0
    while i < len(spans):
        s, kind, e = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][2])
            i += 1
        out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = e
    return "".join([*out, text[at:]]) if out else text


SCHEMA = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} bigint" for k in ADDED_KINDS)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """One row a document: counts by kind, the digest of the base spans, all spans as
    ``kind:start:end``, and on request the redacted text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = SCHEMA + (", redacted string" if with_redacted else "")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        clean = []
        for text in b.column("text").to_pylist():
            text = text or ""
            found = find_spans(text)
            for k in KINDS:
                out[f"n_{k}"].append(len(found[k]))
            out["base_sha256"].append(hashlib.sha256(_joined(found, BASE_KINDS).encode()).hexdigest())
            out["spans"].append(_joined(found, KINDS))
            if with_redacted:
                clean.append(redact(text, found))
        cols = {"doc_id": b.column("doc_id")} | {f"n_{k}": pa.array(out[f"n_{k}"], pa.int64()) for k in BASE_KINDS}
        cols |= {c: pa.array(out[c], pa.string()) for c in ("base_sha256", "spans")}
        cols |= {f"n_{k}": pa.array(out[f"n_{k}"], pa.int64()) for k in ADDED_KINDS}
        if with_redacted:
            cols["redacted"] = pa.array(clean, pa.string())
        return pa.RecordBatch.from_pydict(cols)

    return mapped(rows, run, schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind; all other columns as they are."""
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redact(t, find_spans(t)) for t in b.column(at).to_pylist()]
        return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return mapped(docs, run, docs.schema)
