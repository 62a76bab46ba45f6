"""Search of listings that forgives spelling: substrings, whole words, aliases, then similar words."""

from __future__ import annotations

import re
from collections.abc import Mapping
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gazette.data import SEARCH_FIELDS, SYNONYMS
from gazette.functions.text import search_form

LEAST_LENGTH, MOST_GAP, LEAST_RATIO = 4, 3, 0.78


def query_form(query: str) -> str:
    """search_form for the query itself."""
    x = re.sub(r"\b([a-zA-Z0-9]+)-([a-zA-Z0-9]+)\b", r"\1\2 \1 \2", query)
    return " ".join(re.sub(r"[^\w\s]", " ", x.lower()).split())


@lru_cache(maxsize=100_000)
def similar(token: str, word: str) -> bool:
    return SequenceMatcher(None, token, word).ratio() >= LEAST_RATIO


def _any_similar(token: str):
    @F.pandas_udf(BooleanType())
    def run(words: pd.Series) -> pd.Series:
        return pd.Series([w is not None and any(similar(token, x) for x in w) for w in words])

    return run


def _near(words: Column, length: int) -> Column:
    """The words of about this length."""
    return F.filter(words, lambda w: (F.length(w) >= LEAST_LENGTH) & (F.abs(F.length(w) - length) <= MOST_GAP))


def matches(text: Column, query: str, synonyms: Mapping[str, str] = SYNONYMS, fuzzy: bool = True) -> Column:
    """Whether the text answers the query. A blank query, or one of punctuation only, fits all; a
    substring of the raw or normalized text fits. Else each word of the query is replaced by what it
    stands for, and every word has to fit: as a substring, as what a word of the text stands for, by
    what it stands for itself, or by a similar word. A null text is an empty one. Only rows that the
    cheap conditions leave open send words to Python, and only words of about the word's length."""
    if not query.strip():
        return F.lit(True)
    raw, form = F.lower(F.coalesce(text, F.lit(""))), search_form(text)
    tokens = query_form(query.strip()).split()
    if not tokens:
        return F.lit(True)
    whole = raw.contains(query.strip().lower()) | form.contains(" ".join(tokens))
    words = F.array_distinct(F.split(form, " "))
    meant = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair]) if synonyms else None
    every = F.lit(True)
    for token in dict.fromkeys(t for given in tokens for t in synonyms.get(given, given).split()):
        fits = form.contains(token)
        standing = [w for w, means in synonyms.items() if token in means.split()]
        if standing:
            fits = fits | F.arrays_overlap(words, F.array(*map(F.lit, standing)))
        if token in synonyms:
            fits = fits | form.contains(synonyms[token])
        if fuzzy and len(token) >= LEAST_LENGTH:
            every_word = words
            if meant is not None:
                means = F.filter(F.transform(words, lambda w: F.try_element_at(meant, w)), lambda x: x.isNotNull())
                every_word = F.array_union(words, F.split(F.array_join(means, " "), " "))
            fits = fits | _any_similar(token)(F.when(~(whole | fits), _near(every_word, len(token))))
        every = every & fits
    return whole | every


def corpus(columns: list[str]) -> Column:
    """The searched fields that a table has, joined by spaces; arrays by their items."""
    found = [F.col(c) for c in SEARCH_FIELDS if c in columns]
    return F.concat_ws(" ", *found) if found else F.lit("")


def search(rows: DataFrame, fields: list[str], query: str, synonyms: Mapping[str, str] = SYNONYMS, fuzzy: bool = True) -> DataFrame:
    """rows whose fields, joined by spaces, answer the query."""
    return rows.filter(matches(F.concat_ws(" ", *fields), query, synonyms, fuzzy))
