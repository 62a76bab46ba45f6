import os

import pytest

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="session")
def model():
    from gazette.llm import sp_model

    if not os.path.exists(MODEL):
        pytest.skip("no vocabulary file")
    return sp_model.load(MODEL)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    rows = [(1, "", 0, "a"), (2, None, 1, None), (3, " \n\t ", 2, "b"), (4, "one two three", 3, "c"), (5, "word " * 30_000, 4, "d"), (6, "É ñ 日本 🎉 <b>&amp;", 5, "e"), (6, "É ñ 日本 🎉 <b>&amp;", 5, "e"), (None, "a row without an id", 6, "f"), (None, None, None, None)]
    return spark.createDataFrame([(*r, 0.5, "x", True) for r in rows], "doc_id long, text string, n_words long, spans string, score double, host string, kept boolean")
