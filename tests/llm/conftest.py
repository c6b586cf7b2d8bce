from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with the driver's columns and some that clash with the operators' own."""

    def make(rows, langs=None):
        full = [(i, t, langs[k] if langs else "en", "s", None if t is None else len(t), "clash", 7) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS + ", row_id string, fp int")

    return make
