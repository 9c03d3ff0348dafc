"""The entry point with and without the training-corpus operators."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as E
from predia import registry


@pytest.mark.parametrize("hidden", ["predia.llm", "predia.llm.queries", "corpus_pipeline", "public_tokenizers"])
def test_other_queries_work_without_the_training_operators(monkeypatch, hidden):
    for name in [m for m in sys.modules if m.startswith("predia.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)  # importing it raises ImportError
    assert set(E.queries()) == set(registry.load())
    assert set(E.oracle_sql()) == {n for n, (_, sql) in registry.load().items() if sql is not None}


def test_every_sql_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries())
