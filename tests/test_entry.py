"""The driver's contract."""

import importlib.util

import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_corpus_queries_are_there_if_their_folder_is():
    names = {q for q in entry.queries() if q.startswith("op")}
    expected = 10 if importlib.util.find_spec("terrane.llm") else 0
    assert len(names) == expected
