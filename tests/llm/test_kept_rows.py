"""Which rows the near-duplicate stage keeps when ids are missing or repeated."""

from __future__ import annotations

from predia.llm import simhash

SCHEMA = "doc_id long, text string, lang string"
A = "the quick brown fox jumps over the lazy dog near the old river bank"
B = "entirely other words stand in this line about ships harbours and rain"
C = "a third passage speaks of mountain villages goats cheese and winter snow"


def kept(spark, given):
    return sorted(map(tuple, simhash.first_of_each(spark.createDataFrame(given, SCHEMA)).collect()), key=repr)


def test_null_ids_stay_once_a_component(spark):
    given = [(None, A, "en"), (None, A, "en"), (None, B, "en"), (None, C, "en"), (4, C, "en")]
    assert kept(spark, given) == sorted([(None, A, "en"), (None, B, "en"), (4, C, "en")], key=repr)


def test_repeated_ids_with_other_texts_stay(spark):
    assert kept(spark, [(5, A, "en"), (5, B, "en"), (5, B, "en")]) == sorted([(5, A, "en"), (5, B, "en")], key=repr)


def test_the_row_kept_is_that_of_the_component(spark):
    for given in ([(1, A, "en"), (5, A, "en"), (5, B, "en")], [(5, B, "en"), (5, A, "en"), (1, A, "en")]):
        assert kept(spark, given) == [(1, A, "en"), (5, B, "en")]


def test_nulls_in_other_columns_do_not_mix_rows_up(spark):
    assert kept(spark, [(None, A, None), (None, None, A)]) == sorted([(None, A, None), (None, None, A)], key=repr)
