"""Columns of the input that have the operators' own names, and passes over a large benchmark."""

import pytest

from zetasky.llm import decontam, langid


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, hits string, Fit int")


def test_clashing_columns_stay(spark):
    rows = [(1, "the house over there with things", "en", "mine", 1), (2, "12 34", "en", "", 2)]
    clean = decontam.keep_clean(frame(spark, rows), spark.createDataFrame([(5, "something else entirely")], "item_id long, text string"))
    assert clean.columns == frame(spark, rows).columns and sorted(map(tuple, clean.collect())) == rows
    kept = langid.keep_identified(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and list(map(tuple, kept.collect())) == rows[:1]


@pytest.mark.parametrize("chars", [30, 10**6])
def test_passes_find_the_same(spark, monkeypatch, chars):
    monkeypatch.setattr(decontam, "PASS_CHARS", chars)
    items = spark.createDataFrame([(i, f"benchmark question number {i} about the {w} of things") for i, w in enumerate(("colour and taste", "weight", "smell of old", "number of small"))], "item_id long, text string")
    texts = [(i, f"x {r.text} y" if i % 3 else "nothing here", "en", None, 0) for i, r in enumerate(items.orderBy("item_id").collect() * 2)]
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(frame(spark, texts), items).collect()}
    assert got == {i: str(i % 4) if i % 3 else "" for i in range(8)}
