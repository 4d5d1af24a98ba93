"""Queries against their DuckDB twins, on the smallest tables and on odd rows."""

import pytest

from zetasky.llm import queries

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t "), (4, "one two"), (5, "One TWO"), (6, "É é É é x"), (7, "a b c d e f g h " * 9), (8, "A b c d e f g h " * 9), (9, "0123456789" * 12), (10, "9" + "0123456789" * 12 + "é"), (10, "x" + "0123456789" * 6), (None, "0123456789" * 12), (None, None)]


def same(spark, name, sf_dir, table):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{table}')")
    got = queries.QUERIES[name](spark, sf_dir)
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op4_suffix_dedup", "op10_sharding"])
def test_twins_agree(spark, tmp_path, name):
    same(spark, name, SF, f"{SF}/documents.parquet")
    spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, name, str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")
