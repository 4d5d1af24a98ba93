"""op6_exact_top_k on a table with repeated ids, against its SQL."""

import random

import numpy as np
import pytest

from zetasky.llm import queries


def test_repeated_ids_count_as_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    vector = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(5)]
    rows = [(i % 260, vector()) for i in range(400)]
    rows += [rows[150]] * 13 + [rows[100]] * 3 + [(500, [0.0] * 5), (None, [9.0] * 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(db.execute(queries.ORACLES["op6_exact_top_k"]).fetchall())
    assert len(want) == 40
    assert sorted(map(tuple, queries.op6_exact_top_k(spark, str(tmp_path)).collect())) == want
