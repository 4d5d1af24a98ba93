"""op10_sharding stores its map's versions and places by what it reads back."""

from pyspark.sql import functions as F

from zetasky.llm import queries, sharding, util


def test_query_stores_both_versions(spark, tmp_path, monkeypatch):
    for module in (queries, util):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    spark.range(300).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op10_sharding(spark, str(tmp_path)).collect()
    (folder,) = map(str, tmp_path.glob("zetasky-map-*"))
    start, grown = sharding.read_map(spark, folder, 1), sharding.read_map(spark, folder, 2)
    assert start == sharding.initial_map(16) and grown == sharding.grow(start) and sharding.read_map(spark, folder) == grown
    assert len(rows) == 300 and all((r.shard, r.grown_shard, r.map_version) == (start[r.vslot], grown[r.vslot], 1) for r in rows)
