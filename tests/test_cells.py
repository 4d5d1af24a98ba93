"""Pairs, filters and sums that the patches of a cell of the sky share."""

import pytest
from pyspark.sql import functions as F

from zetasky.functions import healpix
from zetasky.operators import aperture, discs
from zetasky.plans.engine import Correlation
from zetasky.plans.params import Params

SMALL = Params(nside=16, nbins=3, theta_min=150.0, theta_max=1400.0, patch_size=900.0, theta_q=300.0, filter_radius=800.0)


def centres(spark, n):
    """Patches about one place, then one far away."""
    i = F.col("id")
    return spark.range(n + 1).select(i.cast("int").alias("patch_id"), F.when(i < n, 1.0 + i * 0.001).otherwise(4.0).alias("phi_center"), F.when(i < n, 1.2).otherwise(2.0).alias("theta_center"))


def shear(spark):
    """Two redshift bins; every fifth pixel lacks the second, and some fields and weights are null."""
    i = F.col("id")
    both = spark.range(SMALL.npix).select(i, F.explode(F.when(i % 5 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("zbin"))
    some = lambda c, n: F.when(i % n != 3, c)
    return both.select(F.lit(0).alias("map_id"), "zbin", i.alias("pix"), some(F.sin(i * 0.7 + F.col("zbin")), 7).alias("g1"), some(F.cos(i * 1.3), 7).alias("g2"), some(1.0 + i % 3, 11).alias("w"))


def rows(df):
    return {tuple(r)[:5]: tuple(r)[5:] for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    for k, row in want.items():
        assert [x is None for x in got[k]] == [x is None for x in row], k
        assert [x or 0 for x in got[k]] == pytest.approx([x or 0 for x in row], rel=1e-9, abs=1e-9), k


def test_a_store_does_not_grow_with_patches_of_one_place(spark, tmp_path):
    found = {}
    for n in (2, 12):
        Correlation(spark, SMALL, centres(spark, n)).save_pairs(str(tmp_path / str(n)))
        found[n] = spark.read.parquet(str(tmp_path / str(n) / "pairs")).count()
    assert found[12] < 1.1 * found[2]  # six times, with pairs of every patch


def test_discs_are_covered_by_many_tasks(spark, monkeypatch):
    """However few files the centres come in."""
    tasks, cover = [], discs.covering_cells
    monkeypatch.setattr(discs, "covering_cells", lambda df, *rest: tasks.append(df.rdd.getNumPartitions()) or cover(df, *rest))
    engine = Correlation(spark, SMALL, centres(spark, 12).coalesce(1))
    assert engine.members.count() > 0 and engine.filters.count() > 0
    assert tasks == [4, 4]


def test_patches_of_a_pair_are_found_once(spark):
    found = Correlation(spark, SMALL, centres(spark, 12)).cell_pairs
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "arrays_overlap" not in plan


def test_centres_of_cells_step_by_step(spark):
    """Cells of a level have the centres that the formula gives at once, and none is read by a plan that repeats it."""
    subcells = spark.range(12 * 64).selectExpr("cast(id div 64 as int) as face", "cast(id div 8 % 8 as int) as ix", "cast(id % 8 as int) as iy")
    at_once = healpix.face_to_sky(F.col("face"), F.col("ix"), F.col("iy"), 8)
    both = healpix.with_face_centre(subcells, 8).select("face_x", "face_y", "face_z", *at_once).collect()
    assert len(both) == 768 and all(tuple(r)[:3] == tuple(r)[3:] for r in both)
    discs_at = spark.range(1).selectExpr("1 as patch_id", "1d as px", "0d as py", "0d as pz")
    plan = discs.covering_cells(discs_at, 0.1, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at") <= 2 * 4  # two a level, and four levels


def test_ends_and_decks_and_masses(spark, monkeypatch):
    engine, fields = Correlation(spark, SMALL, centres(spark, 5)), shear(spark)
    sums = engine.ends(fields).groupBy("map_id", "patch_id", "bin", "za", "zb").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("ww", "r1", "i1", "r2", "i2")))
    want = rows(sums)
    close(rows(engine.end_sums(fields).select(*sums.columns)), want)
    masses = lambda filters: {tuple(r)[:3]: tuple(r)[3:] for r in aperture.aperture_mass(filters, fields, SMALL).collect()}
    close(masses(engine.filters), masses(engine.filters.drop("cell")))
    xi = rows(engine.xi(fields))
    monkeypatch.setattr(discs, "PATCHES_TOGETHER", 2)
    dealt = Correlation(spark, SMALL, centres(spark, 5))
    assert dealt.members.groupBy("cell").agg(F.countDistinct("patch_id").alias("n")).agg(F.max("n")).first()[0] == 2
    close(rows(dealt.xi(fields)), xi)
    salted = Correlation(spark, SMALL, centres(spark, 5), salt=3)
    close(rows(salted.end_sums(fields).select(*sums.columns)), want)
