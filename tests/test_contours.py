"""Iso-density curves and equal maps against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zetasky.operators import contours
from zetasky.sources import tables


def crossings(g, level):
    """Points where the lines between neighbouring cells cross the level, with a ring of nothing around the grid."""
    p, out = np.pad(g, 1), []
    for i, j in np.ndindex(*p.shape):
        for dx, dy in ((1, 0), (0, 1)):
            if i + dx < len(p) and j + dy < len(p) and (p[i, j] >= level) != (p[i + dx, j + dy] >= level):
                t = (level - p[i, j]) / (p[i + dx, j + dy] - p[i, j])
                out.append((round(i - 1 + dx * t, 9), round(j - 1 + dy * t, 9)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_curves_are_closed_and_cross_every_line_once(spark, seed):
    rng = np.random.default_rng(seed)
    grids = {k: rng.integers(0, 6, (7, 7)).astype(float) for k in "ab"}
    grid = spark.createDataFrame([(k, i, j, float(g[i, j])) for k, g in grids.items() for i in range(7) for j in range(7)], "name string, ix int, iy int, density double")
    levels = {("a", 0.5): 2.5, ("a", 0.9): 3.0, ("b", 0.5): 4.5}
    rows = contours.curves(grid, spark.createDataFrame([(*k, v) for k, v in levels.items()], "name string, share double, level double"), ("name",)).collect()
    for (name, share), level in levels.items():
        loops = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r.curve, r.step)):
            if (r.name, r.share) == (name, share):
                loops[r.curve].append((r.px, r.py))
        assert sorted((round(x, 9), round(y, 9)) for loop in loops.values() for x, y in loop) == crossings(grids[name], level)
        area = 0.0
        for loop in loops.values():
            assert all(math.dist(a, b) < 1.5 for a, b in zip(loop, loop[1:] + loop[:1], strict=True))
            area += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1], strict=True)) / 2
        assert area > 0  # the inside is on the left
    assert sorted({r.curve for r in rows if (r.name, r.share) == ("a", 0.5)}) == list(range(1 + max(r.curve for r in rows if (r.name, r.share) == ("a", 0.5))))


def test_a_round_hill_has_round_curves(spark):
    n, sigma = 61, 9.0
    x, y = np.mgrid[:n, :n] - n // 2
    g = np.exp(-(x**2 + y**2) / (2 * sigma**2))
    grid = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(n) for j in range(n)], "ix int, iy int, density double")
    radii = {0.1: 6.3, 0.2: 15.7}
    levels = spark.createDataFrame([(s, math.exp(-(r**2) / (2 * sigma**2))) for s, r in radii.items()], "share double, level double")
    found = contours.curves(grid, levels).collect()
    assert {r.curve for r in found} == {0}
    for r in found:
        assert math.hypot(r.px - n // 2, r.py - n // 2) == pytest.approx(radii[r.share], abs=0.05)
    assert contours.curves(grid, levels.withColumn("level", F.lit(2.0))).count() == 0


def test_equal_maps(spark):
    i = F.col("id")
    one = spark.range(200).select(F.lit(0).alias("map_id"), F.lit(0).alias("zbin"), i.alias("pix"), F.sin(i).alias("g1"), F.cos(i).alias("g2"), F.lit(1.0).alias("w"))
    under = lambda df, m, z: df.withColumn("map_id", F.lit(m)).withColumn("zbin", F.lit(z))
    other = {
        (0, 1): one.orderBy(F.desc("pix")).repartition(3),
        (1, 0): one.filter("pix < 199"),
        (1, 1): one.withColumn("g1", F.when(i_is(7), F.col("g2")).otherwise(F.col("g1"))),
        (2, 0): one.withColumn("w", F.when(i_is(7), None).otherwise(F.col("w"))),
        (2, 1): one.union(one.filter("pix = 3")),
        (3, 0): one.withColumn("g1", F.when(F.col("pix") == 0, F.lit(-0.0)).otherwise(F.col("g1"))),
        (3, 1): one.withColumn("pix", F.col("pix") + 1),
    }
    every = one
    for (m, z), df in other.items():
        every = every.union(under(df, m, z))
    got = {(r.map_id, r.zbin): (r.same_map, r.same_zbin) for r in tables.equal_maps(every).collect()}
    assert got == {k: (0, 0) if k in ((0, 0), (0, 1), (3, 0)) else k for k in [(0, 0), *other]}
    assert tables.same_map(every, (0, 1), (3, 0)) and not tables.same_map(every, (0, 0), (1, 1)) and not tables.same_map(every, (0, 0), (9, 9)) and tables.same_map(every, (8, 8), (9, 9))


def i_is(n):
    return F.col("pix") == n
