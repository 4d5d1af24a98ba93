"""Density tables of posterior samples for contour and corner plots."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bounds(samples: DataFrame, *columns: str) -> DataFrame:
    return samples.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))


def _cell(column: str, bins: int):
    at = F.floor((F.col(column) - F.col(f"lo_{column}")) / (F.col(f"hi_{column}") - F.col(f"lo_{column}")) * bins)
    return F.least(at, F.lit(bins - 1)).cast("int")


def hist2d(samples: DataFrame, x: str, y: str, bins: int = 200) -> DataFrame:
    """ix, iy, count over the samples' range in cells of equal width; the last cell holds the upper edge."""
    inside = samples.select(x, y).dropna()
    return inside.join(F.broadcast(_bounds(inside, x, y))).groupBy(_cell(x, bins).alias("ix"), _cell(y, bins).alias("iy")).agg(F.count("*").alias("count"))


def grid_centres(samples: DataFrame, x: str, bins: int = 200) -> DataFrame:
    """ix and the centre of its cell."""
    width = (F.col(f"hi_{x}") - F.col(f"lo_{x}")) / bins
    cells = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("ix"))
    return cells.join(F.broadcast(_bounds(samples.select(x).dropna(), x))).select("ix", (F.col(f"lo_{x}") + (F.col("ix") + 0.5) * width).alias("center"))


def smooth_grid(counts: DataFrame, bins: int, sigma: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian smoothing of the histogram of each of ``keys`` on its whole grid, mirrored at the edges: keys, ix, iy, density.

    One axis after the other, so a cell becomes as many rows as the kernel has taps and not their square.
    """
    radius = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    spark = counts.sparkSession
    kernel = spark.createDataFrame([(i, w / sum(taps)) for i, w in zip(range(-radius, radius + 1), taps, strict=True)], "step int, weight double")
    line = spark.range(bins).select(F.col("id").cast("int").alias("i"))
    turn = F.pmod(F.col("i") + F.col("step"), F.lit(2 * bins))  # a kernel wider than the grid is mirrored again and again
    mirrored = F.when(turn >= bins, 2 * bins - 1 - turn).otherwise(turn)
    axis = line.join(F.broadcast(kernel)).select("i", mirrored.alias("source"), "weight").groupBy("i", "source").agg(F.sum("weight").alias("weight"))

    def along(cells: DataFrame, this: str, other: str) -> DataFrame:
        spread = cells.join(F.broadcast(axis.withColumnRenamed("source", this)), this)
        return spread.groupBy(*keys, F.col("i").alias(this), other).agg(F.sum(F.col("mass") * F.col("weight")).alias("mass"))

    spread = along(along(counts.select(*keys, "ix", "iy", F.col("count").cast("double").alias("mass")), "ix", "iy"), "iy", "ix")
    grid = line.select(F.col("i").alias("ix")).join(line.select(F.col("i").alias("iy")))
    grid = counts.select(*keys).distinct().join(grid) if keys else grid
    return grid.join(spread, [*keys, "ix", "iy"], "left").select(*keys, "ix", "iy", F.coalesce("mass", F.lit(0.0)).alias("density"))


def running_mass(grid: DataFrame, keys: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """``grid`` (keys, ix, iy, density) without empty cells, with the mass of all cells of the same keys that are as dense or come before
    in order of falling density, and the total.

    Cells are dealt to parts by density, cut where a sketch of bounded size says that parts are of equal size; each part is
    summed by itself, and the mass of the denser parts is added from their totals. So no task orders a whole grid.
    """
    dense = grid.filter("density > 0")
    shares = [i / parts for i in range(1, parts)] or [0.0]
    found = dense.groupBy(*keys).agg(F.percentile_approx("density", shares, 100 * parts).alias("cuts"))
    on = lambda df, other, *more: df.join(F.broadcast(other), [*keys, *more]) if keys or more else df.join(F.broadcast(other))
    part = F.size(F.filter(F.array_distinct("cuts"), lambda c: c > F.col("density"))).alias("part")
    placed = on(dense, found).select(*keys, "ix", "iy", "density", part)
    by = f"partition by {', '.join(keys)}" if keys else ""
    totals = placed.groupBy(*keys, "part").agg(F.sum("density").alias("own"))
    before = totals.selectExpr(*keys, "part", f"sum(own) over ({by} order by part) - own as denser", f"sum(own) over ({by}) as total")
    inside = f"sum(density) over (partition by {', '.join([*keys, 'part'])} order by density desc, ix, iy rows unbounded preceding)"
    return on(placed, before, "part").selectExpr(*keys, "ix", "iy", "density", f"denser + {inside} as mass", "total")


def hpd_levels(grid: DataFrame, shares: tuple[float, ...] = (0.99, 0.95, 0.68), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, share, level: density of the cell at which the densest cells' mass first exceeds the share; none of an empty grid."""
    wanted = grid.sparkSession.createDataFrame([(s,) for s in shares], "share double")
    beyond = running_mass(grid, keys).join(F.broadcast(wanted), F.col("mass") > F.col("share") * F.col("total"))
    return beyond.groupBy(*keys, "share").agg(F.max("density").alias("level"))


def corner_hist2d(samples: DataFrame, columns: tuple[str, ...], bins: int = 200) -> DataFrame:
    """x, y, ix, iy, count for every pair of ``columns``, the earlier one as x: the histograms of a corner plot.

    One pass over the samples for the bounds and one for all pairs, each pair over the samples that have both values.
    """
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    both = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull()
    bounds = samples.agg(*(f(F.when(both(x, y), F.col(c))).alias(f"{n}_{k}_{a}") for k, (x, y) in enumerate(pairs) for a, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))))

    def cell(k: int, a: str, c: str):
        low, high = F.col(f"lo_{k}_{a}"), F.col(f"hi_{k}_{a}")
        return F.least(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")

    cells = F.array(*(F.when(both(x, y), F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), cell(k, "x", x).alias("ix"), cell(k, "y", y).alias("iy"))) for k, (x, y) in enumerate(pairs)))
    spread = samples.select(*columns).join(F.broadcast(bounds)).select(F.explode(cells).alias("c")).filter("c is not null").select("c.*")
    return spread.groupBy("x", "y", "ix", "iy").agg(F.count("*").alias("count"))


def contour_table(samples: DataFrame, columns: tuple[str, ...], bins: int = 200, sigma: float = 0.5, shares: tuple[float, ...] = (0.99, 0.95, 0.68), truth: dict[str, float] | None = None) -> DataFrame:
    """What a corner plot draws: x, y, ix, iy, density, inside (the smallest share whose region holds the cell, null outside
    all) and is_truth (the cell of the given true values; false without them), for every pair of ``columns``."""
    keys = ("x", "y")
    grid = smooth_grid(corner_hist2d(samples, columns, bins), bins, sigma, keys)
    levels = hpd_levels(grid, shares, keys)
    inside = grid.join(F.broadcast(levels), list(keys)).groupBy(*keys, "ix", "iy", "density").agg(F.min(F.when(F.col("density") >= F.col("level"), F.col("share"))).alias("inside"))
    if not truth:
        return inside.withColumn("is_truth", F.lit(False))
    marked = samples.sparkSession.createDataFrame([tuple(float(truth[c]) for c in columns)], ", ".join(f"`t_{c}` double" for c in columns))
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    at = []
    for x, y in pairs:
        place = _bounds(samples.select(x, y).dropna(), x, y).join(marked.select(F.col(f"t_{x}").alias(x), F.col(f"t_{y}").alias(y)))
        at.append(place.select(F.lit(x).alias("x"), F.lit(y).alias("y"), _cell(x, bins).alias("ix"), _cell(y, bins).alias("iy")))
    places = at[0]
    for more in at[1:]:
        places = places.union(more)
    return inside.join(F.broadcast(places.withColumn("is_truth", F.lit(True))), [*keys, "ix", "iy"], "left").withColumn("is_truth", F.coalesce("is_truth", F.lit(False)))


#: Values that are counted one by one once a quantile's rank is known to lie among them, and the sketch's relative accuracy.
MOST_VALUES, ACCURACY = 10_000, 10_000


def exact_quantiles(samples: DataFrame, x: str, shares: tuple[float, ...], most_values: int = MOST_VALUES, accuracy: int = ACCURACY) -> list[float] | None:
    """Quantiles of a column's values by linear interpolation, exact whatever the table: None without values.

    A sketch of bounded size brackets the two ranks that a quantile lies between; a second pass counts what stands before the
    bracket and in it. While too many are in, the bracket is sketched again; at last the few values left are counted one by
    one. No aggregate holds more than the sketch or ``most_values`` values, and the driver gets a few numbers a pass.
    """
    values = samples.select(F.col(x).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return None
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    found: dict[int, float] = {}
    # of each rank: least and greatest value of its bracket, rank among the bracket's rows, their number, and the sketch's slack
    brackets = {r: (edges.lo, edges.hi, r, n, 2 / accuracy) for r in ranks}
    inside = lambda lo, hi: (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))
    while True:
        for r, (lo, hi, k, size, _) in list(brackets.items()):
            if lo == hi:
                found[r] = lo
            elif size <= most_values:
                listed = values.filter(inside(lo, hi)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()
                sums = list(accumulate(row.n for row in listed))
                found[r] = listed[bisect_right(sums, k)].v
        brackets = {r: b for r, b in brackets.items() if r not in found}
        if not brackets:
            break
        shares_of = lambda k, size, slack: [max(0.0, (k + 1) / size - slack), min(1.0, (k + 1) / size + slack)]
        guess = values.agg(*(F.percentile_approx(F.when(inside(lo, hi), F.col("v")), shares_of(k, size, slack), accuracy).alias(f"q{r}") for r, (lo, hi, k, size, slack) in brackets.items())).first()
        sums = []
        for r, (lo, hi, *_) in brackets.items():
            low, high = guess[f"q{r}"]
            below, above = inside(lo, hi) & (F.col("v") < F.lit(low)), inside(lo, hi) & (F.col("v") > F.lit(high))
            sums += [F.count_if(below).alias(f"below{r}"), F.count_if(inside(low, high)).alias(f"within{r}"), F.max(F.when(below, F.col("v"))).alias(f"under{r}"), F.min(F.when(above, F.col("v"))).alias(f"over{r}")]
        got = values.agg(*sums).first()
        for r, (lo, hi, k, size, _) in list(brackets.items()):
            below, within = got[f"below{r}"], got[f"within{r}"]
            if k < below:
                new = lo, got[f"under{r}"], k, below
            elif k < below + within:
                new = *guess[f"q{r}"], k - below, within
            else:
                new = got[f"over{r}"], hi, k - below - within, size - below - within
            brackets[r] = *new, 2 / accuracy if 2 * new[3] < size else 0.0  # without slack a single value splits the bracket
    mix = lambda a: found[math.floor(a)] if a == math.floor(a) else found[math.floor(a)] + (a - math.floor(a)) * (found[math.ceil(a)] - found[math.floor(a)])
    return [mix(a) for a in at]


def hist1d_density(samples: DataFrame, x: str) -> DataFrame:
    """bin, center, count, density; the width is the lesser of Freedman-Diaconis's and Sturges's.

    Quartiles are exact and found in passes of bounded memory, see ``exact_quantiles``; without values there are no bins.
    """
    inside = samples.select(F.col(x).cast("double").alias("v")).filter("v is not null")
    low, high = exact_quantiles(samples, x, (0.25, 0.75)) or (None, None)
    quartiles = F.lit(None if low is None else high - low).cast("double").alias("iqr")
    stats = inside.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("n > 0").select("*", quartiles)
    spread = F.col("hi") - F.col("lo")
    freedman = 2 * F.col("iqr") / F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    sturges = spread / (F.log2(F.col("n").cast("double")) + 1)
    width = F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges)
    ready = stats.withColumn("bins", F.when(spread > 0, F.ceil(spread / width)).otherwise(1).cast("int"))
    placed = inside.join(F.broadcast(ready)).withColumn("bin", F.when(spread > 0, F.least(F.floor((F.col("v") - F.col("lo")) / spread * F.col("bins")), F.col("bins") - 1)).otherwise(0).cast("int"))
    counted = placed.groupBy("bin").agg(F.count("*").alias("count"))
    cells = ready.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    step = spread / F.col("bins")
    filled = F.coalesce("count", F.lit(0)).cast("long")
    return cells.join(counted, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * step).alias("center"), filled.alias("count"), F.try_divide(filled.cast("double"), F.col("n") * step).alias("density"))


def marginal_summary(samples: DataFrame, x: str) -> DataFrame:
    """mode (centre of the fullest bin, the first of equals) and population standard deviation."""
    fullest = hist1d_density(samples, x).agg(F.max_by("center", F.struct("count", -F.col("bin"))).alias("mode"))
    return fullest.join(F.broadcast(samples.agg(F.stddev_pop(x).alias("std"))))
