"""Iso-density curves: marching squares over a smoothed grid, and segments chained to closed curves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sides of a square between four cells, by number: its lower, right, upper and left one.
LOWER, RIGHT, UPPER, LEFT = 0, 1, 2, 3
#: Segments (from side, to side) of a square by which corners are inside (1 lower left, 2 lower right, 4 upper right, 8 upper left),
#: with the inside on their left; the two saddles stand as if the middle were outside.
SEGMENTS = {
    1: [(LOWER, LEFT)], 2: [(RIGHT, LOWER)], 3: [(RIGHT, LEFT)], 4: [(UPPER, RIGHT)], 5: [(LOWER, LEFT), (UPPER, RIGHT)], 6: [(UPPER, LOWER)], 7: [(UPPER, LEFT)],
    8: [(LEFT, UPPER)], 9: [(LOWER, UPPER)], 10: [(RIGHT, LOWER), (LEFT, UPPER)], 11: [(RIGHT, UPPER)], 12: [(LEFT, RIGHT)], 13: [(LOWER, RIGHT)], 14: [(LEFT, LOWER)],
}
#: The same saddles with the middle inside.
JOINED = {5: [(LOWER, RIGHT), (UPPER, LEFT)], 10: [(LEFT, LOWER), (RIGHT, UPPER)]}


def segments(grid: DataFrame, levels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of the curves at which ``grid`` (keys, ix, iy, density) crosses each of ``levels`` (keys, share, level).

    Returns keys, share, and start and end, each (side, px, py): where it stands on the line between two neighbouring cells'
    centres, in cells. A cell is inside from its level on; around the grid lies a ring of nothing, so curves are closed.
    Every cell is listed under the four squares that it is a corner of: one grouping and no join of the grid with itself.
    """
    corner = [(1, 0, 0), (2, 1, 0), (4, 1, 1), (8, 0, 1)]
    under = F.explode(F.array(*(F.struct(F.lit(bit).alias("bit"), (F.col("ix") - dx).alias("sx"), (F.col("iy") - dy).alias("sy")) for bit, dx, dy in corner))).alias("c")
    held = {bit: F.coalesce(F.max(F.when(F.col("c.bit") == bit, F.col("density"))), F.lit(0.0)).alias(f"d{bit}") for bit, _, _ in corner}
    squares = grid.select(*keys, "ix", "iy", "density", under).groupBy(*keys, F.col("c.sx").alias("sx"), F.col("c.sy").alias("sy")).agg(*held.values())
    level = F.col("level")
    marked = (squares.join(F.broadcast(levels), list(keys)) if keys else squares.join(F.broadcast(levels))).withColumn("inside", sum(F.when(F.col(f"d{bit}") >= level, bit).otherwise(0) for bit in held))
    between = lambda a, b: (level - F.col(f"d{a}")) / (F.col(f"d{b}") - F.col(f"d{a}"))
    sx, sy = F.col("sx"), F.col("sy")

    def at(side: int):
        place = {LOWER: (sx + between(1, 2), sy, 0, 0, 0), RIGHT: (sx + 1, sy + between(2, 4), 1, 0, 1), UPPER: (sx + between(8, 4), sy + 1, 0, 1, 0), LEFT: (sx, sy + between(1, 8), 0, 0, 1)}[side]
        px, py, right, up, upright = place
        name = F.concat_ws(",", (sx + right).cast("string"), (sy + up).cast("string"), F.lit("v" if upright else "h"))
        return F.struct(name.alias("side"), px.cast("double").alias("px"), py.cast("double").alias("py"))

    def pieces(found):
        return F.array(*(F.struct(at(a).alias("start"), at(b).alias("end")) for a, b in found))

    middle = (F.col("d1") + F.col("d2") + F.col("d4") + F.col("d8")) / 4 >= level
    which = F
    for case, found in SEGMENTS.items():
        plain = pieces(found)
        which = which.when(F.col("inside") == case, F.when(middle, pieces(JOINED[case])).otherwise(plain) if case in JOINED else plain)
    return marked.filter("inside between 1 and 14").select(*keys, "share", F.explode(which).alias("s")).select(*keys, "share", "s.start", "s.end")


def curves(grid: DataFrame, levels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The closed curves around the regions of each level: keys, share, curve, step, px, py.

    Curves are numbered from 0 by their first side in the order of names, where each begins, with the inside on the left.
    Chaining goes over the segments of one level of one grid, at most twice its squares, whatever the samples were.
    """
    on = [*keys, "share"]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(pdf.start, pdf.end, strict=True))
        at = dict(zip(pdf.start, zip(pdf.px, pdf.py, strict=True), strict=True))
        rows, number = [], 0
        for first in sorted(after):
            step, side = 0, first
            while side in after:
                rows.append((number, step, *at[side]))
                side, step = after.pop(side), step + 1
            number += step > 0
        out = pd.DataFrame(rows, columns=["curve", "step", "px", "py"])
        for k in reversed(on):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    flat = segments(grid, levels, keys).select(*on, F.col("start.side").alias("start"), F.col("end.side").alias("end"), "start.px", "start.py")
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema}
    return flat.groupBy(*on).applyInPandas(chain, ", ".join([*(f"`{k}` {kinds[k]}" for k in on), "curve int, step int, px double, py double"]))
