"""Pixel pairs of each patch by angular separation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zetasky.functions import geometry, healpix
from zetasky.functions.geometry import arcmin
from zetasky.plans.params import Params

ENDS = ("ra1", "dec1", "ra2", "dec2")
#: Cells of a grid whose edge is the greatest separation: a cell itself and the half of its neighbours that come after it.
AHEAD = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]


def part_of(pix: str, salt: int) -> Column:
    """The part of a patch's pairs that those with this first pixel belong to."""
    return F.pmod(F.xxhash64(pix), F.lit(salt)).cast("int") if salt > 1 else F.lit(0)


def candidate_pairs(members: DataFrame, salt: int = 1, keys: tuple[str, ...] = ("patch_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs of a patch's pixels, each once: ``keys``, part, and pix, ra, dec and the columns to ``carry`` of both ends.

    The join's keys are the patch and what else tells groups of pixels apart, such as the map. With large patches or
    few on many executors, ``salt`` spreads each over that many tasks: the left side is dealt by pixel and the right
    side repeated.
    """
    side = lambda end: members.select(*keys, *(F.col(c).alias(f"{c}{end}") for c in ("pix", "ra", "dec", *carry)))
    left, right, on = side(1), side(2), list(keys)
    if salt > 1:
        left = left.withColumn("part", part_of("pix1", salt))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("part")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given: by the bytes of pixels, few tasks would get all pairs
    joined = left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).filter("pix1 < pix2")
    return joined if salt > 1 else joined.withColumn("part", F.lit(0))


def on_grid(members: DataFrame, distance: float) -> DataFrame:
    """``members`` (ra, dec) with the cell (cx, cy, cz) of their unit vector on a grid whose edge is the chord of ``distance`` in
    radians: what is no farther apart lies in the same cell or in neighbours."""
    edge = 2 * math.sin(min(math.pi, distance) / 2) * (1 + 1e-9)
    xyz = geometry.radec_to_xyz(F.col("ra"), F.col("dec"))
    return healpix.computed(members.withColumns({f"c{a}": F.floor(v / edge).cast("int") for a, v in zip("xyz", xyz, strict=True)}), "cx", "cy", "cz")


def near_pairs(members: DataFrame, distance: float, keys: tuple[str, ...] = ("patch_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``candidate_pairs``, of pixels in the same or in neighbouring cells of a grid of edge ``distance``: all pairs that are no
    farther apart are among them, and their number grows with the square of ``distance`` instead of the patch's.

    Every pair of cells meets once, since the right side is listed under its own cell and under those that come before
    it. A cell holds as many pixels as the resolution puts there, so no key is hot.
    """
    placed = on_grid(members, distance)
    side = lambda end: placed.select(*keys, "cx", "cy", "cz", *(F.col(c).alias(f"{c}_{end}") for c in ("pix", "ra", "dec", *carry)))
    steps = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for a, v in zip("xyz", step, strict=True))) for step in AHEAD))).alias("step")
    right = side("b").select("*", steps).withColumns({f"c{a}": F.col(f"c{a}") - F.col(f"step.d{a}") for a in "xyz"})
    same = (F.col("step.dx") == 0) & (F.col("step.dy") == 0) & (F.col("step.dz") == 0)
    joined = side("a").join(right, [*keys, "cx", "cy", "cz"]).filter(~same | (F.col("pix_a") < F.col("pix_b")))
    first = F.col("pix_a") < F.col("pix_b")
    ends = [F.when(first if end == 1 else ~first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}{end}") for end in (1, 2) for c in ("pix", "ra", "dec", *carry)]
    return joined.select(*keys, *ends)


def binned_pairs(candidates: DataFrame, params: Params) -> DataFrame:
    """Candidates whose separation lies inside a bin, with the bin.

    Each pair's separation is computed once: the comparisons with the edges, which stand in a filter, see a plain column.
    """
    edges = params.edges()
    apart = healpix.computed(candidates.withColumn("distance", geometry.separation(*(F.col(c) for c in ENDS))), "distance")
    inside = apart.filter((F.col("distance") > edges[0]) & (F.col("distance") < edges[-1]))
    return inside.withColumn("bin", params.bin_of(F.col("distance"))).drop("distance").filter("bin is not null")


def pairs(members: DataFrame, params: Params, salt: int = 1, keys: tuple[str, ...] = ("patch_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, part, bin, pix1, pix2, both spin-2 phases and the carried columns of both ends, for separations inside a bin.

    Pixels meet by neighbouring cells where the greatest separation is small beside the patch (``params.by_cells``), else as
    all pairs of the patch.
    """
    if params.by_cells:
        near = near_pairs(members, arcmin(params.theta_max), keys, carry).withColumn("part", part_of("pix1", salt))
    else:
        near = candidate_pairs(members, salt, keys, carry)
    phases = geometry.pair_phases(*(F.col(c) for c in ENDS))
    return binned_pairs(near, params).select(*keys, "part", "bin", "pix1", "pix2", *(c.alias(k) for k, c in phases.items()), *(f"{c}{end}" for c in carry for end in (1, 2)))


def shared_pairs(members: DataFrame, params: Params) -> DataFrame:
    """Each pair of pixels once for all patches that hold both: bin, pix1, pix2, both phases and the sorted patches.

    Where patches overlap, a pair's separation and phases are computed once and not once for each patch. Pixels carry
    their patches, meet by neighbouring cells of the sky, and pairs without a common patch go before anything is computed.
    """
    held = members.groupBy("pix").agg(F.first("ra").alias("ra"), F.first("dec").alias("dec"), F.array_sort(F.collect_set("patch_id")).alias("patches"))
    near = near_pairs(held, arcmin(params.theta_max), (), ("patches",)).filter(F.arrays_overlap("patches1", "patches2"))
    phases = geometry.pair_phases(*(F.col(c) for c in ENDS))
    common = F.array_sort(F.array_intersect("patches1", "patches2")).alias("patches")
    return binned_pairs(near, params).select("bin", "pix1", "pix2", *(c.alias(k) for k, c in phases.items()), common)


def by_cell(members: DataFrame, *keys: str) -> DataFrame:
    """The pixels of every cell's patches, each once with the patches that hold it: cell, pix, patches. Other ``keys`` than the cell can be
    given."""
    keys = keys or ("cell",)
    return members.groupBy(*keys, "pix").agg(F.collect_list(F.col("patch_id").cast("int")).alias("patches"))


def cell_pairs(members: DataFrame, params: Params, salt: int = 1, held: bool = True) -> DataFrame:
    """Pairs of the pixels (patch_id, cell, pix) of a cell's patches, each once for all of them: cell, part, bin, pix1, pix2, both phases
    and the patches that hold both.

    However many patches overlap in a cell, its pairs are those of a disc that the parameters bound. ``held`` false leaves the patches
    out, and keeps pairs that no patch holds.
    """
    phi, theta = healpix.pixel_to_sky(F.col("pix"), params.nside)
    placed = healpix.computed(by_cell(members).withColumns({"ra": phi, "dec": math.pi / 2 - theta}), "ra", "dec")
    if not held:
        return pairs(placed.drop("patches"), params, salt, ("cell",))
    found = pairs(placed, params, salt, ("cell",), ("patches",)).withColumn("patches", F.array_intersect("patches1", "patches2")).drop("patches1", "patches2")
    return healpix.computed(found, "patches").filter(F.size("patches") > 0)  # computed once: a test of its own would go through both lists again


def by_patch(shared: DataFrame, salt: int = 1) -> DataFrame:
    """Shared pairs under each of their patches, as ``pairs`` gives them."""
    part = F.col("part") if "part" in shared.columns else part_of("pix1", salt).alias("part")
    return shared.select(F.explode("patches").alias("patch_id"), part, *(c for c in shared.columns if c not in ("patches", "part", "cell")))


def pair_counts(pair_table: DataFrame, centres: DataFrame, params: Params) -> DataFrame:
    """Pairs of every patch and bin, zeros included."""
    grid = centres.select("patch_id").join(F.broadcast(params.bins(centres.sparkSession).select("bin")))
    counted = pair_table.groupBy("patch_id", "bin").agg(F.count("*").alias("npairs"))
    return grid.join(counted, ["patch_id", "bin"], "left").select("patch_id", "bin", F.coalesce("npairs", F.lit(0)).cast("long").alias("npairs"))


def bin_offsets(counts: DataFrame) -> DataFrame:
    """First position of each bin in its patch's pairs sorted by bin."""
    return counts.selectExpr("patch_id", "bin", "npairs", "sum(npairs) over (partition by patch_id order by bin rows unbounded preceding) - npairs as first")
