"""Spatial joins: pixels in discs, and the aperture filter's pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zetasky.functions import geometry, healpix
from zetasky.plans.params import CELL_REACH as PIXEL_REACH
from zetasky.plans.params import Params

#: Patches of a cell that share their pairs; more are dealt to several groups, so that no group grows with the patches.
PATCHES_TOGETHER = 512


def covering_cells(discs: DataFrame, radius: float, n: int) -> DataFrame:
    """``discs`` (px, py, pz, ...) with the cells (face, ix, iy) of resolution ``n``, a power of 2, that a disc of ``radius`` radians may
    touch, a row for each: from the 12 base cells down, cells out of reach go and the others are split in four.

    No disc looks at all cells: at every level those that stay lie within the radius and a cell's reach.
    """

    def close(df: DataFrame, level: int) -> DataFrame:
        dot = F.col("px") * F.col("face_x") + F.col("py") * F.col("face_y") + F.col("pz") * F.col("face_z")
        reach = math.cos(min(math.pi, radius + PIXEL_REACH / level)) - 1e-12
        near = healpix.computed(healpix.with_face_centre(df, level).withColumn("face_dot", dot).select(*columns, "face", "ix", "iy", "face_dot"), "face_dot")
        return near.filter(F.col("face_dot") >= reach).drop("face_dot")

    level, columns = 1, discs.columns
    found = close(discs.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("face"), F.lit(0).alias("ix"), F.lit(0).alias("iy")), 1)
    while level < n:
        level *= 2
        quarters = F.inline(F.array(*(F.struct((F.col("ix") * 2 + i).alias("ix"), (F.col("iy") * 2 + j).alias("iy")) for i in (0, 1) for j in (0, 1))))
        found = close(found.select(*columns, "face", quarters), level)
    return found


def in_discs(pixels: DataFrame, centres: DataFrame, radius: float, nside: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pixels (pix, ra, dec, x, y, z) in the disc of ``radius`` arcmin about each centre (patch_id, phi_center, theta_center), with the
    columns of the centre to ``carry``.

    Pixels and discs meet by sky cell, an equi-join, and the exact test follows; a disc is listed under every cell that it may
    touch, some tens of about its own size, and a pixel lies in one cell, so no pair comes twice.
    """
    r = geometry.arcmin(radius)
    coarse = 1 << max(0, min(int(math.log2(nside)), int(math.log2(PIXEL_REACH / r))))
    discs = centres.select("patch_id", *carry, (F.sin("theta_center") * F.cos("phi_center")).alias("px"), (F.sin("theta_center") * F.sin("phi_center")).alias("py"), F.cos("theta_center").alias("pz"))
    tasks = int(centres.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given: by the bytes of discs, one task would cover them all and get all their pixels
    touched = covering_cells(healpix.computed(discs.repartition(tasks, "patch_id"), "px", "py", "pz"), r, coarse)
    cell = dict(zip(("face", "ix", "iy"), healpix.sky_to_face(F.col("ra"), F.col("z"), coarse), strict=True))
    placed = healpix.computed(pixels.withColumns(cell), *cell)
    inside = F.col("px") * F.col("x") + F.col("py") * F.col("y") + F.col("pz") * F.col("z") >= math.cos(r)
    return placed.repartition(tasks, *cell).join(touched.repartition(tasks, *cell), list(cell)).filter(inside).select("patch_id", "pix", "ra", "dec", *carry)


def with_cell(centres: DataFrame, params: Params) -> DataFrame:
    """``centres`` with the cell whose patches they share pixels and pairs with: a cell of the sky that is small beside a patch, and
    PATCHES_TOGETHER of its patches by number."""
    level = params.cell_level
    placed = healpix.computed(centres.withColumn("cell", healpix.sky_to_pixel(F.col("phi_center"), F.col("theta_center"), level)), "cell")
    deck = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("patch_id")) - 1) / PATCHES_TOGETHER)
    return placed.withColumn("deck", deck).withColumn("cell", (F.col("cell") + F.col("deck") * healpix.npix(level)).cast("long")).drop("deck")


def patch_pixels(footprint: DataFrame, centres: DataFrame, params: Params) -> DataFrame:
    return in_discs(footprint, with_cell(centres, params), params.patch_size, params.nside, ("cell",))


def snapped(centres: DataFrame, params: Params) -> DataFrame:
    """Centres with the pixel that holds each and that pixel's position."""
    with_pixel = healpix.computed(centres.withColumn("center_pix", healpix.sky_to_pixel(F.col("phi_center"), F.col("theta_center"), params.nside)), "center_pix")
    phi, theta = healpix.pixel_to_sky(F.col("center_pix"), params.nside)
    return healpix.computed(with_pixel.withColumns({"ra_c": phi, "dec_c": math.pi / 2 - theta}), "ra_c", "dec_c")


def filter_pixels(footprint: DataFrame, centres: DataFrame, params: Params) -> DataFrame:
    """Pixels of each filter disc but the central one, with the filter's angle and value."""
    disc = in_discs(footprint, with_cell(snapped(centres, params), params), params.filter_radius, params.nside, ("center_pix", "ra_c", "dec_c", "cell")).filter("pix <> center_pix")
    columns = geometry.filter_columns(F.col("ra"), F.col("dec"), F.col("ra_c"), F.col("dec_c"), params.theta_q)
    return disc.select("patch_id", "pix", *(c.alias(k) for k, c in columns.items()), "cell")


def filter_area(filters: DataFrame, params: Params) -> DataFrame:
    """Pixels and solid angle of each filter; the footprint decides, not any map."""
    return filters.groupBy("patch_id").agg(F.count("*").alias("n_pix"), (F.count("*") * healpix.pixel_area(params.nside)).alias("area"))
