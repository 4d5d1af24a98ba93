"""HEALPix RING pixelisation as Column expressions (Górski et al. 2005, with the library's pixel offsets)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def npix(nside: int) -> int:
    return 12 * nside * nside


def pixel_area(nside: int) -> float:
    """Solid angle of a pixel in steradians."""
    return 4 * math.pi / npix(nside)


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def pixel_to_sky(pix: Column, nside: int) -> tuple[Column, Column]:
    """(phi, theta) of a pixel's centre in radians.

    sin(theta) near the poles comes from the ring number, where 1 - z**2 would cancel.
    """
    n, cap, total = nside, 2 * nside * (nside - 1), npix(nside)
    north_ring = _whole((1 + F.floor(F.sqrt(1 + 2 * pix))) / 2)
    north_step = pix + 1 - 2 * north_ring * (north_ring - 1)
    at = pix - cap
    belt_ring = _whole(at / (4 * n)) + n
    belt_step = at % (4 * n) + 1
    shift = F.when((belt_ring + n) % 2 == 1, 1.0).otherwise(0.5)
    back = F.lit(total) - pix
    south_ring = _whole((1 + F.floor(F.sqrt(2 * back - 1))) / 2)
    south_step = 4 * south_ring + 1 - (back - 2 * south_ring * (south_ring - 1))
    north, belt = pix < cap, pix < total - cap

    def polar(ring: Column, step: Column, sign: int) -> tuple[Column, Column]:
        u = ring * ring / F.lit(3.0 * n * n)
        return (step - 0.5) * math.pi / (2 * ring), F.atan2(F.sqrt(u * (2 - u)), sign * (1 - u))

    north_phi, north_theta = polar(north_ring, north_step, 1)
    south_phi, south_theta = polar(south_ring, south_step, -1)
    z = 2 * (2 * n - belt_ring) / F.lit(3.0 * n)
    phi = F.when(north, north_phi).when(belt, (belt_step - shift) * math.pi / (2 * n)).otherwise(south_phi)
    theta = F.when(north, north_theta).when(belt, F.atan2(F.sqrt(1 - z * z), z)).otherwise(south_theta)
    return phi, theta


def sky_to_pixel(phi: Column, theta: Column, nside: int) -> Column:
    """The pixel that holds a point (not always the one with the nearest centre)."""
    n, cap, total = nside, 2 * nside * (nside - 1), npix(nside)
    z = F.cos(theta)
    za = F.abs(z)
    turn = 2 * math.pi
    t = (phi - F.floor(phi / turn) * turn) * 2 / math.pi
    up, down = _whole(n * (0.5 + t) - 0.75 * n * z), _whole(n * (0.5 + t) + 0.75 * n * z)
    ring = n + 1 + up - down
    odd = 1 - F.pmod(ring, F.lit(2))
    along = F.pmod(_whole((up + down - n + odd + 1) / 2), F.lit(4 * n))
    belt = cap + (ring - 1) * 4 * n + along
    part = t - F.floor(t)
    width = n * F.sqrt(3 * (1 - za))
    p_up, p_down = _whole(part * width), _whole((1 - part) * width)
    p_ring = p_up + p_down + 1
    p_along = F.pmod(_whole(t * p_ring), 4 * p_ring)
    polar = F.when(z > 0, 2 * p_ring * (p_ring - 1) + p_along).otherwise(total - 2 * p_ring * (p_ring + 1) + p_along)
    return F.when(za <= 2.0 / 3.0, belt).otherwise(polar)


#: Fixed values of the pixelisation: for each of the 12 base cells, its southern corner's ring and its longitude in eighths of a turn.
FACE_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_PHI = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def _face_steps(face: Column, ix: Column, iy: Column, n: int):
    """The columns that lead to the centre of a base cell's subcell, each step in terms of the ones before it, given by name."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), face + 1)
    yield lambda at: {"face_ring": pick(FACE_RING) * n - ix - iy - 1}
    yield lambda at: {"face_near": F.when(at("face_ring") < n, at("face_ring")).when(at("face_ring") > 3 * n, 4 * n - at("face_ring")).otherwise(n)}

    def height_and_turn(at):
        ring, near = at("face_ring"), at("face_near")
        cap = 1 - near * near / F.lit(3.0 * n * n)
        z = F.when(ring < n, cap).when(ring > 3 * n, -cap).otherwise((2 * n - ring) * 2 / F.lit(3.0 * n))
        return {"face_z": z, "face_phi": (pick(FACE_PHI) * near + ix - iy) * (math.pi / 4) / near}

    yield height_and_turn
    yield lambda at: {"face_flat": F.sqrt(1 - at("face_z") * at("face_z"))}
    yield lambda at: {"face_x": at("face_flat") * F.cos(at("face_phi")), "face_y": at("face_flat") * F.sin(at("face_phi"))}


def face_to_sky(face: Column, ix: Column, iy: Column, n: int) -> tuple[Column, Column, Column]:
    """x, y, z of the centre of a base cell's subcell (ix, iy) at resolution ``n``; its children are (2 ix + 0 or 1, 2 iy + 0 or 1)."""
    made: dict[str, Column] = {}
    for step in _face_steps(face, ix, iy, n):
        made |= step(made.__getitem__)
    return made["face_x"], made["face_y"], made["face_z"]


def with_face_centre(df: DataFrame, n: int) -> DataFrame:
    """``df`` (face, ix, iy) with face_x, face_y and face_z as ``face_to_sky`` gives them: every step is a column before the next formula
    reads it, often more than once, so that a row computes it once."""
    placed = df
    for step in _face_steps(F.col("face"), F.col("ix"), F.col("iy"), n):
        placed = placed.withColumns(step(F.col))
    return placed.drop("face_ring", "face_near", "face_phi", "face_flat")


def sky_to_face(phi: Column, z: Column, n: int) -> tuple[Column, Column, Column]:
    """Base cell and (ix, iy) of the subcell at resolution ``n``, a power of 2, that holds a point."""
    turn = 2 * math.pi
    t = (phi - F.floor(phi / turn) * turn) * 2 / math.pi
    up, down = _whole(n * (0.5 + t) - 0.75 * n * z), _whole(n * (0.5 + t) + 0.75 * n * z)
    f_up, f_down = _whole(up / n), _whole(down / n)
    belt_face = F.when(f_up == f_down, F.pmod(f_up, F.lit(4)) + 4).when(f_up < f_down, F.pmod(f_up, F.lit(4))).otherwise(F.pmod(f_down, F.lit(4)) + 8)
    quarter = F.least(_whole(t), F.lit(3))
    part, width = t - quarter, n * F.sqrt(3 * (1 - F.abs(z)))
    p_up, p_down = (F.least(_whole(x * width), F.lit(n - 1)) for x in (part, 1 - part))
    belt, north = F.abs(z) <= 2.0 / 3.0, z > 0
    face = F.when(belt, belt_face).when(north, quarter).otherwise(quarter + 8)
    ix = F.when(belt, F.pmod(down, F.lit(n))).when(north, n - 1 - p_down).otherwise(p_up)
    iy = F.when(belt, n - 1 - F.pmod(up, F.lit(n))).when(north, n - 1 - p_up).otherwise(p_down)
    return face.cast("int"), ix.cast("int"), iy.cast("int")


def computed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the columns as values that stand: a filter or join above never repeats the formulas behind them.

    The optimiser moves a filter below a projection by writing the column's formula into it, and formulas of pixels are
    long; it does not move one below a generator that makes the column.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def pixels(spark: SparkSession, nside: int) -> DataFrame:
    """Every pixel with its position: pix, ra, dec, x, y, z."""
    phi, theta = pixel_to_sky(F.col("pix"), nside)
    placed = spark.range(npix(nside)).select(F.col("id").alias("pix")).select("pix", phi.alias("ra"), (math.pi / 2 - theta).alias("dec"))
    return with_vector(computed(placed, "ra", "dec"))


def with_vector(df: DataFrame) -> DataFrame:
    """``df`` (ra, dec) with the unit vector x, y, z."""
    return df.withColumns({"x": F.cos("dec") * F.cos("ra"), "y": F.cos("dec") * F.sin("ra"), "z": F.sin("dec")})


def degrade(values: DataFrame, nside: int, coarse: int, column: str, *keys: str) -> DataFrame:
    """Mean of a map (pix, ``column``) over the coarse pixel that holds each fine pixel's centre, for each of ``keys``."""
    phi, theta = pixel_to_sky(F.col("pix"), nside)
    placed = computed(values.select(*keys, column, phi.alias("phi_of_pix"), theta.alias("theta_of_pix")), "phi_of_pix", "theta_of_pix")
    return placed.select(*keys, sky_to_pixel(F.col("phi_of_pix"), F.col("theta_of_pix"), coarse).alias("pix"), column).groupBy(*keys, "pix").agg(F.avg(column).alias(column))
