"""Spherical geometry, spin-2 phases and the aperture filter as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def arcmin(x: float) -> float:
    return math.radians(x / 60)


def clamped_acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def cos_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    return F.cos(ra1 - ra2) * F.cos(dec1) * F.cos(dec2) + F.sin(dec1) * F.sin(dec2)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in radians."""
    return clamped_acos(cos_separation(ra1, dec1, ra2, dec2))


def radec_to_xyz(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def angle_at(ra1: Column, dec1: Column, ra2: Column, dec2: Column, ra3: Column | None = None, dec3: Column | None = None) -> Column:
    """Signed angle at point 1 between points 2 and 3; point 3 is the north pole unless given."""
    p1, p2 = radec_to_xyz(ra1, dec1), radec_to_xyz(ra2, dec2)
    p3 = radec_to_xyz(ra3, dec3) if ra3 is not None else (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cross = (p1[1] * p2[2] - p1[2] * p2[1], p1[2] * p2[0] - p1[0] * p2[2], p1[0] * p2[1] - p1[1] * p2[0])
    return F.atan2(dot(p3, cross), dot(p2, p3) - dot(p1, p3) * dot(p1, p2))


def pair_phases(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> dict[str, Column]:
    """Spin-2 phases of both ends of a pair, free of trigonometric inverses."""
    c = cos_separation(ra1, dec1, ra2, dec2)
    s = F.cos(dec1) * F.cos(dec2) * F.sin(ra2 - ra1)
    q1, q2 = F.sin(dec2) - F.sin(dec1) * c, F.sin(dec1) - F.sin(dec2) * c
    n1, n2 = q1 * q1 + s * s, q2 * q2 + s * s
    return {"e1_re": (s * s - q1 * q1) / n1, "e1_im": 2 * q1 * s / n1, "e2_re": (s * s - q2 * q2) / n2, "e2_im": -2 * q2 * s / n2}


def compensated_filter(theta: Column, theta_q: float) -> Column:
    """Q at ``theta`` radians for a filter scale in arcmin."""
    q = arcmin(theta_q)
    return theta * theta / (4 * math.pi * q**4) * F.exp(-theta * theta / (2 * q * q))


def filter_columns(ra: Column, dec: Column, ra_c: Column, dec_c: Column, theta_q: float) -> dict[str, Column]:
    """cos 2phi, sin 2phi of the polar angle about the centre, and Q at the distance from it."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_separation(ra, dec, ra_c, dec_c)))
    sin_t = F.sqrt(1 - c * c)
    cos_phi = F.sin(ra - ra_c) * F.cos(dec) / sin_t
    sin_phi = (F.cos(dec) * F.sin(dec_c) - F.sin(dec) * F.cos(dec_c) * F.cos(ra - ra_c)) / sin_t
    return {"q_cos": cos_phi * cos_phi - sin_phi * sin_phi, "q_sin": 2 * sin_phi * cos_phi, "q_val": compensated_filter(F.acos(c), theta_q)}


def tangential(g1: Column, g2: Column, cos2: Column, sin2: Column) -> Column:
    return -g1 * cos2 - g2 * sin2


def rotated(g1: Column, g2: Column, re: Column, im: Column) -> tuple[Column, Column]:
    """(g1 + i g2) times a phase."""
    return g1 * re - g2 * im, g1 * im + g2 * re
