"""The integrated three-point function: covariance over patches of aperture mass and two-point correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zeta(masses: DataFrame, xi: DataFrame, strict: bool = False) -> DataFrame:
    """map_id, z1 <= z2 <= z3, bin, zetap, zetam, with the mass at z1 and xi at (z2, z3); the connected part.

    A patch without a mass or a correlation is left out; ``strict`` makes the value null instead.
    """
    m = masses.select("map_id", F.col("zbin").alias("z1"), "patch_id", "m_ap")
    x = xi.select("map_id", F.col("z1").alias("z2"), F.col("z2").alias("z3"), "patch_id", "bin", "xip", "xim")
    both = x.join(m, (x.map_id == m.map_id) & (x.patch_id == m.patch_id) & (m.z1 <= x.z2)).select(x.map_id, "z1", "z2", "z3", "bin", "m_ap", "xip", "xim")
    whole = lambda c: F.covar_pop("m_ap", c) if not strict else F.when(F.count("*") == F.count(F.col("m_ap") + F.col(c)), F.covar_pop("m_ap", c))
    return both.groupBy("map_id", "z1", "z2", "z3", "bin").agg(whole("xip").alias("zetap"), whole("xim").alias("zetam"))
