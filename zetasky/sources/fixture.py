"""A deterministic sky made from the tables ``lineitem``, ``supplier`` and ``orders``, for queries and tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zetasky.plans.params import Params

PARAMS = Params(nside=32, nbins=5, theta_min=100.0, theta_max=1100.0, patch_size=600.0, theta_q=200.0, filter_radius=450.0)
N_ZBINS, N_MAPS = 4, 3
GOLDEN_ANGLE = 2.399963229728653


def shear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, zbin, pix, g1, g2, w; a missing row is g = w = 0."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pix = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % PARAMS.npix
    w = F.sum("l_quantity")
    return lines.groupBy((F.col("l_linenumber") % N_MAPS).cast("int").alias("map_id"), (F.col("l_suppkey") % N_ZBINS).cast("int").alias("zbin"), pix.alias("pix")).agg(
        (F.sum(F.col("l_quantity") * (F.col("l_discount") - 0.05)) / w).alias("g1"), (F.sum(F.col("l_quantity") * (F.col("l_tax") - 0.04)) / w).alias("g2"), w.alias("w")
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each supplier: its key turns the centre about the pole, its balance sets the height. Patches overlap."""
    k = F.col("s_suppkey")
    phi = k * GOLDEN_ANGLE - F.floor(k * GOLDEN_ANGLE / (2 * math.pi)) * (2 * math.pi)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return suppliers.select(k.cast("int").alias("patch_id"), phi.alias("phi_center"), F.acos(1 - 2 * (F.col("s_acctbal") + 1000) / 11000).alias("theta_center"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pix and m: orders that fall on the pixel, modulo 7; pixels without orders have no row."""
    pix = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 31) % PARAMS.npix
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(pix.alias("pix")).agg((F.count("*") % 7).cast("double").alias("m"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points of the sphere for each line, and a small angle: l_orderkey, l_linenumber, ra1, dec1, ra2, dec2, theta."""
    q, x, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    columns = {"ra1": q * 0.37, "dec1": d * 3.0 - 0.3, "ra2": x * 0.00073 + 0.1, "dec2": t * 5.0 + 0.5, "theta": F.radians(q * d * 251.3 / 60)}
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in columns.items()))
