"""Pixel, patch, mask and shear sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zetasky.functions import healpix
from zetasky.plans.params import Params, check_centres, check_mask_length


def footprint(spark: SparkSession, params: Params, mask: DataFrame | None = None) -> DataFrame:
    """Observed pixels with their positions; ``mask`` (pix, m) keeps those with m neither 0, null nor NaN."""
    every = healpix.pixels(spark, params.nside)
    return every if mask is None else every.join(kept(mask), "pix", "left_semi")


def kept(mask: DataFrame) -> DataFrame:
    m = F.col("m").cast("double")
    return mask.filter((m != 0) & ~F.isnan(m)).select("pix")


def mask_from_list(spark: SparkSession, values: list, params: Params) -> DataFrame:
    check_mask_length(values, params)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pix long, m double")


def patches_from_lists(spark: SparkSession, phi: list[float], theta: list[float]) -> DataFrame:
    check_centres(phi, theta)
    return spark.createDataFrame([(i, float(p), float(t)) for i, (p, t) in enumerate(zip(phi, theta, strict=True))], "patch_id int, phi_center double, theta_center double")


def patches_from_text(spark: SparkSession, phi_path: str, theta_path: str) -> DataFrame:
    """Centres in two text files of one number a line; lines pair up by position, blank ones aside. A file is read as one
    row, so its lines keep their places however Spark would split it."""

    def numbers(path: str, name: str) -> DataFrame:
        lines = F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(x) != "")
        return spark.read.text(path, wholetext=True).select(F.posexplode(lines)).select(F.col("pos").alias("patch_id"), F.trim("col").cast("double").alias(name))

    return numbers(phi_path, "phi_center").join(numbers(theta_path, "theta_center"), "patch_id")


def load_maps(shear: DataFrame, flip_g1: bool = True, flip_g2: bool = False) -> DataFrame:
    """shear (map_id, zbin, pix, g1, g2, w) with the chosen components' signs turned."""
    return shear.withColumns({"g1": F.col("g1") * (-1 if flip_g1 else 1), "g2": F.col("g2") * (-1 if flip_g2 else 1)})


def fingerprints(shear: DataFrame) -> DataFrame:
    """map_id, zbin, n_pix and a 128-bit fingerprint of its rows (pix, g1, g2, w) whatever their order, by one aggregate.

    Sums of two independent 64-bit hashes of the rows, so a row that comes twice counts twice; zeros of both signs are equal,
    and a null is no number. Equal maps have equal fingerprints; others differ but for a chance of about 2 ** -128 a pair.
    """
    values = ["pix", *(F.coalesce(F.col(c) + 0.0, F.lit(float("nan"))) for c in ("g1", "g2", "w")), *(F.col(c).isNull() for c in ("g1", "g2", "w"))]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)"))
    return shear.groupBy("map_id", "zbin").agg(F.count("*").alias("n_pix"), total(1).alias("print1"), total(2).alias("print2"))


def equal_maps(shear: DataFrame) -> DataFrame:
    """map_id, zbin, n_pix and, as same_map and same_zbin, the first (map_id, zbin) with equal fields and weights: two maps whose
    correlation is an auto-correlation have the same. All maps are told apart at once."""
    first = F.min(F.struct("map_id", "zbin")).over(Window.partitionBy("n_pix", "print1", "print2"))
    return fingerprints(shear).withColumn("first", first).select("map_id", "zbin", "n_pix", F.col("first.map_id").alias("same_map"), F.col("first.zbin").alias("same_zbin"))


def same_map(shear: DataFrame, one: tuple[int, int], two: tuple[int, int]) -> bool:
    """Whether two (map_id, zbin) keys name equal fields and weights; of keys without rows, both are empty."""
    if one == two:
        return True
    is_key = lambda key: (F.col("map_id") == key[0]) & (F.col("zbin") == key[1])
    found = fingerprints(shear.filter(is_key(one) | is_key(two))).collect()
    return len({tuple(r)[2:] for r in found}) == 1 and len(found) == 2 or not found
