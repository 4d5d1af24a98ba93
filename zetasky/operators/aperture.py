"""Aperture mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zetasky.functions import healpix
from zetasky.functions.geometry import tangential
from zetasky.plans.params import Params


def aperture_mass(filters: DataFrame, shear: DataFrame, params: Params) -> DataFrame:
    """Area times the weighted mean of tangential shear and filter: map_id, zbin, patch_id, m_ap; null without weight.

    A pixel that a map lacks counts in the area and adds nothing to the sums. The filter's pixels are made once: they take the
    fields of all maps and a mark of their own, which counts the area. A cell's filters take a pixel's fields together and are
    summed where they lie, so what is shuffled are the filters' pixels and never their fields.
    """
    tasks = int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = filters if "cell" in filters.columns else filters.withColumn("cell", F.col("patch_id").cast("long"))
    held = placed.groupBy("cell", "pix").agg(F.collect_list(F.struct("patch_id", "q_cos", "q_sin", "q_val")).alias("held"))
    fields = shear.groupBy("pix").agg(F.collect_list(F.struct("map_id", "zbin", "g1", "g2", "w")).alias("fields"))
    mark = F.array(F.struct(F.lit(None).cast("int").alias("map_id"), F.lit(None).cast("int").alias("zbin"), *(F.lit(None).cast("double").alias(c) for c in ("g1", "g2", "w"))))
    every = F.concat(mark, F.coalesce("fields", F.array().cast("array<struct<map_id:int,zbin:int,g1:double,g2:double,w:double>>"))).alias("every")
    dealt = held.join(fields, "pix", "left").select("cell", "held", every).repartition(tasks, "cell")
    rows = dealt.select("cell", "every", F.explode("held").alias("q")).select("cell", "q", F.explode("every").alias("f")).select("cell", "q.*", "f.*")
    gt = tangential(F.col("g1"), F.col("g2"), F.col("q_cos"), F.col("q_sin"))
    sums = rows.groupBy("cell", "patch_id", "map_id", "zbin").agg(F.sum(F.col("w") * gt * F.col("q_val")).alias("up"), F.sum("w").alias("w"), F.count("*").alias("n"))
    area = F.sum(F.when(F.col("map_id").isNull(), F.col("n"))).over(Window.partitionBy("cell", "patch_id")) * healpix.pixel_area(params.nside)
    return sums.withColumn("area", area).filter("map_id is not null").select("map_id", "zbin", "patch_id", (F.col("area") * F.try_divide("up", "w")).alias("m_ap"))
