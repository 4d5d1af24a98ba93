"""The pair store: geometry kept as Parquet and reused for every map of a footprint and resolution.

Pairs lie in buckets of their cell (and part of it), each once for all patches of the cell that hold it, with the patches' pixels
beside them. A reader that says so to Spark gets pairs that are already dealt by cell: fields are brought to the buckets, and pairs
are read where they are summed.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zetasky.plans.params import Params

#: The cell, by which pairs stay dealt however a reader numbers patches, and the part of its pairs.
KEYS = ("cell", "part")


def save(path: str, params: Params, salt: int, centres: DataFrame, members: DataFrame, pairs: DataFrame, filters: DataFrame, footprint: DataFrame, buckets: int | None = None) -> None:
    """Write the geometry, ``pairs`` being those of cells with their patches. ``buckets`` is the number of tasks that the pairs can later be summed by, the session's shuffle
    partitions unless given; each is one file, sorted by cell and bin."""
    spark = pairs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"zetasky_{uuid.uuid4().hex}"
    pairs.repartition(buckets, *KEYS).write.mode("overwrite").format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS, "bin").option("path", f"{path}/pairs").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay: the table is an external one
    for table, df in (("filters", filters), ("members", members.select("patch_id", "cell", "pix"))):
        df.withColumnRenamed("patch_id", "home").repartitionByRange("home").sortWithinPartitions("home").write.mode("overwrite").parquet(f"{path}/{table}")
    centres.withColumnRenamed("patch_id", "home").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    footprint.select("pix").write.mode("overwrite").parquet(f"{path}/footprint")
    spark.createDataFrame([params.as_row() | {"salt": salt, "buckets": buckets}]).coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_params(spark: SparkSession, path: str) -> tuple[Params, int, int]:
    """The parameters, the parts of a patch's pairs and the buckets."""
    row = spark.read.parquet(f"{path}/params").first().asDict()
    salt, buckets = row.pop("salt"), row.pop("buckets")
    return Params(**row), salt, buckets


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Pairs with their buckets known to Spark, which learns of them from tables alone."""
    name = f"zetasky_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    where = path.replace("'", "\\'")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({', '.join(KEYS)}) sorted by ({', '.join(KEYS)}, bin) into {buckets} buckets location '{where}'")
    found = spark.table(name)
    found.schema  # noqa: B018  resolved now, while the table is there
    spark.sql(f"drop table {name}")
    return found


def load(spark: SparkSession, path: str, table: str, start: int = 0, stop: int | None = None, buckets: int = 0) -> DataFrame:
    """``members``, ``filters`` or ``centres`` of the patches in [start, stop), numbered anew from 0, ``home`` being the stored number; or
    the ``pairs`` of their cells, with the stored numbers of all patches that hold each."""
    inside = lambda df: df.filter(F.col("home") >= start) if stop is None else df.filter((F.col("home") >= start) & (F.col("home") < stop))
    if table == "pairs":
        found = _bucketed(spark, f"{path}/pairs", buckets)
        if start <= 0 and stop is None:
            return found
        return found.join(F.broadcast(inside(spark.read.parquet(f"{path}/centres")).select("cell").distinct()), "cell", "left_semi")
    return inside(spark.read.parquet(f"{path}/{table}")).withColumn("patch_id", (F.col("home") - start).cast("int"))


_left: list[tuple] = []


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a store when the driver ends; a JVM that has ended first leaves it to whoever empties the folder."""
    _left.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))


@atexit.register
def _delete_left() -> None:
    with contextlib.suppress(Py4JError, OSError):
        for jvm, conf, path in _left:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
