"""Shared plumbing: reading tables, Arrow batches in and out, tables written to the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PACKAGE = Path(__file__).resolve().parents[1]

#: Rows that a Python worker handles at a time: bounds its memory whatever Spark's batch size is.
SLICE_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once: executors need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_zetasky_shipped", False):
        context._zetasky_shipped = True
        path = os.path.join(tempfile.mkdtemp(), "zetasky_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def with_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, whose workers hand back what they held when a task is over: they live on for other tasks, and
    freed memory would else stay theirs."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_columns(df: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Run ``make()(list, ...)`` over slices of the named columns; it returns a dict of equally long lists.

    Only the named columns are read, so other columns of any name never clash with the result.
    """

    ship(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = fn(*(part.column(i).to_pylist() for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in schema], schema=schema)

    return with_arrow(df.select(*columns), run, ddl)


def annotate(df: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """``df`` with further columns that ``make()(list, ...)`` gives for slices of the named ones; the rest pass through."""
    ship(df.sparkSession)
    extra = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = fn(*(part.column(places[c]).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(made[f.name], type=f.type) for f in extra)], names=[*part.schema.names, *extra.names])

    places = {c: df.columns.index(c) for c in columns}
    schema = StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
    return with_arrow(df, run, schema)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one where that is unset and no cluster
    is there to share it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), "zetasky-shared")


def pack48(numbers: np.ndarray) -> bytes:
    """Six low bytes of each 64-bit number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(blobs: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate([six, np.zeros((len(six), 2), dtype=np.uint8)], axis=1).reshape(-1).view("<u8")


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal values of ``columns`` in sorted batches, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def sorted_groups(df: DataFrame, columns: list[str], fn, ddl: str) -> DataFrame:
    """``fn`` over batches sorted by ``columns``, all rows of a group in one task; groups are of bounded size."""
    return with_arrow(df.repartition(*columns).sortWithinPartitions(*columns), fn, ddl)


#: Stashes of this driver that are still there, with the JVM's handles to delete them.
_left: dict[str, tuple] = {}


def leave(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends, unless it is unstashed before."""
    _left[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet to the shared folder and read back, with its path for ``unstash``.

    Cuts the lineage so that a lost executor costs no history. What nobody unstashes, because results are read from it,
    goes when the driver ends.
    """
    context = df.sparkSession.sparkContext
    path = f"{shared_folder(df.sparkSession)}/zetasky-{uuid.uuid4().hex}"
    leave(df.sparkSession, path)
    df.write.parquet(path)
    context._jvm.System.gc()  # shuffle files stay until the driver collects what was done with them
    return df.sparkSession.read.parquet(path), path


def unstash(spark: SparkSession, *paths: str) -> None:
    """Delete stashes that nothing reads any more."""
    for path in paths:
        jvm, conf = _left.pop(path, None) or (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


@atexit.register
def unstash_all() -> None:
    """Delete what is left; a JVM that has ended first leaves it to whoever empties the folder."""
    with contextlib.suppress(Py4JError, OSError):
        unstash(None, *list(_left))
