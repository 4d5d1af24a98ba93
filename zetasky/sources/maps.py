"""Maps and masks in FITS and NumPy files, as tables of pixels.

A file on a disk that driver and executors see is dealt by ranges of rows: the header is read once in planning, and each task maps
its own rows into memory and touches the pages of the wanted field alone. A file in another store is read by Spark, whole, by
one task. Everything that a task needs travels with it: executors need no package but numpy and pyarrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Values of a batch that leaves a task, and of the rows that a task is given.
BATCH, VALUES_A_TASK = 1_000_000, 4_000_000


def _fits_layout(field: int):
    """A function that finds the first binary table of a FITS file by ``read(offset, size)`` and gives the place of a field."""

    def layout(read):
        import re

        import numpy as np

        block, at = 2880, 0
        kinds = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}  # fixed values: FITS codes
        while len(head := read(at, block)) == block:
            cards, done = {}, False
            while not done:
                if len(head) < block:
                    raise ValueError("the file ends within a header")
                at += block
                for line in (head[i : i + 80].decode("ascii") for i in range(0, block, 80)):
                    if line.startswith("END") and not line[3:].strip():
                        done = True
                        break
                    if line[8:10] == "= ":
                        text = re.match(r" *(?:'((?:[^']|'')*)'|([^/ ]*))", line[10:])
                        cards[line[:8].strip()] = (text[1] if text[1] is not None else text[2]).strip()
                head = b"" if done else read(at, block)
            shape = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards["NAXIS"]))]
            size = abs(int(cards["BITPIX"])) // 8 * (int(np.prod(shape)) if shape else 0) + int(cards.get("PCOUNT", 0))
            if cards.get("XTENSION") == "BINTABLE":
                if cards.get("ORDERING", "RING") != "RING":
                    raise ValueError("only maps in RING order are read")
                columns = [re.match(r"(\d*)([A-Z])", cards[f"TFORM{i + 1}"]) for i in range(int(cards["TFIELDS"]))]
                counts = [int(c[1] or 1) for c in columns]
                sizes = [n * np.dtype(kinds[c[2]]).itemsize for n, c in zip(counts[: field + 1], columns, strict=False)]
                number = lambda key, other: float(cards.get(f"{key}{field + 1}", other))
                return {"offset": at, "width": shape[0], "rows": shape[1], "begin": sum(sizes[:field]), "count": counts[field], "kind": kinds[columns[field][2]], "scale": number("TSCAL", 1), "zero": number("TZERO", 0), "logical": columns[field][2] == "L"}
            at += -(-size // block) * block
        raise ValueError("the file has no binary table")

    return layout


def _npy_layout():
    def layout(read):
        import io

        import numpy as np

        head = io.BytesIO(read(0, 1 << 16))
        version = np.lib.format.read_magic(head)
        shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if kind.hasobject:
            raise ValueError("arrays of objects are not read")
        if len(shape) != 1:
            raise ValueError("a map is an array of one dimension")
        return {"offset": head.tell(), "width": kind.itemsize, "rows": shape[0], "begin": 0, "count": 1, "kind": kind.str, "scale": 1.0, "zero": 0.0, "logical": False}

    return layout


def _rows_to_batches():
    def batches(table, at: dict, first: int, size: int):
        """pix and m of ``table``, bytes of whole rows from row ``first`` on, in batches of some ``size`` values."""
        import numpy as np
        import pyarrow as pa

        kind = np.dtype(at["kind"])
        step = max(1, size // at["count"])
        for a in range(0, len(table), step):
            held = np.ascontiguousarray(table[a : a + step, at["begin"] : at["begin"] + at["count"] * kind.itemsize])
            values = held.view(kind).ravel()
            values = (values == ord("T") if at["logical"] else values).astype(np.float64) * at["scale"] + at["zero"]
            pix = (first + a) * at["count"] + np.arange(len(values))
            yield pa.RecordBatch.from_pydict({"pix": pix, "m": values})

    return batches


def _source_class(path: str, layout, batches, values_a_task: int, size: int) -> type:
    """A data source for one file; a class made here travels to the executors whole."""

    class Reader(DataSourceReader):
        def partitions(self):
            import os

            def read(offset, n):
                with open(path, "rb") as file:
                    file.seek(offset)
                    return file.read(n)

            at = layout(read)
            if at["offset"] + at["width"] * at["rows"] > os.path.getsize(path):
                raise ValueError("the file ends within its table")
            step = max(1, values_a_task // at["count"])
            return [InputPartition((at, a, min(a + step, at["rows"]))) for a in range(0, at["rows"], step)] or [InputPartition((at, 0, 0))]

        def read(self, partition):
            import numpy as np

            at, start, stop = partition.value
            if start < stop:
                table = np.memmap(path, np.uint8, "r", at["offset"] + start * at["width"], (stop - start, at["width"]))
                yield from batches(table, at, start, size)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "zetasky_map"

        def schema(self):
            return "pix long, m double"

        def reader(self, schema):
            return Reader()

    return Source


def _read(spark: SparkSession, path: str, layout, values_a_task: int) -> DataFrame:
    batches, size = _rows_to_batches(), BATCH
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        local = system.makeQualified(where).toUri().getPath()
        spark.dataSource.register(_source_class(local, layout, batches, values_a_task, size))
        return spark.read.format("zetasky_map").load()

    def run(found):
        import numpy as np

        for batch in found:
            for content in batch.column(0):
                data = content.as_buffer()
                at = layout(lambda offset, n, data=data: data.slice(offset, max(0, min(n, data.size - offset))).to_pybytes())
                table = np.frombuffer(data, np.uint8, at["width"] * at["rows"], at["offset"]).reshape(-1, at["width"])
                yield from batches(table, at, 0, size)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pix long, m double")


def map_from_npy(spark: SparkSession, path: str, values_a_task: int = VALUES_A_TASK) -> DataFrame:
    """pix and m of a one-dimensional NumPy array of numbers or booleans, in file order; arrays of objects are refused."""
    return _read(spark, path, _npy_layout(), values_a_task)


def map_from_fits(spark: SparkSession, path: str, field: int = 0, values_a_task: int = VALUES_A_TASK) -> DataFrame:
    """pix and m of a column of a HEALPix map in a FITS binary table, rows holding one pixel or several.

    The first table is read, after any image. Maps in RING order only; UNSEEN values come as they are, blank ones as NaN.
    """
    return _read(spark, path, _fits_layout(field), values_a_task)
