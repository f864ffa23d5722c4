"""K4: matrices as one .npy file, written and read by tasks, as a Spark data source.

The shape is known before anything is written, so every cell has its byte: the array is cut into stripes of `STRIPE_CELLS`
cells in file order, a task fills one stripe at a time and writes it at its offset into a hidden file beside the
target.  The commit writes the header, checks that every stripe was written, and renames.  A task that is repeated writes
the same bytes to the same place, so lost executors and doubled attempts leave the same file; a failed job leaves none.

Writing at offsets needs a file system with seeks that driver and executors share (a POSIX mount); paths of object stores are refused.
Reading goes by pyarrow's file systems.  Masked cells are nan in the file and null in the frame.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..runtime import prepare
from .raw_contacts import opened

NAME = "array_file"
#: Cells of a stripe, which is what a task holds (8 MB).
STRIPE_CELLS = 1 << 20
#: Cells of a batch that a reader gives.
BATCH_CELLS = 1 << 16
CELLS = pa.schema([("row_id", pa.int64()), ("col_id", pa.int32()), ("v", pa.float64())])


def head(rows: int, columns: int) -> bytes:
    """The header of a file of doubles in row order."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (rows, columns)})
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    stripes: int


class ArrayWriter(DataSourceArrowWriter):
    """Takes (stripe, place, v), sorted within a task by stripe and place."""

    def __init__(self, path: str, rows: int, columns: int, stripe_cells: int):
        self.path, self.rows, self.columns, self.n = path, rows, columns, stripe_cells
        folder, name = os.path.split(path)
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        total, behind = self.rows * self.columns, len(head(self.rows, self.columns))
        current, buffer, done = None, np.empty(0), 0
        with os.fdopen(os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o666), "r+b") as file:

            def flush() -> int:
                if current is None:
                    return 0
                file.seek(behind + current * self.n * 8)
                file.write(buffer.astype("<f8").tobytes())
                return 1

            for batch in iterator:
                stripe, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                v = batch.column(2).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(stripe)) + 1).tolist(), len(stripe)]
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if s == e:
                        continue
                    if stripe[s] != current:
                        done += flush()
                        current = int(stripe[s])
                        buffer = np.full(min(self.n, total - current * self.n), np.nan)
                    buffer[place[s:e] - current * self.n] = v[s:e]
            done += flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        header, total = head(self.rows, self.columns), self.rows * self.columns
        done, wanted = sum(m.stripes for m in messages if m), -(-total // self.n)
        if done != wanted:
            self.abort(messages)
            raise ValueError(f"{done} of {wanted} stripes were written")
        with os.fdopen(os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o666), "r+b") as file:
            file.truncate(len(header) + total * 8)
            file.write(header)
            file.flush()
            os.fsync(file.fileno())
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


@dataclass
class Stretch(InputPartition):
    first: int
    past: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, stripe_cells: int):
        self.path, self.n = path, stripe_cells
        system, inner = opened(path)
        with system.open_input_file(inner) as file:
            version = np.lib.format.read_magic(file)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, self.fortran, self.kind = read(file)
            self.behind = file.tell()
        if len(shape) > 2 or self.kind.hasobject or self.kind.kind not in "fiub":
            raise ValueError(f"{path} holds no matrix of numbers: shape {shape}, {self.kind}")
        self.rows, self.columns = (*shape, 1, 1)[:2]

    def partitions(self) -> list[Stretch]:
        total = self.rows * self.columns
        return [Stretch(i, min(i + self.n, total)) for i in range(0, total, self.n)] or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, inner = opened(self.path)
        with system.open_input_file(inner) as file:
            file.seek(self.behind + partition.first * self.kind.itemsize)
            for first in range(partition.first, partition.past, BATCH_CELLS):
                n = min(BATCH_CELLS, partition.past - first)
                v = np.frombuffer(file.read(n * self.kind.itemsize), self.kind).astype(float)
                place = np.arange(first, first + n)
                row, col = (place % self.rows, place // self.rows) if self.fortran else (place // self.columns, place % self.columns)
                yield pa.record_batch([pa.array(row, pa.int64()), pa.array(col.astype(np.int32)), pa.array(v, mask=np.isnan(v))], schema=CELLS)


class ArrayFile(DataSource):
    """`path`; for writing also `rows`, `columns`; `stripe_cells`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "row_id long, col_id int, v double"

    def stripe(self) -> int:
        return int(self.options.get("stripe_cells", STRIPE_CELLS))

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self.stripe())

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in path:
            raise ValueError(f"{path}: a file system with seeks is needed; write the cells as Parquet")
        if not overwrite and os.path.exists(path):
            raise ValueError(f"{path} is there; arrays cannot be appended to")
        return ArrayWriter(path, int(self.options["rows"]), int(self.options["columns"]), self.stripe())


def save(cells: DataFrame, path: str, stripe_cells: int = STRIPE_CELLS) -> tuple[int, int]:
    """Write cells (row_id, col_id, v) as one .npy file of any size and return its shape, the largest ids plus one.

    Absent cells and null values are nan.  Cells without a row or a column are left out, of repeated cells the largest value
    stays, negative ids are an error, and no cells give an array of shape (0, 0).  A file that is there is replaced."""
    spark = prepare(cells.sparkSession)
    spark.dataSource.register(ArrayFile)
    known = cells.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.col("v").cast("double").alias("v")).where("row_id is not null and col_id is not null")
    found = known.agg(F.max("row_id").alias("r"), F.max("col_id").alias("c"), F.min(F.least("row_id", "col_id")).alias("low")).first()
    if found.r is not None and found.low < 0:
        raise ValueError(f"negative id {found.low}")
    rows, columns = (0, 0) if found.r is None else (found.r + 1, found.c + 1)
    place = F.col("row_id") * columns + F.col("col_id")
    # a masked first cell for every stripe, so that a stripe without cells is written too
    marks = spark.range(-(-rows * columns // stripe_cells)).select((F.col("id") * stripe_cells).alias("place"), F.lit(None).cast("double").alias("v"))
    placed = known.select(place.alias("place"), F.when(~F.isnan("v"), F.col("v")).alias("v")).union(marks)
    stripes = placed.selectExpr(f"place div {stripe_cells} as stripe", "place", "v")
    ready = stripes.repartition("stripe").sortWithinPartitions("stripe", "place", F.asc_nulls_first("v"))
    ready.write.format(NAME).mode("overwrite").options(rows=rows, columns=columns, stripe_cells=stripe_cells).save(path)
    return rows, columns


def load(spark: SparkSession, path: str, stripe_cells: int = STRIPE_CELLS) -> DataFrame:
    """All cells (row_id, col_id, v) of a .npy file of at most two dimensions in either order; a vector is one column."""
    prepare(spark).dataSource.register(ArrayFile)
    return spark.read.format(NAME).option("stripe_cells", stripe_cells).load(path)
