"""Helpers shared by the corpus operators: reading, shared storage, bounded samples, checked broadcasts."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import prepare, shared_root

#: A side of at most this many rows of a few bytes may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 1_000_000
#: Bound on the bytes of the labelled texts that a classifier is fitted on.
FIT_BYTES = 24 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among the folders that driver and executors share: below spark.checkpoint.dir."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays as long as results may be read from it; clear() deletes the application's tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application wrote with materialise(); results that read them are gone with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their exact names."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join where right, a written table, is broadcast only if its counted rows are within the bound; otherwise by shuffle."""
    return left.join(F.broadcast(right) if right.count() <= rows else right.hint("merge"), on, how)


def tail_schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: object, limit: int, budget: int = FIT_BYTES) -> DataFrame:
    """At most `limit` labelled documents (doc_id, text, y) of `budget` bytes together, in the order of a hash of doc_id.

    A document that does not fit into what is left of the budget is passed over.  The bounds are what
    makes broadcasting the ids safe; null labels and ids are left out."""
    pick = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & where)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = [(int(r[0]), int(r[1]), i) for i, r in enumerate(pick.collect())]
    picked = docs.sparkSession.createDataFrame(rows, "doc_id long, y int, place int")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "place").agg(F.sum(F.octet_length("text")).alias("n"))  # a row for each id
    left, fits = budget, set()
    for r in sorted(sizes.collect(), key=lambda r: r.place):
        if (r.n or 0) <= left:
            left -= r.n or 0
            fits.add(r.doc_id)
    picked = docs.sparkSession.createDataFrame([r[:2] for r in rows if r[0] in fits], "doc_id long, y int")
    return text.join(F.broadcast(picked), "doc_id")


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Dense logistic regression by Newton steps on standardised features; returns weights on the raw scale and bias."""
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else float(y.mean() * 0.98 + 0.01)
        return np.zeros(x.shape[1] if x.ndim == 2 else 0), math.log(p / (1 - p))
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / std, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], l2 * len(y))
    reg[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        grad = z.T @ (p - y) + reg * w
        hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / std, float(w[-1] - (w[:-1] * mean / std).sum())


#: Bytes of an Arrow batch that a Python worker is sent, where the session has Spark's own default of 64 MB.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Long texts must not pile up in a worker: lower the session's batch size unless it was chosen."""
    prepare(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system: workers are used again by other tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow for a function from a batch to a dict of columns, in the order of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(fields, (out[f.name] for f in fields), strict=True)], schema=fields)
            del out, batch
        give_back()

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Keep the rows where mask(batch) is true, with every column as it is."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.asarray(mask(batch), bool)))
        give_back()

    return df.mapInArrow(run, df.schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by its place under the exact name (names may also differ in case only)."""
    return batch.column(batch.schema.names.index(name))
