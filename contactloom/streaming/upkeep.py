"""Streaming upkeep of counts: scatter sums (A1), distance counts (A3), contingency (A11), densities.

A stream's micro-batch is reduced to partial aggregates, which are written as a delta named by the batch
id.  A batch that runs again overwrites its own delta, so it counts once.  The current rows merge the
newest snapshot and the deltas behind it; `compact` merges them into a snapshot and deletes what it replaces.  Only folders
with Spark's success mark are read, so a batch or compaction that broke off leaves the state as it was.

All state is in tables of a shared folder: nothing grows in the driver or the executors, and the merge is a partial aggregation
by key.  One query writes to a folder at a time.  Records are taken as new ones: a cell that comes in two records is two
records for A3 and A15, as it is for the batch operators.  An empty batch leaves an empty delta; a folder without batches
gives no rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import contacts as C
from ..operators import matrix as M
from ..operators import tracks as T

#: Deltas that are merged into a snapshot.
COMPACT_EVERY = 50


@dataclass
class Upkeep:
    """State in `folder`: rows by `keys` whose `values` are merged by the named function ("sum" or "max")."""

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]
    values: dict[str, str]
    partial: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)
    every: int = COMPACT_EVERY

    def _complete(self, kind: str) -> dict[int, str]:
        """Finished folders of deltas or snapshots by batch id."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        there = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not there.exists(top):
            return {}
        out = {}
        for status in there.listStatus(top):
            name = status.getPath().getName()
            if re.fullmatch(r"\d+", name) and there.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out[int(name)] = f"{self.folder}/{kind}/{name}"
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch; one that a snapshot holds already is passed over."""
        if batch_id <= max(self._complete("snapshots"), default=-1):
            return
        self.merged(self.partial(batch)).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/deltas/{batch_id}")
        if len(self._complete("deltas")) >= self.every:
            self.compact()

    def merged(self, rows: DataFrame) -> DataFrame:
        how: dict[str, Callable[[str], Column]] = {"sum": F.sum, "max": F.max}
        out = rows.groupBy(*self.keys).agg(*[how[f](c).alias(c) for c, f in self.values.items()])
        return out.select(*self.keys, *self.values)

    def state(self) -> DataFrame:
        """One row a key over all batches."""
        snapshots, deltas = self._complete("snapshots"), self._complete("deltas")
        last = max(snapshots, default=-1)
        paths = ([snapshots[last]] if snapshots else []) + [path for k, path in sorted(deltas.items()) if k > last]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merged(self.spark.read.schema(self.schema).parquet(*paths))

    def current(self) -> DataFrame:
        """The rows of the batch operator over all records so far."""
        return self.finish(self.state())

    def compact(self) -> None:
        """Merge the state into a snapshot up to the last delta; the snapshot before it stays for readers that hold it."""
        deltas, snapshots = self._complete("deltas"), self._complete("snapshots")
        last = max(deltas, default=-1)
        if last <= max(snapshots, default=-1):
            return
        self.state().write.mode("overwrite").parquet(f"{self.folder}/snapshots/{last}")
        for k, path in deltas.items():
            if k <= last:
                self._delete(path)
        for k in sorted(snapshots)[:-1]:
            self._delete(snapshots[k])

    def start(self, stream: DataFrame, **trigger: object) -> StreamingQuery:
        """Keep the state up with a stream; the stream's own checkpoint lies beside the state."""
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(lambda batch, number: self.apply(batch, number))
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def scatter_sums(spark: SparkSession, folder: str, bin_map: DataFrame) -> Upkeep:
    """A1 over a stream of contacts, against a static bin map."""
    return Upkeep(spark, folder, "row_id long, col_id int, v double", ("row_id", "col_id"), {"v": "sum"}, lambda batch: M.inter_sums(batch, bin_map).select(F.col("row_id").cast("long"), F.col("col_id").cast("int"), "v"))


def distance_counts(spark: SparkSession, folder: str) -> Upkeep:
    """A3 over a stream of contacts."""
    return Upkeep(spark, folder, "chr_idx int, dist int, n long", ("chr_idx", "dist"), {"n": "sum"}, C.distance_counts)


def densities(spark: SparkSession, folder: str, labels: DataFrame) -> Upkeep:
    """A15 over a stream of contacts, against static labels."""
    keys = ("chr1", "chr2", "id1", "id2")
    return Upkeep(spark, folder, "chr1 int, chr2 int, id1 int, id2 int, s double", keys, {"s": "sum"}, lambda batch: C.density_sums(batch, labels), lambda sums: C.per_area(sums, labels))


def contingency(spark: SparkSession, folder: str, first: str, second: str) -> Upkeep:
    """A11 of two tracks over a stream of intervals (track_id, chr_idx, x1, x2, cluster_id).

    The state is the label of every track and start that the batch operator takes, the longest interval's; the table of loci is made of it when asked for."""

    def table(state: DataFrame) -> DataFrame:
        rows = state.select("track_id", "chr_idx", "x1", "label.x2", "label.cluster_id")
        return T.contingency(*(rows.where(F.col("track_id") == name).drop("track_id") for name in (first, second)))

    label = F.struct(F.col("x2").cast("int").alias("x2"), F.col("cluster_id").cast("int").alias("cluster_id")).alias("label")
    kept = F.col("track_id").isin(first, second)
    schema = "track_id string, chr_idx int, x1 int, label struct<x2:int,cluster_id:int>"
    return Upkeep(spark, folder, schema, ("track_id", "chr_idx", "x1"), {"label": "max"}, lambda batch: batch.where(kept).select("track_id", F.col("chr_idx").cast("int"), F.col("x1").cast("int"), label), table)
