"""What the operators need of a session."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where they see the driver's folders; elsewhere it is shipped with --py-files."""
    env = spark.sparkContext.environment
    known = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where all run in one process (a local master) and none is set, a temporary folder is taken; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: a plan that is read several times stays small, and a lost executor costs one read."""
    spark = prepare(df.sparkSession)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


#: Rows of jobs that a command runs side by side.
AT_ONCE = 8


def side_by_side[T, U](spark: SparkSession, run: Callable[[T], U], items: Iterable[T], at_once: int = AT_ONCE) -> Iterator[U]:
    """run of every item, in the items' order, `at_once` of them at a time: the jobs of one fill the cluster while another waits for its driver.

    Items are taken in the caller's thread, and begin to run while later ones are still made.  The first error ends the results."""
    with ThreadPoolExecutor(at_once) as pool:
        yield from pool.map(inheritable_thread_target(spark)(run), items)


def numbered(df: DataFrame, *order: str | Column, name: str = "place", first: int = 1) -> DataFrame:
    """Number the rows of a whole table by an order, from `first`, without a task that holds them all.

    The rows are sorted into parts, one row of counts for each part comes to the driver, and rows are numbered within
    their part behind those of earlier parts.  Ties get consecutive numbers in any order; the result is not sorted."""
    placed = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before, total = [], first
    for part, n in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        before.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "_part int, _before long")  # a row for each part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_own") + F.col("_before")).alias(name))
