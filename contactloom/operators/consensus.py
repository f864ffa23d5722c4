"""Consensus of several assignments (row_id, cid): hubs shared by greedy choice, the rest by their neighbours."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, numbered
from .metrics import BLOCK, Nearest, array_of, nearer, tallied, unassigned_share, unassigned_votes
from .tracks import greedy_cells


def two_way_hubs(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Rows of the k largest cells that share no id; (row_id, cid)."""
    return _hub_rows(a.withColumnRenamed("cid", "id1").join(b.withColumnRenamed("cid", "id2"), "row_id"), ("id1", "id2"), k)


def three_way_hubs(a: DataFrame, b: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """The same over triples of ids; ties go to the lowest ids."""
    both = a.withColumnRenamed("cid", "id1").join(b.withColumnRenamed("cid", "id2"), "row_id")
    return _hub_rows(both.join(c.withColumnRenamed("cid", "id3"), "row_id"), ("id1", "id2", "id3"), k)


def _hub_rows(rows: DataFrame, ids: tuple[str, ...], k: int) -> DataFrame:
    """Rows of the first k greedily taken tuples of ids, numbered in their order.  Only these k are brought to the driver."""
    cells = greedy_cells(rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")), ids=ids)
    first = cells.orderBy(F.desc("n"), *ids).limit(k).collect()
    hubs = rows.sparkSession.createDataFrame([(*[r[i] for i in ids], hub) for hub, r in enumerate(first)], ", ".join(f"{i} long" for i in ids) + ", hub int")
    return rows.join(F.broadcast(hubs), list(ids)).select("row_id", F.col("hub").alias("cid"))


#: Open rows that are labelled in one step; a task holds the links among them.
CHUNK = 1024


def fill_by_neighbours(rows: DataFrame, hubs: DataFrame, neighbours: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows without a label take the majority of their neighbours' labels, one after the other.

    The order is that of the share of neighbours without a label at the outset, then of row_id; rows without
    neighbours come last.  A row sees the labels of those before it; ties, and no label at all, give the lowest.
    Rows go in chunks of the order: votes of what is labelled already are counted by join, and only the links
    within a chunk are followed in order, by one task."""
    spark = rows.sparkSession
    neighbours = cut(neighbours)
    open_ = cut(rows.select("row_id").join(hubs, "row_id", "left_anti"))
    share = unassigned_share(neighbours.join(open_.withColumnRenamed("row_id", "i"), "i", "left_semi"), hubs)
    placed = open_.join(share.withColumnRenamed("i", "row_id"), "row_id", "left").select("row_id", F.coalesce("share", F.lit(2.0)).alias("share"))
    order = cut(numbered(placed, "share", "row_id", name="number", first=0).select("row_id", "number"))
    total = order.count()
    if not total:
        return hubs.select("row_id", "cid")
    labels = cut(hubs.select("row_id", F.col("cid").cast("int").alias("cid")))
    for first in range(0, total, chunk):
        mine = cut(order.where((F.col("number") >= first) & (F.col("number") < first + chunk)))
        links = neighbours.join(F.broadcast(mine.withColumnRenamed("row_id", "i")), "i")
        votes = links.join(labels.select(F.col("row_id").alias("j"), "cid"), "j").where("cid >= 0").groupBy("number", "cid").agg(F.count(F.lit(1)).alias("n"))
        within = links.join(F.broadcast(mine.select(F.col("row_id").alias("j"), F.col("number").alias("other"))), "j").where("other < number")
        todo = votes.select(F.lit(0).alias("kind"), "number", F.col("cid").cast("long").alias("what"), "n").union(within.select(F.lit(1), "number", "other", F.lit(1).cast("long"))).union(mine.select(F.lit(2), "number", "row_id", F.lit(0).cast("long")))
        labels = cut(labels.union(todo.withColumn("chunk", F.lit(first)).groupBy("chunk").applyInPandas(_in_order, "row_id long, cid int")).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return labels


#: Rows of a piece and of a chunk when neighbours are found anew; a task holds a chunk and which of its rows are neighbours.
PIECE = 256
FOUND = 4096


def fill_by_nearest(rows: DataFrame, hubs: DataFrame, metric: str = "euclidean", percent: float = 2.0, block: int = BLOCK, chunk: int = FOUND) -> DataFrame:
    """M23, M24 from rows (row_id, features): fill_by_neighbours with the neighbours that nearest_rows finds, of which none is stored or shuffled.

    Each row keeps the limit of its neighbours and the votes of the hubs.  Rows without a label are stored in the order, in pieces; a chunk of them meets
    the pieces labelled before it, which only gives counts, and one task finds the neighbours within the chunk and labels it in order."""
    spark = rows.sparkSession
    labels = cut(hubs.select("row_id", F.col("cid").cast("int").alias("cid")))
    found = Nearest(rows, (metric, percent), block=block, labels=labels)
    votes = cut(found.votes())
    limits = found.limits().join(labels, "row_id", "left_anti")
    share = unassigned_votes(votes).withColumnRenamed("i", "row_id")
    placed = limits.select("row_id").join(share, "row_id", "left").select("row_id", F.coalesce("share", F.lit(2.0)).alias("share"))
    order = cut(numbered(placed, "share", "row_id", name="number", first=0).select("row_id", "number", F.floor(F.col("number") / PIECE).alias("piece")))
    total = order.count()
    if not total:
        return labels

    def pack(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("number")
        columns = {"number": own.number.to_numpy(np.int64), "row_id": own.row_id.to_numpy(np.int64), "x": np.frombuffer(b"".join(own.x)), "value": own.value.to_numpy(float), "seen": seen[["number", "cid", "n"]].to_numpy(np.int64)}
        return pd.DataFrame({"piece": own.piece.iloc[:1].to_list(), **{c: [v.tobytes()] for c, v in columns.items()}})

    by_hubs = votes.where("cid >= 0").join(order.withColumnRenamed("row_id", "i"), "i").select("piece", "number", "cid", "n")
    pieces = cut(limits.join(order, "row_id").groupBy("piece").cogroup(by_hubs.groupBy("piece")).applyInPandas(pack, "piece long, number binary, row_id binary, x binary, value binary, seen binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units():
            for batch in batches:
                for k in range(batch.num_rows):
                    number, cid = array_of(batch, "number", k), array_of(batch, "cid", k)
                    x, y = array_of(batch, "x", k, float).reshape(len(number), -1), array_of(batch, "y", k, float).reshape(len(cid), -1)
                    yield batch.column("piece")[k].as_py(), number, nearer(x, y, metric, array_of(batch, "value", k, float)), cid

        return tallied(units())

    def label(own: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("piece")
        number, x, limit, seen = (np.concatenate([np.frombuffer(v, kind) for v in own[c]]) for c, kind in (("number", np.int64), ("x", float), ("value", float), ("seen", np.int64)))
        seen = np.concatenate([seen.reshape(-1, 3), counted[["i", "cid", "n"]].to_numpy(np.int64)])
        cid = _labels_of(x.reshape(len(number), -1), limit, seen - [number[0], 0, 0], metric)
        ends = np.cumsum([len(v) // 8 for v in own.number])[:-1]
        return pd.DataFrame({"row_id": own.row_id.to_list(), "y": own.x.to_list(), "cid": [c.tobytes() for c in np.split(cid, ends)]})

    done, size = [], max(1, chunk // PIECE)
    for first in range(0, -(-total // PIECE), size):
        mine = cut(pieces.where((F.col("piece") >= first) & (F.col("piece") < first + size)).repartition(4))
        if done:
            before = reduce(DataFrame.unionAll, [d.select("y", "cid") for d in done])
            units = mine.select("piece", "number", "x", "value").hint("shuffle_replicate_nl").crossJoin(before)
            counted = units.mapInArrow(count, "i long, cid long, n long").groupBy("i", "cid").agg(F.sum("n").alias("n"))
        else:
            counted = spark.createDataFrame([], "i long, cid long, n long")
        own, counted = (d.withColumn("chunk", F.lit(first)).groupBy("chunk") for d in (mine, counted))
        done.append(cut(own.cogroup(counted).applyInPandas(label, "row_id binary, y binary, cid binary").coalesce(1)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(array_of(batch, "row_id", k)), pa.array(array_of(batch, "cid", k), pa.int64()).cast(pa.int32())], names=["row_id", "cid"])

    return labels.unionAll(reduce(DataFrame.unionAll, [d.select("row_id", "cid") for d in done]).mapInArrow(unpack, "row_id long, cid int"))


def _labels_of(x: np.ndarray, limit: np.ndarray, votes: np.ndarray, metric: str) -> np.ndarray:
    """Labels of rows in order, from the votes (place, cid, n) of labelled rows and those of the rows among themselves."""
    cids = np.unique(np.r_[0, votes[:, 1]])  # 0 is the lowest, which a row without votes gets
    n = np.zeros((len(limit), len(cids)), np.int64)
    np.add.at(n, (votes[:, 0], np.searchsorted(cids, votes[:, 1])), votes[:, 2])
    out = np.zeros(len(limit), np.int64)
    for s in range(0, len(limit), PIECE):
        near = nearer(x[s : s + PIECE], x[: s + PIECE], metric, limit[s : s + PIECE])
        for r in range(s, s + len(near)):
            n[r] += np.bincount(out[:r][near[r - s, :r]], minlength=len(cids))
            out[r] = n[r].argmax()
    return cids[out]


def _in_order(todo: pd.DataFrame) -> pd.DataFrame:
    """Labels of a chunk of rows (kind 2), from votes (kind 0) and links to rows before (kind 1)."""
    votes, links, out = defaultdict(Counter), defaultdict(list), {}
    for kind, number, what, n in todo.loc[todo.kind < 2, ["kind", "number", "what", "n"]].itertuples(index=False):
        if kind:
            links[number].append(what)
        else:
            votes[number][what] += n
    ids = dict(todo.loc[todo.kind == 2, ["number", "what"]].itertuples(index=False))
    for number in sorted(ids):
        seen = votes[number]
        seen.update(out[o] for o in links[number])
        out[number] = min(seen, key=lambda c: (-seen[c], c), default=0)
    return pd.DataFrame({"row_id": [ids[k] for k in out], "cid": list(out.values())})
