"""Exports of results: arrays, text matrices, heat maps and reports.

Heat maps are drawn by the driver and meant for small matrices; `most` bounds what they collect."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.colours import blend
from ..operators.cluster import centre_pairs, chi_square, similar_entries
from . import array_file

#: Cells that an export to the driver may hold.
MOST = 4_000_000
#: Sides below this are drawn with enlarged cells.
SMALL_SIDE, ENLARGED = 50, 50


def dense(cells: DataFrame, most: int = MOST) -> np.ndarray:
    """A small matrix (row_id, col_id, v) as an array, nan where masked; larger ones are refused."""
    top = cells.agg((F.max("row_id") + 1).alias("r"), (F.max("col_id") + 1).alias("c")).first()
    r, c = top.r or 0, top.c or 0
    if r * c > most:
        raise ValueError(f"{r} x {c} cells are more than {most}; write the cells as Parquet")
    out = np.full((r, c), np.nan)
    for x in cells.toLocalIterator():
        out[x.row_id, x.col_id] = np.nan if x.v is None else x.v
    return out


def save_array(cells: DataFrame, path: str) -> tuple[int, int]:
    """K4: .npy file of a matrix of any size, written by tasks; its shape."""
    return array_file.save(cells, path)


def text_matrix(rows: DataFrame) -> DataFrame:
    """K5: lines (value) of space-separated features in row order, NaN where masked; to be written with write.text."""
    parts = F.transform("features", lambda x: F.coalesce(x.cast("string"), F.lit("NaN")))
    return rows.orderBy("row_id").select(F.concat_ws(" ", parts).alias("value"))


def heat_map(cells: DataFrame, path: str, log: bool = False, most: int = MOST) -> None:
    """PNG from white to red, small matrices with enlarged cells."""
    m = np.nan_to_num(dense(cells.withColumn("v", F.log1p("v")) if log else cells, most))
    low, high = (float(m.min()), float(m.max())) if m.size else (0.0, 0.0)
    share = np.round(255 * (m - low) / (high - low)).astype(int) if high > low else np.zeros(m.shape, int)
    pixels = np.array([blend(i / 255) for i in range(256)], np.uint8)[share]
    if min(m.shape, default=0) < SMALL_SIDE:
        pixels = pixels.repeat(ENLARGED, 0).repeat(ENLARGED, 1)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def score_report(scores: DataFrame, means: DataFrame) -> str:
    """Lines of every score by map type, then the geometric means; a handful of rows."""
    lines = [f"{r.map_type}\t{r.score_type}\tshuffled {r.shuffled:.6g}\tbaseline {r.baseline:.6g}\tscore {r.ratio:.6g}" for r in scores.orderBy("map_type", "score_type").collect() if r.ratio is not None]
    return "\n".join(lines + [f"geometric mean\t{r.score_type}\t{r.geometric_mean:.6g}" for r in means.orderBy("score_type").collect()])


def cluster_statistics(members: DataFrame, centres: DataFrame) -> DataFrame:
    """K9: for each pair of clusters sizes, distance, chi-square with p, and the number of similar entries."""
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    pairs = centre_pairs(centres).select("c1", "c2", vectors.euclidean("a", "b").alias("distance"))
    out = pairs.join(chi_square(centres), ["c1", "c2"]).join(similar_entries(centres), ["c1", "c2"])
    out = out.join(size.select(F.col("cid").alias("c1"), F.col("n").alias("n1")), "c1", "left")
    return out.join(size.select(F.col("cid").alias("c2"), F.col("n").alias("n2")), "c2", "left").select("c1", "c2", "n1", "n2", "distance", "statistic", "p", "n_similar")
