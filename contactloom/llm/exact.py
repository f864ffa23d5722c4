"""Exact dedup by a tree-merge of sorted digest runs, in built-in DataFrame functions only.

Texts are equal when they are identical after deleting every character of `[\\x20\\x09-\\x0D]`.

1. Every input partition is a leaf of the tree.  Its rows become a run: SHA-256, MD5 and byte length of
   the normalised text, code points of the original text, doc_id and a row number; texts go no further.
2. Level 0 merges the rows of a leaf by digest.  Spark's sort aggregation does it: every task sorts its
   own rows by key and folds equal neighbours before anything is sent.
3. Level r merges the runs of `2**BITS` nodes that differ in the r-th group of bits of the leaf number
   (BITS rounds of a binomial exchange at once): a multiway merge of sorted runs.  An entry keeps the
   best candidate (most code points, then smallest doc_id, then smallest row number) and the group's
   rows.  Entries meet only where SHA-256, MD5 and length all agree: that verifies the identifier at
   each level, so two texts are taken for one only if both digests and the length collide.
4. The root has no node number left but is still dealt by digest, so no task holds it whole.  Answers
   of groups of two rows or more go back down the same levels.  A join between two levels meets at most
   `2**BITS` children of a parent, and the last one at most the rows of a leaf; a group with a third of
   all rows never meets under one key.

Levels are written tables in the shared folder, so a lost executor costs one level's tasks.

A null text counts as the empty text; whitespace alone equals it.  A null doc_id sorts behind all
others, and a group of null ids alone has a null keep_id.  Of repeated rows (one doc_id, one length)
exactly one stays.  Empty tables give empty results; other columns are passed over, whatever their names.
A text is held whole, three times at most, while its digests are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, join_checked, materialise, quoted

#: Deleted before texts are compared: fixed values of the contract.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Bits of the leaf number that one level merges.
BITS = 4
DIGEST = ["sha", "md", "size"]


def normalised(text: Column) -> Column:
    """The text without whitespace; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITESPACE, "")


def leaves(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """The leaf runs: one entry a row, with the number of its leaf.  row names a column that numbers rows; else they are numbered here."""
    raw, norm = F.col(quoted(text)), F.col("norm")
    rows = docs.select(
        F.col(quoted(doc_id)).cast("long").alias("doc_id"),
        F.coalesce(F.char_length(raw.cast("string")), F.lit(0)).cast("long").alias("points"),
        (F.col(quoted(row)).cast("long") if row else F.monotonically_increasing_id()).alias("row"),
        F.spark_partition_id().alias("leaf"),
        normalised(raw).alias("norm"),
    )
    sha, md = (F.unhex(f) for f in (F.sha2(norm.cast("binary"), 256), F.md5(norm.cast("binary"))))
    return rows.select("doc_id", "points", "row", "leaf", sha.alias("sha"), md.alias("md"), F.octet_length("norm").cast("long").alias("size"))


def candidate() -> Column:
    """Ordered so that the least is the row that stays."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def merge_up(runs: DataFrame) -> list[DataFrame]:
    """The levels of the tree from the leaves to the root: digest, node, best candidate, rows."""
    level = runs.groupBy(*DIGEST, F.col("leaf").alias("node")).agg(F.min(candidate()).alias("best"), F.count("*").alias("n"))
    levels = [materialise(level, "digest-level")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        top >>= BITS
        level = levels[-1].groupBy(*DIGEST, F.shiftright("node", BITS).alias("node")).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        levels.append(materialise(level, "digest-level"))
    return levels


def hand_down(levels: list[DataFrame]) -> DataFrame:
    """Digest, leaf, keeper and size of every group of two rows or more, for each leaf that holds a row of it."""
    answer = levels[-1].where("n > 1").select(*DIGEST, F.col("node").alias("up"), F.col("best").alias("keep"), F.col("n").alias("group_size"))
    for below in reversed(levels[:-1]):
        children = below.select(*DIGEST, "node", F.shiftright("node", BITS).alias("up"))
        answer = children.join(answer, [*DIGEST, "up"]).select(*DIGEST, F.col("node").alias("up"), "keep", "group_size")
    return answer.select(*DIGEST, F.col("up").alias("leaf"), "keep", "group_size")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row): one row for each row of docs."""
    runs = materialise(leaves(docs, doc_id, text, row), "digest-leaves")
    found = runs.join(hand_down(merge_up(runs)), [*DIGEST, "leaf"], "left")
    alone = F.col("keep").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row",
    )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns as they are."""
    (number,) = fresh(docs, "row_number")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    gone = materialise(verdicts(numbered, row=number).where("not kept").select(F.col("row").alias(number)), "gone")
    return join_checked(numbered, gone, number, "left_anti").select(*columns_of(docs))
