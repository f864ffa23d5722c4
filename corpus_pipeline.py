"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Between stages the rows are written as Parquet
and read again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import bagminhash, mixing, packing, quality_rules, secrets_scan
from contactloom.llm.common import columns_of, fresh, join_checked, materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier is fitted on the labelled rows among the stage's input.

    Null and empty texts go, repeated rows are judged alike, an empty table stays empty."""
    return quality_rules.keep(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the smallest doc_id (ids before null).

    A row goes only if its own text is in the class of a kept one, so rows without an id, or different texts
    under one id, stand each for themselves.  Of repeated rows (one doc_id, one text) one stays; null counts as
    the empty text, and texts without words are one class.  All columns are kept, whatever their names."""
    found = materialise(bagminhash.marked(docs), "stage-classes")
    (key,) = fresh(docs, "dedup_key")
    keyed = docs.withColumn(key, bagminhash.row_key())
    gone = materialise(found.where("not is_first").select(F.col("key").alias(key)).distinct(), "stage-gone")
    kept = join_checked(keyed, gone, key, "left_anti")
    again = materialise(found.where("is_first").groupBy(F.col("key").alias(key)).count().where("count > 1").select(key), "stage-again")
    if again.limit(1).count():
        kept = join_checked(kept, again, key, "left_anti").union(join_checked(kept, again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*columns_of(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked in the text, and n_chars follows it; every document stays, null texts stay null."""
    return secrets_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: the written files hold it, by number and row, and packing follows it.

    Rows without a source are a source of their own; repeated rows stay."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset, packed in the order in which the mixing stage stored its rows.

    docs that are not read from files have no such order and are packed without one."""
    try:
        order = packing.stored_order(docs)
        docs.select(order)
    except AnalysisException:
        order = None
    return packing.pack(docs, order=order)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mix), ("packing", pack)]
#: The classifier, signatures and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
