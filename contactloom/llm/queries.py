"""The queries opN_<name> over the test tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, exact, media, mixing, packing, periodic, quality_crf, quality_rules, resampling, secrets_scan, substring, token_rollup, toxicity
from .common import materialise, read, remainder, shared_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return with_held_out(toxicity.score(docs, lexicon), remainder("doc_id", 4) == 2)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = quality_crf.fit(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return with_held_out(quality_crf.score(docs, field), remainder("doc_id", 5) == 0)


def with_held_out(scored: DataFrame, held_out: Column) -> DataFrame:
    first, *rest = scored.columns
    return scored.select(first, held_out.alias("held_out"), *rest)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert every document, revise its count by the end id, withdraw documents under five words, replay the revision, insert the withdrawn ones again: the totals are over all documents."""
    counts = materialise(token_rollup.count_tokens(read(spark, sf_dir, "documents")).withColumn("n_closed", F.col("n_tokens") + 1), "token-counts")
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    versions = [("words-1", "n_words"), ("word_bpe_49k", "n_tokens")]
    revised = token_rollup.revisions(counts, "word_bpe_49k", "n_tokens", "n_closed")
    rollup.commit("0001-insert", token_rollup.inserts(counts, versions))
    rollup.commit("0002-revise", revised)
    short, closed = counts.where("n_words < 5"), [("words-1", "n_words"), ("word_bpe_49k", "n_closed")]
    rollup.commit("0003-delete", token_rollup.deletes(short, closed))
    rollup.commit("0002-revise", revised)
    rollup.commit("0004-insert", token_rollup.inserts(short, closed))
    return rollup.totals()


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(read(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its stored form's and payload's digests, and the full-resolution RGB tensor (height, width, rgb)."""
    return media.media(read(spark, sf_dir, "documents"), tensors=True)


def repeating(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's edit: of every tenth document by id the words from some place on are made periodic. Null ids are left as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g, order = h // 10, np.arange(n)
    a = g % n
    order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(read(spark, sf_dir, "documents"), repeating)
    by_exponent = """array_sort(runs, (x, y) -> case when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1)
        when x.start <> y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, if(x.period = y.period, 0, 1)) end)"""
    return found.withColumn("top", F.expr(f"try_element_at({by_exponent}, 1)")).selectExpr(
        "doc_id", "cast(size(runs) as long) as n_runs", "top.start as start", "top.length as length", "top.period as period", "1000 * top.length div top.period as exponent_milli",
        "sha2(cast(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '') as binary), 256) as runs_sha256",
        "sha2(cast(collapsed as binary), 256) as collapsed_sha256",
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.verdicts(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is all texts of benchmark."""
    drawn = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), target_id="item_id")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_crf": op2_quality_crf,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_token_rollup": op5_token_rollup,
    "op6_bagminhash": op6_bagminhash,
    "op7_substring": op7_substring,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE: dict[str, str] = {
    "op12_exact_dedup": """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g')) AS text_sha256, row_number() OVER () AS r FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g""",
}
