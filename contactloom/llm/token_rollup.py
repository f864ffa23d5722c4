"""Token counts: additive rollups by source, language and tokenizer version, kept up by signed changes.

A change feed has signed rows: an insert adds a document and its tokens, a delete
takes them away, a revised count takes the old one away and adds the new one.  A
batch is reduced to one row for each (source, lang, version) and written to a folder
of its own; then a mark with the batch's id, which names that folder, is renamed into
place, which fails if the id has a mark already.  So of several drivers that commit
one id exactly one wins, a job that dies before its mark leaves nothing behind that
is read, and replays and retried jobs change nothing.  Looking for one mark is all
that a commit asks of earlier ones.  Totals are the sums over marked batches;
compact() folds them into a base that remembers which batches it holds.

Nulls in source, lang or version are groups of their own; null counts are 0.  Null
texts count as empty, very long ones whole.  Repeated rows count each.  Totals of no
documents and no tokens are left out.  Empty batches commit and change nothing.
Columns besides those named are passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, column
from .kernel import chunks
from .packing import tokenizer_path
from .word_tokens import token_ids

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class Rollup:
    """A rollup table in a folder that all executors share: data/ has the deltas, marks/ a file for each batch, bases/ one for each base."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def _files(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(self._path(self.path).toString()), self.spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(p)

    def _exists(self, path: str) -> bool:
        return self._files.util().exists(self._path(path))

    def _names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.util().listStatus(self._path(path))) if self._exists(path) else []

    def _claim(self, path: str, text: str) -> bool:
        """Put a file with this text at path, in one step; false if there is one."""
        files, jvm = self._files, self.spark._jvm
        sc = self.spark.sparkContext
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        # a one-row text table would be a folder; the file is written by the file system itself
        made = self._path(draft).getFileSystem(self.spark._jsc.hadoopConfiguration()).create(self._path(draft))
        made.write(bytearray(text.encode()))
        made.close()
        files.mkdir(self._path(path).getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without OVERWRITE the rename fails if the target exists
        try:
            files.rename(self._path(draft), self._path(path), options)
            return True
        except Py4JJavaError as e:
            if not self._exists(path):
                raise
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            files.delete(self._path(draft), False)
            return False

    def _read(self, folder: str, names: list[str]) -> list[str]:
        return [r.value for r in self.spark.read.text([f"{self.path}/{folder}/{n}" for n in names]).collect()] if names else []

    def committed(self) -> list[str]:
        """Ids of committed batches."""
        return self._names(f"{self.path}/marks")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply signed events (source, lang, tokenizer_version, n_docs, n_tokens); false if the batch is already in."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum() or batch.startswith("_"):
            raise ValueError("a batch id has letters, digits, - and _, and begins with none of these signs")
        if self._exists(f"{self.path}/marks/{batch}"):
            return False
        delta = events.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in ("n_docs", "n_tokens")))
        name = uuid.uuid4().hex
        delta.write.parquet(f"{self.path}/data/{name}")
        return self._claim(f"{self.path}/marks/{batch}", json.dumps({"batch": batch, "data": name}))

    def _base(self) -> dict:
        names = self._names(f"{self.path}/bases")
        return json.loads(self._read("bases", names[-1:])[0]) if names else {"held": [], "data": None}

    def _rows(self) -> tuple[DataFrame, list[str]]:
        base = self._base()
        held = set(base["held"])
        marks = [json.loads(t) for t in self._read("marks", [b for b in self.committed() if b not in held])]
        paths = [f"{self.path}/data/{d}" for d in [*(m["data"] for m in marks), base["data"]] if d]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows, sorted(held | {m["batch"] for m in marks})

    def totals(self) -> DataFrame:
        sums = self._rows()[0].groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens")))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Fold the committed batches into a new base; false if another driver made one meanwhile.  The old files stay until they are removed by hand."""
        number = len(self._names(f"{self.path}/bases"))
        rows, held = self._rows()
        name = uuid.uuid4().hex
        rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens"))).write.parquet(f"{self.path}/data/{name}")
        return self._claim(f"{self.path}/bases/{number:06d}", json.dumps({"held": held, "data": name}))


def inserts(counts: DataFrame, versions: Iterable[tuple[str, str]], sign: int = 1) -> DataFrame:
    """Signed rows for documents (source, lang, a column of counts for each version)."""
    each = F.array(*(F.struct(F.lit(v).alias("tokenizer_version"), F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * F.col(c)).cast("long").alias("n_tokens")) for v, c in versions))
    return counts.select("source", "lang", F.inline(each))


def deletes(counts: DataFrame, versions: Iterable[tuple[str, str]]) -> DataFrame:
    return inserts(counts, versions, -1)


def revisions(counts: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Signed rows for changed counts: the old one goes, the new one comes."""
    return deletes(counts, [(version, old)]).union(inserts(counts, [(version, new)]))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(source, lang, n_words, n_tokens) of every row of docs: white-space words, and ids of the tokenizer file at `path`."""
    path = path or tokenizer_path()

    def run(batch: pa.RecordBatch) -> dict:
        text = column(batch, "text")
        words = [np.zeros(0, np.int64)] + [np.diff(c.bounds) for c in chunks(text)]
        tokens = [np.zeros(0, np.int64)] + [np.diff(b) for _, _, b in token_ids(text, path)]
        return {"source": column(batch, "source"), "lang": column(batch, "lang"), "n_words": np.concatenate(words), "n_tokens": np.concatenate(tokens)}

    return arrow_map(docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text"), run, "source string, lang string, n_words long, n_tokens long")
