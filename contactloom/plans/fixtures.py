"""Relations of the engine's shapes, derived from the test tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..runtime import prepare

#: Bin width of the derived relations.
RESOLUTION = 1_000_000


def _contacts(chromosomes: int, bins: int) -> str:
    pair = lambda key: f"CAST(({key} % {chromosomes} + 1) * 1000 + FLOOR({key} / {chromosomes}) % {bins} AS BIGINT)"
    return (
        f"SELECT CAST(FLOOR(lo / 1000) AS INT) AS chr1, CAST(lo % 1000 AS INT) AS bin1, CAST(FLOOR(hi / 1000) AS INT) AS chr2, CAST(hi % 1000 AS INT) AS bin2, CAST(SUM(q) AS DOUBLE) AS cnt "
        f"FROM (SELECT LEAST(la, lb) AS lo, GREATEST(la, lb) AS hi, q FROM (SELECT {pair('l_partkey')} AS la, {pair('l_orderkey')} AS lb, l_quantity AS q FROM lineitem) l) m GROUP BY lo, hi"
    )


def _track(key: str) -> str:
    return (
        f"SELECT CAST({key} % 4 + 1 AS INT) AS chr_idx, CAST(FLOOR({key} / 4) % 60 AS INT) * 1000000 AS x1, CAST(FLOOR({key} / 4) % 60 AS INT) * 1000000 + 1000000 AS x2, "
        f"CAST(COUNT(*) % 4 AS INT) AS cluster_id FROM lineitem GROUP BY {key} % 4, FLOOR({key} / 4) % 60"
    )


def _chroms(n: int, length: int) -> str:
    return f"SELECT chr_idx, CONCAT('chr', chr_idx) AS name, CAST({length} AS BIGINT) AS length FROM (SELECT DISTINCT CAST(l_partkey % {n} + 1 AS INT) AS chr_idx FROM lineitem) c"


_BED = (
    "SELECT l_orderkey * 10 + l_linenumber AS line_no, CONCAT(CASE WHEN l_linenumber = 7 THEN 'x' ELSE 'chr' END, l_partkey % 5 + 1, chr(9), FLOOR(l_partkey / 4) % 60 * 1000000, chr(9), "
    "FLOOR(l_partkey / 4) % 60 * 1000000 + 1500000, chr(9), CASE WHEN l_linenumber = 3 THEN 'na' WHEN l_linenumber % 2 = 0 THEN CONCAT('a', l_suppkey % 5) ELSE CONCAT('A', l_suppkey % 5) END, "
    "CASE WHEN l_linenumber = 5 THEN '' ELSE CONCAT(chr(9), '9') END) AS value FROM (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(MIN(l_partkey) AS INT) AS l_partkey, CAST(MIN(l_suppkey) AS INT) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) t"
)

#: Common SQL of the relations.
SHARED = {
    "chroms": _chroms(4, 59_999_999),
    "chroms_intra": _chroms(2, 149_999_999),
    "contacts": _contacts(4, 60),
    "contacts_intra": _contacts(2, 150),
    "track_a": _track("l_partkey"),
    "track_b": _track("l_orderkey"),
    "norm_vec": "SELECT CAST(c_nationkey % 4 + 1 AS INT) AS chr_idx, CAST(c_custkey AS INT) AS bin, CAST(c_acctbal AS DOUBLE) AS value FROM customer",
    "bed": _BED.replace("FLOOR(l_partkey / 4) % 60 * 1000000 + 1500000", "CAST(FLOOR(l_partkey / 4) AS INT) % 60 * 1000000 + 1500000").replace("FLOOR(l_partkey / 4) % 60 * 1000000,", "CAST(FLOOR(l_partkey / 4) AS INT) % 60 * 1000000,"),
    "wide_track": "SELECT CAST(o_custkey % 4 + 1 AS INT) AS chr_idx, CAST(o_orderkey % 40 AS INT) * 500000 AS x1, CAST(o_orderkey % 40 AS INT) * 500000 + CAST(MIN(o_custkey) % 7 AS INT) * 400000 AS x2, CAST(MAX(o_custkey) % 3 AS INT) AS cluster_id FROM orders GROUP BY o_custkey % 4, o_orderkey % 40",
}
#: By engine: cells of a 64-column matrix with about 1/17 of them masked.
_MASK = "CASE WHEN (vec_id * 64 + {j}) % 17 = 0 THEN NULL ELSE CAST({x} AS DOUBLE) END"
SPARK = SHARED | {"matrix": "SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(col_id AS INT) AS col_id, " + _MASK.format(j="col_id", x="x") + " AS v FROM embeddings LATERAL VIEW posexplode(embedding) p AS col_id, x"}
DUCK = SHARED | {"matrix": "SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(j - 1 AS INT) AS col_id, " + _MASK.format(j="j - 1", x="embedding[j]") + " AS v FROM embeddings, range(1, 65) t(j)"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the Parquet tables of a folder."""
    sql = re.sub(r"FROM (lineitem|customer|orders|embeddings)\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", SPARK[name])
    return prepare(spark).sql(sql)


def oracle(body: str, *names: str, **more: str) -> str:
    """DuckDB SQL: the named relations and further ones as common table expressions before the body."""
    parts = [f"{n} AS ({DUCK[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
