"""Registered queries of the library's own operators, each with the same relation as SQL.

A query applies one operator to the derived relations of fixtures.py.  Whole numbers
come out as long, fractions as double rounded to six places, on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import colours, scalars, vectors
from ..operators import contacts as C
from ..operators import intervals as I
from ..operators import matrix as M
from ..operators import metrics as D
from ..operators import scoring as S
from ..operators import tracks as T
from ..runtime import cut, numbered, prepare, shared_root
from ..sources import array_file, bed, exports, raw_contacts, tables
from ..streaming import upkeep
from .fixtures import DUCK, RESOLUTION, oracle, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Relations:
    """Derived relations by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return relation(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)


def _columns(spec: str) -> list[tuple[str, str]]:
    """"a b|c|d": whole numbers, fractions, strings."""
    return [(c, kind) for part, kind in zip((spec + "||").split("|"), ("long", "double", "string"), strict=False) for c in part.split()]


def add(name: str, spec: str, build: Callable[[Relations], DataFrame], body: str | None = None, *names: str, **more: str) -> None:
    columns = _columns(spec)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(Relations(spark, sf_dir))
        return out.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if k == "double" else F.col(c).cast(k).alias(c) for c, k in columns])

    QUERIES[name] = query
    if body is not None:
        picked = ", ".join(f'ROUND(CAST("{c}" AS DOUBLE), 6) AS "{c}"' if k == "double" else f'CAST("{c}" AS {"BIGINT" if k == "long" else "VARCHAR"}) AS "{c}"' for c, k in columns)
        ORACLE[name] = oracle(f"SELECT {picked} FROM ({body}) result", *names, **more)


R = RESOLUTION
CELL = "chr1 bin1 chr2 bin2|cnt"
ROW = "chr_idx x1 x2 cluster_id"

# -- pieces of SQL that several oracles share -------------------------------------------------------------------
LAST = "(SELECT chr_idx, x1, arg_max(cluster_id, CAST(x2 AS BIGINT) * 1000 + cluster_id) AS cluster_id FROM {t} GROUP BY chr_idx, x1)"
TABLE = f"SELECT a.cluster_id AS id1, b.cluster_id AS id2, COUNT(*) AS n FROM {LAST.format(t='track_a')} a JOIN {LAST.format(t='track_b')} b USING (chr_idx, x1) WHERE a.cluster_id >= 0 AND b.cluster_id >= 0 GROUP BY 1, 2"
TABLE_CHR = TABLE.replace("SELECT a", "SELECT chr_idx, a", 1).replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")
INTRA = "SELECT chr1 AS chr_idx, bin1, bin2, ABS(bin1 - bin2) AS dist, cnt FROM contacts_intra WHERE chr1 = chr2"
STATS = "SELECT chr_idx, dist, COUNT(*) AS n, AVG(cnt) AS mean, STDDEV_SAMP(cnt) AS sd FROM intra GROUP BY 1, 2"
VALID = "SELECT chr_idx, arg_min(lo, lo) + 1 AS first, arg_min(hi, lo) - 1 AS last FROM (SELECT chr_idx, i, MIN(dist) AS lo, MAX(dist) AS hi FROM (SELECT chr_idx, dist, dist - ROW_NUMBER() OVER (PARTITION BY chr_idx ORDER BY dist) AS i FROM stats WHERE n >= 50) GROUP BY 1, 2) GROUP BY 1"
ZROWS = "SELECT i.*, (cnt - mean) / NULLIF(sd, 0) AS z FROM intra i JOIN stats USING (chr_idx, dist) JOIN valid USING (chr_idx) WHERE dist BETWEEN first AND last"
BAD = "SELECT v.chr_idx, v.bin FROM norm_vec v JOIN (SELECT chr_idx, AVG(CASE WHEN value > 0 THEN LN(CASE WHEN value > 0 THEN value END) END) AS m, STDDEV_SAMP(CASE WHEN value > 0 THEN LN(CASE WHEN value > 0 THEN value END) END) AS s FROM norm_vec GROUP BY 1) USING (chr_idx) WHERE NOT (value > 0) OR (LN(CASE WHEN value > 0 THEN value END) - m) / s < -3 OR (LN(CASE WHEN value > 0 THEN value END) - m) / s > 5"
LABELS = f"SELECT chr_idx, bin, arg_max(cluster_id, x1) AS cluster_id FROM (SELECT chr_idx, x1, cluster_id, UNNEST(range(x1 // {R}, x2 // {R})) AS bin FROM track_a) GROUP BY 1, 2"
BOTH = "SELECT c.*, a.cluster_id AS id1, b.cluster_id AS id2 FROM contacts c JOIN labels a ON a.chr_idx = chr1 AND a.bin = bin1 JOIN labels b ON b.chr_idx = chr2 AND b.bin = bin2"
AREA = "SELECT a.chr_idx AS chr1, b.chr_idx AS chr2, a.cluster_id AS id1, b.cluster_id AS id2, COUNT(*) AS area FROM labels a JOIN labels b ON a.chr_idx < b.chr_idx GROUP BY 1, 2, 3, 4"
DENSITY = "SELECT chr1, chr2, id1, id2, COALESCE(s, 0) / area AS density FROM area LEFT JOIN (SELECT chr1, chr2, id1, id2, SUM(LN(1 + cnt)) AS s FROM pairs WHERE cnt > 0 AND chr1 < chr2 GROUP BY 1, 2, 3, 4) USING (chr1, chr2, id1, id2)"
CV = "SELECT id1, id2, STDDEV_SAMP(density) / AVG(density) AS cv FROM density WHERE density > 0 GROUP BY 1, 2 HAVING COUNT(*) > 3"
BINMAP = "SELECT chr_idx, bin, cluster_id + (DENSE_RANK() OVER (ORDER BY chr_idx) - 1) * (SELECT MAX(cluster_id) + 1 FROM labels) AS proto, ROW_NUMBER() OVER (ORDER BY chr_idx, bin) - 1 AS row_id FROM labels"
ENDS = "SELECT a.row_id, b.proto AS col_id, cnt AS v FROM contacts JOIN bin_map a ON a.chr_idx = chr1 AND a.bin = bin1 JOIN bin_map b ON b.chr_idx = chr2 AND b.bin = bin2 WHERE cnt > 0 AND chr1 <> chr2 UNION ALL SELECT b.row_id, a.proto, cnt FROM contacts JOIN bin_map a ON a.chr_idx = chr1 AND a.bin = bin1 JOIN bin_map b ON b.chr_idx = chr2 AND b.bin = bin2 WHERE cnt > 0 AND chr1 <> chr2"
SUMS = "SELECT row_id, col_id, SUM(v) AS v FROM ends GROUP BY 1, 2"
DENSE = "SELECT r.row_id, c.col_id, COALESCE(v, 0) AS v FROM bin_map r CROSS JOIN (SELECT DISTINCT proto AS col_id FROM bin_map) c LEFT JOIN sums USING (row_id, col_id) WHERE NOT EXISTS (SELECT 1 FROM bin_map o WHERE o.chr_idx = r.chr_idx AND o.proto = c.col_id)"
CHAIN = {"labels": LABELS, "bin_map": BINMAP, "ends": ENDS, "sums": SUMS, "dense": DENSE}
ZCHAIN = {"intra": INTRA, "stats": STATS, "valid": VALID, "zrows": ZROWS}


def labels(r: Relations) -> DataFrame:
    return T.bins_of(r.track_a, R)


def bin_map(r: Relations) -> DataFrame:
    return cut(M.bed_mapping(labels(r)))


def dense(r: Relations) -> DataFrame:
    return M.build(r.contacts, bin_map(r))[0]


def stored(r: Relations, relation: DataFrame, name: str) -> str:
    """A new folder below the shared one that holds a relation as four files."""
    folder = f"{shared_root(r.spark)}/{name}-{uuid.uuid4().hex}"
    relation.repartition(4).write.parquet(f"{folder}/rows")
    return folder


def streamed(r: Relations, relation: DataFrame, build: Callable[[str], upkeep.Upkeep]) -> DataFrame:
    """A relation's rows as a stream of one file a micro-batch, and the state after it."""
    folder = stored(r, relation, "stream")
    kept = build(f"{folder}/state")
    kept.every = 3  # a snapshot on the way
    kept.start(r.spark.readStream.schema(relation.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")).awaitTermination()
    return kept.current()


def raw_files(r: Relations) -> DataFrame:
    """The contacts, exported as raw files and read again."""
    folder = f"{shared_root(r.spark)}/raw-{uuid.uuid4().hex}"
    raw_contacts.export(r.contacts.withColumn("resolution", F.lit(R)), r.chroms, folder)
    return raw_contacts.contacts(r.spark, folder).where(F.col("resolution") == R)


# -- sources ---------------------------------------------------------------------------------------------------
add("s1_contacts", CELL, lambda r: r.contacts, "SELECT * FROM contacts", "contacts")
add("s1_raw_contacts", CELL, raw_files, "SELECT * FROM contacts", "contacts")
add("s2_raw_block", CELL, lambda r: tables.block(raw_files(r), 3, 1), "SELECT chr2 AS chr1, bin2 AS bin1, chr1 AS chr2, bin1 AS bin2, cnt FROM contacts WHERE chr1 = 1 AND chr2 = 3", "contacts")
add("s2_block", CELL, lambda r: tables.block(r.contacts, 1, 3), "SELECT * FROM contacts WHERE chr1 = 1 AND chr2 = 3", "contacts")
add("s3_normalised", CELL, lambda r: tables.normalised(r.contacts, r.norm_vec.where("bin < 60")),
    "SELECT c.chr1, c.bin1, c.chr2, c.bin2, cnt / (a.value * b.value) AS cnt FROM contacts c JOIN norm_vec a ON a.chr_idx = chr1 AND a.bin = bin1 JOIN norm_vec b ON b.chr_idx = chr2 AND b.bin = bin2 WHERE a.value > 0 AND b.value > 0 AND a.bin < 60 AND b.bin < 60", "contacts", "norm_vec")
add("s4_flipped_block", CELL, lambda r: tables.block(r.contacts, 4, 2), "SELECT chr2 AS chr1, bin2 AS bin1, chr1 AS chr2, bin1 AS bin2, cnt FROM contacts WHERE chr1 = 2 AND chr2 = 4", "contacts")
add("s5_norm_vector", "chr_idx bin|value", lambda r: tables.norm_vector(r.norm_vec.withColumns({"norm": F.lit("VC"), "resolution": F.lit(R)}), "VC", R, 2), "SELECT * FROM norm_vec WHERE chr_idx = 2", "norm_vec")
EXPECTED = "SELECT chr_idx, dist, mean AS value FROM stats"


def expected(r: Relations) -> DataFrame:
    return C.distance_stats(r.contacts_intra).select("chr_idx", "dist", F.col("mean").alias("value"))


add("s6_expected_at", "chr1 chr2|cutoff", lambda r: tables.expected_at(expected(r), 1), "SELECT a.chr_idx AS chr1, b.chr_idx AS chr2, LEAST(a.mean, b.mean) AS cutoff FROM stats a JOIN stats b ON a.chr_idx < b.chr_idx AND a.dist = 1 AND b.dist = 1", "contacts_intra", intra=INTRA, stats=STATS)
add("s7_resolution", "resolution", lambda r: tables.choose_resolution(r.contacts.select((F.col("chr1") * 500000).alias("resolution")), 1_000_000), "SELECT CASE WHEN MAX(CASE WHEN chr1 * 500000 = 1000000 THEN 1 END) = 1 THEN 1000000 ELSE MAX(chr1) * 500000 END AS resolution FROM contacts", "contacts")
add("s8_chromosomes", "chr_idx length||name", lambda r: r.chroms, "SELECT * FROM chroms", "chroms")
FIELDS = "SELECT line_no, f[1] AS name, CAST(f[2] AS INT) AS x1, CAST(f[3] AS INT) AS x2, UPPER(f[4]) AS cluster_name FROM (SELECT line_no, string_split(value, chr(9)) AS f FROM bed) WHERE LEN(f) >= 5 AND f[1] LIKE 'chr%' AND UPPER(f[4]) <> 'NA'"
IDS = "SELECT cluster_name, ROW_NUMBER() OVER (ORDER BY MIN(line_no)) - 1 AS cluster_id FROM fields GROUP BY cluster_name"
PARSED = "SELECT chr_idx, x1, MIN(LEAST(x2, length)) AS x2, arg_min(cluster_id, line_no) AS cluster_id, arg_min(cluster_name, line_no) AS cluster_name FROM fields JOIN ids USING (cluster_name) JOIN chroms USING (name) GROUP BY chr_idx, x1, LEAST(x2, length)"
BED = {"fields": FIELDS, "ids": IDS, "parsed": PARSED}
add("s9_bed_fields", "line_no x1 x2||name cluster_name", lambda r: bed.fields(r.bed), "SELECT * FROM fields", "bed", fields=FIELDS)
add("s10_bed_at_resolution", f"{ROW}||cluster_name", lambda r: I.split(bed.parse(r.bed, r.chroms), R), f"SELECT chr_idx, s AS x1, LEAST(s + {R}, x2) AS x2, cluster_id, cluster_name FROM (SELECT *, UNNEST(range(x1, CAST(x2 AS BIGINT), {R})) AS s FROM parsed)", "bed", "chroms", **BED)
add("s11_bed_track", f"{ROW}||cluster_name", lambda r: bed.parse(r.bed, r.chroms), "SELECT * FROM parsed", "bed", "chroms", **BED)
add("s12_norm_choice", "||intra inter", lambda r: r.spark.createDataFrame([tables.pick_norms(r.contacts.select(F.concat(F.lit("INTER_VC"), F.when(F.col("chr1") == 1, "").otherwise("X")).alias("norm")).union(r.contacts.select(F.lit("KR"))))], "intra string, inter string"), "SELECT 'KR' AS intra, 'INTER_VC' AS inter FROM contacts LIMIT 1", "contacts")


def two_tracks(r: Relations) -> DataFrame:
    return r.track_a.withColumn("track_id", F.lit("a")).unionByName(r.track_b.withColumn("track_id", F.lit("b")))


TWO = "SELECT 'a' AS track_id, * FROM track_a UNION ALL SELECT 'b', * FROM track_b"
add("s13_many_tracks", f"{ROW}||track_id", two_tracks, TWO, "track_a", "track_b")

# -- sinks -----------------------------------------------------------------------------------------------------
NAMES = "[" + ", ".join("'" + ",".join(map(str, c)) + "'" for c in colours.PALETTE) + "]"
NAMED = lambda r: r.track_a.withColumn("cluster_name", F.concat(F.lit("C"), "cluster_id"))
TAB = "chr(9)"
add("k1_bed9", "||value", lambda r: bed.bed9(NAMED(r), r.chroms), f"SELECT CONCAT_WS({TAB}, name, x1, x2, CONCAT('C', cluster_id), cluster_id, '.', x1, x2, {NAMES}[cluster_id % 20 + 1]) AS value FROM track_a JOIN chroms USING (chr_idx)", "track_a", "chroms")
add("k2_bed_graph", "||value", lambda r: bed.bed_graph(r.track_a.withColumn("value", F.col("cluster_id")), r.chroms), f"SELECT CONCAT_WS({TAB}, name, x1, x2, cluster_id) AS value FROM track_a JOIN chroms USING (chr_idx)", "track_a", "chroms")
add("k3_null_bed", "||value", lambda r: bed.null_bed(r.track_a, r.chroms), f"SELECT CONCAT_WS({TAB}, name, x1, x2, 'null', 'null', '.', x1, x2, '0,0,0') AS value FROM track_a JOIN chroms USING (chr_idx)", "track_a", "chroms")
add("k8_mapping_dump", "||value", lambda r: bed.mapping_dump(labels(r).select("chr_idx", "bin", (F.col("cluster_id") - 1).alias("proto")), r.chroms, R, True),
    f"SELECT CONCAT_WS({TAB}, name, bin * {R}, LEAST(bin * {R} + {R}, length), '-1', 1, '.', bin * {R}, LEAST(bin * {R} + {R}, length), {NAMES}[2]) AS value FROM labels JOIN chroms USING (chr_idx) WHERE cluster_id = 0", "track_a", "chroms", labels=LABELS)
add("k11_row_index", "row_id chr_idx x1 x2", lambda r: I.to_intervals(bin_map(r), r.chroms, R), f"SELECT row_id, chr_idx, bin * {R} AS x1, LEAST(bin * {R} + {R}, length) AS x2 FROM bin_map JOIN chroms USING (chr_idx)", "track_a", "chroms", labels=LABELS, bin_map=BINMAP)

# -- projections, filters, predicates --------------------------------------------------------------------------
add("p1_bed_validity", "n_rows n_labels", lambda r: bed.fields(r.bed).join(r.chroms, "name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster_name").alias("n_labels")), "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT cluster_name) AS n_labels FROM fields JOIN chroms USING (name)", "bed", "chroms", fields=FIELDS)
add("p2_label_ids", "cluster_id||cluster_name", lambda r: bed.label_ids(bed.fields(r.bed)), "SELECT * FROM ids", "bed", fields=FIELDS, ids=IDS)
add("p3_far_intra", CELL, lambda r: C.far(r.contacts_intra, R), "SELECT * FROM contacts_intra WHERE cnt > 0 AND chr1 = chr2 AND ABS(bin1 - bin2) > 5", "contacts_intra")
add("p4_positive", CELL, lambda r: C.positive(r.contacts.withColumn("cnt", F.col("cnt") - 100)), "SELECT chr1, bin1, chr2, bin2, cnt - 100 AS cnt FROM contacts WHERE cnt > 100", "contacts")
add("p5_valid_distances", "chr_idx first last", lambda r: C.valid_distances(C.distance_counts(r.contacts_intra)), "SELECT * FROM valid", "contacts_intra", intra=INTRA, stats=STATS, valid=VALID)
add("p6_outliers", "chr_idx bin1 bin2 dist|cnt z", lambda r: C.without_outliers(C.distance_z(r.contacts_intra), 2.0).withColumnRenamed("chr1", "chr_idx"), "SELECT * FROM zrows WHERE ABS(z) < 2", "contacts_intra", **ZCHAIN)
add("p7_bad_bins", "chr_idx bin", lambda r: C.bad_bins(r.norm_vec), BAD, "norm_vec")
GOOD = "SELECT row_id FROM matrix GROUP BY 1 HAVING COUNT(v) > 3 AND COUNT(v) >= {s} * 64"
add("p8_good_rows", "row_id", lambda r: M.good_rows(r.matrix, 64, 0.94), GOOD.format(s=0.94), "matrix")
add("p9_good_columns", "row_id col_id|v", lambda r: M.drop_bad_columns(r.matrix, r.matrix.select("row_id").distinct().count(), 0.94), "SELECT * FROM matrix WHERE col_id IN (SELECT col_id FROM matrix GROUP BY 1 HAVING COUNT(v) > 3 AND COUNT(v) >= 0.94 * (SELECT COUNT(DISTINCT row_id) FROM matrix))", "matrix")
add("p10_compact", "chr_idx bin proto row_id", lambda r: M.compact(bin_map(r), bin_map(r).where("row_id % 3 <> 0").select("row_id")), "SELECT chr_idx, bin, proto, ROW_NUMBER() OVER (ORDER BY chr_idx, bin) - 1 AS row_id FROM bin_map WHERE row_id % 3 <> 0", "track_a", labels=LABELS, bin_map=BINMAP)
add("p11_quick_clean", "row_id", lambda r: M.quick_clean(r.matrix, 64, 0.06), "SELECT row_id FROM matrix GROUP BY 1 HAVING (64 - COUNT(v)) / 64.0 < 0.06", "matrix")
add("p12_near_diagonal", CELL, lambda r: C.mask_near_diagonal(r.contacts_intra, 5), "SELECT * FROM contacts_intra WHERE chr1 <> chr2 OR ABS(bin1 - bin2) >= 5", "contacts_intra")
add("p13_bad_rows_columns", CELL, lambda r: C.mask_bad(r.contacts, C.bad_bins(r.norm_vec)), "SELECT * FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.chr_idx = chr1 AND b.bin = bin1) AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.chr_idx = chr2 AND b.bin = bin2)", "contacts", "norm_vec", bad=BAD)
add("p14_bad_across_resolutions", CELL, lambda r: C.mask_bad(r.contacts, C.bad_bins(r.norm_vec), 10), "SELECT * FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.chr_idx = chr1 AND b.bin // 10 = bin1) AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.chr_idx = chr2 AND b.bin // 10 = bin2)", "contacts", "norm_vec", bad=BAD)


def one_translocation(r: Relations) -> DataFrame:
    return r.spark.createDataFrame([(1, 3)], "chr1 int, chr2 int")


add("p15_block_masks", "chr_idx col_id", lambda r: M.masked_pairs(bin_map(r), one_translocation(r)), "SELECT DISTINCT chr_idx, proto AS col_id FROM bin_map UNION SELECT 1, proto FROM bin_map WHERE chr_idx = 3 UNION SELECT 3, proto FROM bin_map WHERE chr_idx = 1", "track_a", labels=LABELS, bin_map=BINMAP)
add("p16_clean", "row_id col_id|v", lambda r: M.clean(r.matrix.withColumn("v", F.col("v") * 1e-9), True), "SELECT row_id, col_id, CASE WHEN v IS NULL OR ABS(v * 1e-9) < 1e-10 THEN 0 ELSE v * 1e-9 END AS v FROM matrix", "matrix")
add("p17_non_positive", "row_id col_id|v", lambda r: M.mask_non_positive(r.matrix), "SELECT row_id, col_id, CASE WHEN v > 0 THEN v END AS v FROM matrix", "matrix")
GLOBAL = "SELECT AVG(v) AS m, STDDEV_SAMP(v) AS s FROM matrix WHERE v > 0"
add("p18_high_z", "row_id col_id|v", lambda r: M.mask_outliers(r.matrix, 1.5), "SELECT row_id, col_id, CASE WHEN NOT (v > 0 AND (v - m) / s > 1.5) THEN v END AS v FROM matrix, g", "matrix", g=GLOBAL)
add("p19_two_sided_z", "row_id col_id|v", lambda r: M.mask_outliers(r.matrix, 1.0, True), "SELECT row_id, col_id, CASE WHEN NOT (v > 0 AND ABS((v - m) / s) > 1.0) THEN v END AS v FROM matrix, g", "matrix", g=GLOBAL)
add("p20_size_gate", "enough", lambda r: r.spark.createDataFrame([(int(M.large_enough(r.matrix)),)], "enough int"), "SELECT CASE WHEN COUNT(DISTINCT row_id) > 10 AND COUNT(DISTINCT col_id) > 2 THEN 1 ELSE 0 END AS enough FROM matrix", "matrix")
MEMBERS = "SELECT vec_id AS row_id, label AS cid FROM embeddings"


def members(r: Relations) -> DataFrame:
    return r.spark.read.parquet(f"{r.sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("row_id"), F.col("label").cast("int").alias("cid"))


def _cluster():
    from ..operators import cluster

    return cluster


add("p21_large_clusters", "row_id cid", lambda r: _cluster().large_clusters(members(r), 50), "SELECT row_id, cid FROM m WHERE cid IN (SELECT cid FROM m GROUP BY 1 HAVING COUNT(*) > 50)", m=MEMBERS)
add("p22_isolated", "chr_idx bin proto", lambda r: I.isolated(labels(r).withColumnRenamed("cluster_id", "proto")), "SELECT chr_idx, bin, cluster_id AS proto FROM (SELECT *, LAG(cluster_id) OVER w AS b, LEAD(cluster_id) OVER w AS a FROM labels WINDOW w AS (PARTITION BY chr_idx ORDER BY bin)) WHERE b <> cluster_id AND a <> cluster_id", "track_a", labels=LABELS)

# -- intervals -------------------------------------------------------------------------------------------------
add("i1_split", ROW, lambda r: I.split(r.wide_track, 300_000), "SELECT chr_idx, s AS x1, LEAST(s + 300000, x2) AS x2, cluster_id FROM (SELECT *, UNNEST(range(x1, x2, 300000)) AS s FROM wide_track)", "wide_track")
ISLAND = "SELECT chr_idx, MIN(x1) AS x1, MAX(x2) AS x2, MIN(cluster_id) AS cluster_id FROM (SELECT *, SUM(fresh) OVER (PARTITION BY chr_idx ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN LAG(x2) OVER w = x1 AND LAG(cluster_id) OVER w = cluster_id THEN 0 ELSE 1 END AS fresh FROM track_a WINDOW w AS (PARTITION BY chr_idx ORDER BY x1, x2))) GROUP BY chr_idx, i"
add("i2_collapse", ROW, lambda r: I.collapse(r.track_a), ISLAND, "track_a")
add("i3_clip", ROW, lambda r: I.clip(r.track_a.withColumn("x2", F.col("x2") + 500_000), r.chroms), "SELECT chr_idx, x1, LEAST(x2 + 500000, length) AS x2, cluster_id FROM track_a JOIN chroms USING (chr_idx)", "track_a", "chroms")
add("i4_deduplicate", f"{ROW} line_no", lambda r: I.deduplicate(two_tracks(r).withColumn("line_no", F.when(F.col("track_id") == "a", F.col("x1")).otherwise(F.col("x2") + 1 - F.col("chr_idx") * 400000)).drop("track_id")),
    "SELECT chr_idx, x1, x2, arg_min(cluster_id, line_no) AS cluster_id, MIN(line_no) AS line_no FROM (SELECT *, x1 AS line_no FROM track_a UNION ALL SELECT *, x2 + 1 - chr_idx * 400000 FROM track_b) GROUP BY 1, 2, 3", "track_a", "track_b")
add("i5_order", f"{ROW} place", lambda r: numbered(r.track_a, "chr_idx", "x1", "x2"), "SELECT *, ROW_NUMBER() OVER (ORDER BY chr_idx, x1, x2) AS place FROM track_a", "track_a")
add("i6_to_bins", f"{ROW} bin", lambda r: I.to_bins(r.wide_track, 400_000), "SELECT *, UNNEST(range(x1 // 400000, x2 // 400000)) AS bin FROM wide_track", "wide_track")
add("i7_to_intervals", "chr_idx bin x1 x2", lambda r: I.to_intervals(labels(r), r.chroms, R), f"SELECT chr_idx, bin, bin * {R} AS x1, LEAST(bin * {R} + {R}, length) AS x2 FROM labels JOIN chroms USING (chr_idx)", "track_a", "chroms", labels=LABELS)
add("i8_relabel", f"{ROW}||cluster_name", lambda r: I.relabel(r.track_a, r.spark.createDataFrame([(0, 7, "X"), (2, 9, "Y")], "cluster_id int, new_id int, new_name string")), "SELECT chr_idx, x1, x2, CASE cluster_id WHEN 0 THEN 7 WHEN 2 THEN 9 ELSE cluster_id END AS cluster_id, CASE cluster_id WHEN 0 THEN 'X' WHEN 2 THEN 'Y' ELSE CAST(cluster_id AS VARCHAR) END AS cluster_name FROM track_a", "track_a")
add("i9_width", f"{ROW} width", lambda r: I.width_in_bins(r.wide_track, 400_000), "SELECT *, (x2 - x1) // 400000 AS width FROM wide_track", "wide_track")
add("i11_label_at_start", "chr_idx x1 cluster_id", lambda r: I.label_at_start(two_tracks(r)), "SELECT chr_idx, x1, arg_max(cluster_id, CAST(x2 AS BIGINT) * 1000 + cluster_id) AS cluster_id FROM two GROUP BY 1, 2", "track_a", "track_b", two=TWO)

# -- joins -----------------------------------------------------------------------------------------------------
add("j1_scatter", "row_id col_id|v", lambda r: M.scatter(C.positive(r.contacts).where("chr1 <> chr2"), bin_map(r), "cnt"), "SELECT * FROM ends", "contacts", "track_a", **{k: CHAIN[k] for k in ("labels", "bin_map", "ends")})
add("j2_both_ends", f"{CELL.split('|')[0]} id1 id2|cnt", lambda r: C.both_ends(r.contacts, labels(r)), BOTH, "contacts", "track_a", labels=LABELS)
add("j3_join_tracks", "chr_idx x1 id1 id2", lambda r: T.join_tracks(r.track_a, r.track_b), f"SELECT chr_idx, x1, a.cluster_id AS id1, b.cluster_id AS id2 FROM {LAST.format(t='track_a')} a JOIN {LAST.format(t='track_b')} b USING (chr_idx, x1) WHERE a.cluster_id >= 0 AND b.cluster_id >= 0", "track_a", "track_b")
add("j4_common_loci", f"{ROW}||track_id", lambda r: T.common_loci(two_tracks(r), 4 * R, 8), f"SELECT * FROM two WHERE (chr_idx, x1 // {4 * R}) IN (SELECT (chr_idx, x1 // {4 * R}) FROM two GROUP BY chr_idx, x1 // {4 * R} HAVING COUNT(*) = 8)", "track_a", "track_b", two=TWO)
add("j5_areas", "chr1 chr2 id1 id2 area", lambda r: C.areas(labels(r)), AREA, "track_a", labels=LABELS)
W64 = "SELECT row_id, LIST(v ORDER BY col_id) AS f FROM matrix GROUP BY 1"
#: The rows that stand for centres, and those that query all rows.
FIVE = "SELECT * FROM w WHERE row_id < 5"
EVERY = 50
PAIR = "SELECT a.row_id AS i, b.row_id AS j, UNNEST(a.f) AS x, UNNEST(b.f) AS y FROM w a JOIN w b ON a.row_id {op} b.row_id"
METRIC = {
    "euclidean": "SQRT(64 * SUM((x - y) * (x - y)) / COUNT(x + y))", "manhattan": "64 * SUM(ABS(x - y)) / COUNT(x + y)",
    "cosine": "SUM(x * y) / SQRT((1e-100 + SUM(CASE WHEN y IS NOT NULL THEN x * x END)) * (1e-100 + SUM(CASE WHEN x IS NOT NULL THEN y * y END)))", "correlation": "CORR(x, y)",
}


def rows(r: Relations) -> DataFrame:
    return M.wide(r.matrix)


def pair_sql(metric: str, op: str) -> tuple[str, dict]:
    return f"SELECT i, j, {METRIC[metric]} AS value FROM p GROUP BY i, j", {"w": W64, "p": PAIR.format(op=op)}


for _m, _id in (("euclidean", "j6_all_pairs_euclidean"), ("manhattan", "j6_all_pairs_manhattan"), ("cosine", "j6_all_pairs_cosine"), ("correlation", "j6_all_pairs_correlation")):
    _sql, _more = pair_sql(_m, "<=")
    add(_id, "i j|value", lambda r, m=_m: D.all_pairs(rows(r), m, block=64), _sql, "matrix", **_more)
_sql, _more = pair_sql("cosine", "<")
add("j7_masked_pairs", "i j|value", lambda r: D.masked_pairs(rows(r), members(r), 3, "cosine"), f"SELECT * FROM ({_sql}) WHERE i IN (SELECT row_id FROM m WHERE cid < 3) AND j IN (SELECT row_id FROM m WHERE cid < 3)", "matrix", m=MEMBERS, **_more)


def centres(r: Relations, n: int = 5) -> DataFrame:
    return M.wide(r.matrix.where(f"row_id < {n}")).select(F.col("row_id").cast("int").alias("cid"), F.col("features").alias("centre"))


TO = "SELECT a.row_id, b.row_id AS cid, UNNEST(a.f) AS x, UNNEST(b.f) AS y FROM w a JOIN w b ON b.row_id < 5"
add("j8_to_centres", "row_id cid|euclidean manhattan", lambda r: D.several_metrics(rows(r), centres(r), ("euclidean", "manhattan")), f"SELECT row_id, cid, {METRIC['euclidean']} AS euclidean, {METRIC['manhattan']} AS manhattan FROM t GROUP BY 1, 2", "matrix", w=W64, t=TO)
HALF = "SELECT 64 * 0 + col_id AS col_id, col_id % 5 + 1 AS w FROM (SELECT DISTINCT col_id FROM matrix)"


def col_weights(r: Relations) -> DataFrame:
    return r.matrix.select("col_id").distinct().select("col_id", (F.col("col_id") % 5 + 1).cast("long").alias("w"))


add("j9_weighted_to_centres", "row_id cid|value", lambda r: D.to_centres(D.root_weighted(rows(r), col_weights(r)), D.root_weighted(rows(r).where("row_id < 5"), col_weights(r)).select(F.col("row_id").cast("int").alias("cid"), F.col("features").alias("centre"))),
    f"SELECT row_id, cid, {METRIC['euclidean']} AS value FROM t GROUP BY 1, 2", "matrix", s="SELECT row_id, col_id, v * SQRT(col_id % 5 + 1) AS v FROM matrix", w=W64.replace("FROM matrix", "FROM s"), t=TO)
NEAR = "SELECT i, j, value FROM pairs WHERE i <> j UNION ALL SELECT j, i, value FROM pairs WHERE i <> j"
RANK = "SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY value, j) AS k, COUNT(*) OVER (PARTITION BY i) AS n FROM near"
CUT = "SELECT i, MAX(CASE WHEN k = 1 + 0 * n AND 1 = GREATEST(1, LEAST(FLOOR((n + 1) * 0.1), n)) OR k = GREATEST(1, LEAST(FLOOR((n + 1) * 0.1), n)) THEN value END) AS a, MAX(CASE WHEN k = LEAST(GREATEST(1, LEAST(FLOOR((n + 1) * 0.1), n)) + 1, n) THEN value END) AS b, MAX(CASE WHEN (n + 1) * 0.1 < 1 OR (n + 1) * 0.1 >= n THEN 0 ELSE (n + 1) * 0.1 - FLOOR((n + 1) * 0.1) END) AS s FROM ranked GROUP BY i"
_sql, _more = pair_sql("euclidean", "<=")
KNN = {**_more, "pairs": _sql, "near": NEAR, "ranked": RANK, "cut": CUT, "nn": "SELECT near.i, near.j FROM near JOIN cut USING (i) WHERE value < a + s * (b - a)"}


def knn(r: Relations) -> DataFrame:
    return D.nearest_rows(rows(r), "euclidean", 10.0, 64)


def knn_votes(r: Relations, labels: DataFrame) -> DataFrame:
    """Labels of the same neighbours, counted."""
    return D.Nearest(rows(r), ("euclidean", 10.0), block=64, labels=labels).votes()


add("j10_nearest", "i j", knn, "SELECT * FROM nn", "matrix", **KNN)
add("j11_best_centre", "row_id cid", lambda r: D.best_centre(D.to_centres(rows(r), centres(r), "correlation"), 0.1), f"SELECT row_id, arg_min(cid, -value * 1000000 + cid * 1e-9) AS cid FROM (SELECT row_id, cid, {METRIC['correlation']} AS value FROM t GROUP BY 1, 2) WHERE value > 0.1 GROUP BY 1", "matrix", w=W64, t=TO)
add("j12_upsample", "chr_idx bin cluster_id", lambda r: C.upsample(labels(r), r.contacts.select(F.col("chr1").alias("chr_idx"), (F.col("bin1") * 3 + 1).alias("bin")).distinct(), 3), "SELECT f.chr_idx, f.bin, l.cluster_id FROM (SELECT DISTINCT chr1 AS chr_idx, bin1 * 3 + 1 AS bin FROM contacts) f JOIN labels l ON l.chr_idx = f.chr_idx AND l.bin = f.bin // 3", "contacts", "track_a", labels=LABELS)
add("j13_without_pairs", CELL, lambda r: C.without_pairs(r.contacts, r.spark.createDataFrame([(3, 1), (2, 2)], "chr1 int, chr2 int")), "SELECT * FROM contacts WHERE NOT (chr1 = 1 AND chr2 = 3) AND NOT (chr1 = 2 AND chr2 = 2)", "contacts")
add("j14_cluster_track", ROW, lambda r: _cluster().to_track(members(r), I.to_intervals(bin_map(r), r.chroms, R)), f"SELECT chr_idx, bin * {R} AS x1, LEAST(bin * {R} + {R}, length) AS x2, cid + 1 AS cluster_id FROM m JOIN bin_map USING (row_id) JOIN chroms USING (chr_idx) WHERE cid >= 0", "track_a", "chroms", labels=LABELS, bin_map=BINMAP, m=MEMBERS)
add("j15_values_on_intervals", "chr_idx x1 x2|value", lambda r: _cluster().values_on_intervals(r.matrix.where("col_id = 3").select("row_id", F.col("v").alias("value")), I.to_intervals(bin_map(r), r.chroms, R)), f"SELECT chr_idx, bin * {R} AS x1, LEAST(bin * {R} + {R}, length) AS x2, v AS value FROM matrix JOIN bin_map USING (row_id) JOIN chroms USING (chr_idx) WHERE col_id = 3", "matrix", "track_a", "chroms", labels=LABELS, bin_map=BINMAP)
add("j16_assignment_track", ROW, lambda r: _cluster().to_track(members(r), I.to_intervals(bin_map(r), r.chroms, R), False), f"SELECT chr_idx, bin * {R} AS x1, LEAST(bin * {R} + {R}, length) AS x2, cid AS cluster_id FROM m JOIN bin_map USING (row_id) JOIN chroms USING (chr_idx) WHERE cid >= 0", "track_a", "chroms", labels=LABELS, bin_map=BINMAP, m=MEMBERS)
add("j17_distance_z", "chr_idx bin1 bin2 dist|cnt z", lambda r: C.distance_z(r.contacts_intra).withColumnRenamed("chr1", "chr_idx"), "SELECT * FROM zrows", "contacts_intra", **ZCHAIN)
add("j18_chromosome_pairs", "chr1 chr2", lambda r: C.chromosome_pairs(r.chroms), "SELECT a.chr_idx AS chr1, b.chr_idx AS chr2 FROM chroms a JOIN chroms b ON a.chr_idx <= b.chr_idx", "chroms")
ONE = "SELECT track_id, chr_idx, x1, arg_max(cluster_id, CAST(x2 AS BIGINT) * 1000 + cluster_id) AS cluster_id FROM two GROUP BY 1, 2, 3"
PAIRED = "SELECT a.track_id AS track1, b.track_id AS track2, a.cluster_id AS id1, b.cluster_id AS id2, COUNT(*) AS n FROM one a JOIN one b USING (chr_idx, x1) WHERE a.track_id <= b.track_id AND a.cluster_id >= 0 AND b.cluster_id >= 0 GROUP BY 1, 2, 3, 4"
add("j19_track_pairs", "id1 id2 n||track1 track2", lambda r: T.track_pairs(two_tracks(r)), PAIRED, "track_a", "track_b", two=TWO, one=ONE)

# -- aggregations ----------------------------------------------------------------------------------------------
add("a1_scatter_sum", "row_id col_id|v", lambda r: M.inter_sums(r.contacts, bin_map(r)), "SELECT * FROM sums", "contacts", "track_a", **{k: CHAIN[k] for k in ("labels", "bin_map", "ends", "sums")})
add("a1_streamed", "row_id col_id|v", lambda r: streamed(r, r.contacts, lambda f, m=bin_map(r): upkeep.scatter_sums(r.spark, f, m)), "SELECT * FROM sums", "contacts", "track_a", **{k: CHAIN[k] for k in ("labels", "bin_map", "ends", "sums")})


def intra_map(r: Relations) -> DataFrame:
    cells = r.contacts_intra.where("chr1 = chr2").select(F.col("chr1").alias("chr_idx"), F.explode(F.array("bin1", "bin2")).alias("bin")).distinct()
    return M.global_rows(cells.withColumn("proto", (F.col("bin") % 3 + F.col("chr_idx") * 3 - 3).cast("int")))


IMAP = "SELECT chr_idx, bin, bin % 3 + chr_idx * 3 - 3 AS proto, ROW_NUMBER() OVER (ORDER BY chr_idx, bin) - 1 AS row_id FROM (SELECT chr_idx, bin1 AS bin FROM intra UNION SELECT chr_idx, bin2 FROM intra)"
IENDS = "SELECT a.row_id, b.proto AS col_id, z FROM zrows z JOIN imap a ON a.chr_idx = z.chr_idx AND a.bin = bin1 JOIN imap b ON b.chr_idx = z.chr_idx AND b.bin = bin2 WHERE ABS(z) < 5 AND cnt > 0 UNION ALL SELECT b.row_id, a.proto, z FROM zrows z JOIN imap a ON a.chr_idx = z.chr_idx AND a.bin = bin1 JOIN imap b ON b.chr_idx = z.chr_idx AND b.bin = bin2 WHERE ABS(z) < 5 AND cnt > 0"
add("a2_guarded_mean", "row_id col_id|v", lambda r: M.intra_means(r.contacts_intra, intra_map(r)), "SELECT row_id, col_id, AVG(z) AS v FROM iends GROUP BY 1, 2 HAVING COUNT(*) > 10", "contacts_intra", **ZCHAIN, imap=IMAP, iends=IENDS)
add("a3_distance_counts", "chr_idx dist n", lambda r: C.distance_counts(r.contacts_intra), "SELECT chr_idx, dist, n FROM stats", "contacts_intra", intra=INTRA, stats=STATS)
add("a3_streamed", "chr_idx dist n", lambda r: streamed(r, r.contacts_intra, lambda f: upkeep.distance_counts(r.spark, f)), "SELECT chr_idx, dist, n FROM stats", "contacts_intra", intra=INTRA, stats=STATS)
add("a4_distance_stats", "chr_idx dist|mean sd", lambda r: C.distance_stats(r.contacts_intra), "SELECT chr_idx, dist, mean, sd FROM stats", "contacts_intra", intra=INTRA, stats=STATS)
ZCOL = "SELECT row_id, col_id, CASE WHEN v > 0 THEN GREATEST(-3, LEAST(3, (v - m) / s)) ELSE v END AS v FROM {t} JOIN (SELECT col_id, AVG(v) FILTER (v > 0) AS m, STDDEV_SAMP(v) FILTER (v > 0) AS s FROM {t} GROUP BY 1) USING (col_id)"
add("a5_column_z", "row_id col_id|v", lambda r: M.column_z(r.matrix), ZCOL.format(t="matrix"), "matrix")
add("a6_row_z", "row_id col_id|v", lambda r: M.row_z(r.matrix), "SELECT row_id, col_id, CASE WHEN n > 2 THEN (v - m) / s ELSE v END AS v FROM matrix JOIN (SELECT row_id, AVG(v) FILTER (v > 0) AS m, STDDEV_SAMP(v) FILTER (v > 0) AS s, COUNT(v) FILTER (v > 0) AS n FROM matrix GROUP BY 1) USING (row_id)", "matrix")
add("a7_global_stats", "n|mean sd", lambda r: M.global_stats(r.matrix), "SELECT COUNT(*) AS n, AVG(v) AS mean, STDDEV_SAMP(v) AS sd FROM matrix WHERE v > 0", "matrix")
add("a8_column_z_floor", "row_id col_id|v", lambda r: M.column_z_floor(r.matrix, -0.5), "SELECT row_id, col_id, (v - m) / s AS v FROM matrix JOIN (SELECT col_id, AVG(v) AS m, STDDEV_SAMP(v) AS s FROM matrix WHERE v > -0.5 GROUP BY 1) USING (col_id) WHERE v > -0.5", "matrix")
VC = "SELECT row_id, col_id, v / r / c * (SELECT SUM(v) FROM {t} WHERE v > 0) / SUM(v / r / c) OVER () AS v FROM (SELECT *, SUM(v) OVER (PARTITION BY row_id) AS r, SUM(v) OVER (PARTITION BY col_id) AS c FROM {t} WHERE v > 0)"
add("a9_vanilla_coverage", "row_id col_id|v", lambda r: M.vanilla_coverage(r.matrix), VC.format(t="matrix"), "matrix")
add("a10_weights", "col_id w", lambda r: M.weights(bin_map(r)), "SELECT proto AS col_id, COUNT(*) AS w FROM bin_map GROUP BY 1", "track_a", labels=LABELS, bin_map=BINMAP)
add("a11_contingency", "id1 id2 n", lambda r: T.contingency(r.track_a, r.track_b), TABLE, "track_a", "track_b")
add("a11_streamed", "id1 id2 n", lambda r: streamed(r, r.track_a.withColumn("track_id", F.lit("a")).union(r.track_b.withColumn("track_id", F.lit("b"))), lambda f: upkeep.contingency(r.spark, f, "a", "b")), TABLE, "track_a", "track_b")
add("a12_contingency_by_chromosome", "chr_idx id1 id2 n", lambda r: T.contingency(r.track_a, r.track_b, True), TABLE_CHR, "track_a", "track_b")
add("a13_marginals", "side id n", lambda r: T.marginals(T.contingency(r.track_a, r.track_b)), "SELECT 1 AS side, id1 AS id, SUM(n) AS n FROM t GROUP BY id1 UNION ALL SELECT 2, id2, SUM(n) FROM t GROUP BY id2 UNION ALL SELECT 0, NULL, SUM(n) FROM t", "track_a", "track_b", t=TABLE)
add("a14_max_id", "max_id", lambda r: T.max_id(r.track_a), "SELECT MAX(cluster_id) AS max_id FROM track_a", "track_a")
DCHAIN = {"labels": LABELS, "pairs": BOTH, "area": AREA, "density": DENSITY, "cv": CV}
add("a15_densities", "chr1 chr2 id1 id2|density", lambda r: C.densities(r.contacts, labels(r)), "SELECT * FROM density", "contacts", "track_a", **DCHAIN)
add("a15_streamed", "chr1 chr2 id1 id2|density", lambda r: streamed(r, r.contacts, lambda f: upkeep.densities(r.spark, f, labels(r))), "SELECT * FROM density", "contacts", "track_a", **DCHAIN)
add("a16_variation", "id1 id2|cv", lambda r: C.variation(C.densities(r.contacts, labels(r))), "SELECT * FROM cv", "contacts", "track_a", **DCHAIN)
add("a17_sd_of_variations", "|sd_cv", lambda r: C.deviation_of_variations(C.variation(C.densities(r.contacts, labels(r)))), "SELECT STDDEV_SAMP(cv) AS sd_cv FROM cv", "contacts", "track_a", **DCHAIN)
add("a18_dense_ids", "cluster_id dense_id", lambda r: C.dense_ids(r.track_a.withColumn("cluster_id", F.col("cluster_id") * 3 + 1)), "SELECT DISTINCT cluster_id * 3 + 1 AS cluster_id, DENSE_RANK() OVER (ORDER BY cluster_id) - 1 AS dense_id FROM track_a", "track_a")
FACTOR, ROUNDS = 4, 10
SIDED = "SELECT CASE WHEN chr_idx % 2 = 1 THEN 'A' ELSE 'B' END AS side, chr_idx, bin, cluster_id FROM labels"
PLACED = f"SELECT side, round, chr_idx, bin, cluster_id, ROW_NUMBER() OVER (PARTITION BY side, round, cluster_id ORDER BY MD5(CONCAT_WS('|', 0, round, chr_idx, bin)), chr_idx, bin) - 1 AS p FROM sided, range(0, {ROUNDS}) t(round)"
STARTS = f"SELECT side, cluster_id, n, COALESCE(SUM(n) OVER (PARTITION BY side ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT side, cluster_id, COUNT(*) // {FACTOR} AS n FROM sided GROUP BY 1, 2)"
BLOCKS = f"SELECT side, round, chr_idx, bin, cluster_id, p // {FACTOR} + b AS block FROM placed JOIN starts USING (side, cluster_id) WHERE p < n * {FACTOR}"
BSUMS = "SELECT a.round, a.block AS brow, b.block AS bcol, SUM(cnt) AS s FROM (SELECT chr1, bin1, chr2, bin2, cnt FROM contacts WHERE cnt > 0 AND chr1 <> chr2 UNION ALL SELECT chr2, bin2, chr1, bin1, cnt FROM contacts WHERE cnt > 0 AND chr1 <> chr2) c JOIN blocks a ON a.side = 'A' AND a.chr_idx = chr1 AND a.bin = bin1 JOIN blocks b ON b.side = 'B' AND b.round = a.round AND b.chr_idx = chr2 AND b.bin = bin2 GROUP BY 1, 2, 3"
MEANS = f"SELECT brow, bcol, SUM(LN(1 + s)) / {ROUNDS} AS v FROM bsums GROUP BY 1, 2"
GRID = "SELECT a.block AS brow, b.block AS bcol, a.cluster_id AS id1, b.cluster_id AS id2, COALESCE(v, 0) AS v FROM (SELECT DISTINCT block, cluster_id FROM blocks WHERE side = 'A' AND round = 0) a CROSS JOIN (SELECT DISTINCT block, cluster_id FROM blocks WHERE side = 'B' AND round = 0) b LEFT JOIN means ON brow = a.block AND bcol = b.block"
VAR = "SELECT AVG((v - m) * (v - m)) AS score FROM (SELECT v, AVG(v) OVER ({over}) AS m FROM grid)"
KL = "SELECT SUM(CASE WHEN v > 0 THEN v / t * LN(v / m) ELSE 0 END) AS score FROM (SELECT v, AVG(v) OVER ({over}) AS m, SUM(v) OVER () AS t FROM grid)"
RATIOS = f"SELECT 'variance' AS score_type, b.score AS baseline, s.score AS shuffled, b.score / s.score AS ratio FROM ({VAR.format(over='')}) b, ({VAR.format(over='PARTITION BY id1, id2')}) s UNION ALL SELECT 'kl', b.score, s.score, b.score / s.score FROM ({KL.format(over='')}) b, ({KL.format(over='PARTITION BY id1, id2')}) s"
SCHAIN = {"labels": LABELS, "sided": SIDED, "placed": PLACED, "starts": STARTS, "blocks": BLOCKS, "bsums": BSUMS, "means": MEANS, "grid": GRID, "ratios": RATIOS}
KINDS = ("ODDS_VS_EVENS",)


def blocks(r: Relations) -> DataFrame:
    return S.shuffled_blocks(S.sided_bins(labels(r), r.chroms, KINDS), FACTOR, ROUNDS)


def sparse_map(r: Relations) -> S.BlockMap:
    own = cut(blocks(r))
    return S.block_map(own, cut(S.mean_over_rounds(S.block_sums(r.contacts, own), ROUNDS)))


def grid(r: Relations) -> DataFrame:
    b = blocks(r)
    b = cut(b)
    return cut(S.grid(b, S.mean_over_rounds(S.block_sums(r.contacts, b), ROUNDS)))


def chain(last: str) -> dict:
    names = list(SCHAIN)
    return {k: SCHAIN[k] for k in names[: names.index(last) + 1]}


add("a19_block_sums", "round brow bcol|s", lambda r: S.block_sums(r.contacts, blocks(r)), "SELECT * FROM bsums", "contacts", "track_a", **chain("bsums"))
add("a20_mean_over_rounds", "brow bcol|v", lambda r: S.mean_over_rounds(S.block_sums(r.contacts, blocks(r)), ROUNDS), "SELECT * FROM means", "contacts", "track_a", **chain("means"))
add("a21_regions", "r1 r2 n|s", lambda r: S.map_regions(sparse_map(r), symmetric=True), "SELECT LEAST(id1, id2) AS r1, GREATEST(id1, id2) AS r2, SUM(v) AS s, COUNT(*) AS n FROM grid GROUP BY 1, 2", "contacts", "track_a", **chain("grid"))
add("a22_variance_score", "|score", lambda r: S.map_scores(sparse_map(r)).withColumnRenamed("variance", "score"), VAR.format(over="PARTITION BY id1, id2"), "contacts", "track_a", **chain("grid"))
add("a23_divergence_score", "|score", lambda r: S.map_scores(sparse_map(r)).withColumnRenamed("kl", "score"), KL.format(over="PARTITION BY id1, id2"), "contacts", "track_a", **chain("grid"))
add("a24_score_ratios", "|baseline shuffled ratio|score_type", lambda r: S.map_ratios(sparse_map(r)), "SELECT * FROM ratios", "contacts", "track_a", **SCHAIN)
add("a25_geometric_mean", "|geometric_mean|score_type", lambda r: S.geometric_mean(S.map_ratios(sparse_map(r)).union(S.map_ratios(sparse_map(r)).withColumn("ratio", F.col("ratio") * 4))), "SELECT score_type, ratio * 2 AS geometric_mean FROM ratios", "contacts", "track_a", **SCHAIN)
add("a26_wcss", "restart n_clusters|wcss", lambda r: _cluster().within(members(r).withColumns({"restart": F.lit(0), "distance": F.col("row_id") / 100.0}), 3), "SELECT 0 AS restart, SUM(d) / 3 + SUM(CASE WHEN n < 5 THEN 3.4028234663852886e38 ELSE 0 END) AS wcss, COUNT(*) AS n_clusters FROM (SELECT cid, SUM(row_id / 100.0) AS d, COUNT(*) AS n FROM m GROUP BY 1)", m=MEMBERS)
add("a27_mean_centres", "cid col_id weight|v", lambda r: _cluster().mean_centres(r.matrix, members(r)), "SELECT cid, col_id, AVG(v) AS v, ANY_VALUE(w) AS weight FROM matrix JOIN m USING (row_id) JOIN (SELECT cid, COUNT(*) AS w FROM m GROUP BY 1) USING (cid) GROUP BY 1, 2", "matrix", m=MEMBERS)
CUTOFF = "SELECT a.chr_idx AS chr1, b.chr_idx AS chr2, 60 + 5 * (a.chr_idx + b.chr_idx) AS cutoff FROM chroms a JOIN chroms b ON a.chr_idx < b.chr_idx"
add("a28_translocations", "chr1 chr2 hits", lambda r: C.translocations(r.contacts, C.chromosome_pairs(r.chroms, False).withColumn("cutoff", 60 + 5 * (F.col("chr1") + F.col("chr2"))), C.bad_bins(r.norm_vec)),
    "SELECT chr1, chr2, COUNT(*) AS hits FROM contacts c JOIN cutoffs USING (chr1, chr2) WHERE cnt > cutoff AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.chr_idx = chr1 AND b.bin = bin1) AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.chr_idx = chr2 AND b.bin = bin2) GROUP BY 1, 2 HAVING COUNT(*) >= 12", "contacts", "chroms", "norm_vec", cutoffs=CUTOFF, bad=BAD)
GREEDY = {f"p{k}": "SELECT * FROM t" + (" WHERE " + " AND ".join(f"id1 NOT IN (SELECT id1 FROM p{j}) AND id2 NOT IN (SELECT id2 FROM p{j})" for j in range(1, k)) if k > 1 else "") + " ORDER BY n DESC, id1, id2 LIMIT 1" for k in range(1, 5)}
add("a29_accuracy", "matched total|accuracy", lambda r: T.accuracy(T.contingency(r.track_a, r.track_b)), "SELECT m AS matched, s AS total, CAST(m AS DOUBLE) / s AS accuracy FROM (SELECT SUM(n) AS m FROM (SELECT n FROM p1 UNION ALL SELECT n FROM p2 UNION ALL SELECT n FROM p3 UNION ALL SELECT n FROM p4)), (SELECT SUM(n) AS s FROM t)", "track_a", "track_b", t=TABLE, **GREEDY)
ARI = "SELECT (s - a * b / (N * (N - 1) / 2.0)) / NULLIF((a + b) / 2 - a * b / (N * (N - 1) / 2.0), 0) AS ari FROM (SELECT SUM(n * (n - 1) / 2.0) AS s, SUM(n) AS N FROM t), (SELECT SUM(n * (n - 1) / 2.0) AS a FROM (SELECT SUM(n) AS n FROM t GROUP BY id1)), (SELECT SUM(n * (n - 1) / 2.0) AS b FROM (SELECT SUM(n) AS n FROM t GROUP BY id2))"
ARI = ARI.replace("SUM(n) AS N", "SUM(n) AS total").replace("(N * (N - 1)", "(total * (total - 1)")
add("a30_ari", "|ari", lambda r: T.adjusted_rand_index(T.contingency(r.track_a, r.track_b)), ARI, "track_a", "track_b", t=TABLE)
add("a31_census", "total row_max col_max|row_mean col_mean", lambda r: M.census(r.matrix), "SELECT * FROM (SELECT SUM(n) AS total, MAX(n) AS row_max, AVG(n) AS row_mean FROM (SELECT COUNT(*) FILTER (v IS NULL) AS n FROM matrix GROUP BY row_id)), (SELECT MAX(n) AS col_max, AVG(n) AS col_mean FROM (SELECT COUNT(*) FILTER (v IS NULL) AS n FROM matrix GROUP BY col_id))", "matrix")
REAL = "v > 1e-10 AND v < 0.9 * 3.4028234663852886e38"
add("a32_real_mean", "row_id|mean_real sd_real", lambda r: M.wide(r.matrix).select("row_id", *[c.alias(k) for k, c in vectors.array_stats(F.col("features")).items()]), f"SELECT row_id, AVG(v) FILTER ({REAL}) AS mean_real, STDDEV_POP(v) FILTER ({REAL}) AS sd_real FROM matrix GROUP BY 1", "matrix")
add("a33_array_stats", "row_id|missing maximum mean", lambda r: M.wide(r.matrix).select("row_id", *[c.alias(k) for k, c in vectors.array_stats(F.col("features")).items()]), "SELECT row_id, 1 - COUNT(v) / 64.0 AS missing, MAX(v) AS maximum, AVG(v) AS mean FROM matrix GROUP BY 1", "matrix")
VOTE = "SELECT i, cid, COUNT(*) AS n FROM nn JOIN m ON m.row_id = j GROUP BY 1, 2"
add("a34_majority", "i cid", lambda r: D.majority_votes(knn_votes(r, members(r))), "SELECT i, arg_min(cid, cid - 1000 * n) AS cid FROM vote GROUP BY 1", "matrix", **KNN, m=MEMBERS, vote=VOTE)
add("a35_max_off_diagonal", "|value", lambda r: D.largest(rows(r), "euclidean"), "SELECT MAX(value) AS value FROM pairs WHERE i < j", "matrix", **{k: KNN[k] for k in ("w", "p", "pairs")})
add("a36_partial_aggregation", "chr1 chr2 n|s", lambda r: C.by_pair(r.contacts), "SELECT chr1, chr2, SUM(cnt) AS s, COUNT(*) AS n FROM contacts GROUP BY 1, 2", "contacts")
add("a37_unassigned_share", "i|share", lambda r: D.unassigned_votes(knn_votes(r, members(r).where("cid > 1"))), "SELECT i, AVG(CASE WHEN cid > 1 THEN 0.0 ELSE 1.0 END) AS share FROM nn JOIN m ON m.row_id = j GROUP BY 1", "matrix", **KNN, m=MEMBERS)

# -- matrix and clustering -------------------------------------------------------------------------------------
FEATURES = "features"


def features(r: Relations) -> DataFrame:
    return rows(r)


def planted(r: Relations) -> DataFrame:
    """Full embeddings with planted labels."""
    return prepare(r.spark).read.parquet(f"{r.sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))


def clusters(kind: str) -> Callable[[Relations], DataFrame]:
    def build(r: Relations) -> DataFrame:
        c = _cluster()
        x = planted(r)
        return c.ordered(c.assign(x, c.fit(x, 4, kind, [7], 20), kind).select("row_id", "cid"))

    return build


add("m1_kmeans", "row_id cid", clusters("means"))
add("m2_kmedians", "row_id cid", clusters("medians"))
STEP = "SELECT row_id, arg_min(cid, value * 1000000 + cid * 1e-9) AS cid, MIN(value) AS distance FROM (SELECT row_id, cid, " + METRIC["euclidean"] + " AS value FROM t GROUP BY 1, 2) GROUP BY 1"


def one_step(r: Relations) -> DataFrame:
    import numpy as np

    start = D.matrix_of(rows(r).where("row_id < 5").orderBy("row_id").toPandas().features)
    fill = np.where(np.isnan(start), 0.0, start)
    return _cluster().assign(rows(r), fill[None])


ZERO = "SELECT row_id, LIST(COALESCE(v, 0) ORDER BY col_id) AS f FROM matrix WHERE row_id < 5 GROUP BY 1"
add("m1_assignment_step", "row_id cid|distance", one_step, "SELECT * FROM step", "matrix", w=W64, z=ZERO, t="SELECT a.row_id, b.row_id AS cid, UNNEST(a.f) AS x, UNNEST(b.f) AS y FROM w a CROSS JOIN z b", step=STEP)
add("m3_best_of_restarts", "row_id cid", lambda r: _cluster().best_of(planted(r), 4)[1])


def swept(r: Relations) -> DataFrame:
    out = None
    for k, kind, m in _cluster().sweep(planted(r), 3, 5):
        one = m.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).withColumns({"k": F.lit(k), "kind": F.lit(kind)})
        out = one if out is None else out.union(one)
    return out


add("m4_sweep", "k cid n||kind", swept)
add("m5_cluster_order", "row_id cid", lambda r: _cluster().ordered(members(r)), "SELECT row_id, c AS cid FROM m JOIN (SELECT cid, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, MIN(row_id)) - 1 AS c FROM m GROUP BY 1) USING (cid)", m=MEMBERS)
add("m6_assignment", "row_id cid", lambda r: r.matrix.select("row_id").distinct().join(members(r).where("cid < 2"), "row_id", "left").select("row_id", F.coalesce("cid", F.lit(-1)).alias("cid")), "SELECT DISTINCT x.row_id, COALESCE(m.cid, -1) AS cid FROM matrix x LEFT JOIN m ON m.row_id = x.row_id AND m.cid < 2", "matrix", m=MEMBERS)
add("m7_quick_centres", "cid col_id weight|v", lambda r: _cluster().quick_centres(features(r), r.matrix, 4))


def _proto():
    from ..operators import proto

    return proto


add("m8_proto_clusters", "chr_idx bin proto", lambda r: _proto().discover(C.observed_over_expected(C.far(r.contacts_intra, R)), r.chroms_intra, R, 3))
add("m8_proto_offsets", "chr_idx bin proto", lambda r: _proto().offset(labels(r).withColumnRenamed("cluster_id", "proto")), "SELECT chr_idx, bin, cluster_id + b AS proto FROM labels JOIN (SELECT chr_idx, COALESCE(SUM(n) OVER (ORDER BY chr_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT chr_idx, MAX(cluster_id) + 1 AS n FROM labels GROUP BY 1)) USING (chr_idx)", "track_a", labels=LABELS)
add("m9_global_rows", "chr_idx bin proto row_id", lambda r: M.global_rows(labels(r).withColumnRenamed("cluster_id", "proto")), "SELECT chr_idx, bin, cluster_id AS proto, ROW_NUMBER() OVER (ORDER BY chr_idx, bin) - 1 AS row_id FROM labels", "track_a", labels=LABELS)
add("m10_bed_mapping", "chr_idx bin proto row_id", bin_map, "SELECT * FROM bin_map", "track_a", labels=LABELS, bin_map=BINMAP)
add("m11_matrix_build", "row_id col_id|v", dense, "SELECT * FROM dense", "contacts", "track_a", **CHAIN)
OE = "SELECT i.chr_idx, bin1, bin2, LN(cnt / m) AS v FROM intra i JOIN (SELECT chr_idx, dist, AVG(cnt) AS m FROM intra WHERE cnt > 0 GROUP BY 1, 2) USING (chr_idx, dist) WHERE cnt > 0"
OE2 = f"SELECT * FROM ({OE}) UNION ALL SELECT chr_idx, bin2, bin1, v FROM ({OE}) WHERE bin1 <> bin2"
add("m12_observed_over_expected", "chr_idx bin1 bin2|v", lambda r: C.observed_over_expected(r.contacts_intra), OE2, "contacts_intra", intra=INTRA)
add("m12_second_block", "chr_idx bin1 bin2|v", lambda r: C.second_z_block(C.observed_over_expected(r.contacts_intra), C.distance_z(r.contacts_intra), r.chroms_intra.select("chr_idx", F.expr(f"cast(length div {R} + 1 as int)").alias("n"))),
    f"SELECT * FROM oe UNION ALL SELECT chr_idx, bin1, bin2 + 150, z FROM zrows UNION ALL SELECT chr_idx, bin2, bin1 + 150, z FROM zrows WHERE bin1 <> bin2", "contacts_intra", **ZCHAIN, oe=OE2)
PRE = {"vc": VC.format(t="dense"), "zv": ZCOL.format(t="vc"), "kept": "SELECT * FROM zv WHERE row_id IN (SELECT row_id FROM zv GROUP BY 1 HAVING COUNT(v) > 3 AND COUNT(v) >= 0.3 * 16)"}


def preprocessed(r: Relations) -> DataFrame:
    b = bin_map(r)
    return M.preprocess(dense(r), None, M.weights(b), 16)


add("m13_preprocess", "row_id col_id|v", preprocessed, "SELECT * FROM kept", "contacts", "track_a", **CHAIN, **PRE)


def _commands():
    from . import commands

    return commands


add("m14_settings", "post scaled log intra n|total", lambda r: _commands().settings_summary(*M.build(r.contacts, bin_map(r)), None, M.weights(bin_map(r)), 16))
add("m15_best_candidate", "candidate|ratio", lambda r: S.best_candidates(S.run(r.contacts, candidates(r), r.chroms, KINDS, FACTOR, ROUNDS, tracks=("candidate",))))


def candidates(r: Relations) -> DataFrame:
    a, b = labels(r), T.bins_of(r.track_b, R)
    return a.withColumn("candidate", F.lit(0)).union(b.withColumn("candidate", F.lit(1)))


add("m16_first_candidate", "k candidate", lambda r: r.track_a.select(F.col("cluster_id").alias("k"), (F.col("x1") / R + F.col("chr_idx") * 100).cast("int").alias("candidate")).groupBy("k").agg(F.min("candidate").alias("candidate")), f"SELECT cluster_id AS k, MIN(x1 // {R} + chr_idx * 100) AS candidate FROM track_a GROUP BY 1", "track_a")
add("m17_shuffled_index", "round chr_idx bin cluster_id block||side", blocks, "SELECT * FROM blocks", "track_a", **chain("blocks"))
SPLIT_SQL = " UNION ALL ".join(f"SELECT '{k}' AS map_type, chr_idx, CASE WHEN chr_idx IN ({', '.join(map(str, v))}) THEN 'A' ELSE 'B' END AS side FROM chroms" for k, v in S.SPLITS.items())
SPLIT_SQL += " UNION ALL SELECT 'ODDS_VS_EVENS', chr_idx, CASE WHEN chr_idx % 2 = 1 THEN 'A' ELSE 'B' END FROM chroms UNION ALL SELECT 'FIRST_HALF_VS_SECOND_HALF', chr_idx, CASE WHEN chr_idx <= 2 THEN 'A' ELSE 'B' END FROM chroms UNION ALL SELECT 'SKIP_BY_TWOS', chr_idx, CASE WHEN (chr_idx - 1) % 4 < 2 THEN 'A' ELSE 'B' END FROM chroms"


def partitions(r: Relations) -> DataFrame:
    out = None
    for kind in (*S.SPLITS, *S.ORIGINAL):
        one = S.partition(r.chroms, kind)
        out = one if out is None else out.union(one)
    return out


add("m18_partitions", "chr_idx||map_type side", partitions, SPLIT_SQL, "chroms")
add("m19_inter_map", "row col|cnt", lambda r: _commands().inter_map(r.contacts, r.chroms, R, "ODDS_VS_EVENS"),
    "SELECT bin1 + CASE chr1 WHEN 3 THEN 60 ELSE 0 END AS row, bin2 + CASE chr2 WHEN 4 THEN 60 ELSE 0 END AS col, cnt FROM (SELECT chr1, bin1, chr2, bin2, cnt FROM contacts WHERE cnt > 0 AND chr1 <> chr2 UNION ALL SELECT chr2, bin2, chr1, bin1, cnt FROM contacts WHERE cnt > 0 AND chr1 <> chr2) WHERE chr1 % 2 = 1 AND chr2 % 2 = 0", "contacts")
add("m20_block_scores", "|baseline shuffled ratio|score_type", lambda r: S.run(r.contacts, labels(r), r.chroms, KINDS, FACTOR, ROUNDS), "SELECT * FROM ratios", "contacts", "track_a", **SCHAIN)
add("m21_first_eigenvector", "row_id|value", lambda r: _cluster().first_eigenvector_of(rows(r), "correlation"))
add("m22_root_weights", "row_id col_id|v", lambda r: M.scale_by_root_weights(r.matrix, col_weights(r)), "SELECT row_id, col_id, v * SQRT(col_id % 5 + 1) AS v FROM matrix", "matrix")


def _consensus():
    from ..operators import consensus

    return consensus


def second_members(r: Relations) -> DataFrame:
    return members(r).withColumn("cid", ((F.col("cid") + F.when(F.col("row_id") % 5 == 0, 1).otherwise(0)) % 4).cast("int"))


HUBS = {
    "m": MEMBERS, "s2": "SELECT row_id, (cid + CASE WHEN row_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS id2 FROM m",
    "t": "SELECT cid AS id1, id2, COUNT(*) AS n FROM m JOIN s2 USING (row_id) GROUP BY 1, 2", **{k: GREEDY[k] for k in ("p1", "p2", "p3")},
    "hubs": "SELECT id1, id2, 0 AS hub FROM p1 UNION ALL SELECT id1, id2, 1 FROM p2 UNION ALL SELECT id1, id2, 2 FROM p3",
}
HUB_ROWS = "SELECT m.row_id, hub AS cid FROM m JOIN s2 USING (row_id) JOIN hubs ON hubs.id1 = m.cid AND hubs.id2 = s2.id2"
add("m23_two_way_hubs", "row_id cid", lambda r: _consensus().two_way_hubs(members(r), second_members(r), 3), HUB_ROWS, **HUBS)
add("m23_fill_by_neighbours", "row_id cid", lambda r: _consensus().fill_by_nearest(rows(r), _consensus().two_way_hubs(members(r), second_members(r), 3), "euclidean", 10.0, 64))


def third_members(r: Relations) -> DataFrame:
    return members(r).withColumn("cid", ((F.col("cid") + F.when(F.col("row_id") % 7 == 0, 2).when(F.col("row_id") % 7 == 1, 3).otherwise(0)) % 4).cast("int"))


IDS3 = ("id1", "id2", "id3")
TRIPLES = {
    "m": MEMBERS, "s2": HUBS["s2"], "s3": "SELECT row_id, (cid + CASE row_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END) % 4 AS id3 FROM m",
    "j": "SELECT row_id, cid AS id1, id2, id3 FROM m JOIN s2 USING (row_id) JOIN s3 USING (row_id)", "t": "SELECT id1, id2, id3, COUNT(*) AS n FROM j GROUP BY 1, 2, 3",
    **{f"q{k}": "SELECT * FROM t" + "".join(f" {'AND' if q else 'WHERE'} {i} NOT IN (SELECT {i} FROM q{o})" for q, (o, i) in enumerate((o, i) for o in range(1, k) for i in IDS3)) + " ORDER BY n DESC, id1, id2, id3 LIMIT 1" for k in range(1, 4)},
    "hubs": " UNION ALL ".join(f"SELECT id1, id2, id3, {k - 1} AS hub FROM q{k}" for k in range(1, 4)),
}
add("m24_three_way_hubs", "row_id cid", lambda r: _consensus().three_way_hubs(members(r), second_members(r), third_members(r), 3), "SELECT row_id, hub AS cid FROM j JOIN hubs USING (id1, id2, id3)", **TRIPLES)
CENTRES = "SELECT row_id, LIST(v ORDER BY col_id) AS f FROM matrix WHERE row_id < 5 GROUP BY 1"


def imputed(r: Relations) -> DataFrame:
    flat = M.long(_cluster().impute(rows(r), centres(r), members(r).where("cid < 5")))
    return flat


add("m25_impute", "row_id col_id|v", imputed, "SELECT x.row_id, x.col_id, COALESCE(x.v, CASE WHEN c.v > 0 THEN c.v END) AS v FROM matrix x LEFT JOIN (SELECT * FROM m WHERE cid < 5 AND cid IN (SELECT cid FROM m WHERE cid < 5 GROUP BY 1 HAVING COUNT(*) > 10)) g USING (row_id) LEFT JOIN matrix c ON c.row_id = g.cid AND c.col_id = x.col_id", "matrix", m=MEMBERS)
add("m28_capped_restarts", "row_id cid", lambda r: _cluster().best_of(planted(r), 3, "medians")[1])
add("m29_chi_square", "c1 c2|statistic p", lambda r: _cluster().chi_square(centres(r).withColumn("centre", F.transform("centre", lambda x: F.abs(x) * 50))))
OBSERVED = "SELECT a.row_id AS c1, b.row_id AS c2, ROUND_EVEN(ABS(a.v) * 50, 0) AS o, ABS(b.v) * 50 AS e FROM matrix a JOIN matrix b USING (col_id) WHERE a.row_id < 5 AND b.row_id < 5 AND col_id < 32"
add("m29_statistic", "c1 c2|statistic", lambda r: _cluster().chi_square(centres(r).withColumn("centre", F.transform("centre", lambda x: F.abs(x) * 50))),
    "SELECT c1, c2, SUM((o - e * s) * (o - e * s) / (e * s)) AS statistic FROM (SELECT *, SUM(o) OVER (PARTITION BY c1, c2) / SUM(e) OVER (PARTITION BY c1, c2) AS s FROM observed WHERE o >= 0 AND e > 0) GROUP BY 1, 2", "matrix", observed=OBSERVED)
PAIR5 = "SELECT a.row_id AS c1, b.row_id AS c2, UNNEST(a.f) AS x, UNNEST(b.f) AS y FROM five a JOIN five b ON a.row_id {op} b.row_id"
SCALED = "SELECT c1, c2, ABS(x) * 50 AS x, ABS(y) * 50 AS y FROM p"
PAIRED_STATISTICS = "SELECT c1, c2, SUM((o - e * s) * (o - e * s) / (e * s)) AS statistic FROM (SELECT *, SUM(o) OVER (PARTITION BY c1, c2) / SUM(e) OVER (PARTITION BY c1, c2) AS s FROM observed WHERE o >= 0 AND e > 0) GROUP BY 1, 2"
add("k9_cluster_statistics", "c1 c2 n1 n2 n_similar|distance statistic", lambda r: exports.cluster_statistics(members(r), centres(r).withColumn("centre", F.transform("centre", lambda x: F.abs(x) * 50))),
    f"SELECT c1, c2, a.n AS n1, b.n AS n2, n_similar, distance, statistic FROM (SELECT c1, c2, {METRIC['euclidean']} AS distance, SUM(CASE WHEN (x - y) * (x - y) / NULLIF(ABS(y), 0) < 0.05 THEN 1 ELSE 0 END) AS n_similar FROM scaled GROUP BY 1, 2) JOIN ({PAIRED_STATISTICS}) USING (c1, c2) LEFT JOIN sizes a ON a.cid = c1 LEFT JOIN sizes b ON b.cid = c2",
    "matrix", w=W64, five=FIVE, p=PAIR5.format(op="<"), scaled=SCALED, observed=OBSERVED, m=MEMBERS, sizes="SELECT cid, COUNT(*) AS n FROM m GROUP BY 1")
add("m30_centre_distances", "c1 c2|distance per_entry", lambda r: _cluster().centre_pairs(centres(r)).select("c1", "c2", vectors.euclidean("a", "b").alias("distance"), (vectors.euclidean("a", "b") / 64).alias("per_entry")), f"SELECT c1, c2, {METRIC['euclidean']} AS distance, {METRIC['euclidean']} / 64 AS per_entry FROM p GROUP BY 1, 2", "matrix", w=W64, five=FIVE, p=PAIR5.format(op="<"))
add("m31_similar_entries", "c1 c2 n_similar", lambda r: _cluster().similar_entries(centres(r)), "SELECT c1, c2, SUM(CASE WHEN (x - y) * (x - y) / NULLIF(ABS(y), 0) < 0.05 THEN 1 ELSE 0 END) AS n_similar FROM p GROUP BY 1, 2", "matrix", w=W64, five=FIVE, p=PAIR5.format(op="<"))
add("m32_centre_correlations", "c1 c2|value", lambda r: _cluster().centre_pairs(centres(r), False).select("c1", "c2", vectors.correlation("a", "b").alias("value")), f"SELECT c1, c2, {METRIC['correlation']} AS value FROM p GROUP BY 1, 2", "matrix", w=W64, five=FIVE, p=PAIR5.format(op="<="))
_sql, _more = pair_sql("cosine", "<=")
add("m33_similarity_matrix", "i j|value", lambda r: D.mirrored(D.all_pairs(rows(r), "cosine")), f"SELECT i, j, value FROM pairs UNION ALL SELECT j, i, value FROM pairs WHERE i <> j", "matrix", **_more, pairs=_sql)
add("m34_eigen_types", "row_id|value", lambda r: _cluster().first_eigenvector_of(rows(r), "cosine").select("row_id", F.col("value").cast("float").alias("value")))
add("m35_append_intra", "row_id col_id|v", lambda r: M.append_intra(r.matrix, r.matrix.where("col_id < 10"), 64), "SELECT * FROM matrix UNION ALL SELECT row_id, col_id + 64, v FROM matrix WHERE col_id < 10", "matrix")

# -- scalar functions ------------------------------------------------------------------------------------------
add("f1_log_pseudo", CELL, lambda r: M.log_pseudo(r.contacts.withColumnRenamed("cnt", "v")).withColumnRenamed("v", "cnt"), "SELECT chr1, bin1, chr2, bin2, LN(cnt + 1) AS cnt FROM contacts", "contacts")
add("f2_log_int", "chr1 bin1 chr2 bin2 v", lambda r: r.contacts.withColumn("v", scalars.log1p_int(F.col("cnt"))), "SELECT chr1, bin1, chr2, bin2, FLOOR(LN(1 + cnt)) AS v FROM contacts", "contacts")
add("f3_log_clean", "row_id col_id|v", lambda r: r.matrix.where("v > -1").withColumn("v", scalars.log_clean(F.col("v"), -9.0)), "SELECT row_id, col_id, CASE WHEN v > 0 THEN LN(1 + v) ELSE -9 END AS v FROM matrix WHERE v > -1", "matrix")
add("f4_expm1", "row_id col_id|v", lambda r: r.matrix.withColumn("v", scalars.expm1_positive(F.col("v"))), "SELECT row_id, col_id, CASE WHEN EXP(v) - 1 > 0 THEN EXP(v) - 1 ELSE v END AS v FROM matrix", "matrix")


QUERIED = f"SELECT a.row_id AS i, b.row_id AS j, UNNEST(a.f) AS x, UNNEST(b.f) AS y FROM w a JOIN w b ON b.row_id % {EVERY} = 0"


def column_metric(name: str) -> Callable[[Relations], DataFrame]:
    def build(r: Relations) -> DataFrame:
        """Rows whose id is divisible by EVERY against all rows."""
        x = cut(rows(r))
        return D.against(x, x.where(f"row_id % {EVERY} = 0"), name)

    return build


for _m, _id in (("correlation", "f5_correlation"), ("euclidean", "f6_euclidean"), ("manhattan", "f7_manhattan"), ("cosine", "f8_cosine")):
    add(_id, "i j|value", column_metric(_m), pair_sql(_m, "")[0], "matrix", w=W64, p=QUERIED)
add("f9_arctanh", "row_id col_id|v", lambda r: r.matrix.withColumn("v", vectors.arctanh(F.col("v"))), "SELECT row_id, col_id, 0.5 * (LN(1 + GREATEST(-0.99, LEAST(0.99, v))) - LN(1 - GREATEST(-0.99, LEAST(0.99, v)))) AS v FROM matrix WHERE v IS NOT NULL UNION ALL SELECT row_id, col_id, -2.646652 AS v FROM matrix WHERE FALSE UNION ALL SELECT row_id, col_id, NULL FROM matrix WHERE v IS NULL", "matrix")
add("f10_distance", "chr1 bin1 bin2 dist", lambda r: C.distance(r.contacts_intra), "SELECT chr_idx AS chr1, bin1, bin2, dist FROM intra", "contacts_intra", intra=INTRA)
add("f11_clamp", "row_id col_id|v", lambda r: M.clamp(r.matrix, -0.5, 0.5), "SELECT row_id, col_id, CASE WHEN v IS NOT NULL THEN GREATEST(-0.5, LEAST(0.5, v)) END AS v FROM matrix", "matrix")
add("f12_choose_two", "id1 id2|pairs", lambda r: T.contingency(r.track_a, r.track_b).withColumn("pairs", T.choose_two(F.col("n"))), "SELECT id1, id2, n * (n - 1) / 2.0 AS pairs FROM t", "track_a", "track_b", t=TABLE)
add("f13_colour", "chr_idx x1||colour", lambda r: r.track_a.withColumn("colour", colours.colour(F.col("cluster_id") + F.expr(f"cast(x1 div {R} as int)"))), f"SELECT chr_idx, x1, {NAMES}[(cluster_id + x1 // {R}) % 20 + 1] AS colour FROM track_a", "track_a")
add("f15_transpose", "row_id col_id|v", lambda r: M.transpose(r.matrix), "SELECT col_id AS row_id, row_id AS col_id, v FROM matrix", "matrix")
add("f16_concat", "row_id col_id|v", lambda r: M.long(M.concat(rows(r), rows(r))), "SELECT * FROM matrix UNION ALL SELECT row_id, col_id + 64, v FROM matrix", "matrix")
add("f17_divide_by_weights", "row_id col_id|v", lambda r: M.divide_by_weights(r.matrix, col_weights(r)), "SELECT row_id, col_id, v / (col_id % 5 + 1) AS v FROM matrix", "matrix")
add("f18_divide_by_count", "row_id col_id|v", lambda r: M.long(rows(r).select("row_id", vectors.divide_by_count(F.col("features"), F.col("row_id") % 7).alias("features"))), "SELECT row_id, col_id, v / GREATEST(row_id % 7, 1) AS v FROM matrix", "matrix")
add("f19_add_divide", "row_id col_id|v", lambda r: M.combined([r.matrix, r.matrix], 10), "SELECT row_id, col_id, (v + v) / 10 AS v FROM matrix", "matrix")
add("f20_min_max", "|low high", lambda r: M.extremes(r.matrix), "SELECT MIN(v) AS low, MAX(v) AS high FROM matrix", "matrix")
add("f21_float_cells", "row_id col_id|v", lambda r: M.as_floats(r.matrix), "SELECT row_id, col_id, CAST(v AS FLOAT) AS v FROM matrix", "matrix")
add("f23_strings", "line_no||label name", lambda r: bed.plain(bed.fields(r.bed)), "SELECT line_no, LOWER(cluster_name) AS label, regexp_replace(name, '^chr', '') AS name FROM fields", "bed", fields=FIELDS)
add("f24_unordered_key", "lo hi n", lambda r: T.contingency(r.track_a, r.track_b).groupBy(scalars.unordered_key(F.col("id1"), F.col("id2")).alias("k")).agg(F.sum("n").alias("n")).select("k.lo", "k.hi", "n"), "SELECT LEAST(id1, id2) AS lo, GREATEST(id1, id2) AS hi, SUM(n) AS n FROM t GROUP BY 1, 2", "track_a", "track_b", t=TABLE)
add("f25_file_stems", "k||stem", lambda r: T.ids(r.track_a).select((F.col("cluster_id") + 2).alias("k")).withColumn("stem", scalars.file_stem("x", True, False, True, "means", F.col("k"))), "SELECT DISTINCT cluster_id + 2 AS k, CONCAT('x_vc_z_means_k', cluster_id + 2) AS stem FROM track_a", "track_a")
add("f26_bins", "chr_idx n", lambda r: r.chroms.withColumn("n", scalars.bins(F.col("length"), 7_000_000)), "SELECT chr_idx, length // 7000000 + 1 AS n FROM chroms", "chroms")

# -- sorts, limits, sets ---------------------------------------------------------------------------------------
add("o1_sorted_intervals", f"{ROW} place", lambda r: I.ordered(r.wide_track).withColumn("place", F.row_number().over(Window.partitionBy("chr_idx").orderBy("x1", "x2"))), "SELECT *, ROW_NUMBER() OVER (PARTITION BY chr_idx ORDER BY x1, x2) AS place FROM wide_track", "wide_track")
add("o2_by_unassigned", "i place", lambda r: numbered(D.unassigned_votes(knn_votes(r, members(r).where("cid > 1"))).withColumn("share", F.round("share", 9)), "share", "i"), "SELECT i, ROW_NUMBER() OVER (ORDER BY ROUND(share, 9), i) AS place FROM (SELECT i, AVG(CASE WHEN cid > 1 THEN 0.0 ELSE 1.0 END) AS share FROM nn JOIN m ON m.row_id = j GROUP BY 1)", "matrix", **KNN, m=MEMBERS)
add("o3_descending", "chr_idx bin place", lambda r: C.bad_bins(r.norm_vec).withColumn("place", F.row_number().over(Window.partitionBy("chr_idx").orderBy(F.desc("bin")))), f"SELECT chr_idx, bin, ROW_NUMBER() OVER (PARTITION BY chr_idx ORDER BY bin DESC) AS place FROM bad", "norm_vec", bad=BAD)
add("o4_top_cell", "id1 id2 n", lambda r: T.top_cell(T.contingency(r.track_a, r.track_b)), "SELECT * FROM t ORDER BY n DESC, id1, id2 LIMIT 1", "track_a", "track_b", t=TABLE)
add("o5_union_bad", "chr_idx bin", lambda r: C.union_bad(C.bad_bins(r.norm_vec), r.norm_vec.where("value < 500")), f"SELECT chr_idx, bin FROM bad UNION SELECT chr_idx, bin FROM norm_vec WHERE value < 500", "norm_vec", bad=BAD)
_sql2, _more2 = pair_sql("manhattan", "<=")
add("o6_common_neighbours", "i j", lambda r: D.Nearest(rows(r), ("euclidean", 10.0), ("manhattan", 10.0), block=64).pairs(),
    "SELECT i, j FROM nn INTERSECT SELECT i, j FROM nn2", "matrix", **KNN, pairs2=_sql2, near2=NEAR.replace("pairs", "pairs2"), ranked2=RANK.replace("near", "near2"), cut2=CUT.replace("ranked", "ranked2"), nn2="SELECT near2.i, near2.j FROM near2 JOIN cut2 USING (i) WHERE value < a + s * (b - a)")
add("o7_except", "row_id", lambda r: D.others(r.matrix, members(r).where("cid = 1")), "SELECT DISTINCT row_id FROM matrix EXCEPT SELECT row_id FROM m WHERE cid = 1", "matrix", m=MEMBERS)
add("o8_distinct_ids", "cluster_id", lambda r: T.ids(r.track_a), "SELECT DISTINCT cluster_id FROM track_a", "track_a")
add("o9_rounds", "round n", lambda r: blocks(r).groupBy("round").agg(F.count(F.lit(1)).alias("n")), "SELECT round, COUNT(*) AS n FROM blocks GROUP BY 1", "track_a", **chain("blocks"))

# -- arrays and text -------------------------------------------------------------------------------------------
def array_cells(r: Relations) -> DataFrame:
    """The matrix, written as one .npy file and read again."""
    path = f"{shared_root(r.spark)}/matrix-{uuid.uuid4().hex}.npy"
    exports.save_array(r.matrix, path)
    return array_file.load(r.spark, path)


def text_rows(r: Relations) -> DataFrame:
    """Masked values and sum of every line of the text matrix, written and read again."""
    folder = f"{shared_root(r.spark)}/text-{uuid.uuid4().hex}"
    exports.text_matrix(rows(r)).write.text(folder)
    values = F.transform(F.split("value", " "), lambda x: F.when(x != "NaN", x.cast("double")))
    return r.spark.read.text(folder).select(F.size(F.filter(values, lambda x: x.isNull())).alias("masked"), F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("total"))


add("k4_array", "row_id col_id|v", array_cells, "SELECT * FROM matrix", "matrix")
add("k5_text_rows", "masked|total", text_rows, "SELECT 64 - COUNT(v) AS masked, SUM(v) AS total FROM matrix GROUP BY row_id", "matrix")

# -- extension points and commands -----------------------------------------------------------------------------
add("u1_metric_registry", "i j|value", column_metric("mean_square"), "SELECT i, j, AVG((x - y) * (x - y)) AS value FROM p GROUP BY i, j", "matrix", w=W64, p=QUERIED)
add("u2_score_registry", "|score|score_type", lambda r: S.SCORES["variance"](grid(r), regional=False).withColumn("score_type", F.lit("variance")), f"SELECT 'variance' AS score_type, score FROM ({VAR.format(over='')})", "contacts", "track_a", **chain("grid"))
add("u7_per_chromosome", "chr_idx n", lambda r: I.collapse(r.track_a).groupBy("chr_idx").agg(F.count(F.lit(1)).alias("n")), f"SELECT chr_idx, COUNT(*) AS n FROM ({ISLAND}) GROUP BY 1", "track_a")
BOTH_WAYS = "SELECT 'a' AS track1, 'b' AS track2, m AS matched, s AS total FROM taken UNION ALL SELECT 'b', 'a', m, s FROM taken UNION ALL SELECT track1, track2, SUM(n), SUM(n) FROM paired WHERE track1 = track2 GROUP BY 1, 2"
TAKEN = "SELECT (SELECT SUM(n) FROM (SELECT n FROM p1 UNION ALL SELECT n FROM p2 UNION ALL SELECT n FROM p3 UNION ALL SELECT n FROM p4)) AS m, (SELECT SUM(n) FROM t) AS s"
add("cmd_compare", "matched total|accuracy|track1 track2", lambda r: T.pairwise_accuracy(two_tracks(r)), f"SELECT *, CAST(matched AS DOUBLE) / total AS accuracy FROM ({BOTH_WAYS})", "track_a", "track_b", two=TWO, one=ONE, paired=PAIRED, t=TABLE, **GREEDY, taken=TAKEN)
ARI_AB = ARI
add("cmd_ari", "|ari|track1 track2", lambda r: T.pairwise_ari(two_tracks(r)).where("track1 <> track2"), f"SELECT 'a' AS track1, 'b' AS track2, ari FROM ({ARI}) UNION ALL SELECT 'b', 'a', ari FROM ({ARI})", "track_a", "track_b", t=TABLE)
add("cmd_cvs", "id1 id2|cv", lambda r: _commands().cvs(r.contacts, r.track_a, R)[0], "SELECT * FROM cv", "contacts", "track_a", **DCHAIN)
add("cmd_block_scores", "|geometric_mean|track_id score_type", lambda r: _commands().block_scores(r.contacts, two_tracks(r), r.chroms, R, compression=FACTOR)[1])
add("cmd_compress", "i j|l1 cosine", lambda r: _commands().compress(r.contacts, r.track_a, R, n_columns=16))
add("cmd_annotate", "k chr_idx x1 x2 cluster_id", lambda r: _commands().annotate(r.contacts, r.norm_vec, r.chroms, R, 3, 4))
