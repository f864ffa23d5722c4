"""The five commands as composed plans."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cluster, contacts, intervals, matrix, metrics, proto, scoring, tracks
from ..runtime import AT_ONCE, cut, side_by_side

COMPRESSED_BP = 1_600_000
#: Settings of the sweep: (raw counts with coverage norm, or the given normalised ones; columns scaled by root weights; logarithm; intra columns appended).
SETTINGS = tuple(product((True, False), repeat=4))


def factor(resolution: int) -> int:
    return max(1, COMPRESSED_BP // resolution)


def configured(inter: DataFrame, intra: DataFrame, normed: tuple[DataFrame, DataFrame] | None, weights: DataFrame, n_columns: int, settings: tuple = SETTINGS) -> Iterator[tuple[tuple, DataFrame, DataFrame]]:
    """(setting, cells, weights of their columns) of each setting; column z scores are always taken.

    Settings on normalised counts need `normed`, their inter and intra cells, and are left out without them.
    Cells are not scaled yet: means take them scaled once, medians twice."""
    behind = weights.select((F.col("col_id") + n_columns).cast("int").alias("col_id"), "w")

    def build(setting: tuple) -> tuple[tuple, DataFrame, DataFrame] | None:
        post, _, log, appended = setting
        source = (inter, intra) if post else normed
        if source is None:
            return None
        cells = matrix.preprocess(source[0], source[1] if appended else None, weights, n_columns, post, log)
        return setting, cells, weights.unionByName(behind) if appended else weights

    return filter(None, side_by_side(weights.sparkSession, build, settings))


def settings_summary(inter: DataFrame, intra: DataFrame, normed: tuple[DataFrame, DataFrame] | None, weights: DataFrame, n_columns: int, settings: tuple = SETTINGS) -> DataFrame:
    """Cells and their sum, as means take them, under each setting."""
    out, inter, intra = None, cut(inter), cut(intra)
    for setting, cells, w in configured(inter, intra, normed, weights, n_columns, settings):
        cells = matrix.scale_by_root_weights(cells, w) if setting[1] else cells
        one = cells.agg(F.count("v").alias("n"), F.sum("v").alias("total"))
        one = one.select(*(F.lit(int(v)).alias(k) for k, v in zip(("post", "scaled", "log", "intra"), setting, strict=True)), "n", "total")
        out = one if out is None else out.union(one)
    return out


def inter_map(table: DataFrame, chroms: DataFrame, resolution: int, kind: str) -> DataFrame:
    """The sparse map of side A against side B; a chromosome's bins stand behind those of the ones before it on its side."""
    sides = scoring.partition(chroms, kind).join(chroms, "chr_idx").withColumn("n", F.expr(f"length div {resolution} + 1"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("side").orderBy("chr_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sides.select("chr_idx", "side", before.alias("before"))
    inter = contacts.positive(table).where("chr1 <> chr2").select("chr1", "bin1", "chr2", "bin2", "cnt")
    both = inter.union(inter.select("chr2", "bin2", "chr1", "bin1", "cnt"))
    a = offsets.where("side = 'A'").select(F.col("chr_idx").alias("chr1"), F.col("before").alias("_a"))
    b = offsets.where("side = 'B'").select(F.col("chr_idx").alias("chr2"), F.col("before").alias("_b"))
    return both.join(F.broadcast(a), "chr1").join(F.broadcast(b), "chr2").select((F.col("bin1") + F.col("_a")).alias("row"), (F.col("bin2") + F.col("_b")).alias("col"), "cnt")


def compare(many: DataFrame, ari: bool = False) -> DataFrame:
    """Compare: every pair of tracks (track_id, ...)."""
    return tracks.pairwise_ari(many) if ari else tracks.pairwise_accuracy(many)


def cvs(table: DataFrame, track: DataFrame, resolution: int) -> tuple[DataFrame, DataFrame]:
    """Variation: coefficients of variation by ordered pair of clusters, and their deviation."""
    bins = tracks.bins_of(intervals.collapse(track), resolution)
    out = contacts.variation(contacts.densities(table, bins))
    return out, contacts.deviation_of_variations(out)


def block_scores(table: DataFrame, many: DataFrame, chroms: DataFrame, resolution: int, kinds: tuple[str, ...] = tuple(scoring.SPLITS), compression: int | None = None, seed: int = 22871) -> tuple[DataFrame, DataFrame]:
    """Block scores: scores of every track by partition, and their geometric means; tracks are cut to the loci that all of them have."""
    n = many.select("track_id").distinct().count()
    same = tracks.common_loci(many, resolution, n)
    labels = intervals.to_bins(same, resolution).groupBy("track_id", "chr_idx", "bin").agg(F.max_by("cluster_id", F.struct("x1", "x2", "cluster_id")).alias("cluster_id"))
    scores = scoring.run(table, labels, chroms, kinds, compression or factor(resolution), seed=seed, tracks=("track_id",))
    return scores, scoring.geometric_mean(scores, ("track_id",))


def compress(table: DataFrame, track: DataFrame, resolution: int, n_columns: int) -> DataFrame:
    """Compress: compressed inter matrix of an annotation, and L1 and cosine of all pairs of its rows."""
    mapping = matrix.bed_mapping(tracks.bins_of(track, resolution))
    cells = matrix.vanilla_coverage(matrix.build(table, mapping)[0])
    cells = matrix.drop_bad_rows(cells, n_columns)
    cells = cut(cells)
    cells = matrix.log_pseudo(matrix.drop_bad_columns(cells, cells.select("row_id").distinct().count()))
    rows = cut(matrix.wide(cells))
    one = metrics.all_pairs(rows, "manhattan").withColumnRenamed("value", "l1")
    return one.join(metrics.all_pairs(rows, "cosine").withColumnRenamed("value", "cosine"), ["i", "j"])


def feature_rows(table: DataFrame, norm_vec: DataFrame, chroms: DataFrame, resolution: int, *, normed: DataFrame | None = None, settings: tuple = SETTINGS, mapping: DataFrame | None = None, cutoffs: DataFrame | None = None) -> tuple[DataFrame, Iterator[tuple[tuple, str, DataFrame]]]:
    """The intervals of the matrix's rows, and (setting, kind, rows) of every feature matrix that is clustered.

    Bad bins and translocated pairs are masked, proto clusters found unless a mapping is
    given, and the matrix is built once for the raw counts and once for the normalised ones, if there are any."""
    bad = contacts.bad_bins(norm_vec)
    clean = contacts.mask_bad(table, bad)
    if mapping is None:
        oe = contacts.observed_over_expected(contacts.far(clean, resolution))
        mapping = matrix.global_rows(proto.discover(oe, chroms, resolution))
    mapping = cut(mapping)
    translocated = contacts.translocations(clean, cutoffs) if cutoffs is not None else None
    n_columns = mapping.select("proto").distinct().count()
    inter, intra = map(cut, matrix.build(clean, mapping, translocated))
    ready = tuple(map(cut, matrix.build(contacts.mask_bad(normed, bad), mapping, translocated))) if normed is not None else None

    def wide(one: tuple[tuple, DataFrame, DataFrame]) -> list[tuple[tuple, str, DataFrame]]:
        (setting, cells, w), out = one, []
        for kind in ("means", "medians"):
            if setting[1]:
                cells = matrix.scale_by_root_weights(cells, w)
            cells = cut(cells)
            out.append((setting, kind, cut(matrix.wide(cells))))
        return out

    each = side_by_side(table.sparkSession, wide, configured(inter, intra, ready, matrix.weights(mapping), n_columns, settings))
    return intervals.to_intervals(mapping, chroms, resolution), chain.from_iterable(each)


def setting_name(setting: tuple) -> str:
    """A setting as a file stem."""
    return "_".join(name for name, on in zip(("raw", "scaled", "log", "intra"), setting, strict=True) if on) or "plain"


def eigen_tracks(*args: DataFrame, settings: tuple = SETTINGS, **options) -> Iterator[tuple[str, DataFrame]]:
    """(name, track of values) of the first eigenvector of the rows' correlations, for every feature matrix: once, and again where medians take the columns scaled twice."""
    where, each = feature_rows(*args, settings=settings, **options)
    for setting, kind, rows in each:
        if kind == "means" or setting[1]:
            vector = cluster.first_eigenvector_of(rows, "correlation")
            yield setting_name(setting) + ("_twice" if kind == "medians" else ""), cluster.values_on_intervals(vector, where)


def annotate(table: DataFrame, norm_vec: DataFrame, chroms: DataFrame, resolution: int, first: int, past: int, *, normed: DataFrame | None = None, restarts: int = cluster.RESTARTS, iterations: int = cluster.MAX_ITERATIONS, settings: tuple = SETTINGS, mapping: DataFrame | None = None, cutoffs: DataFrame | None = None, seed: int = 22871, at_once: int = AT_ONCE) -> DataFrame:
    """Annotate: the best annotation (k, chr_idx, x1, x2, cluster_id) for k from first to past - 1.

    Clusterings of different settings, algorithms and k do not depend on each other; `at_once` of them run side by side, so that
    the small jobs of one fill the cluster while another waits for its driver.  The result does not depend on it.
    Every setting and algorithm (see feature_rows) gives a candidate, and the candidate with the best variance ratio on odd against even chromosomes stays."""
    where, each = feature_rows(table, norm_vec, chroms, resolution, normed=normed, settings=settings, mapping=mapping, cutoffs=cutoffs)

    def clustered(job: tuple[int, str, DataFrame]) -> tuple[int, DataFrame]:
        k, kind, rows = job
        return k, cut(cluster.best_of(rows, k, kind, restarts, seed, iterations)[1])

    out, jobs = None, ((k, kind, rows) for _, kind, rows in each for k in range(first, past))
    for candidate, (k, members) in enumerate(side_by_side(table.sparkSession, clustered, jobs, at_once)):
        one = cluster.to_track(members, where).withColumns({"k": F.lit(k), "candidate": F.lit(candidate)})
        out = one if out is None else out.union(one)
    out = cut(out)
    bins = out.select("k", "candidate", "chr_idx", F.expr(f"cast(x1 div {resolution} as int)").alias("bin"), "cluster_id")
    scores = scoring.run(table, bins, chroms, ("ODDS_VS_EVENS",), min(factor(resolution), 2) if resolution >= COMPRESSED_BP else factor(resolution), seed=0, tracks=("k", "candidate"))
    best = scoring.best_candidates(scores, "k").select("k", "candidate")
    kept = out.join(F.broadcast(best), ["k", "candidate"]).select("k", "chr_idx", "x1", "x2", "cluster_id")
    return intervals.collapse(kept, ("k",))
