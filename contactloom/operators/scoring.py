"""Scoring annotations by randomised block compression.

Contacts between two sets of chromosomes form a matrix whose rows and columns are
grouped by cluster.  In each round the bins of a cluster are shuffled and cut into
blocks of `factor`; cells are summed by block.  The mean over rounds of ln(1 + sum)
is scored against its cluster-pair regions and against one region over all.  Maps stay
sparse: sums, counts and the share of the zero cells come from the cells that are seen
and from counts of blocks.  The functions on full grids are for maps that are given as such."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from .contacts import positive

ROUNDS = 10
# Chromosomes of the first side of each split; the second side is every other autosome.
SPLITS = {
    "SPLIT1": (1, 4, 5, 8, 9, 12, 13, 16, 17, 20, 21),
    "SPLIT2": (1, 3, 4, 5, 8, 11, 13, 14, 15, 16, 17, 18),
    "SPLIT3": (1, 3, 6, 8, 10, 11, 12, 17, 21),
    "SPLIT4": (1, 4, 6, 7, 9, 11, 12, 15, 16, 17, 18, 22),
    "SPLIT5": (1, 2, 3, 5, 6, 9, 15, 16, 21, 22),
}
ORIGINAL = ("ODDS_VS_EVENS", "FIRST_HALF_VS_SECOND_HALF", "SKIP_BY_TWOS")


def partition(chroms: DataFrame, kind: str) -> DataFrame:
    """(map_type, chr_idx, side) of every chromosome, a row each."""
    ordinal = F.row_number().over(Window.orderBy("chr_idx")) - 1
    out = chroms.select("chr_idx", ordinal.alias("_o"))
    if kind in SPLITS:
        first = F.col("chr_idx").isin(*SPLITS[kind])
    elif kind == "ODDS_VS_EVENS":
        first = F.col("chr_idx") % 2 == 1
    elif kind == "FIRST_HALF_VS_SECOND_HALF":
        first = F.col("_o") < F.expr(f"{chroms.count()} div 2")
    elif kind == "SKIP_BY_TWOS":
        first = F.col("_o") % 4 < 2
    else:
        raise ValueError(f"unknown partition {kind}")
    return out.select(F.lit(kind).alias("map_type"), "chr_idx", F.when(first, "A").otherwise("B").alias("side"))


def random_order(seed: int, round_: Column, chr_: Column, bin_: Column) -> Column:
    """A pseudo-random key that other engines can compute too."""
    return F.md5(F.concat_ws("|", F.lit(seed), round_, chr_, bin_))


def shuffled_blocks(bins: DataFrame, factor: int, rounds: int = ROUNDS, seed: int = 0, keys: tuple[str, ...] = ("map_type", "side")) -> DataFrame:
    """(keys, round, chr_idx, bin, cluster_id, block) from bins (keys, chr_idx, bin, cluster_id).

    Every cluster is shuffled, cut to whole blocks, and numbered behind the clusters before it."""
    factor = max(1, factor)
    each = bins.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    w = Window.partitionBy(*keys, "round", "cluster_id").orderBy(random_order(seed, F.col("round"), F.col("chr_idx"), F.col("bin")), "chr_idx", "bin")
    placed = each.withColumn("_p", F.row_number().over(w) - 1)
    sizes = bins.groupBy(*keys, "cluster_id").agg(F.expr(f"count(1) div {factor}").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "cluster_id", "_n", before.alias("_b"))  # a row for each cluster
    out = placed.join(F.broadcast(starts), [*keys, "cluster_id"]).where(F.col("_p") < F.col("_n") * factor)
    return out.select(*keys, "round", "chr_idx", "bin", "cluster_id", (F.expr(f"_p div {factor}") + F.col("_b")).alias("block"))


def block_sums(contacts: DataFrame, blocks: DataFrame, keys: tuple[str, ...] = ("map_type",)) -> DataFrame:
    """Sums of cells by round and pair of blocks, rows from side A and columns from side B; the map stays sparse."""
    inter = positive(contacts).where("chr1 <> chr2").select("chr1", "bin1", "chr2", "bin2", "cnt")
    both = inter.union(inter.select("chr2", "bin2", "chr1", "bin1", "cnt"))
    a = blocks.where("side = 'A'").select(*keys, "round", F.col("chr_idx").alias("chr1"), F.col("bin").alias("bin1"), F.col("block").alias("brow"))
    b = blocks.where("side = 'B'").select(*keys, "round", F.col("chr_idx").alias("chr2"), F.col("bin").alias("bin2"), F.col("block").alias("bcol"))
    return both.join(a, ["chr1", "bin1"]).join(b, [*keys, "round", "chr2", "bin2"]).groupBy(*keys, "round", "brow", "bcol").agg(F.sum("cnt").alias("s"))


def mean_over_rounds(sums: DataFrame, rounds: int = ROUNDS, keys: tuple[str, ...] = ("map_type",)) -> DataFrame:
    """Mean of ln(1 + sum); a pair of blocks without contacts in a round counts 0 there."""
    return sums.groupBy(*keys, "brow", "bcol").agg((F.sum(F.log1p("s")) / rounds).alias("v"))


def grid(blocks: DataFrame, means: DataFrame, keys: tuple[str, ...] = ("map_type",)) -> DataFrame:
    """All pairs of blocks with their clusters, 0 where nothing was seen; a block belongs to one cluster in every round."""
    of = lambda side, block, cid: blocks.where(f"side = '{side}' and round = 0").select(*keys, F.col("block").alias(block), F.col("cluster_id").alias(cid)).distinct()
    return of("A", "brow", "id1").join(of("B", "bcol", "id2"), list(keys)).join(means, [*keys, "brow", "bcol"], "left").select(*keys, "brow", "bcol", "id1", "id2", F.coalesce("v", F.lit(0.0)).alias("v"))


def regions(cells: DataFrame, symmetric: bool = False, keys: tuple[str, ...] = ("map_type",)) -> DataFrame:
    """Sum and count of each cluster-pair region; symmetric folds (a, b) and (b, a)."""
    a, b = (F.least("id1", "id2"), F.greatest("id1", "id2")) if symmetric else (F.col("id1"), F.col("id2"))
    return cells.groupBy(*keys, a.alias("r1"), b.alias("r2")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))


def _with_mean(cells: DataFrame, regional: bool, symmetric: bool, keys: tuple[str, ...]) -> DataFrame:
    if not regional:
        return cells.withColumn("_m", F.avg("v").over(Window.partitionBy(*keys)))
    a, b = (F.least("id1", "id2"), F.greatest("id1", "id2")) if symmetric else (F.col("id1"), F.col("id2"))
    return cells.withColumn("_m", F.avg("v").over(Window.partitionBy(*keys, a, b)))


def variance_score(cells: DataFrame, regional: bool = True, symmetric: bool = False, keys: tuple[str, ...] = ("map_type",)) -> DataFrame:
    """Mean squared deviation from the mean of the region (or of the whole matrix)."""
    return _with_mean(cells, regional, symmetric, keys).groupBy(*keys).agg(F.avg((F.col("v") - F.col("_m")) * (F.col("v") - F.col("_m"))).alias("score"))


def divergence_score(cells: DataFrame, regional: bool = True, symmetric: bool = False, keys: tuple[str, ...] = ("map_type",), strict: bool = False) -> DataFrame:
    """Sum of p ln(p / q), p the cell's and q its region mean's share of the total; a zero cell adds 0, or makes the score NULL if strict."""
    rows = _with_mean(cells, regional, symmetric, keys).withColumn("_t", F.sum("v").over(Window.partitionBy(*keys)))
    p, q = F.try_divide("v", "_t"), F.try_divide("_m", "_t")
    term = F.when(F.col("v") > 0, p * F.ln(p / q)).otherwise(F.lit(None if strict else 0.0).cast("double"))
    score = F.sum(term)
    return rows.groupBy(*keys).agg((F.when(F.count(term) == F.count(F.lit(1)), score) if strict else score).alias("score"))


#: Scores by name; a score takes (cells, regional, symmetric, keys).
SCORES: dict[str, Callable[..., DataFrame]] = {"variance": variance_score, "kl": divergence_score}


@dataclass(frozen=True)
class BlockMap:
    """A map of blocks without its zero cells: `cells` (keys, brow, bcol, id1, id2, v), and `sizes` (keys, id1, id2, n), the cells of each pair of clusters, zeros among them."""

    cells: DataFrame
    sizes: DataFrame
    keys: tuple[str, ...] = ("map_type",)


def block_map(blocks: DataFrame, means: DataFrame, keys: tuple[str, ...] = ("map_type",)) -> BlockMap:
    """The means with the clusters of their blocks; sizes are products of block counts, so pairs of blocks are never listed."""
    known = blocks.where("round = 0").select(*keys, "side", "block", "cluster_id").distinct()
    of = lambda side, block, cid: known.where(f"side = '{side}'").select(*keys, F.col("block").alias(block), F.col("cluster_id").alias(cid))
    count = lambda side, cid, n: known.where(f"side = '{side}'").groupBy(*keys, F.col("cluster_id").alias(cid)).agg(F.count(F.lit(1)).alias(n))
    cells = means.where("v > 0").join(of("A", "brow", "id1"), [*keys, "brow"]).join(of("B", "bcol", "id2"), [*keys, "bcol"])
    sizes = count("A", "id1", "n1").join(count("B", "id2", "n2"), list(keys))
    return BlockMap(cells.select(*keys, "brow", "bcol", "id1", "id2", "v"), sizes.select(*keys, "id1", "id2", (F.col("n1") * F.col("n2")).alias("n")), keys)


def _by_region(rows: DataFrame, regional: bool, symmetric: bool) -> DataFrame:
    """rows with their region (r1, r2): a cluster pair, folded if symmetric, or the whole map."""
    if not regional:
        return rows.withColumns({"r1": F.lit(0), "r2": F.lit(0)})
    a, b = (F.least("id1", "id2"), F.greatest("id1", "id2")) if symmetric else (F.col("id1"), F.col("id2"))
    return rows.withColumns({"r1": a, "r2": b})


def map_regions(m: BlockMap, regional: bool = True, symmetric: bool = False) -> DataFrame:
    """A21 from the cells that are not zero: (keys, r1, r2, s, n, seen), the sum, the number of all cells and of those that are not zero."""
    by = [*m.keys, "r1", "r2"]
    sizes = _by_region(m.sizes, regional, symmetric).groupBy(*by).agg(F.sum("n").alias("n"))
    seen = _by_region(m.cells, regional, symmetric).groupBy(*by).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("seen"))
    return sizes.join(seen, by, "left").select(*by, F.coalesce("s", F.lit(0.0)).alias("s"), "n", F.coalesce("seen", F.lit(0)).alias("seen"))


def map_scores(m: BlockMap, regional: bool = True, symmetric: bool = False, strict: bool = False) -> DataFrame:
    """(keys, variance, kl).  A zero cell deviates by its region's mean; it adds nothing to kl, or makes it NULL if strict."""
    by = [*m.keys, "r1", "r2"]
    regions = map_regions(m, regional, symmetric).withColumn("mean", F.col("s") / F.col("n"))
    off = F.col("v") - F.col("mean")
    parts = _by_region(m.cells, regional, symmetric).join(regions.select(*by, "mean"), by).groupBy(*by).agg(F.sum(off * off).alias("dev"), F.sum(F.col("v") * F.ln(F.col("v") / F.col("mean"))).alias("log"))
    rows = regions.join(parts, by, "left")
    zeros = F.col("n") - F.col("seen")
    variance = F.sum(F.coalesce("dev", F.lit(0.0)) + zeros * F.col("mean") * F.col("mean")) / F.sum("n")
    kl = F.coalesce(F.try_divide(F.sum("log"), F.sum("s")), F.lit(0.0))
    return rows.groupBy(*m.keys).agg(variance.alias("variance"), (F.when(F.sum(zeros) == 0, kl) if strict else kl).alias("kl"))


def map_ratios(m: BlockMap, symmetric: bool = False) -> DataFrame:
    """Baseline (one region over the whole map) over shuffled (cluster regions) for every score; NULL where the latter is 0."""
    named = lambda rows, name: rows.select(*m.keys, F.stack(F.lit(len(SCORES)), *[x for k in SCORES for x in (F.lit(k), F.col(k))]).alias("score_type", name))
    base, own = named(map_scores(m, regional=False), "baseline"), named(map_scores(m, symmetric=symmetric), "shuffled")
    return base.join(own, [*m.keys, "score_type"]).select(*m.keys, "score_type", "baseline", "shuffled", F.try_divide("baseline", "shuffled").alias("ratio"))


def ratios(cells: DataFrame, symmetric: bool = False, keys: tuple[str, ...] = ("map_type",)) -> DataFrame:
    """Baseline over shuffled for every score; NULL where the latter is 0."""
    out = None
    for name, score in SCORES.items():
        base = score(cells, regional=False, keys=keys).withColumnRenamed("score", "baseline")
        own = score(cells, regional=True, symmetric=symmetric, keys=keys).withColumnRenamed("score", "shuffled")
        one = base.join(own, list(keys)).select(*keys, F.lit(name).alias("score_type"), "baseline", "shuffled", F.try_divide("baseline", "shuffled").alias("ratio"))
        out = one if out is None else out.union(one)
    return out


def best_candidates(scores: DataFrame, *by: str) -> DataFrame:
    """(by, candidate, ratio): the candidate with the largest variance ratio; ties go to the first one."""
    return scores.where("score_type = 'variance'").groupBy(*by).agg(F.max_by("candidate", F.struct("ratio", -F.col("candidate"))).alias("candidate"), F.max("ratio").alias("ratio"))


def geometric_mean(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Over map types, by score type."""
    return scores.where("ratio > 0").groupBy(*keys, "score_type").agg(F.exp(F.avg(F.ln("ratio"))).alias("geometric_mean"))


def sided_bins(bins: DataFrame, chroms: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Bins (.., chr_idx, bin, cluster_id) with every map type and the side of their chromosome."""
    sides = None
    for kind in kinds:
        one = partition(chroms, kind)
        sides = one if sides is None else sides.union(one)
    return bins.join(F.broadcast(sides), "chr_idx")


def run(contacts: DataFrame, bins: DataFrame, chroms: DataFrame, kinds: tuple[str, ...] = tuple(SPLITS), factor: int = 8, rounds: int = ROUNDS, seed: int = 0, tracks: tuple[str, ...] = ()) -> DataFrame:
    """Scores of annotations; tracks, map types and rounds are grouping columns of one job."""
    keys = (*tracks, "map_type")
    blocks = cut(shuffled_blocks(sided_bins(bins, chroms, kinds), factor, rounds, seed, (*keys, "side")))
    m = block_map(blocks, mean_over_rounds(block_sums(contacts, blocks, keys), rounds, keys), keys)
    return map_ratios(BlockMap(cut(m.cells), cut(m.sizes), keys))
