"""Feature matrices in long form: cells (row_id, col_id, v), NULL or absent where masked.

Shapes: bin_map (chr_idx, bin, proto, row_id), col_weights (col_id, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from .contacts import MIN_PER_CELL, distance_z, positive, without_outliers

# Fixed values.
CLAMP = 3.0
ROW_SHARE, COLUMN_SHARE, MIN_GOOD = 0.3, 0.75, 3


def global_rows(bins: DataFrame) -> DataFrame:
    """M9: row ids over (chr_idx, bin, proto) in chromosome and bin order: counts by chromosome first, then numbers within each."""
    sizes = bins.groupBy("chr_idx").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("chr_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("chr_idx", before.alias("_b"))
    number = F.row_number().over(Window.partitionBy("chr_idx").orderBy("bin")) - 1
    return bins.withColumn("_r", number).join(F.broadcast(starts), "chr_idx").withColumn("row_id", (F.col("_r") + F.col("_b")).cast("long")).drop("_r", "_b")


def bed_mapping(labels: DataFrame) -> DataFrame:
    """proto = cluster id + ordinal of the chromosome * (largest id + 1), with row ids."""
    top = labels.agg((F.max("cluster_id") + 1).alias("_k"))
    order = labels.select("chr_idx").distinct().select("chr_idx", (F.dense_rank().over(Window.orderBy("chr_idx")) - 1).alias("_o"))
    protos = labels.join(F.broadcast(order), "chr_idx").join(F.broadcast(top)).withColumn("proto", (F.col("cluster_id") + F.col("_o") * F.col("_k")).cast("int"))
    return global_rows(protos.select("chr_idx", "bin", "proto"))


def weights(bin_map: DataFrame) -> DataFrame:
    """A10: loci of each proto cluster."""
    return bin_map.groupBy(F.col("proto").alias("col_id")).agg(F.count(F.lit(1)).alias("w"))


def inter_sums(contacts: DataFrame, bin_map: DataFrame) -> DataFrame:
    """Both ends mapped; each contact between chromosomes counts for (row1, proto2) and (row2, proto1)."""
    return scatter(positive(contacts).where("chr1 <> chr2"), bin_map, "cnt").groupBy("row_id", "col_id").agg(F.sum("v").alias("v"))


def scatter(rows: DataFrame, bin_map: DataFrame, value: str) -> DataFrame:
    """Cells of both ends of contact-like rows."""
    a = bin_map.select(F.col("chr_idx").alias("chr1"), F.col("bin").alias("bin1"), F.col("row_id").alias("_r1"), F.col("proto").alias("_p1"))
    b = bin_map.select(F.col("chr_idx").alias("chr2"), F.col("bin").alias("bin2"), F.col("row_id").alias("_r2"), F.col("proto").alias("_p2"))
    joined = rows.join(a, ["chr1", "bin1"]).join(b, ["chr2", "bin2"])
    v = F.col(value).cast("double").alias("v")
    ends = F.array(F.struct(F.col("_r1").alias("row_id"), F.col("_p2").alias("col_id"), v), F.struct(F.col("_r2").alias("row_id"), F.col("_p1").alias("col_id"), v))
    return joined.select(F.inline(ends))


def intra_means(contacts: DataFrame, bin_map: DataFrame) -> DataFrame:
    """A2: mean z score of the contacts within a chromosome, outliers left out, where more than 10 meet in a cell."""
    z = without_outliers(distance_z(contacts).where("cnt > 0"))
    cells = scatter(z, bin_map, "z").groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"))
    return cells.where(F.col("n") > MIN_PER_CELL).select("row_id", "col_id", "v")


def masked_pairs(bin_map: DataFrame, translocated: DataFrame | None = None) -> DataFrame:
    """(row chromosome, column) blocks that are masked: a proto's own chromosome, and translocated pairs both ways."""
    own = bin_map.select("chr_idx", F.col("proto").alias("col_id")).distinct()
    if translocated is None:
        return own
    both = translocated.select("chr1", "chr2").union(translocated.select(F.col("chr2"), F.col("chr1")))
    other = own.withColumnRenamed("chr_idx", "chr2").join(F.broadcast(both), "chr2").select(F.col("chr1").alias("chr_idx"), "col_id")
    return own.union(other).distinct()


def densify(cells: DataFrame, bin_map: DataFrame, masked: DataFrame) -> DataFrame:
    """All (row, column) cells outside the mask, 0 where no contact was seen. Columns are proto clusters, a few hundred."""
    columns = bin_map.select(F.col("proto").alias("col_id")).distinct()
    grid = bin_map.select("row_id", "chr_idx").join(F.broadcast(columns)).join(F.broadcast(masked), ["chr_idx", "col_id"], "left_anti")
    return grid.join(cells, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("v", F.lit(0.0)).alias("v"))


def build(contacts: DataFrame, bin_map: DataFrame, translocated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Inter sums on a dense grid with masks, and intra means."""
    bin_map = cut(bin_map)
    return densify(inter_sums(contacts, bin_map), bin_map, masked_pairs(bin_map, translocated)), intra_means(contacts, bin_map)


def append_intra(inter: DataFrame, intra: DataFrame, n_columns: int) -> DataFrame:
    """Intra cells as columns behind the inter ones."""
    return inter.select("row_id", "col_id", "v").union(intra.select("row_id", (F.col("col_id") + n_columns).cast("int"), "v"))


def vanilla_coverage(cells: DataFrame) -> DataFrame:
    """V / (row sum * column sum), scaled back to the old total; what is not positive is masked."""
    pos = cut(cells.where("v > 0"))  # read by the sums and by the division
    rows, columns = pos.groupBy("row_id").agg(F.sum("v").alias("_r")), pos.groupBy("col_id").agg(F.sum("v").alias("_c"))
    scaled = cut(pos.join(rows, "row_id").join(F.broadcast(columns), "col_id").select("row_id", "col_id", (F.col("v") / F.col("_r") / F.col("_c")).alias("_v"), "v"))
    ratio = scaled.agg(F.try_divide(F.sum("v"), F.sum("_v")).alias("_k"))
    return scaled.join(F.broadcast(ratio)).select("row_id", "col_id", (F.col("_v") * F.col("_k")).alias("v"))


def divide_by_weights(cells: DataFrame, col_weights: DataFrame) -> DataFrame:
    """v / w; NULL where the weight is 0."""
    return cells.join(F.broadcast(col_weights), "col_id").select("row_id", "col_id", F.try_divide(F.col("v"), F.col("w").cast("double")).alias("v"))


def scale_by_root_weights(cells: DataFrame, col_weights: DataFrame) -> DataFrame:
    """V * sqrt(w)."""
    return cells.join(F.broadcast(col_weights), "col_id").select("row_id", "col_id", (F.col("v") * F.sqrt("w")).alias("v"))


def log_pseudo(cells: DataFrame) -> DataFrame:
    """ln(v + 1)."""
    return cells.withColumn("v", F.log1p("v"))


def column_z(cells: DataFrame, clamp: float = CLAMP) -> DataFrame:
    """Z scores by column over positive cells, which alone are replaced; clamped."""
    pos = F.when(F.col("v") > 0, F.col("v"))
    stats = cells.groupBy("col_id").agg(F.avg(pos).alias("_m"), F.stddev_samp(pos).alias("_s"))
    z = F.try_divide(F.col("v") - F.col("_m"), "_s")
    clamped = F.when(z.isNotNull(), F.greatest(F.lit(-clamp), F.least(F.lit(clamp), z)))
    return cells.join(F.broadcast(stats), "col_id").select("row_id", "col_id", F.when(F.col("v") > 0, clamped).otherwise(F.col("v")).alias("v"))


def row_z(cells: DataFrame) -> DataFrame:
    """Z scores by row over the row's positive cells, if more than two; replaces all cells."""
    pos = F.when(F.col("v") > 0, F.col("v"))
    stats = cells.groupBy("row_id").agg(F.avg(pos).alias("_m"), F.stddev_samp(pos).alias("_s"), F.count(pos).alias("_n"))
    return cells.join(stats, "row_id").select("row_id", "col_id", F.when(F.col("_n") > 2, F.try_divide(F.col("v") - F.col("_m"), "_s")).otherwise(F.col("v")).alias("v"))


def global_stats(cells: DataFrame) -> DataFrame:
    """Mean and deviation of the positive cells."""
    return cells.where("v > 0").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n"))


def column_z_floor(cells: DataFrame, floor: float) -> DataFrame:
    """Z scores by column over cells above the floor; the others are masked."""
    kept = cells.where(F.col("v") > floor)
    stats = kept.groupBy("col_id").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    return kept.join(F.broadcast(stats), "col_id").select("row_id", "col_id", F.try_divide(F.col("v") - F.col("_m"), "_s").alias("v"))


def mask_outliers(cells: DataFrame, limit: float, both_sides: bool = False) -> DataFrame:
    """Positive cells whose global z is above the limit (or beyond it on either side) become NULL."""
    z = (F.col("v") - F.col("mean")) / F.col("sd")
    out = (F.abs(z) if both_sides else z) > limit
    return cells.join(F.broadcast(global_stats(cells))).select("row_id", "col_id", F.when(~F.coalesce((F.col("v") > 0) & out, F.lit(False)), F.col("v")).alias("v"))


def mask_non_positive(cells: DataFrame) -> DataFrame:
    """P17."""
    return cells.withColumn("v", F.when(F.col("v") > 0, F.col("v")))


def clean(cells: DataFrame, fill: bool = False) -> DataFrame:
    """Infinite or tiny values become 0; masked ones too if asked."""
    v = F.col("v")
    out = F.when(F.abs(v).isin(float("inf")) | (F.abs(v) < 1e-10), F.lit(0.0)).otherwise(F.nanvl(v, F.lit(None).cast("double")))
    return cells.withColumn("v", F.coalesce(out, F.lit(0.0)) if fill else out)


def good_rows(cells: DataFrame, n_columns: int, share: float = ROW_SHARE) -> DataFrame:
    """Row ids with more than three good cells and at least the share of good ones."""
    n = cells.groupBy("row_id").agg(F.count("v").alias("_n"))
    return n.where((F.col("_n") > MIN_GOOD) & (F.col("_n") >= share * n_columns)).select("row_id")


def drop_bad_rows(cells: DataFrame, n_columns: int, share: float = ROW_SHARE) -> DataFrame:
    """Ids stay as they are; compact() numbers them at export."""
    return cells.join(good_rows(cells, n_columns, share), "row_id", "left_semi")


def drop_bad_columns(cells: DataFrame, n_rows: int, share: float = COLUMN_SHARE) -> DataFrame:
    """The same by column."""
    n = cells.groupBy("col_id").agg(F.count("v").alias("_n"))
    good = n.where((F.col("_n") > MIN_GOOD) & (F.col("_n") >= share * n_rows)).select("col_id")
    return cells.join(F.broadcast(good), "col_id", "left_semi").select("row_id", "col_id", "v")


def compact(bin_map: DataFrame, rows: DataFrame) -> DataFrame:
    """P10: the mapping of the rows that stay, numbered anew in order."""
    return global_rows(bin_map.join(rows, "row_id", "left_semi").drop("row_id"))


def quick_clean(cells: DataFrame, n_columns: int, limit: float = 0.7) -> DataFrame:
    """Rows whose masked share is below the limit."""
    n = cells.groupBy("row_id").agg(F.count("v").alias("_n"))
    return n.where((F.lit(n_columns) - F.col("_n")) / n_columns < limit).select("row_id")


def large_enough(cells: DataFrame) -> bool:
    """P20: more than 10 rows and 2 columns."""
    r = cells.agg(F.countDistinct("row_id").alias("r"), F.countDistinct("col_id").alias("c")).first()
    return r.r > 10 and r.c > 2


def census(cells: DataFrame) -> DataFrame:
    """Masked cells in all, and the most and the mean by row and by column."""
    null = F.when(F.col("v").isNull(), 1).otherwise(0)
    total = cells.agg(F.sum(null).alias("total"))
    rows = cells.groupBy("row_id").agg(F.sum(null).alias("n")).agg(F.max("n").alias("row_max"), F.avg("n").alias("row_mean"))
    columns = cells.groupBy("col_id").agg(F.sum(null).alias("n")).agg(F.max("n").alias("col_max"), F.avg("n").alias("col_mean"))
    return total.join(F.broadcast(rows)).join(F.broadcast(columns))


def transpose(cells: DataFrame) -> DataFrame:
    """F15."""
    return cells.select(F.col("col_id").cast("long").alias("row_id"), F.col("row_id").cast("int").alias("col_id"), "v")


def wide(cells: DataFrame) -> DataFrame:
    """Rows as arrays (row_id, features) over the columns in order; NULL where masked or absent."""
    columns = cells.select("col_id").distinct().select("col_id", (F.row_number().over(Window.orderBy("col_id")) - 1).cast("int").alias("_k"))
    n = columns.agg(F.count(F.lit(1)).cast("int").alias("_n"))
    m = cells.join(F.broadcast(columns), "col_id").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "v"))).alias("_m"))
    return m.join(F.broadcast(n)).select("row_id", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.element_at("_m", k)).alias("features"))


def long(rows: DataFrame) -> DataFrame:
    """Cells of (row_id, features)."""
    return rows.select("row_id", F.posexplode("features").alias("col_id", "v"))


def clamp(cells: DataFrame, low: float, high: float) -> DataFrame:
    """values within [low, high]; masked cells stay masked."""
    return cells.withColumn("v", F.when(F.col("v").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col("v")))))


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """F16: the features of two matrices side by side, for rows that both have."""
    return left.join(right.select("row_id", F.col("features").alias("_g")), "row_id").select("row_id", F.concat("features", "_g").alias("features"))


def combined(parts: list[DataFrame], divisor: float = 1.0) -> DataFrame:
    """element-wise sum of matrices over a divisor; cells that are masked or absent in all of them are NULL or absent."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("row_id", "col_id").agg(F.try_divide(F.sum("v"), F.lit(divisor)).alias("v"))


def extremes(cells: DataFrame) -> DataFrame:
    """least and greatest value."""
    return cells.agg(F.min("v").alias("low"), F.max("v").alias("high"))


def as_floats(cells: DataFrame) -> DataFrame:
    """values in single precision."""
    return cells.withColumn("v", F.col("v").cast("float"))


def preprocess(inter: DataFrame, intra: DataFrame | None, col_weights: DataFrame, n_columns: int, vc: bool = True, log: bool = False, z: bool = True) -> DataFrame:
    """VC norm or division by weights, optional logarithm, column z, intra columns appended, rows with few good cells dropped."""
    out = vanilla_coverage(inter) if vc else divide_by_weights(inter, col_weights)
    out = cut(log_pseudo(out) if log else out)
    out = cut(column_z(out)) if z else out
    if intra is not None:
        out = append_intra(out, intra, n_columns)
        n_columns *= 2
    return drop_bad_rows(out, n_columns)
