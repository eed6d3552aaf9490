"""The tables that browser tracks and plots are drawn from. Drawing itself is out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionspark.functions.columns import ratio
from regionspark.functions.lineage import cut
from regionspark.operators import footprint, ranges


def rolling(df: DataFrame, value: str, by: list[str], position: str, n: int = 100, how: str = "sum", fill: float | None = None) -> DataFrame:
    """Centred rolling sum or mean over n rows (49 before, 50 after for n = 100); incomplete frames are
    dropped, or get ``fill``."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(-((n - 1) // 2), n // 2)
    agg = F.sum(value) if how == "sum" else F.avg(value)
    out = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("rolled", F.when(F.col("_n") == n, agg.over(w)))
    return out.filter("rolled is not null").drop("_n") if fill is None else out.withColumn("rolled", F.coalesce("rolled", F.lit(fill))).drop("_n")


def tumbling(df: DataFrame, value: str, by: list[str], position: str, width: int, total: int) -> DataFrame:
    """Sums of ``width`` positions each, from position 1; the last, partial bin is dropped."""
    b = F.floor((F.col(position) - 1) / width)
    return df.filter(F.col(position) <= total // width * width).groupBy(*by, b.alias("bin")).agg(F.sum(value).alias("value"))


def round_significant(x: Column, digits: int = 2) -> Column:
    k = F.floor(F.log10(F.abs(x))) - (digits - 1)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / F.pow(F.lit(10.0), k)) * F.pow(F.lit(10.0), k))


def coverage_track(fragments: DataFrame, region: tuple[str, int, int], cells: DataFrame, window: int = 100, downsample: float = 0.1, max_points: int = 3000, ymax: float | str | None = None, seed: int = 1234) -> DataFrame:
    """Normalised rolling coverage of one region by group: (grp, position, coverage, ymax). cells:
    cell_id, barcode, grp, n_count. The region filter reaches the scan. ymax ``qNN``: NN per cent of the
    maximum of the track, not a quantile."""
    chrom, start, end = region
    near = fragments.filter((F.col("chrom") == chrom) & (F.col("start") <= end + 1) & (F.col("end") >= start))
    spark = fragments.sparkSession
    one = spark.createDataFrame([(0, chrom, start, end)], "region_id int, chrom string, start long, end long")
    cuts = footprint.cut_matrix(near, one, cells)
    scales = footprint.group_scales(cells)
    pile = footprint.by_group(cuts.select("cell_id", "position", "value"), cells, scales)
    width = end - start + 1
    grid = scales.select("grp", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(width).cast("long"))).alias("position"))
    dense = grid.join(pile, ["grp", "position"], "left").select("grp", "position", F.coalesce("norm", F.lit(0.0)).alias("norm"))
    rolled = rolling(dense, "norm", ["grp"], "position", window).select("grp", (F.col("position") + start - 1).alias("position"), F.col("rolled").alias("coverage"))
    n = min(max_points, int(width * downsample))
    pick = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("grp", "position", F.lit(seed)), "position"))
    kept = rolled.withColumn("_r", pick).filter(F.col("_r") <= n).drop("_r")
    top = round_significant(F.max("coverage").over(Window.partitionBy()))
    if isinstance(ymax, str):
        top = top * int(ymax[1:]) / 100
    elif ymax is not None:
        top = F.lit(float(ymax))
    out = kept.withColumn("ymax", top)
    return out.withColumn("coverage", F.least("coverage", "ymax"))


def tile_plot(fragments: DataFrame, region: tuple[str, int, int], cells: DataFrame, tile: int = 100, top_cells: int = 100) -> DataFrame:
    """Cut sites by tile of the cells with most of them, per group: (grp, cell_id, bin, value)."""
    chrom, start, end = region
    one = fragments.sparkSession.createDataFrame([(0, chrom, start, end)], "region_id int, chrom string, start long, end long")
    near = fragments.filter((F.col("chrom") == chrom) & (F.col("start") <= end + 1) & (F.col("end") >= start))
    cuts = footprint.cut_matrix(near, one, cells).select("cell_id", "position", "value")
    total = cells.select("cell_id", "grp").join(cuts.groupBy("cell_id").agg(F.sum("value").alias("_t")), "cell_id", "left").na.fill(0, ["_t"])
    best = total.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("_t"), "cell_id"))).filter(F.col("_r") <= top_cells).select("cell_id", "grp")
    return tumbling(cuts.join(best, "cell_id"), "value", ["grp", "cell_id"], "position", tile, end - start + 1)


def peak_track(peaks: DataFrame, region: tuple[str, int, int]) -> DataFrame:
    """Peaks that overlap the region, clipped to it."""
    chrom, start, end = region
    p = peaks.filter((F.col("chrom") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
    return p.withColumns({"start": F.greatest(F.lit(start), F.col("start")), "end": F.least(F.lit(end), F.col("end"))})


def link_track(links: DataFrame, region: tuple[str, int, int], min_abs_score: float = 0.0, points: int = 0) -> DataFrame:
    """Links wholly inside the region; with points, each as a quadratic curve of so many points."""
    chrom, start, end = region
    x = links.filter((F.col("chrom") == chrom) & (F.col("start") >= start) & (F.col("end") <= end) & (F.abs("score") > min_abs_score))
    if not points:
        return x
    t = F.col("_i") / float(points - 1)
    mid = (F.col("start") + F.col("end")) / 2
    x = x.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return x.withColumns({"x": (1 - t) * (1 - t) * F.col("start") + 2 * t * (1 - t) * mid + t * t * F.col("end"), "y": -2 * t * (1 - t)}).drop("_i")


def annotation_track(annotation: DataFrame, region: tuple[str, int, int], gap: int = 1000) -> DataFrame:
    """Rows of genes that overlap the region, each with its gene's span and lane: genes whose spans,
    merged with ``gap`` bases between, don't meet share a lane."""
    chrom, start, end = region
    rows = annotation.filter((F.col("chrom") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
    genes = rows.groupBy("chrom", "gene_name").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wide = genes.withColumns({"id": F.xxhash64("gene_name"), "_end": F.col("end"), "end": F.col("end") + gap})
    lanes = ranges.disjoint_bins(wide).select(F.col("gene_name").alias("_gene"), F.col("start").alias("gene_start"), F.col("_end").alias("gene_end"), F.col("bin").alias("lane"))
    return rows.join(lanes, rows.gene_name == lanes._gene).drop("_gene")


def expression_plot(expression: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """(gene, grp, cell_id, expression) of all cells, zeros included."""
    spark = expression.sparkSession
    g = spark.createDataFrame([(x,) for x in genes], "gene string")
    grid = cells.select("cell_id", "grp").crossJoin(F.broadcast(g))  # the genes that are named
    return grid.join(expression.filter(F.col("gene").isin(*genes)), ["gene", "cell_id"], "left").select("gene", "grp", "cell_id", F.coalesce("value", F.lit(0.0)).alias("expression"))


def signal_track(scores: DataFrame, region: tuple[str, int, int], n: int = 200, smooth: str = "mean", bin_width: int = 100) -> DataFrame:
    """A signal (chrom, start, end, score: bedGraph runs) by base, smoothed by a rolling mean (edges 0) or
    averaged by bins."""
    chrom, start, end = region
    s = scores.filter((F.col("chrom") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
    base = s.select(F.explode(F.sequence(F.greatest(F.lit(start), F.col("start")), F.least(F.lit(end), F.col("end")))).alias("position"), "score")
    grid = scores.sparkSession.range(start, end + 1).select(F.col("id").alias("position"), F.lit(chrom).alias("chrom"))
    dense = grid.join(base, "position", "left").na.fill(0, ["score"])
    if smooth == "mean":
        return rolling(dense, "score", ["chrom"], "position", n, "mean", 0.0).select("position", F.col("rolled").alias("score"))
    return dense.groupBy((F.floor((F.col("position") - start) / bin_width) * bin_width + start).alias("position")).agg(F.avg("score").alias("score"))


def region_heatmap(matrix: DataFrame, scales: DataFrame, window: int, total: int, min_counts: float = 1, max_quantile: float | None = None) -> DataFrame:
    """Tumbling sums of a region matrix (grp, region_id, position, value) per cell (grp, n_cells), regions
    below min_counts dropped, values capped at a quantile of the group."""
    rows = matrix.join(matrix.groupBy("region_id").agg(F.sum("value").alias("_t")).filter(F.col("_t") >= min_counts).select("region_id"), "region_id", "left_semi")
    t = tumbling(rows, "value", ["grp", "region_id"], "position", window, total).join(scales, "grp").select("grp", "region_id", "bin", ratio(F.col("value"), F.col("n_cells")).alias("value"))
    if max_quantile is None:
        return t
    q = t.groupBy("grp").agg(F.percentile("value", max_quantile).alias("_q"))
    return t.join(q, "grp").select("grp", "region_id", "bin", F.least("value", "_q").alias("value"))


def region_plot(matrix: DataFrame, scales: DataFrame, window: int, total: int, weights: DataFrame | None = None) -> DataFrame:
    """Mean over regions per group and bin. weights (region_id, n): a region of the matrix stands for n."""
    matrix = cut(matrix)
    h, found = region_heatmap(matrix, scales, window, total, 0), matrix.select("region_id").distinct()
    if weights is None:
        n, value = found.count(), F.col("value")
    else:
        w = weights.select("region_id", F.col("n").alias("_w"))
        n, value, h = found.join(w, "region_id").agg(F.sum("_w")).first()[0], F.col("value") * F.col("_w"), h.join(w, "region_id")
    return h.groupBy("grp", "bin").agg((F.sum(value) / n).alias("mean"))


def footprint_plot(data: DataFrame, how: str = "subtract") -> DataFrame:
    """Footprints less, or over, what is expected."""
    x = F.col("norm") - F.col("expected") if how == "subtract" else ratio(F.col("norm"), F.col("expected"))
    return data.withColumn("norm", x)


def tss_plot(pile: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean normalised pileup by group and position."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    s = pile.join(groups.select("cell_id", "grp"), "cell_id").groupBy("grp", "position").agg(F.sum("value").alias("_s"))
    return s.join(n, "grp").select("grp", "position", (F.col("_s") / F.col("_n")).alias("mean"))
