"""Links between peaks and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionspark.functions.columns import parse_range, ratio
from regionspark.operators import linalg, ranges, stats


def linked_genes(links: DataFrame, peaks: DataFrame, min_abs_score: float = 0.0) -> DataFrame:
    return links.filter(F.abs("score") > min_abs_score).join(peaks.select("peak"), "peak", "left_semi").select("gene").distinct()


def linked_peaks(links: DataFrame, genes: DataFrame, min_abs_score: float = 0.0) -> DataFrame:
    return links.filter(F.abs("score") > min_abs_score).join(genes.select("gene"), "gene", "left_semi").select("peak").distinct()


def connections_to_links(connections: DataFrame, groups: DataFrame | None = None, threshold: float = 0.0, sep=("-", "-")) -> DataFrame:
    """Links from (peak1, peak2, coaccess): on one chromosome, above the threshold, from midpoint to
    midpoint; group: of the first peak, else of the second (groups: peak, ccan)."""
    c = connections.filter(F.col("coaccess") > threshold).withColumns({"_a": parse_range(F.col("peak1"), sep), "_b": parse_range(F.col("peak2"), sep)}).filter("_a.chrom = _b.chrom")
    mid = lambda x: (F.col(f"{x}.start") + F.col(f"{x}.end")) / 2
    group = F.lit(None).cast("string")
    if groups is not None:
        for i in (1, 2):
            c = c.join(groups.select(F.col("peak").alias(f"_p{i}"), F.col("ccan").alias(f"_g{i}")), F.col(f"peak{i}") == F.col(f"_p{i}"), "left")
        group = F.coalesce("_g1", "_g2")
    return c.select(F.col("_a.chrom").alias("chrom"), F.least(mid("_a"), mid("_b")).alias("start"), F.greatest(mid("_a"), mid("_b")).alias("end"), F.col("coaccess").alias("score"), group.alias("grp"))


def distance_pairs(peaks: DataFrame, genes: DataFrame, distance: int = 500_000, min_distance: int | None = None, bin_size: int | None = None) -> DataFrame:
    """(feature_id, gene): peaks within the distance of a gene's start site and not within the smaller one."""
    tss = ranges.resize_tss(genes)
    def within(d):
        wide = ranges.extend(tss, d, d).select("gene", "chrom", "start", "end")
        return ranges.find_overlaps(peaks.select("feature_id", "chrom", "start", "end"), wide, bin_size=bin_size or max(1 << 10, 1 << (2 * d).bit_length())).select(F.col("q_feature_id").alias("feature_id"), F.col("s_gene").alias("gene")).distinct()

    out = within(distance)
    return out if min_distance is None else out.join(within(min_distance), ["feature_id", "gene"], "left_anti")


def pair_correlation(pairs: DataFrame, peaks: DataFrame, genes: DataFrame, n_cells: int, method: str = "pearson") -> DataFrame:
    """(feature_id, gene, score) of the stated pairs. Sparse rows: peaks (feature_id, cell_id, value),
    genes (gene, cell_id, value); zeros count."""
    if method == "spearman":
        peaks, genes = linalg.sparse_ranks(peaks, n_cells), linalg.sparse_ranks(genes, n_cells, "gene")
    stat = lambda d, k: d.groupBy(k).agg(F.sum("value").alias(f"s_{k}"), F.sum(F.col("value") * F.col("value")).alias(f"q_{k}"))
    xy = pairs.join(peaks.withColumnRenamed("value", "_x"), "feature_id").join(genes.withColumnRenamed("value", "_y"), ["gene", "cell_id"]).groupBy("feature_id", "gene").agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"))
    out = pairs.join(xy, ["feature_id", "gene"], "left").join(stat(peaks, "feature_id"), "feature_id").join(stat(genes, "gene"), "gene")
    n = float(n_cells)
    cov = F.coalesce("xy", F.lit(0.0)) - F.col("s_feature_id") * F.col("s_gene") / n
    var = lambda k: F.greatest(F.lit(0.0), F.col(f"q_{k}") - F.col(f"s_{k}") * F.col(f"s_{k}") / n)
    return out.select("feature_id", "gene", ratio(cov, F.sqrt(var("feature_id") * var("gene"))).alias("score"))


def background_peaks(pairs: DataFrame, features: DataFrame, n: int = 200, bins: int = 10, seed: int = 1234) -> DataFrame:
    """For each peak of ``pairs``, n peaks of other chromosomes like it in GC, count and length: from the
    same cell of a grid of quantile bins, by a seeded hash. A grid cell is cut to its first rows of each
    chromosome before the join, so no cell's pairs are all made.

    features: feature_id, chrom, gc_percent, count, sequence_length."""
    cut = features
    for c in ("gc_percent", "count", "sequence_length"):
        q = (cut.select(F.percentile_approx(c, [i / bins for i in range(1, bins)])).first()[0] or []) if bins > 1 else []
        cut = cut.withColumn(f"_{c}", sum((F.when(F.col(c) > v, 1).otherwise(0) for v in q), F.lit(0)))
    key = ["_gc_percent", "_count", "_sequence_length"]
    order = [F.xxhash64("feature_id", F.lit(seed)), F.col("feature_id")]
    pool = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "chrom").orderBy(*order))).filter(F.col("_n") <= n)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_n", *order))
    # n rows of other chromosomes are among the first n + n rows of the cell
    pool = pool.withColumn("_m", rank).filter(F.col("_m") <= 2 * n).select(*key, F.col("feature_id").alias("background_id"), F.col("chrom").alias("_c"), "_m")
    own = pairs.select("feature_id").distinct().join(cut, "feature_id").select("feature_id", "chrom", *key)
    got = own.join(pool, key).filter("chrom <> _c")
    return got.withColumn("_i", F.row_number().over(Window.partitionBy("feature_id").orderBy("_m"))).filter(F.col("_i") <= n).select("feature_id", "background_id")


def link_peaks(peaks: DataFrame, genes: DataFrame, features: DataFrame, gene_ranges: DataFrame, n_cells: int, distance: int = 500_000, min_distance: int | None = None, min_cells: int = 10, method: str = "pearson", n_sample: int = 200, pvalue_cutoff: float = 0.05, score_cutoff: float = 0.05, seed: int = 1234, bins: int = 10) -> DataFrame:
    """Peaks linked to genes: correlated beyond what matched peaks of other chromosomes are. Columns
    chrom, start, end, score, gene, peak, zscore, pvalue; a link runs from start site to peak midpoint.
    Genes with fewer than two peaks in range are left out; the test is one-sided on -|z|."""
    seen = lambda d, k: d.filter("value <> 0").groupBy(k).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_cells).select(k)
    peaks, genes = peaks.join(seen(peaks, "feature_id"), "feature_id", "left_semi"), genes.join(seen(genes, "gene"), "gene", "left_semi")
    features = features.join(peaks.select("feature_id").distinct(), "feature_id", "left_semi")
    pairs = distance_pairs(features, gene_ranges.join(genes.select("gene").distinct(), "gene", "left_semi"), distance, min_distance)
    pairs = pairs.join(pairs.groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("gene"), "gene", "left_semi")
    scored = pair_correlation(pairs, peaks, genes, n_cells, method).filter(F.abs("score") > score_cutoff)
    back = scored.select("feature_id", "gene").join(background_peaks(scored, features, n_sample, bins, seed), "feature_id")
    b = pair_correlation(back.select(F.col("background_id").alias("feature_id"), "gene").distinct(), peaks, genes, n_cells, method).withColumnsRenamed({"feature_id": "background_id", "score": "_b"})
    null = back.join(b, ["background_id", "gene"]).groupBy("feature_id", "gene").agg(F.avg("_b").alias("_mean"), F.stddev_samp("_b").alias("_sd"))
    z = ratio(F.col("score") - F.col("_mean"), F.col("_sd"))
    out = scored.join(null, ["feature_id", "gene"]).withColumn("zscore", z).withColumn("pvalue", stats.normal_tail(-F.abs("zscore"))).filter(F.col("pvalue") < pvalue_cutoff)
    tss = ranges.resize_tss(gene_ranges).select("gene", F.col("start").alias("_tss"))
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    out = out.join(features.select("feature_id", "chrom", "start", "end"), "feature_id").join(tss, "gene")
    return out.select("chrom", F.least("_tss", mid).alias("start"), F.greatest("_tss", mid).alias("end"), "score", "gene", F.col("feature_id").alias("peak"), "zscore", "pvalue")
