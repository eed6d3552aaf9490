"""Quality control of fragments and regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from regionspark.functions.columns import correlation, ratio
from regionspark.functions.lineage import cut
from regionspark.operators import quantify, ranges
from regionspark.operators.running import with_ranks

MITO = ("chrM", "Mt", "MT")
DINUCLEOTIDES = [a + b for a in "ACGT" for b in "ACGT"]


def count_fragments(fragments: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Per barcode: fragments, mononucleosomal (147 < length < 294), nucleosome-free (length < 147) and
    reads. A length of 147 is neither. With a whitelist (barcode), a row for every cell, also at 0."""
    width = F.col("end") - F.col("start")
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    out = fragments.groupBy("barcode").agg(F.count(F.lit(1)).alias("frequency_count"), n((width > 147) & (width < 294)).alias("mononucleosomal"), n(width < 147).alias("nucleosome_free"), F.sum("read_count").alias("reads_count"))
    if cells is None:
        return out
    return cells.select("barcode").distinct().join(out, "barcode", "left").na.fill(0)


def nucleosome_signal(fragments: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """mononucleosomal / nucleosome-free and its rounded ecdf; no nucleosome-free fragments give null,
    and no percentile."""
    n = count_fragments(fragments, cells).withColumn("signal", ratio(F.col("mononucleosomal"), F.col("nucleosome_free")))
    n = cut(n.select("barcode", "signal"))
    ranked = with_ranks(n.filter("signal is not null"), F.col("signal"), ecdf="percentile").withColumn("percentile", F.bround("percentile", 2))
    return ranked.unionByName(n.filter("signal is null").withColumn("percentile", F.lit(None).cast("double")))


def cell_quality(fragments: DataFrame, tss: DataFrame, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """One row for each cell: fragment counts, nucleosome signal and TSS enrichment with their percentiles."""
    rows = count_fragments(fragments, cells)
    signal = nucleosome_signal(fragments, cells).select("barcode", F.col("signal").alias("nucleosome_signal"), F.col("percentile").alias("nucleosome_percentile"))
    named = (cells if cells is not None else fragments.select("barcode").distinct()).select(F.col("barcode").alias("cell_id"), "barcode")
    enrichment = tss_enrichment(fragments, tss, named, bin_size=bin_size).select(F.col("cell_id").alias("barcode"), "tss_enrichment", F.col("percentile").alias("tss_percentile"))
    return rows.join(signal, "barcode").join(enrichment, "barcode", "left")


def cut_sites(fragments: DataFrame) -> DataFrame:
    """Both ends of each fragment as positions, with the end they come from."""
    return fragments.select("chrom", "cell_id", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit("start").alias("side")), F.struct(F.col("end").alias("pos"), F.lit("end").alias("side")))).alias("_x")).select("chrom", "cell_id", "_x.*")


def counted_cuts(rows: DataFrame) -> DataFrame:
    """Cut sites as ranges of one base, each (chrom, start, end, cell_id) once with its number ``n``."""
    return ranges.places(cut_sites(rows).select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), "cell_id"), ("cell_id",))


def tss_enrichment(fragments: DataFrame, tss: DataFrame, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """Mean normalised cut sites within 500 bases of a start site over those at the flanks (the first and
    last 100 of +-1000). A cell without flank cuts gets the mean flank of all cells, zeros included;
    mitochondrial sites are dropped. tss: chrom, start (the site)."""
    rows = quantify.whitelist(fragments, cells)
    window = ranges.places(tss.filter(~F.col("chrom").isin(*MITO)).select("chrom", (F.col("start") - 1000).alias("start"), (F.col("start") + 1000).alias("end")))
    hits = ranges.find_overlaps(counted_cuts(rows), window, bin_size=bin_size).withColumn("_at", F.col("q_start") - F.col("s_start"))
    n = lambda test: F.sum(F.when(test, F.col("q_n") * F.col("s_n")).otherwise(0))
    at = F.col("_at")
    got = hits.groupBy(F.col("q_cell_id").alias("cell_id")).agg(n((at >= 500) & (at <= 1500)).alias("center"), n((at < 100) | (at > 1900)).alias("flank"))
    every = (cells if cells is not None else rows).select("cell_id").distinct().join(got, "cell_id", "left").na.fill(0)
    mean = every.agg((F.avg("flank") / 200).alias("_mean"))
    norm = F.when(F.col("flank") > 0, F.col("flank") / 200).otherwise(F.col("_mean"))
    out = every.crossJoin(F.broadcast(mean))  # one row
    score = F.coalesce(ratio(F.col("center"), norm), F.lit(0.0)) / 1001
    scored = cut(out.select("cell_id", "center", "flank", score.alias("tss_enrichment")))
    return with_ranks(scored, F.col("tss_enrichment"), ecdf="percentile").withColumn("percentile", F.bround("percentile", 2))


def tss_pileup(fragments: DataFrame, tss: DataFrame, cells: DataFrame | None = None, upstream: int = 1000, downstream: int = 1000, bin_size: int = ranges.BIN) -> DataFrame:
    """Cut sites by cell and offset from the site, strand-aware: (cell_id, position, value)."""
    rows = quantify.whitelist(fragments, cells)
    sites = ranges.places(tss.filter(~F.col("chrom").isin(*MITO)).select("chrom", "start", F.col("start").alias("end"), *(["strand"] if "strand" in tss.columns else [F.lit("+").alias("strand")])))
    window = ranges.extend(sites.withColumn("site", F.col("start")), upstream, downstream)
    hits = ranges.find_overlaps(counted_cuts(rows), window, bin_size=bin_size)
    off = F.col("q_start") - F.col("s_site")
    return hits.select(F.col("q_cell_id").alias("cell_id"), F.when(F.col("s_strand") == "-", -off).otherwise(off).alias("position"), (F.col("q_n") * F.col("s_n")).alias("_n")).groupBy("cell_id", "position").agg(F.sum("_n").alias("value"))


def tss_enrichment_full(pileup: DataFrame, upstream: int = 1000) -> DataFrame:
    """Per cell and position over the cell's flank mean; and the mean of the middle 1001 positions."""
    flank = F.abs("position") > upstream - 100
    per = pileup.groupBy("cell_id").agg((F.sum(F.when(flank, F.col("value")).otherwise(0)) / 200).alias("f"), F.sum(F.when(F.abs("position") <= 500, F.col("value")).otherwise(0)).alias("c"))
    mean = per.agg(F.avg("f").alias("_m"))
    out = per.crossJoin(F.broadcast(mean))  # one row
    return out.select("cell_id", F.coalesce(ratio(F.col("c"), F.when(F.col("f") > 0, F.col("f")).otherwise(F.col("_m"))), F.lit(0.0)).alias("_s")).select("cell_id", (F.col("_s") / 1001).alias("tss_enrichment"))


def _count(seq: Column, what: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(what), F.lit("")))) / len(what)


def region_stats(sequences: DataFrame) -> DataFrame:
    """Per feature (feature_id, sequence): length, GC per cent and the counts of the 16 dinucleotides,
    overlapping ones included; no sequence gives nulls."""
    seq = F.upper("sequence")
    gc = ratio(100.0 * (_count(seq, "G") + _count(seq, "C")), F.length(seq))
    rows = sequences.select("feature_id", F.length(seq).cast("long").alias("sequence_length"), gc.alias("gc_percent"), seq.alias("_seq"))
    fields = [f for f in rows.schema.fields if f.name != "_seq"]
    return rows.mapInArrow(_dinucleotides, StructType([*fields, *(StructField(d, LongType()) for d in DINUCLEOTIDES)]))


def letters(text) -> np.ndarray:
    """A, C, G, T of a string in Arrow as 0 to 3, each other byte as 4."""
    return _LETTER[np.frombuffer(text.as_buffer(), np.uint8)]


_LETTER = np.full(256, 4, np.uint8)
_LETTER[[ord(c) for c in "ACGT"]] = range(4)


def _dinucleotides(batches):
    import pyarrow as pa

    piece = 1 << 20
    for batch in batches:
        seq = batch.column(batch.num_columns - 1)
        n = np.zeros((len(seq), 25), np.int64)
        for r, text in enumerate(seq):
            if text.is_valid:
                code = letters(text)
                for at in range(0, len(code) - 1, piece):
                    x = code[at : at + piece + 1]
                    n[r] += np.bincount(x[:-1] * 5 + x[1:], minlength=25)
        none = seq.is_null().to_numpy(zero_copy_only=False)
        counts = [pa.array(n[:, a * 5 + b], mask=none) for a in range(4) for b in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*batch.schema.names[:-1], *DINUCLEOTIDES])


def depth_correlation(embeddings: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """Pearson correlation of each component (embedding array) with n_count."""
    x = embeddings.join(cells.select("cell_id", "n_count"), "cell_id").select("n_count", F.posexplode("embedding").alias("component", "x"))
    return x.filter(F.col("component") < n).groupBy((F.col("component") + 1).alias("component")).agg(correlation(F.col("x"), F.col("n_count")).alias("correlation"))


def fragment_histogram(fragments: DataFrame, groups: DataFrame | None = None, bins: int = 200, lo: int = 0, hi: int = 800) -> DataFrame:
    """Fragments by group and length bin within [lo, hi]."""
    rows = fragments.withColumn("_w", F.col("end") - F.col("start")).filter(F.col("_w").between(lo, hi))
    rows = rows.withColumn("grp", F.lit("all")) if groups is None else rows.join(groups.select("barcode", "grp"), "barcode")
    b = F.least(F.floor((F.col("_w") - lo) * bins / (hi - lo)), F.lit(bins - 1))
    return rows.groupBy("grp", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_scatter(points: DataFrame, grid: int = 1000, bandwidth: float = 1.0) -> DataFrame:
    """Gaussian kernel density of each (x, y) on a grid, from counts by grid cell: the table that meets
    in one task has grid^2 rows at most."""
    b = points.agg(*(f(c).cast("double").alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy")).first()
    if b[0] is None:
        return points.withColumn("density", F.lit(None).cast("double"))
    lo, hi = np.array([b[0], b[1]]), np.array([b[2], b[3]])
    step = np.maximum((hi - lo) / (grid - 1), 1e-12)
    cell = [F.floor((F.col(c) - float(lo[i])) / float(step[i]) + 0.5).cast("int") for i, c in enumerate("xy")]
    placed = points.withColumns({"_i": cell[0], "_j": cell[1]})
    counted = placed.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("n")).toPandas()
    h = np.zeros((grid, grid))
    h[counted["_i"], counted["_j"]] = counted["n"]
    for axis in (0, 1):
        d = np.arange(grid) * step[axis]
        k = np.exp(-0.5 * ((d[:, None] - d[None, :]) / bandwidth) ** 2) / (bandwidth * np.sqrt(2 * np.pi))
        h = k @ h if axis == 0 else h @ k
    h /= max(counted["n"].sum(), 1)
    at = list(zip(counted["_i"].tolist(), counted["_j"].tolist(), strict=True))
    table = points.sparkSession.createDataFrame([(i, j, float(h[i, j])) for i, j in at], "_i int, _j int, density double")
    return placed.join(F.broadcast(table), ["_i", "_j"]).drop("_i", "_j")  # grid^2 rows at most
