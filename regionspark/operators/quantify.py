"""Counting fragments over regions, tiles and genes; sparse matrices are (feature_id, cell_id, value).

Fragments are BED rows, 0-based and half open: ``[start, end)`` overlaps a closed region ``[a, b]`` if
start < b + 0 and end >= a, read as start + 1 <= b and end >= a. Each fragment counts once for each
region that it overlaps, whatever its read count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from regionspark.functions.columns import ratio
from regionspark.operators import ranges


def as_ranges(fragments: DataFrame) -> DataFrame:
    """Fragments as closed, 1-based ranges."""
    return fragments.withColumn("start", F.col("start") + 1)


def whitelist(fragments: DataFrame, cells: DataFrame | None) -> DataFrame:
    """Fragments of the cells in cellmap (cell_id, barcode), with their cell_id; all if there is none."""
    if cells is None:
        return fragments.withColumn("cell_id", F.col("barcode").cast("string"))
    return fragments.join(cells.select("cell_id", "barcode"), "barcode")


def feature_matrix(fragments: DataFrame | Sequence[DataFrame], features: DataFrame, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """Counts of fragments by feature (feature_id, chrom, start, end) and cell, over one or more files."""
    files = [fragments] if isinstance(fragments, DataFrame) else list(fragments)
    rows = whitelist(files[0], cells)
    for f in files[1:]:
        rows = rows.unionByName(whitelist(f, cells))
    pairs = ranges.find_overlaps(as_ranges(rows.select("chrom", "start", "end", "cell_id")), features.select("chrom", "start", "end", "feature_id"), bin_size=bin_size)
    return pairs.groupBy(F.col("s_feature_id").alias("feature_id"), F.col("q_cell_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("value"))


def wide_feature_matrix(fragments: DataFrame, features: DataFrame, cells: DataFrame | None = None, most: int = 200_000) -> DataFrame:
    """``feature_matrix`` for features that meet many fragments each, so that nearly each pair is a row of the
    result: fragments are dealt by cell and counted there, and no pair is shuffled. The features are counted
    and dealt out in blocks of about ``most``; each block goes to all tasks, in a pass of its own over the
    fragments. One cell's fragments must fit a task."""
    ids = features.select("feature_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    span = ids.groupBy(F.col("chrom").alias("_c")).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    rows = whitelist(fragments, cells).select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "cell_id")
    rows = rows.join(span, (F.col("chrom") == F.col("_c")) & (F.col("start") < F.col("_hi")) & (F.col("end") >= F.col("_lo")), "left_semi")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "cell_id").sortWithinPartitions("cell_id")
    n, repeated = ids.groupBy("feature_id").agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n") > 1, F.lit(False))).first()
    passes = max(1, -(-n // most))
    key = StructType([StructField("feature_id", ids.schema["feature_id"].dataType), StructField("cell_id", rows.schema["cell_id"].dataType), StructField("value", LongType())])
    out = []
    for i in range(passes):
        own = ids if passes == 1 else ids.filter(F.pmod(F.xxhash64("feature_id"), F.lit(passes)) == i)
        out.append(dealt.mapInArrow(_count_by_cell(own.toArrow()), key))
    both = reduce(DataFrame.unionByName, out)
    return both.groupBy("feature_id", "cell_id").agg(F.sum("value").alias("value")) if repeated else both


def _count_by_cell(features, rows_at_once: int = 4096, pairs_at_once: int = 1 << 21):
    """A function for mapInArrow over fragments in order of cell: (feature_id, cell_id, value)."""
    import numpy as np
    import pyarrow as pa

    number = lambda x: x.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(x, pa.ChunkedArray) else x.to_numpy(zero_copy_only=False)
    flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    by_chrom = {}
    chroms = np.asarray(features["chrom"].to_pylist(), dtype=object)
    for chrom in set(chroms.tolist()):
        at = np.flatnonzero(chroms == chrom)
        own = features.take(pa.array(at)).sort_by([("start", "ascending"), ("end", "ascending")])
        by_chrom[chrom] = (flat(own["feature_id"]), number(own["start"]), number(own["end"]))

    def count(table, code):
        chrom = np.asarray(table["chrom"].to_pylist(), dtype=object)
        start, end, cells = number(table["start"]), number(table["end"]), flat(table["cell_id"])
        for c in dict.fromkeys(chrom.tolist()):
            if c not in by_chrom:
                continue
            name, a, b = by_chrom[c]
            at = np.flatnonzero(chrom == c)
            s, e, k = start[at], end[at], code[at]
            near = np.flatnonzero((a <= e.max()) & (b > s.min()))
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            step = max(1, pairs_at_once // len(at))
            for f in (near[i : i + step] for i in range(0, len(near), step)):
                met = ((s[:, None] < b[f]) & (e[:, None] >= a[f])).view(np.int8)
                n = np.add.reduceat(met, first, axis=0, dtype=np.int64)
                row, col = np.nonzero(n)
                if len(row):
                    yield pa.RecordBatch.from_arrays([name.take(pa.array(f[col])), cells.take(pa.array(at[first[row]])), pa.array(n[row, col])], ["feature_id", "cell_id", "value"])

    def run(batches):
        held, n = [], 0
        for batch in batches_or_end(batches):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
                if n < rows_at_once:
                    continue
            if not n:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            code = flat(flat(table["cell_id"]).dictionary_encode(null_encoding="encode")).indices.to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(code[1:] != code[:-1]) + 1  # where the next cell begins
            upto = n if batch is None else int(ends[-1]) if len(ends) else 0
            at = 0
            while at < upto:
                cut = ends[(ends > at) & (ends <= min(at + rows_at_once, upto))]
                to = int(cut[-1]) if len(cut) else int(min(ends[ends > at][0] if (ends > at).any() else upto, upto))
                to = upto if upto - at <= rows_at_once else to
                yield from count(table.slice(at, to - at), code[at:to])
                at = to
            held, n = (table.slice(upto).to_batches(), n - upto) if upto < n else ([], 0)

    def batches_or_end(batches):
        yield from batches
        yield None

    return run


def known_features(features: DataFrame, fragments: DataFrame, keep_all: bool = False) -> DataFrame:
    """Features on chromosomes that the fragments have; all if keep_all."""
    return features if keep_all else features.join(fragments.select("chrom").distinct(), "chrom", "left_semi")


def bin_matrix(fragments: DataFrame, width: int = 5000, cells: DataFrame | None = None) -> DataFrame:
    """Counts by tile (chrom, tile) and cell: tile numbers are arithmetic, no join is needed."""
    rows = whitelist(fragments, cells)
    tile = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    return rows.select("chrom", tile.alias("tile"), "cell_id").groupBy("chrom", "tile", "cell_id").agg(F.count(F.lit(1)).alias("value"))


def aggregate_tiles(fragments: DataFrame, width: int = 5000, min_counts: int = 5, cells: DataFrame | None = None) -> DataFrame:
    """Tiles with more than min_counts fragments, neighbouring tiles joined and their counts summed - a
    fragment across two joined tiles counts twice. Columns chrom, start, end, cell_id, value."""
    bins = bin_matrix(fragments, width, cells)
    kept = bins.groupBy("chrom", "tile").agg(F.sum("value").alias("_total")).filter(F.col("_total") > min_counts)
    tiles = kept.select("chrom", (F.col("tile") * width + 1).alias("start"), ((F.col("tile") + 1) * width).alias("end"), "tile")
    joined = ranges._islands(tiles, ["chrom"], 1)
    span = joined.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    of = joined.select("chrom", "tile", "_island").join(span, ["chrom", "_island"])
    return bins.join(of, ["chrom", "tile"]).groupBy("chrom", "start", "end", "cell_id").agg(F.sum("value").alias("value"))


def gene_spans(annotation: DataFrame) -> DataFrame:
    """Per gene_id: span, strand (``*`` as ``+``), biotype and a name made unique by suffixes."""
    from pyspark.sql import Window

    first = lambda c: F.min_by(c, F.struct("start", "end", "tx_id"))
    g = annotation.groupBy("gene_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), first("strand").alias("strand"), first("gene_biotype").alias("gene_biotype"), first("gene_name").alias("gene_name"))
    n = F.row_number().over(Window.partitionBy("gene_name").orderBy("chrom", "start", "gene_id")) - 1
    g = g.withColumn("strand", F.when(F.col("strand") == "*", "+").otherwise(F.col("strand")))
    return g.withColumn("_n", n).withColumn("gene_name", F.when(F.col("_n") == 0, F.col("gene_name")).otherwise(F.concat_ws(".", "gene_name", F.col("_n").cast("string")))).drop("_n")


def gene_activity(fragments: DataFrame, annotation: DataFrame, biotypes: Sequence[str] | None = ("protein_coding",), max_width: int | None = 500_000, upstream: int = 2000, downstream: int = 0, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """Fragments by gene (gene_name, cell_id, value) over spans extended upstream; genes without a name
    go by their id, genes as wide as max_width or wider are left out. No join by bins is made, so that
    ``bin_size`` changes nothing."""
    named = annotation.withColumn("gene_name", F.coalesce(F.when(F.col("gene_name") != "", F.col("gene_name")), F.col("gene_id")))
    genes = gene_spans(named)
    if biotypes is not None:
        genes = genes.filter(F.col("gene_biotype").isin(*biotypes))
    if max_width is not None:
        genes = genes.filter(F.col("end") - F.col("start") + 1 < max_width)
    regions = ranges.extend(genes, upstream, downstream).select(F.col("gene_name").alias("feature_id"), "chrom", "start", "end").filter("feature_id is not null and feature_id <> ''")
    return wide_feature_matrix(fragments, regions, cells).withColumnRenamed("feature_id", "gene_name")


def motif_counts(fragments: DataFrame, positions: DataFrame, flank: int = 1000, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """Fragments by motif and cell over positions (motif_id, chrom, start, end) widened to flank."""
    half = flank // 2
    wide = ranges.extend(positions, half, half, from_midpoint=True)
    with_id = wide.select(F.col("motif_id").alias("feature_id"), "chrom", "start", "end")
    return feature_matrix(fragments, with_id, cells, bin_size).withColumnRenamed("feature_id", "motif_id")


def counts_in_region(counts: DataFrame, features: DataFrame, regions: DataFrame, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """Per cell: counts of features that overlap regions, added once for each hit; zeros for all cells."""
    hits = ranges.find_overlaps(features.select("feature_id", "chrom", "start", "end"), regions.select("chrom", "start", "end"), bin_size=bin_size)
    n = hits.groupBy(F.col("q_feature_id").alias("feature_id")).agg(F.count(F.lit(1)).alias("_hits"))
    got = counts.join(n, "feature_id").groupBy("cell_id").agg(F.sum(F.col("value") * F.col("_hits")).alias("_in"))
    every = cells.select("cell_id") if cells is not None else counts.select("cell_id").distinct()
    return every.join(got, "cell_id", "left").select("cell_id", F.coalesce("_in", F.lit(0)).alias("in_region"))


def fraction_in_region(counts: DataFrame, features: DataFrame, regions: DataFrame, bin_size: int = ranges.BIN) -> DataFrame:
    total = counts.groupBy("cell_id").agg(F.sum("value").alias("total"))
    inside = counts_in_region(counts, features, regions, total, bin_size)
    return inside.join(total, "cell_id").select("cell_id", "in_region", "total", ratio(F.col("in_region"), F.col("total")).alias("fraction"))


def frip(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Fraction of each cell's fragments (cell_id, fragments) that lie in peaks."""
    inside = counts.groupBy("cell_id").agg(F.sum("value").alias("in_peaks"))
    return totals.join(inside, "cell_id", "left").select("cell_id", ratio(F.coalesce("in_peaks", F.lit(0)), F.col("fragments")).alias("frip"))


def merge_overlapping(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Sum the rows of features that reduce to one range. Columns chrom, start, end, cell_id, value."""
    at = F.struct("chrom", "start", "end").alias("_at")  # features at one place are merged as one
    joined = ranges._islands(features.select("chrom", "start", "end").distinct(), ["chrom"], 1).select("chrom", "start", "end", "_island", at)
    span = joined.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    place = joined.select("chrom", "_island", "_at").join(span, ["chrom", "_island"]).select("_at", "chrom", "start", "end")
    of = features.select("feature_id", at).join(place, "_at").select("feature_id", "chrom", "start", "end")
    return counts.join(of, "feature_id").groupBy("chrom", "start", "end", "cell_id").agg(F.sum("value").alias("value"))
