"""Base-resolution pileups: cut matrices, region matrices, Tn5 bias and footprints."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionspark.functions.columns import ratio
from regionspark.operators import quantify, ranges
from regionspark.operators.qc import counted_cuts, letters


def cut_matrix(fragments: DataFrame, regions: DataFrame, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """Cut sites by region (region_id, chrom, start, end), cell and position: both fragment ends, position
    = coordinate - (start + 1), kept if 0 < position <= width."""
    strand = [F.col("s_strand").alias("strand")] if "strand" in regions.columns else []
    keys = [F.col("s_region_id").alias("region_id"), F.col("q_cell_id").alias("cell_id"), "position", (F.col("s_last") - F.col("s_first") + 1).alias("width"), *strand]
    return _cut_hits(fragments, regions, cells, bin_size).groupBy(*keys).agg(F.sum("q_n").alias("value"))


def _cut_hits(fragments: DataFrame, regions: DataFrame, cells: DataFrame | None, bin_size: int) -> DataFrame:
    """Counted cut sites (``q_n``) inside regions, with their position."""
    wide = regions.withColumns({"first": F.col("start"), "last": F.col("end"), "end": F.col("end") + 2})
    hits = ranges.find_overlaps(counted_cuts(quantify.whitelist(fragments, cells)), wide, bin_size=bin_size).withColumn("position", F.col("q_start") - F.col("s_first") - 1)
    return hits.filter((F.col("position") > 0) & (F.col("position") <= F.col("s_last") - F.col("s_first") + 1))


def region_pileup(fragments: DataFrame, regions: DataFrame, cells: DataFrame | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """``pileup`` of the cut matrix of regions of one width (chrom, start, end, strand if there is one), which
    is not made: regions at one place are joined once, and weigh as many as they are."""
    hits = _cut_hits(fragments, ranges.places(regions), cells, bin_size)
    strand = [F.col("s_strand").alias("strand")] if "strand" in regions.columns else []
    return pileup(hits.select(F.col("q_cell_id").alias("cell_id"), "position", (F.col("s_last") - F.col("s_first") + 1).alias("width"), (F.col("q_n") * F.col("s_n")).alias("value"), *strand))


def pileup(cuts: DataFrame) -> DataFrame:
    """Sum over regions of one width, minus strands reversed; positions are labelled from the centre
    (1..w minus round(w / 2), half to even)."""
    p = F.when(F.col("strand") == "-", F.col("width") + 1 - F.col("position")).otherwise(F.col("position")) if "strand" in cuts.columns else F.col("position")
    return cuts.groupBy("cell_id", (p - F.bround(F.col("width") / 2)).cast("long").alias("position")).agg(F.sum("value").alias("value"))


def by_group(pile: DataFrame, groups: DataFrame, scales: DataFrame | None = None, scale: float | None = None) -> DataFrame:
    """(grp, position, count, norm) from cells' pileups and groups (cell_id, grp); norm = count / the
    group's scale (grp, group_scale) times ``scale``, by default their median."""
    out = pile.join(groups.select("cell_id", "grp"), "cell_id").groupBy("grp", "position").agg(F.sum("value").alias("count"))
    if scales is None:
        return out.withColumn("norm", F.col("count").cast("double"))
    mid = scales.agg(F.percentile("group_scale", 0.5).alias("_mid")) if scale is None else scales.sparkSession.createDataFrame([(float(scale),)], "_mid double")
    s = scales.select(F.col("grp").alias("_g"), "group_scale").crossJoin(F.broadcast(mid))  # one row
    return out.join(s, F.col("grp").eqNullSafe(F.col("_g"))).select("grp", "position", "count", (ratio(F.col("count"), F.col("group_scale")) * F.col("_mid")).alias("norm"))


def group_scales(cells: DataFrame) -> DataFrame:
    """Mean n_count times cells of each group."""
    return cells.groupBy("grp").agg((F.avg("n_count") * F.count(F.lit(1))).alias("group_scale"))


def region_matrix(fragments: DataFrame, regions: DataFrame, groups: DataFrame, upstream: int = 3000, downstream: int = 3000, dedup: bool = True, file_id: str | None = None, bin_size: int = ranges.BIN) -> DataFrame:
    """Cut sites by group, region and position around region centres; both ends of a fragment must lie
    inside, minus strands read backwards. dedup: each distinct position of a region, group and end counts
    once per file; else every cut counts. Equal spans and regions at one place are joined once, and the
    counts of a place go to all its regions."""
    total = upstream + downstream + 1
    center = ranges.resize_center(regions)
    wide = ranges.extend(center, upstream, downstream).select("region_id", "chrom", "start", "end", *(["strand"] if "strand" in regions.columns else [F.lit("+").alias("strand")]))
    reps, members = ranges.representatives(wide, "region_id")
    rows = fragments.join(groups.select("barcode", "grp"), "barcode").select("chrom", F.col("start").alias("a"), F.col("end").alias("z"), "grp", *([F.col(file_id).alias("file")] if file_id else [F.lit(0).alias("file")]))
    spans = ranges.places(rows.select("chrom", (F.col("a") + 1).alias("start"), F.col("z").alias("end"), "a", "z", "grp", "file"), ("a", "z", "grp", "file"))
    hit = ranges.find_overlaps(spans, reps.drop("n"), bin_size=bin_size)
    off = lambda c: F.when(F.col("s_strand") == "-", total - (F.col(c) - F.col("s_start"))).otherwise(F.col(c) - F.col("s_start"))
    hit = hit.withColumns({"_p": off("q_a"), "_q": off("q_z")}).filter("_p > 0 and _q > 0").filter((F.col("_p") < total) & (F.col("_q") < total))
    ends = hit.select(F.col("q_grp").alias("grp"), F.col("s_region_id").alias("region_id"), F.col("q_file").alias("file"), F.col("q_n").alias("_n"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("_p").alias("position")), F.struct(F.lit("z").alias("side"), F.col("_q").alias("position")))).alias("_x")).select("grp", "region_id", "file", "_n", "_x.*")
    if dedup:
        ends = ends.drop("_n").distinct().withColumn("_n", F.lit(1))
    at = ends.groupBy("grp", F.col("region_id").alias("_rep"), "position").agg(F.sum("_n").alias("value"))
    return at.join(members, "_rep").select("grp", "region_id", "position", "value")


def hexamers_at(positions: DataFrame, genome: DataFrame, block: int, up: int = 3, down: int = 2) -> DataFrame:
    """The six bases around each position (chrom, pos). genome: chrom, block, seq of fixed blocks that
    carry up + down bases of their neighbour at the end; hexamers with other letters are dropped."""
    at = F.col("pos") - up
    p = positions.withColumn("block", F.floor(at / block)).join(genome, ["chrom", "block"])
    six = F.upper(F.substring(F.col("seq"), (at - F.col("block") * block + 1).cast("int"), F.lit(up + down + 1)))
    return p.withColumn("hexamer", six).filter(F.col("hexamer").rlike("^[ACGT]{6}$")).drop("seq", "block")


def _hexamer_codes(text) -> np.ndarray:
    """The hexamer at each place of a string in Arrow as a number below 4,096; -1 where it has other letters."""
    code = letters(text)
    if len(code) < 6:
        return np.empty(0, np.int16)
    six, odd = np.zeros(len(code) - 5, np.int16), np.zeros(len(code) - 5, bool)
    for i in range(6):
        x = code[i : len(code) - 5 + i]
        six = six * np.int16(4) + (x & 3)
        odd |= x == 4
    six[odd] = -1
    return six


_HEXAMERS = ["".join(x) for x in itertools.product("ACGT", repeat=6)]


def hexamer_counts(sequences: DataFrame, every: int = 1) -> DataFrame:
    """(hexamer, n, every): occurrences of hexamers in sequences, those at each ``every``th base apart; a row for
    each task. Hexamers with other letters than A, C, G and T are dropped."""
    import pyarrow as pa

    def run(batches):
        n = np.zeros((2, 4096), np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    six = _hexamer_codes(text)
                    for k, x in enumerate((six, six[::every])):
                        n[k] += np.bincount(x[x >= 0], minlength=4096)
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array([_HEXAMERS[i] for i in at], pa.string()), pa.array(n[0, at]), pa.array(n[1, at])], ["hexamer", "n", "every"])

    return sequences.select(F.upper("sequence")).mapInArrow(run, "hexamer string, n long, every long")


def hexamers_by_offset(sequences: DataFrame) -> DataFrame:
    """(offset, hexamer, n): occurrences by place in the sequence, summed over the rows of a batch."""
    import pyarrow as pa

    names = np.asarray(_HEXAMERS, dtype=object)

    def rows(key):
        key = np.concatenate(key)
        if key.max() < 4 * len(key):
            n = np.bincount(key)
            key = np.flatnonzero(n)
            n = n[key]
        else:
            key, n = np.unique(key, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((key >> 12).astype(np.int32)), pa.array(names[key & 4095], pa.string()), pa.array(n.astype(np.int64))], ["offset", "hexamer", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    six = _hexamer_codes(text)
                    at = np.flatnonzero(six >= 0)
                    held.append((at << 12) | six[at])
                    size += len(at)
                    if size > 1 << 22:
                        yield rows(held)
                        held, size = [], 0
        if size:
            yield rows(held)

    return sequences.select(F.upper("sequence")).mapInArrow(run, "offset int, hexamer string, n long")


def insertion_bias(observed: DataFrame, genomic: DataFrame, complete: bool = True) -> DataFrame:
    """bias of each hexamer: observed cut sites over genomic occurrences. Both have a column hexamer, and each row
    counts once or, if there is a column n, so many times."""
    times = lambda d: F.sum("n") if "n" in d.columns else F.count(F.lit(1))
    o, g = (d.groupBy("hexamer").agg(times(d).alias(n)) for d, n in ((observed, "_o"), (genomic, "_g")))
    out = g.join(o, "hexamer", "full").select("hexamer", ratio(F.coalesce("_o", F.lit(0)), F.coalesce("_g", F.lit(0))).alias("bias"))
    if complete and out.count() != 4096:
        raise ValueError("not all 4,096 hexamers occur")
    return out


def expected_insertions(sequences: DataFrame, bias: DataFrame, flank: int = 50) -> DataFrame:
    """Expected cuts by offset: the bias of the hexamers there, summed over regions (region_id, sequence
    of one width), over the mean of the first ``flank`` and last ``flank + 1`` offsets."""
    at = hexamers_by_offset(sequences).join(F.broadcast(bias), "hexamer").groupBy("offset").agg(F.sum(F.col("n") * F.col("bias")).alias("_e"))  # 4,096 rows
    n = at.agg((F.max("offset") + 1).alias("_w"))
    x = at.crossJoin(F.broadcast(n))  # one row
    mean = x.agg(F.avg(F.when((F.col("offset") < flank) | (F.col("offset") >= F.col("_w") - flank - 1), F.col("_e"))).alias("_m"))
    return x.crossJoin(F.broadcast(mean)).select("offset", ratio(F.col("_e"), F.col("_m")).alias("expected"))  # one row


def run_footprint(fragments: DataFrame, sites: DataFrame, groups: DataFrame, sequences: DataFrame | None = None, bias: DataFrame | None = None, upstream: int = 250, downstream: int = 250, within: DataFrame | None = None, flank: int = 50, bin_size: int = ranges.BIN) -> DataFrame:
    """Footprint of a set of sites (region_id, chrom, start, end, strand): those inside the regions of
    ``within``, resized to their centre and extended, piled up by group and set over their flanks. With the sequences
    of the extended sites (feature_id, sequence, three bases before and two after) and a hexamer bias, also
    what is expected. groups: cell_id, barcode, grp."""
    own = sites if within is None else ranges.subset_by_overlaps(sites.withColumn("id", F.col("region_id")), within, bin_size=bin_size)
    wide = ranges.extend(ranges.resize_center(own), upstream, downstream)
    width = upstream + downstream + 1
    pile = region_pileup(fragments, wide.select("chrom", "start", "end", "strand"), groups.select("cell_id", "barcode"), bin_size)
    pile = pile.withColumn("position", (F.col("position") + F.bround(F.lit(width) / 2)).cast("long"))
    return footprint_data(pile, groups, width, None if sequences is None else expected_insertions(sequences, bias, flank), flank)


def footprint_data(pile: DataFrame, groups: DataFrame, width: int, expected: DataFrame | None = None, flank: int = 50) -> DataFrame:
    """Per group and position: mean over cells, over the mean of the flank (first ``flank`` and last
    ``flank + 1`` positions of the whole block); with expected, also the ratio's counterpart column.
    Positions run 1..width; zeros count."""
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    s = pile.join(groups.select("cell_id", "grp"), "cell_id").groupBy("grp", "position").agg(F.sum("value").alias("_s"))
    grid = size.select("grp", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(width).cast("long"))).alias("position"))
    x = grid.join(s, ["grp", "position"], "left").withColumn("_m", F.coalesce("_s", F.lit(0)) / F.col("_n"))
    edge = (F.col("position") <= flank) | (F.col("position") >= width - flank)
    norm = F.avg(F.when(edge, F.col("_m"))).over(Window.partitionBy("grp"))
    out = x.select("grp", "position", ratio(F.col("_m"), norm).alias("norm"))
    if expected is not None:
        out = out.join(F.broadcast(expected.select((F.col("offset") + 1).alias("position"), "expected")), "position", "left")  # as many rows as positions
    return out
