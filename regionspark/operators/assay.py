"""The assay: a bundle of DataFrames, with creation filters, subsetting, merging and renaming.

Layers hold non-zero values only; every statistic per cell or feature starts from the cells or features
table, so that zeros count."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionspark.functions.columns import range_name
from regionspark.functions.lineage import cut, store
from regionspark.operators import quantify, ranges
from regionspark.operators.running import with_ranks


@dataclass(frozen=True)
class Motifs:
    """Feature x motif hits and what is known of the motifs."""

    data: DataFrame  # feature_id, motif_id
    pwm: DataFrame | None = None  # motif_id, pos, base, p
    names: DataFrame | None = None  # motif_id, motif_name
    positions: DataFrame | None = None  # motif_id, chrom, start, end, strand
    meta: DataFrame | None = None

    def subset(self, features: DataFrame | None = None, motifs: DataFrame | None = None) -> Motifs:
        out = self.data if features is None else self.data.join(features.select("feature_id"), "feature_id", "left_semi")
        if motifs is None:
            return replace(self, data=out)
        of = lambda d: None if d is None else d.join(motifs.select("motif_id"), "motif_id", "left_semi")
        return Motifs(of(out), of(self.pwm), of(self.names), of(self.positions), of(self.meta))

    def convert(self, ids: DataFrame, to_names: bool = True) -> DataFrame:
        """motif_id to motif_name, or back; unknown ones give null."""
        key, other = ("motif_id", "motif_name") if to_names else ("motif_name", "motif_id")
        return ids.select(key).join(self.names.select(key, other), key, "left")


@dataclass(frozen=True)
class Assay:
    """features: feature_id, chrom, start, end, ...; cells: cell_id, ...; counts, data, scaled: layers."""

    features: DataFrame
    cells: DataFrame
    counts: DataFrame
    data: DataFrame | None = None
    scaled: DataFrame | None = None
    fragments: tuple[DataFrame, ...] = ()  # chrom, start, end, barcode, read_count
    cellmaps: tuple[DataFrame, ...] = ()  # cell_id, barcode; one for each of fragments
    annotation: DataFrame | None = None
    motifs: Motifs | None = None
    links: DataFrame | None = None
    seqinfo: DataFrame | None = None  # chrom, length, is_circular, genome
    bias: DataFrame | None = None  # hexamer, bias
    positions: dict[str, DataFrame] = field(default_factory=dict)  # by key: cell or group level pileups

    def __repr__(self) -> str:
        return f"Assay(layers: {', '.join(k for k in ('counts', 'data', 'scaled') if getattr(self, k) is not None)}; fragment files: {len(self.fragments)}; motifs: {self.motifs is not None})"

    def dim(self) -> tuple[int, int]:
        return self.features.count(), self.cells.count()

    def with_annotation(self, annotation: DataFrame) -> Assay:
        if "tx_id" not in annotation.columns and "transcript_id" in annotation.columns:
            annotation = annotation.withColumnRenamed("transcript_id", "tx_id")
        missing = {"tx_id", "gene_name", "gene_id", "gene_biotype", "type"} - set(annotation.columns)
        if missing:
            raise ValueError(f"annotation lacks {sorted(missing)}")
        return replace(self, annotation=annotation)

    def with_links(self, links: DataFrame) -> Assay:
        if "score" not in links.columns:
            raise ValueError("links need a score")
        return replace(self, links=links)

    def with_bias(self, bias: DataFrame) -> Assay:
        if {"hexamer", "bias"} - set(bias.columns):
            raise ValueError("bias has columns hexamer and bias")
        return replace(self, bias=bias)

    def with_layer(self, name: str, layer: DataFrame) -> Assay:
        if name not in ("counts", "data", "scaled"):
            raise ValueError("a layer is counts, data or scaled")
        odd = layer.join(self.features, "feature_id", "left_anti").limit(1).count() + layer.join(self.cells, "cell_id", "left_anti").limit(1).count()
        if odd:
            raise ValueError("the layer has features or cells that the assay lacks")
        return replace(self, **{name: layer})

    def add_fragments(self, fragments: DataFrame, cellmap: DataFrame) -> Assay:
        """Append a fragment file; a cell belongs to one file only."""
        for other in self.cellmaps:
            if cellmap.join(other, "cell_id", "left_semi").limit(1).count():
                raise ValueError("cells of this fragment file are in another one")
        return replace(self, fragments=(*self.fragments, fragments), cellmaps=(*self.cellmaps, cellmap))

    def rename_cells(self, names: DataFrame) -> Assay:
        """names: cell_id, new_id; cells without a new name keep theirs."""
        def of(d):
            if d is None or "cell_id" not in d.columns:
                return d
            cols = d.columns
            return d.join(names, "cell_id", "left").withColumn("cell_id", F.coalesce("new_id", "cell_id")).select(*cols)

        return replace(self, cells=of(self.cells), counts=of(self.counts), data=of(self.data), scaled=of(self.scaled), cellmaps=tuple(map(of, self.cellmaps)), positions={k: of(v) for k, v in self.positions.items()})

    def subset(self, features: DataFrame | None = None, cells: DataFrame | None = None) -> Assay:
        """Keep features and cells; feature statistics are computed anew, group pileups stay."""
        def of(d):
            if d is None:
                return None
            if features is not None and "feature_id" in d.columns:
                d = d.join(features.select("feature_id"), "feature_id", "left_semi")
            if cells is not None and "cell_id" in d.columns:
                d = d.join(cells.select("cell_id"), "cell_id", "left_semi")
            return d

        out = replace(self, cells=of(self.cells), counts=of(self.counts), data=of(self.data), scaled=of(self.scaled), cellmaps=tuple(map(of, self.cellmaps)), motifs=None if self.motifs is None else self.motifs.subset(features), positions={k: of(v) for k, v in self.positions.items()})
        return replace(out, features=feature_stats(of(self.features).select("feature_id", "chrom", "start", "end"), out.counts))


def nonzero(counts: DataFrame) -> DataFrame:
    return counts.filter("value <> 0")


def binarize(counts: DataFrame) -> DataFrame:
    return nonzero(counts).withColumn("value", F.lit(1.0))


def cell_stats(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """n_count and n_feature of every cell."""
    got = nonzero(counts).groupBy("cell_id").agg(F.sum("value").alias("_c"), F.count(F.lit(1)).alias("_f"))
    return cells.join(got, "cell_id", "left").select(*cells.columns, F.coalesce("_c", F.lit(0)).alias("n_count"), F.coalesce("_f", F.lit(0)).alias("n_feature"))


def feature_stats(features: DataFrame, counts: DataFrame) -> DataFrame:
    """count and percentile (ecdf) of every feature."""
    got = counts.groupBy("feature_id").agg(F.sum("value").alias("_c"))
    out = features.join(got, "feature_id", "left").select(*features.columns, F.coalesce("_c", F.lit(0)).alias("count"))
    return with_ranks(cut(out), F.col("count"), ecdf="percentile")


def create_filters(counts: DataFrame, min_features: int = 0, min_cells: int = 0, max_cells: int | str | None = None) -> DataFrame:
    """The counts left by the creation filters: cells by features first, then features by the cells that
    are left; max_cells ``qNN``: NN per cent of those."""
    rows = nonzero(counts)
    cells = rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_features).select("cell_id")
    rows = rows.join(cells, "cell_id", "left_semi")
    seen = rows.groupBy("feature_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_cells)
    if isinstance(max_cells, str):
        max_cells = cells.count() * int(max_cells[1:]) / 100
    if max_cells is not None:
        seen = seen.filter(F.col("_n") <= max_cells)
    return rows.join(seen, "feature_id", "left_semi")


def create_assay(counts: DataFrame, features: DataFrame, min_features: int = 0, min_cells: int = 0, max_cells=None, check_disjoint: bool = False, **slots) -> Assay:
    """An assay of the counts that the creation filters leave. check_disjoint: warn of overlapping features."""
    if check_disjoint and not ranges.is_disjoint(features).first()[0]:
        warnings.warn("the features overlap each other", stacklevel=2)
    rows = store(create_filters(counts, min_features, min_cells, max_cells))  # read by each slot and by what follows
    cells = cell_stats(rows.select("cell_id").distinct(), rows)
    kept = features.join(rows.select("feature_id").distinct(), "feature_id", "left_semi")
    out = Assay(feature_stats(kept, rows), cells, rows)
    annotation = slots.pop("annotation", None)
    out = replace(out, **slots)
    return out if annotation is None else out.with_annotation(annotation)


def subset_matrix(counts: DataFrame, min_rows: int = 0, min_cols: int = 0, max_row_val: float | None = None, max_col_val: float | None = None) -> DataFrame:
    """Rows and columns with more than the stated non-zeros and a maximum below the stated one; both
    tests look at the whole matrix."""
    rows = nonzero(counts)

    def test(key, least, most):
        got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("_m")).filter(F.col("_n") > least)
        return (got if most is None else got.filter(F.col("_m") < most)).select(key)

    return rows.join(test("feature_id", min_rows, max_row_val), "feature_id", "left_semi").join(test("cell_id", min_cols, max_col_val), "cell_id", "left_semi")


def accessible_features(counts: DataFrame, cells: DataFrame | None = None, min_cells: int = 10) -> DataFrame:
    """Features found in more than min_cells of the cells."""
    rows = nonzero(counts)
    if cells is not None:
        rows = rows.join(cells.select("cell_id"), "cell_id", "left_semi")
    return rows.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_cells")).filter(F.col("n_cells") > min_cells)


def intersect_matrix(counts: DataFrame, features: DataFrame, regions: DataFrame, invert: bool = False, bin_size: int = ranges.BIN) -> DataFrame:
    """Rows of features that overlap regions, once for each hit; inverted, those that don't."""
    if invert:
        kept = ranges.subset_by_overlaps(features.withColumn("id", F.col("feature_id")), regions, invert=True, bin_size=bin_size)
        return counts.join(kept, "feature_id", "left_semi")
    hits = ranges.find_overlaps(features.select("feature_id", "chrom", "start", "end"), ranges.places(regions.select("chrom", "start", "end")), bin_size=bin_size)
    times = hits.groupBy(F.col("q_feature_id").alias("feature_id")).agg(F.sum("s_n").cast("int").alias("_times"))
    rows = counts.join(times, "feature_id")
    # the rows are repeated last, by more tasks than their own size would get
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.withColumn("_again", F.explode(F.array_repeat(F.lit(0).cast("byte"), F.col("_times")))).drop("_times", "_again")


def add_missing(counts: DataFrame, features: DataFrame, cells: DataFrame) -> DataFrame:
    """Every feature and cell at least once: rows with value 0 where one has none."""
    first_cell, first_feature = cells.agg(F.min("cell_id").alias("cell_id")), features.agg(F.min("feature_id").alias("feature_id"))
    f = features.select("feature_id").join(counts, "feature_id", "left_anti").crossJoin(F.broadcast(first_cell))  # one row
    c = cells.select("cell_id").join(counts, "cell_id", "left_anti").crossJoin(F.broadcast(first_feature))  # one row
    zero = f.select("feature_id", "cell_id").unionByName(c.select("feature_id", "cell_id")).distinct().withColumn("value", F.lit(0).cast(dict(counts.dtypes)["value"]))
    return counts.unionByName(zero)


def downsample_features(features: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """n features without replacement, by a seeded hash; an error if there are fewer."""
    if features.count() < n:
        raise ValueError("fewer features than asked for")
    return features.orderBy(F.xxhash64("feature_id", F.lit(seed)), "feature_id").limit(n)


def average_counts(cells: DataFrame, group: str = "ident", n: str = "n_count") -> DataFrame:
    return cells.groupBy(group).agg(F.avg(n).alias("mean_count"))


def cells_per_group(cells: DataFrame, group: str = "ident") -> DataFrame:
    """Cells by group; the group of null is there even when empty."""
    spark = cells.sparkSession
    none = spark.createDataFrame([(None, 0)], f"{group} {dict(cells.dtypes)[group]}, n_cells long")
    return cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells")).unionByName(none).groupBy(group).agg(F.sum("n_cells").alias("n_cells"))


def average_matrix(counts: DataFrame, cells: DataFrame, group: str = "ident") -> DataFrame:
    """Mean of each feature over all cells of each group."""
    size = cells.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed(group, "_group")
    total = counts.join(cells.select("cell_id", group), "cell_id").groupBy("feature_id", group).agg(F.sum("value").alias("_sum"))
    return total.join(size, total[group].eqNullSafe(size["_group"])).select("feature_id", group, (F.col("_sum") / F.col("_size")).alias("mean"))


def fold_change(counts: DataFrame, cells: DataFrame, features: DataFrame, base: float = 2.0, pseudo: float = 1e-4) -> DataFrame:
    """log of mean + pseudo between two groups of cells (cell_id, grp in (1, 2)); means include zeros."""
    size = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(*(F.max(F.when(F.col("grp") == g, F.col("n"))).alias(f"n{g}") for g in (1, 2)))
    x = counts.join(cells, "cell_id").groupBy("feature_id").agg(*(F.sum(F.when(F.col("grp") == g, F.col("value")).otherwise(0.0)).alias(f"s{g}") for g in (1, 2)), *(F.sum(F.when((F.col("grp") == g) & (F.col("value") > 0), 1).otherwise(0)).alias(f"k{g}") for g in (1, 2)))
    x = features.select("feature_id").join(x, "feature_id", "left").na.fill(0).crossJoin(F.broadcast(size))  # one row
    log = lambda g: F.ln(F.col(f"s{g}") / F.col(f"n{g}") + pseudo) / F.ln(F.lit(base))
    return x.select("feature_id", (log(1) - log(2)).alias("log_fc"), (F.col("k1") / F.col("n1")).alias("pct_1"), (F.col("k2") / F.col("n2")).alias("pct_2"))


def merge(assays: list[Assay]) -> Assay:
    """Bind cells. Features are known by their place. Where all assays have the same ones, or those that
    not all have are disjoint, rows are bound as they are; else features that overlap across
    assays are reduced to one range and their rows summed. Equal cell names get the prefix of their
    assay's number. Annotation and seqinfo come from the first; motifs, bias, links and pileups are
    dropped. Genomes must be equal."""
    genomes = [a.seqinfo.select("genome").distinct().orderBy("genome").collect() if a.seqinfo is not None and "genome" in a.seqinfo.columns else None for a in assays]
    if len({str(g) for g in genomes if g}) > 1:
        raise ValueError("the assays have different genomes")
    ids = [a.cells.select("cell_id") for a in assays]
    clash = any(ids[i].join(ids[j], "cell_id", "left_semi").limit(1).count() for i in range(len(ids)) for j in range(i))
    if clash:
        assays = [a.rename_cells(a.cells.select("cell_id", F.concat(F.lit(f"{i + 1}_"), "cell_id").alias("new_id"))) for i, a in enumerate(assays)]
    place = ["chrom", "start", "end"]
    feature, count, cell = None, None, None
    for i, a in enumerate(assays):
        key = F.struct(F.lit(i).alias("assay"), F.col("feature_id").cast("string").alias("id"))
        f, c = a.features.select(key.alias("feature_id"), *place), a.counts.select(key.alias("feature_id"), "cell_id", F.col("value").cast("double").alias("value"))
        feature = f if feature is None else feature.unionByName(f)
        count = c if count is None else count.unionByName(c)
        cell = a.cells.select("cell_id") if cell is None else cell.unionByName(a.cells.select("cell_id"))
    places = cut(feature.select(*place, F.col("feature_id.assay").alias("assay")).distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("n")))
    different = places.filter(F.col("n") < len(assays)).drop("n")
    if different.isEmpty() or ranges.is_disjoint(different).first()[0]:
        features = places.select(range_name().alias("feature_id"), *place)
        counts = count.join(feature.select("feature_id", range_name().alias("place")), "feature_id").groupBy(F.col("place").alias("feature_id"), "cell_id").agg(F.sum("value").alias("value"))
    else:
        features = ranges.reduce(places).select(range_name().alias("feature_id"), *place)
        counts = quantify.merge_overlapping(count, feature).select(range_name().alias("feature_id"), "cell_id", "value")
    counts = store(counts)
    return Assay(feature_stats(features, counts), cell_stats(cell, counts), counts, fragments=tuple(f for a in assays for f in a.fragments), cellmaps=tuple(c for a in assays for c in a.cellmaps), annotation=assays[0].annotation, seqinfo=assays[0].seqinfo)
