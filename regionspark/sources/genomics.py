"""Other files: peaks, annotation, sequences, signals and mitochondrial counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NARROW = "chrom string, start long, end long, name string, score double, strand string, fold_change double, neg_log10_pvalue double, neg_log10_qvalue double, relative_summit long"
BASES = ("A", "C", "G", "T")


def read_peaks(spark: SparkSession, path: str, broad: bool = False) -> DataFrame:
    """narrowPeak (10 columns) or broadPeak (9); starts become 1-based."""
    schema = ", ".join(NARROW.split(", ")[: 9 if broad else 10])
    return spark.read.csv(path, sep="\t", comment="#", schema=schema).withColumn("start", F.col("start") + 1)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """A signal by runs (chrom, start, end, score), 1-based and closed; stands in for bigWig."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, score double").withColumn("start", F.col("start") + 1)


def read_gtf(spark: SparkSession, path: str, biotypes: list[str] | None = None) -> DataFrame:
    """Annotation rows (chrom, start, end, strand, type, tx_id, gene_name, gene_id, gene_biotype)."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, source string, type string, start long, end long, score string, strand string, frame string, attributes string", quote="")
    tag = lambda name: F.nullif(F.regexp_extract("attributes", rf'{name} "([^"]*)"', 1), F.lit(""))
    out = rows.select("chrom", "start", "end", F.when(F.col("strand") == ".", "*").otherwise(F.col("strand")).alias("strand"), "type", tag("transcript_id").alias("tx_id"), tag("gene_name").alias("gene_name"), tag("gene_id").alias("gene_id"), F.coalesce(tag("gene_biotype"), tag("gene_type")).alias("gene_biotype"))
    return out if biotypes is None else out.filter(F.col("gene_biotype").isin(*biotypes))


def tss_positions(annotation: DataFrame, biotypes: list[str] | None = ("protein_coding",)) -> DataFrame:
    """Start sites of genes of the biotypes (all if None), each site once."""
    from regionspark.operators import quantify, ranges

    genes = quantify.gene_spans(annotation)
    if biotypes is not None:
        genes = genes.filter(F.col("gene_biotype").isin(*biotypes))
    return ranges.resize_tss(genes)


def read_fasta(spark: SparkSession, path: str, block: int = 1 << 16, overlap: int = 5) -> DataFrame:
    """Genome in fixed blocks (chrom, block, seq), 0-based; a block also has the next one's first bases.
    Read by lines, so that a contig is dealt over the file's splits: lines count their bases within a
    split, and one row for each split carries contig and position on. One line must fit a task; text
    before the first ``>`` is dropped, a contig without bases has one empty block, and contig names are
    unique within a file."""
    source = ["_file", "_split"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1))
    lines = lines.select(*source, "_at", head.alias("_head"), F.when(head.isNull(), F.regexp_replace("value", r"\s", "")).otherwise("").alias("_bases")).withColumn("_n", F.length("_bases").cast("long"))
    so_far = Window.partitionBy(*source).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"_name": F.last("_head", ignorenulls=True).over(so_far), "_sum": F.sum("_n").over(so_far)})
    lines = lines.withColumn("_from", F.last(F.when(F.col("_head").isNotNull(), F.col("_sum")), ignorenulls=True).over(so_far))
    lines = lines.withColumn("_end", F.col("_sum") - F.coalesce("_from", F.lit(0)))

    splits = lines.groupBy(*source).agg(F.max_by(F.struct("_name", "_end"), "_at").alias("_last")).select(*source, "_last.*")
    earlier = Window.partitionBy("_file").orderBy("_split")
    upto = earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("_total", F.sum("_end").over(upto))
    start = F.last(F.when(F.col("_name").isNotNull(), F.col("_total") - F.col("_end")), ignorenulls=True).over(upto)
    splits = splits.withColumns({"_open": F.last("_name", ignorenulls=True).over(upto), "_length": F.col("_total") - F.coalesce(start, F.lit(0))})
    splits = splits.select(*source, F.lag("_open").over(earlier).alias("_open"), F.lag("_length").over(earlier).alias("_length"))

    at = F.col("_end") - F.col("_n") + F.when(F.col("_name").isNull(), F.coalesce("_length", F.lit(0))).otherwise(0)
    placed = lines.filter("_n > 0 or _head is not null").join(splits, source).select("_file", F.coalesce("_name", "_open").alias("chrom"), at.alias("_at"), "_n", "_bases").filter("chrom is not null")
    lo = lambda b: F.greatest(F.col("_at"), b * block)
    piece = lambda b: F.substring(F.col("_bases"), (lo(b) - F.col("_at") + 1).cast("int"), (F.least(F.col("_at") + F.col("_n"), (b + 1) * block + overlap) - lo(b)).cast("int"))
    first, last = F.greatest(F.floor((F.col("_at") - overlap) / block), F.lit(0)), F.floor((F.col("_at") + F.greatest(F.col("_n"), F.lit(1)) - 1) / block)
    pieces = placed.select("_file", "chrom", "_at", F.explode(F.transform(F.sequence(first, last), lambda b: F.struct(b.alias("block"), piece(b).alias("p")))).alias("_x")).select("_file", "chrom", F.col("_x.block").alias("block"), "_at", "_x.p")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "p"))), lambda x: x["p"]), "")
    return pieces.groupBy("_file", "chrom", "block").agg(joined.alias("seq")).select("chrom", "block", "seq")


def region_sequences(genome: DataFrame, regions: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Sequence of each region (feature_id, chrom, start, end: 1-based); unknown chromosomes give null."""
    need = regions.withColumn("block", F.explode(F.sequence(F.floor((F.col("start") - 1) / block), F.floor((F.col("end") - 1) / block))))
    part = need.join(genome, ["chrom", "block"], "left")
    lo = F.greatest(F.col("start") - 1, F.col("block") * block)
    hi = F.least(F.col("end"), (F.col("block") + 1) * block)
    piece = F.substring(F.col("seq"), (lo - F.col("block") * block + 1).cast("int"), (hi - lo).cast("int"))
    out = part.select("feature_id", "block", piece.alias("p")).groupBy("feature_id").agg(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("block", "p")))).alias("ps"))
    joined = F.array_join(F.transform("ps", lambda x: x["p"]), "")
    return out.select("feature_id", F.when(F.size("ps") > 0, joined).alias("sequence"))


def read_mito(spark: SparkSession, folder: str, prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts: pos, cell_id, base, fwd, rev; reference: pos, ref; depth: cell_id, depth) of a folder with a
    file for each base, a reference allele table and a depth table."""
    counts = None
    for b in BASES:
        one = spark.read.csv(f"{folder}/{prefix}*.{b}.txt*", schema="pos long, cell_id string, fwd long, rev long").select("pos", "cell_id", F.lit(b).alias("base"), "fwd", "rev")
        counts = one if counts is None else counts.unionByName(one)
    ref = spark.read.text(f"{folder}/{prefix}*_refAllele.txt*").select(F.split(F.trim("value"), r"\s+").alias("x")).select(F.col("x")[0].cast("long").alias("pos"), F.upper(F.col("x")[1]).alias("ref"))
    depth = spark.read.text(f"{folder}/{prefix}*.depthTable.txt*").select(F.split(F.trim("value"), r"\s+").alias("x")).select(F.col("x")[0].alias("cell_id"), F.col("x")[1].cast("double").alias("depth"))
    return counts, ref, depth


def stacked(counts: DataFrame) -> DataFrame:
    """Counts as rows of features ``base-pos-strand``."""
    return counts.selectExpr("pos", "cell_id", "base", "stack(2, 'fwd', fwd, 'rev', rev) as (strand, value)").filter("value > 0").select(F.concat_ws("-", "base", F.col("pos").cast("string"), "strand").alias("feature_id"), "cell_id", "value")
