"""Fragment files: tab-separated chrom, start, end, barcode, read count [, strand], ``#`` header lines."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("chrom", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("barcode", StringType()), StructField("read_count", LongType()), StructField("strand", StringType())])


def is_remote(path: str) -> bool:
    return path.startswith(("http", "ftp"))


def read_fragments(spark: SparkSession, path: str | list[str], strand: bool = False) -> DataFrame:
    """Rows of one or more files; a malformed line is an error."""
    schema = SCHEMA if strand else StructType(SCHEMA.fields[:5])
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="FAILFAST")


def validate_columns(spark: SparkSession, path: str) -> int:
    """5 or 6 columns; a file without data lines is an error."""
    line = spark.read.text(path).filter(~F.col("value").startswith("#")).limit(1).collect()
    if not line:
        raise ValueError(f"{path} has no fragments")
    n = len(line[0].value.split("\t"))
    if n not in (5, 6):
        raise ValueError(f"{path} has {n} columns, not 5 or 6")
    return n


def _hashes(spark: SparkSession, path: str) -> str:
    """MD5 of a file of any size, streamed from whatever store holds it; of a folder or pattern, the MD5 of
    its files' MD5s in order of name."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for s in fs.globStatus(at) or [] for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if f.isFile()]
    if not found:
        raise FileNotFoundError(path)
    sums = []
    for f in sorted((f.getPath() for f in found), key=lambda p: p.toString()):
        stream = fs.open(f)
        try:
            sums.append(jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream))
        finally:
            stream.close()
    return sums[0] if len(sums) == 1 else hashlib.md5("".join(sums).encode()).hexdigest()


@dataclass(frozen=True)
class FragmentFile:
    """A fragment file with its cells (cell_id, barcode) and hash."""

    spark: SparkSession
    path: str
    cells: DataFrame | None = None
    hash: str | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, cells: DataFrame | None = None, validate: bool = True, tolerance: float = 0.5) -> FragmentFile:
        if is_remote(path):
            return cls(spark, path, cells)
        validate_columns(spark, path)
        out = cls(spark, path, cells, _hashes(spark, path))
        if validate and cells is not None and not out.validate_cells(tolerance):
            raise ValueError("cells of the map are not in the file")
        return out

    def read(self) -> DataFrame:
        return read_fragments(self.spark, self.path)

    def head(self, n: int = 6) -> DataFrame:
        return self.read().limit(n)

    def validate_cells(self, tolerance: float = 0.5, max_lines: int | None = None) -> bool:
        """Whether (1 - tolerance) of the cells are found, among the first max_lines lines if given."""
        need = int(self.cells.count() * (1 - tolerance))
        rows = self.read() if max_lines is None else self.read().limit(max_lines)
        return rows.join(self.cells.select("barcode"), "barcode", "left_semi").select("barcode").distinct().limit(need).count() >= need

    def validate_hash(self) -> bool:
        return True if is_remote(self.path) or self.hash is None else _hashes(self.spark, self.path) == self.hash

    def validate(self) -> bool:
        return (self.cells is None or self.validate_cells()) and self.validate_hash()

    def with_path(self, path: str) -> FragmentFile:
        if not is_remote(path) and self.hash is not None and _hashes(self.spark, path) != self.hash:
            raise ValueError(f"{path} is another file")
        return replace(self, path=path)

    def with_cells(self, cells: DataFrame) -> FragmentFile:
        if {"cell_id", "barcode"} - set(cells.columns):
            raise ValueError("a cell map has columns cell_id and barcode")
        out = replace(self, cells=cells)
        if not out.validate_cells():
            raise ValueError("cells of the map are not in the file")
        return out

    def subset(self, cells: DataFrame) -> FragmentFile:
        return replace(self, cells=self.cells.join(cells.select("cell_id"), "cell_id", "left_semi"))

    def named_cells(self) -> DataFrame:
        """The cell map; without one, every barcode names itself."""
        return self.cells if self.cells is not None else self.read().select(F.col("barcode").alias("cell_id"), "barcode").distinct()


def region_rows(fragments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Fragments that overlap a closed region: plain filters, so Parquet sorted by (chrom, start) skips."""
    return fragments.filter((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") >= start)).withColumn("length", F.col("end") - F.col("start"))


def regions_rows(fragments: DataFrame, regions: DataFrame, idents: DataFrame | None = None, bin_size: int | None = None) -> DataFrame:
    """Fragments that overlap each of many closed regions (region_id, chrom, start, end), with the region and,
    from idents (barcode, ident), the cell's group; barcodes without one are left out then."""
    from regionspark.operators import ranges

    spans = fragments.withColumns({"_s": F.col("start"), "_e": F.col("end")}).withColumn("start", F.col("_s") + 1)
    keep = [c for c in fragments.columns if c not in ("chrom", "start", "end")]
    hits = ranges.find_overlaps(spans, regions.select("region_id", "chrom", "start", "end"), bin_size=bin_size or ranges.BIN)
    out = hits.select(F.col("s_region_id").alias("region_id"), F.col("q_chrom").alias("chrom"), F.col("q__s").alias("start"), F.col("q__e").alias("end"), *(F.col(f"q_{c}").alias(c) for c in keep)).withColumn("length", F.col("end") - F.col("start"))
    return out if idents is None else out.join(idents.select("barcode", "ident"), "barcode")


def filter_cells(fragments: DataFrame, cells: DataFrame) -> DataFrame:
    return fragments.join(cells.select("barcode"), "barcode", "left_semi").select(*fragments.columns)


def group_file_name(group: str) -> str:
    """Spaces and path separators become ``_``."""
    return re.sub(r"[ /\\]", "_", group)


def split_by_group(fragments: DataFrame, groups: DataFrame, path: str | None = None) -> DataFrame:
    """Fragments with the group (barcode, grp) of their cell; with a path, also written as one folder of
    tab-separated files for each group."""
    out = fragments.join(groups.select("barcode", "grp"), "barcode").select(*fragments.columns, "grp")
    if path is not None:
        write_fragments(out.withColumn("grp", F.regexp_replace("grp", r"[ /\\]", "_")), path, "grp")
    return out


def write_fragments(fragments: DataFrame, path: str, by: str | None = None) -> None:
    """Sorted within files by (chrom, start); gzip text."""
    w = fragments.sortWithinPartitions("chrom", "start").write.mode("overwrite")
    (w.partitionBy(by) if by else w).csv(path, sep="\t", compression="gzip")


def store_parquet(fragments: DataFrame, path: str) -> None:
    """The columnar form to query from: one folder for each chromosome, ranges of start in order."""
    fragments.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").partitionBy("chrom").parquet(path)
