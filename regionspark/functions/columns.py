"""Column expressions with the reference's numeric conventions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty=None) -> Column:
    """top / bottom; where bottom is 0, ``empty`` (null unless given) instead of an ANSI error."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; null where one doesn't vary (corr raises then under ANSI)."""
    own = lambda a, b: F.when(b.isNotNull(), a)
    return ratio(F.covar_pop(x, y), F.stddev_pop(own(x, y)) * F.stddev_pop(own(y, x)))


def range_name(chrom="chrom", start="start", end="end", sep=("-", "-")) -> Column:
    """chrom-start-end."""
    return F.concat(F.col(chrom), F.lit(sep[0]), F.col(start).cast("string"), F.lit(sep[1]), F.col(end).cast("string"))


def parse_range(name: Column, sep=("-", "-")) -> Column:
    """Struct (chrom, start, end); only the last two fields are numbers, so a contig may hold the separator."""
    import re

    pattern = f"^(.*){re.escape(sep[0])}(\\d+){re.escape(sep[1])}(\\d+)$"
    whole = F.when(name.rlike(pattern), name)
    part = lambda i: F.regexp_extract(whole, pattern, i)
    return F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def strand_start(start="start", end="end", strand="strand") -> Column:
    """Position of the first base in reading direction; ``*`` reads like ``+``."""
    return F.when(F.col(strand) == "-", F.col(end)).otherwise(F.col(start))


def ecdf(value: Column, *by: str) -> Column:
    """Share of rows at or below each value."""
    return F.cume_dist().over(Window.partitionBy(*by).orderBy(value))


def average_rank(value: Column, *by: str) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def seeded(id_: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends on the id and the seed alone."""
    return (F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
