"""Running aggregates that don't need a whole key in one task.

A plain window over a chromosome puts all its rows in one task. Here rows are cut into blocks of
positions; a window runs inside each block, and one row per block carries what came before it. The
rows are shuffled once, by (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionspark.functions.lineage import cut

BLOCK = 1 << 20
_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def running(df: DataFrame, by: Sequence[str], position: str, order: Sequence[Column], value: Column, how: str, out: str, exclusive: bool = True, backwards: bool = False, block: int = BLOCK) -> DataFrame:
    """Add ``out``: the max, min or sum of ``value`` over the rows before (and, unless exclusive, at)
    each row in ``order``, whose first term is ``position``; backwards: over the rows after (``order`` has
    plain columns then)."""
    agg = _AGG[how]
    blocked = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)))
    # backwards means the order turned round: a frame that reaches to the end is computed anew for each row
    turn = (lambda c: c.desc()) if backwards else (lambda c: c)
    near = Window.partitionBy(*by, "_block").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    rows = blocked.withColumn("_near", agg(value).over(near))
    carry = blocked.groupBy(*by, "_block").agg(agg(value).alias("_total"))
    far = Window.partitionBy(*by).orderBy(turn(F.col("_block"))).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_block").alias("_b"), agg("_total").over(far).alias("_far"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by] + [F.col("_block") == F.col("_b")]
    joined = rows.join(carry, on, "left")
    if how == "sum":
        both = F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))
    else:
        both = (F.greatest if how == "max" else F.least)("_near", "_far")
        if dict(joined.dtypes)["_near"].startswith("struct"):
            a, b = F.col("_near"), F.col("_far")
            first = (a > b) if how == "max" else (a < b)
            both = F.when(b.isNull() | first, a).otherwise(b)
    return joined.withColumn(out, both).select(*df.columns, out)


def cumulative(df: DataFrame, value: Column) -> DataFrame:
    """(_v, _k, _p, _upto, _total): each distinct value, its rows, the range of values it lies in, the rows
    at or below it and all rows. Values are dealt out by range; one row for each range carries what came before."""
    n = df.select(value.alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_k"))
    n = cut(n.repartitionByRange(F.col("_v").asc_nulls_first()).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carry = n.groupBy("_p").agg(F.sum("_k").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_far"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    near = F.sum("_k").over(Window.partitionBy("_p").orderBy(F.col("_v").asc_nulls_first()))
    return n.withColumn("_near", near).join(F.broadcast(carry), "_p").select("_v", "_k", "_p", (F.col("_near") + F.col("_far")).alias("_upto"), "_total")  # a row for each range


def with_ranks(df: DataFrame, value: Column, rank: str | None = None, ecdf: str | None = None) -> DataFrame:
    """Add the rank of ``value`` (ties at their mean) and the share of rows at or below it, over the table."""
    of = cumulative(df, value).select("_v", (F.col("_upto") - (F.col("_k") - 1) / 2).alias("_rank"), (F.col("_upto") / F.col("_total")).alias("_ecdf"))
    own = df.withColumn("_own", value)
    out = own.join(of, F.col("_own").eqNullSafe(F.col("_v")))
    return out.select(*df.columns, *(F.col(c).alias(name) for c, name in (("_rank", rank), ("_ecdf", ecdf)) if name))
