"""Statistics that the composite operators share."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from regionspark.functions.columns import average_rank, seeded
from regionspark.functions.lineage import cut
from regionspark.operators.running import cumulative


def normal_tail(z: Column) -> Column:
    """P(Z <= z) of the standard normal, by Arrow batches: Spark has no erf."""
    erfc = np.vectorize(math.erfc, otypes=[float])

    @pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, 0.5 * erfc(-x.fillna(0).to_numpy() / math.sqrt(2))))

    return F.nanvl(tail(z), F.lit(None).cast("double"))


def hypergeometric_tail(q: Column, m: Column, n: Column, k: Column) -> Column:
    """P(X >= q) for k draws from m marked and n others, by log-gamma sums over Arrow batches."""

    @pandas_udf("double")
    def tail(q: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for q_, m_, n_, k_ in zip(q, m, n, k, strict=True):
            lo, hi = max(int(q_), int(k_ - n_), 0), int(min(k_, m_))
            if lo > hi:
                out.append(0.0)
                continue
            x = np.arange(lo, hi + 1)
            lg = lambda v: np.array([math.lgamma(a + 1) for a in np.atleast_1d(v)])
            logs = lg(m_) - lg(x) - lg(m_ - x) + lg(n_) - lg(k_ - x) - lg(n_ - k_ + x) - (lg(m_ + n_) - lg(k_) - lg(m_ + n_ - k_))
            top = logs.max()
            out.append(min(1.0, float(np.exp(top) * np.exp(logs - top).sum())))
        return pd.Series(out)

    return tail(q.cast("double"), m.cast("double"), n.cast("double"), k.cast("double"))


def adjust(df: DataFrame, p: str = "pvalue", out: str = "p_adjust", method: str = "BH") -> DataFrame:
    """Benjamini-Hochberg, or Bonferroni. One row for each test. BH's reverse running minimum goes over ranges
    of p, with one row for each range that carries the minimum of those above."""
    if method == "bonferroni":
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        return df.crossJoin(F.broadcast(n)).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")  # one row
    if method != "BH":
        raise ValueError("method is BH or bonferroni")
    df = cut(df)
    x = cumulative(df, F.col(p)).withColumn("_q", F.col("_v") * F.col("_total") / F.col("_upto"))
    above = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carry = x.groupBy("_p").agg(F.min("_q").alias("_m")).select("_p", F.min("_m").over(above).alias("_far"))
    near = F.min("_q").over(Window.partitionBy("_p").orderBy(F.desc("_v")))
    x = x.withColumn("_near", near).join(F.broadcast(carry), "_p").select("_v", F.least(F.lit(1.0), "_near", "_far").alias(out))
    return df.join(x, F.col(p).eqNullSafe(F.col("_v"))).drop("_v")


def weighted_sample(df: DataFrame, n: int, weight: str, id_: str, seed: int = 1234) -> DataFrame:
    """n rows without replacement, with chances by weight: the smallest -ln(u) / w, u from a hash of the id."""
    key = -F.ln(seeded(F.col(id_), seed)) / F.col(weight)
    return df.filter(F.col(weight) > 0).orderBy(key, id_).limit(n)


def kernel_density(values: np.ndarray, counts: np.ndarray, grid: np.ndarray, bandwidth: float = 1.0) -> np.ndarray:
    z = (grid[:, None] - values[None, :]) / bandwidth
    return (np.exp(-0.5 * z * z) @ counts) / (counts.sum() * bandwidth * math.sqrt(2 * math.pi))


def match_region_stats(query: DataFrame, pool: DataFrame, columns: list[str], n: int = 10_000, bandwidth: float = 1.0, seed: int = 1234) -> DataFrame:
    """n rows of the pool whose columns are distributed like the query's: densities of both on 512 points
    (from counts by bins of a quarter of the bandwidth), weight query / pool, weighted sample."""
    weight = F.lit(1.0)
    for c in columns:
        width = bandwidth / 4
        binned = lambda d: d.filter(F.col(c).isNotNull()).groupBy(F.floor(F.col(c) / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))  # noqa: B023, E731
        q, p = binned(query).toPandas(), binned(pool).toPandas()
        if not len(q) or not len(p):
            continue
        qx, px = (q["b"].to_numpy() + 0.5) * width, (p["b"].to_numpy() + 0.5) * width
        grid = np.linspace(min(qx.min(), px.min()) - 3 * bandwidth, max(qx.max(), px.max()) + 3 * bandwidth, 512)
        r = kernel_density(qx, q["n"].to_numpy(), grid, bandwidth) / np.maximum(kernel_density(px, p["n"].to_numpy(), grid, bandwidth), 1e-300)
        y, lo, step = F.array(*map(F.lit, map(float, r))), float(grid[0]), float(grid[1] - grid[0])
        t = (F.col(c) - lo) / step
        i = F.floor(t).cast("int")
        inside = (i >= 0) & (i < 511)
        j = F.when(inside, i).otherwise(0)
        weight = weight * F.when(inside, F.element_at(y, j + 1) * (1 - (t - j)) + F.element_at(y, j + 2) * (t - j)).otherwise(1e-6)
    return weighted_sample(pool.withColumn("weight", F.coalesce(weight, F.lit(0.0))), n, "weight", "feature_id", seed)


def wilcoxon(counts: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:
    """Rank-sum test of each feature between groups 1 and 2 of cells (cell_id, grp), zeros included:
    non-zeros are ranked, the zeros of a feature share one rank."""
    cells = cells.filter("grp in (1, 2)")
    size = cells.agg(*(F.sum((F.col("grp") == g).cast("long")).alias(f"n{g}") for g in (1, 2)))
    x = counts.filter("value <> 0").join(cells, "cell_id")
    x = x.withColumn("_r", average_rank(F.col("value"), "feature_id")).withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy("feature_id", "value")))
    s = x.groupBy("feature_id").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("value") < 0).cast("long")).alias("neg"), F.sum(F.when((F.col("grp") == 1) & (F.col("value") > 0), F.col("_r")).otherwise(0.0)).alias("rp"), F.sum(F.when((F.col("grp") == 1) & (F.col("value") < 0), F.col("_r")).otherwise(0.0)).alias("rn"), F.sum(F.when((F.col("grp") == 1) & (F.col("value") > 0), 1).otherwise(0)).alias("kp"), F.sum(F.when((F.col("grp") == 1) & (F.col("value") < 0), 1).otherwise(0)).alias("kn"), F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("ties"))
    s = features.select("feature_id").join(s, "feature_id", "left").na.fill(0).crossJoin(F.broadcast(size))  # one row
    n = F.col("n1") + F.col("n2")
    zero = n - F.col("k")
    z1 = F.col("n1") - F.col("kp") - F.col("kn")
    rank = F.col("rn") + F.col("rp") + F.col("kp") * zero + z1 * (F.col("neg") + (zero + 1) / 2)
    u = rank - F.col("n1") * (F.col("n1") + 1) / 2
    ties = F.col("ties") + (zero * zero * zero - zero).cast("double")
    var = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.when(n > 1, ties / (n * (n - 1))).otherwise(0.0))
    d = u - F.col("n1") * F.col("n2") / 2.0
    z = F.when(var > 0, (d - F.signum(d) * 0.5) / F.sqrt(var))
    return s.select("feature_id", u.alias("u"), z.alias("z")).withColumn("pvalue", F.coalesce(2 * normal_tail(-F.abs("z")), F.lit(1.0)))
