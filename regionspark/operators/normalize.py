"""Normalisation and variable features over (feature_id, cell_id, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionspark.functions.columns import ratio
from regionspark.functions.lineage import cut, store
from regionspark.operators.running import with_ranks


def tfidf(counts: DataFrame, n_cells: int | None = None, method: int = 1, scale: float = 1e4, idf: DataFrame | None = None) -> DataFrame:
    """Term frequency times inverse document frequency. Methods: 1 log1p(tf idf scale); 2 tf log1p(idf);
    3 log1p(tf scale) log1p(idf); 4 value idf. A stated idf (feature_id, idf) is used as it is, without
    the log of methods 2 and 3; its zeros are an error."""
    if method not in (1, 2, 3, 4):
        raise ValueError("method is 1 to 4")
    counts = store(counts)  # read three times
    cell = counts.groupBy("cell_id").agg(F.sum("value").alias("_cell"))
    if idf is None:
        cells = F.lit(n_cells).cast("double") if n_cells is not None else None
        feature = counts.groupBy("feature_id").agg(F.sum("value").alias("_row"))
        if cells is None:
            feature = feature.crossJoin(F.broadcast(cell.agg(F.count(F.lit(1)).cast("double").alias("_n"))))  # one row
            cells = F.col("_n")
        feature = feature.select("feature_id", ratio(cells, F.col("_row")).alias("idf"))
    else:
        if idf.filter("idf = 0").limit(1).count():
            raise ValueError("idf has zeros")
        feature = idf.select("feature_id", "idf")
    tf = ratio(F.col("value"), F.col("_cell"), 0.0)
    weight = F.col("idf") if idf is not None else F.log1p("idf")
    value = {1: F.log1p(tf * F.col("idf") * scale), 2: tf * weight, 3: F.log1p(tf * scale) * weight, 4: F.col("value") * F.col("idf")}[method]
    return counts.join(cell, "cell_id").join(feature, "feature_id").select("feature_id", "cell_id", F.coalesce(value, F.lit(0.0)).alias("value"))


def top_features(features: DataFrame, counts: DataFrame, cutoff: int | str | None = "q5") -> DataFrame:
    """count, percentile (ecdf) and variable of every feature. cutoff: none, all are variable; a number,
    counts above it; ``qNN``, percentiles above NN per cent."""
    total = counts.groupBy("feature_id").agg(F.sum("value").alias("_c"))
    out = features.select("feature_id").join(total, "feature_id", "left").select("feature_id", F.coalesce("_c", F.lit(0)).alias("count"))
    out = with_ranks(cut(out), F.col("count"), ecdf="percentile")
    if cutoff is None:
        return out.withColumn("variable", F.lit(True))
    test = F.col("percentile") > int(cutoff[1:]) / 100 if isinstance(cutoff, str) else F.col("count") > cutoff
    return out.withColumn("variable", test)


def pearson_residual_variance(features: DataFrame, counts: DataFrame, n_cells: int, theta: float = 10.0) -> DataFrame:
    """Variance (over n) of clipped Pearson residuals of each feature, from its non-zeros and the number
    of its zeros: the matrix stays sparse."""
    total = counts.groupBy("feature_id").agg(F.sum("value").alias("_t"))
    n, clip = F.lit(float(n_cells)), F.sqrt(F.lit(float(n_cells)))
    mean = total.withColumn("_mu", F.col("_t") / n).withColumn("_sd", F.sqrt(F.col("_mu") + F.col("_mu") * F.col("_mu") / theta))
    cut = lambda x: F.least(F.greatest(x, -clip), clip)
    r = cut((F.col("value") - F.col("_mu")) / F.col("_sd"))
    x = counts.filter("value <> 0").join(mean.filter("_sd > 0"), "feature_id").groupBy("feature_id", "_t", "_mu", "_sd").agg(F.sum(r).alias("_s"), F.sum(r * r).alias("_q"), F.count(F.lit(1)).alias("_k"))
    zero = cut(-F.col("_mu") / F.col("_sd"))
    s, q = F.col("_s") + (n - F.col("_k")) * zero, F.col("_q") + (n - F.col("_k")) * zero * zero
    got = x.select("feature_id", F.col("_t").alias("_count"), (q / n - (s / n) * (s / n)).alias("_v"))
    return features.select("feature_id").join(got, "feature_id", "left").select("feature_id", F.coalesce("_count", F.lit(0)).alias("count"), F.coalesce("_v", F.lit(0.0)).alias("residual_variance"))


def rank_by_residual_variance(variance: DataFrame, min_counts: float = 10, n: int = 20_000) -> DataFrame:
    """The n most variable features among those of more than min_counts, with average ranks."""
    ok = with_ranks(cut(variance.filter(F.col("count") > min_counts)), -F.col("residual_variance"), rank="rank")
    return ok.orderBy("rank", "feature_id").limit(n)


def _loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic regression with tricube weights."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    k = max(3, int(np.ceil(span * len(x))))
    out = np.empty(len(at))
    for i, p in enumerate(at):
        lo = max(0, min(int(np.searchsorted(x, p)) - k // 2, len(x) - k))
        while lo + k < len(x) and x[lo + k] - p < p - x[lo]:
            lo += 1
        while lo > 0 and p - x[lo - 1] < x[lo + k - 1] - p:
            lo -= 1
        u, v = x[lo : lo + k] - p, y[lo : lo + k]
        w = np.clip(1 - (np.abs(u) / max(np.abs(u).max(), 1e-12)) ** 3, 0, 1) ** 1.5
        a = np.stack([np.ones_like(u), u, u * u], 1) * w[:, None]
        out[i] = np.linalg.lstsq(a, v * w, rcond=None)[0][0]
    return out


def mean_variance(features: DataFrame, counts: DataFrame, n_cells: int, bins: int = 1000, per_bin: int = 50, span: float = 0.1, weight_mean: float = 0.0, min_mean: float | None = None, seed: int = 1234) -> DataFrame:
    """Residual of log1p(variance) from its local regression on log1p(mean), and the rank of features by
    residual and mean. The curve is fitted on at most per_bin features of each of ``bins`` bins of the
    mean (50,000 by default), and interpolated for all."""
    from pyspark.sql import Window

    s = counts.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = float(n_cells)
    x = features.select("feature_id").join(s, "feature_id", "left").na.fill(0, ["s", "q"])
    x = x.select("feature_id", (F.col("s") / n).alias("mean"), F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / n) / max(n - 1, 1)).alias("variance"))
    x = x.withColumns({"log_mean": F.log1p("mean"), "log_variance": F.log1p("variance")})
    used = x.filter("mean > 0" if min_mean is None else f"mean > {min_mean}")
    lo, hi = used.agg(F.min("log_mean"), F.max("log_mean")).first()
    if lo is None:
        return x.withColumns({"residual": F.lit(None).cast("double"), "rank": F.lit(None).cast("double")})
    b = F.least(F.floor((F.col("log_mean") - lo) / max(hi - lo, 1e-12) * bins), F.lit(bins - 1))
    pick = Window.partitionBy("b").orderBy(F.xxhash64("feature_id", F.lit(seed)), "feature_id")
    fit = used.withColumn("b", b).withColumn("n", F.row_number().over(pick)).filter(F.col("n") <= per_bin).select("log_mean", "log_variance").toPandas()
    grid = np.linspace(lo, hi, min(256, max(2, len(fit))))
    curve = _loess(fit["log_mean"].to_numpy(), fit["log_variance"].to_numpy(), grid, max(span, min(1.0, 8 / max(len(fit), 1))))
    step = float(grid[1] - grid[0]) if len(grid) > 1 and grid[1] > grid[0] else 1.0
    y = F.array(*map(F.lit, map(float, curve)))
    i = F.least(F.greatest(F.floor((F.col("log_mean") - lo) / step), F.lit(0)), F.lit(len(grid) - 2)).cast("int")
    t = (F.col("log_mean") - lo) / step - i
    fitted = F.element_at(y, i + 1) * (1 - t) + F.element_at(y, i + 2) * t
    ok = used.withColumn("residual", F.col("log_variance") - fitted)
    ok = with_ranks(with_ranks(cut(ok), -F.col("mean"), rank="_by_mean"), -F.col("residual"), rank="_by_residual")
    ok = ok.withColumn("rank", weight_mean * F.col("_by_mean") + (1 - weight_mean) * F.col("_by_residual"))
    return x.join(ok.select("feature_id", "residual", "rank"), "feature_id", "left")
