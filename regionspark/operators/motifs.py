"""Motif matrices, scans and enrichment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionspark.functions.columns import ratio
from regionspark.operators import stats


def find_motifs(hits: DataFrame, query: DataFrame, background: DataFrame, method: str = "BH") -> DataFrame:
    """Motifs enriched in query features against background ones. hits: (feature_id, motif_id). p is
    P(X >= observed) of the hypergeometric; rows by p, then falling fold."""
    n = lambda d, a: d.select("feature_id").distinct().agg(F.count(F.lit(1)).alias(a))
    count = lambda d, a: hits.join(d.select("feature_id").distinct(), "feature_id", "left_semi").groupBy("motif_id").agg(F.count(F.lit(1)).alias(a))
    out = hits.select("motif_id").distinct().join(count(query, "observed"), "motif_id", "left").join(count(background, "background"), "motif_id", "left").na.fill(0)
    out = out.crossJoin(F.broadcast(n(query, "_q").crossJoin(n(background, "_b"))))  # one row
    po, pb = 100.0 * F.col("observed") / F.col("_q"), 100.0 * F.col("background") / F.col("_b")
    out = out.withColumns({"percent_observed": po, "percent_background": pb}).withColumn("fold_enrichment", ratio(F.col("percent_observed"), F.col("percent_background")))
    out = out.withColumn("pvalue", stats.hypergeometric_tail(F.col("observed"), F.col("background"), F.col("_b") - F.col("background"), F.col("_q")))
    return stats.adjust(out, method=method).select("motif_id", "observed", "background", "percent_observed", "percent_background", "fold_enrichment", "pvalue", "p_adjust")


def pfm_to_pwm(pfm: DataFrame, pseudo: float = 0.8, background: float = 0.25) -> DataFrame:
    """Log2 odds (motif_id, pos, base, score) from counts (motif_id, pos, base, n)."""
    total = pfm.groupBy("motif_id", "pos").agg(F.sum("n").alias("_t"))
    p = (F.col("n") + pseudo / 4) / (F.col("_t") + pseudo)
    return pfm.join(total, ["motif_id", "pos"]).select("motif_id", "pos", "base", F.log2(p / background).alias("score"))


def _matrices(pwm: DataFrame) -> dict[str, np.ndarray]:
    """The motif library on the driver: rows are positions x 4 of each motif, bounded by the library."""
    rows = pwm.toPandas()
    out = {}
    for k, own in rows.groupby("motif_id"):
        m = np.zeros((int(own["pos"].max()) + 1, 5))
        m[own["pos"], own["base"].map("ACGT".index)] = own["score"]
        m[:, 4] = -1e9
        out[k] = m
    return out


def _threshold(m: np.ndarray, p: float) -> float:
    """Least attained score that a random uniform sequence reaches with probability p at most, on a fine
    grid; less what rounding to the grid may have added."""
    step = 0.01
    low = np.floor(m[:, :4].min(1) / step).astype(int)
    dist = np.ones(1)
    for row, lo in zip(m[:, :4], low, strict=True):
        k = np.round(row / step).astype(int) - lo
        new = np.zeros(len(dist) + k.max())
        for i in k:
            new[i : i + len(dist)] += dist / 4
        dist = new
    tail = np.cumsum(dist[::-1])[::-1]
    at = next(iter(np.flatnonzero((tail <= p) & (dist > 0))), len(dist))
    return (at + low.sum() - len(m) / 2) * step


def scan(sequences: DataFrame, pwm: DataFrame, p_cutoff: float = 5e-5) -> DataFrame:
    """Hits of every motif on both strands: (feature_id, motif_id, offset, strand, score)."""
    mats = _matrices(pwm)
    cut = {k: _threshold(m, p_cutoff) for k, m in mats.items()}
    code = np.full(256, 4, np.uint8)
    for i, c in enumerate("ACGT"):
        code[ord(c)] = code[ord(c.lower())] = i

    def run(batches):
        for pdf in batches:
            rows = []
            for f, s in zip(pdf["feature_id"], pdf["sequence"], strict=True):
                x = code[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
                for k, m in mats.items():
                    n = len(x) - len(m) + 1
                    if n <= 0:
                        continue
                    back = np.concatenate([m[::-1, 3::-1], m[::-1, 4:]], 1)
                    for strand, mm in (("+", m), ("-", back)):
                        score = sum(mm[i][x[i : i + n]] for i in range(len(mm)))
                        for at in np.flatnonzero(score >= cut[k] - 1e-9):
                            rows.append((f, k, int(at), strand, float(score[at])))
            yield pd.DataFrame(rows, columns=["feature_id", "motif_id", "offset", "strand", "score"])

    return sequences.select("feature_id", "sequence").mapInPandas(run, f"feature_id {dict(sequences.dtypes)['feature_id']}, motif_id string, offset long, strand string, score double")


def motif_matrix(hits: DataFrame, what: str = "binary") -> DataFrame:
    """(feature_id, motif_id, value): binary, counts or the greatest score. Features without hits, also
    those of unknown chromosomes, have no entries: all zero."""
    value = {"binary": F.lit(1.0), "counts": F.count(F.lit(1)).cast("double"), "scores": F.max("score")}[what]
    return hits.groupBy("feature_id", "motif_id").agg(F.max(F.lit(1.0)).alias("value") if what == "binary" else value.alias("value"))


def create_motifs(hits: DataFrame, pwm: DataFrame | None = None, names: DataFrame | None = None, positions: DataFrame | None = None):
    """Motif slots after checks: names are unique, and pwm has the motifs of the matrix."""
    from regionspark.operators.assay import Motifs

    if names is not None and names.groupBy("motif_id").count().filter("count > 1").limit(1).count():
        raise ValueError("motif ids are not unique")
    if pwm is not None and hits.select("motif_id").distinct().join(pwm, "motif_id", "left_anti").limit(1).count():
        raise ValueError("motifs without a matrix")
    return Motifs(hits.select("feature_id", "motif_id").distinct(), pwm, names, positions)


def add_motifs(sequences: DataFrame, pfm: DataFrame, names: DataFrame | None = None, pvalue: float = 5e-5):
    """All that is added with motifs: the slots (hits, log odds, names, positions) and the features'
    region statistics. sequences: feature_id, sequence; pfm: motif_id, pos, base, n."""
    from regionspark.functions.lineage import cut
    from regionspark.operators.qc import region_stats

    pwm = pfm_to_pwm(pfm)
    found = cut(scan(sequences, pwm, pvalue))
    return create_motifs(found, pwm, names, found), region_stats(sequences)


def information_content(pfm: DataFrame) -> DataFrame:
    """What a motif logo is drawn from: (motif_id, pos, base, p, height)."""
    t = pfm.groupBy("motif_id", "pos").agg(F.sum("n").alias("_t"))
    p = ratio(F.col("n"), F.col("_t"))
    x = pfm.join(t, ["motif_id", "pos"]).withColumn("p", p)
    h = x.groupBy("motif_id", "pos").agg((2.0 + F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p") / math.log(2)).otherwise(0.0))).alias("_ic"))
    return x.join(h, ["motif_id", "pos"]).select("motif_id", "pos", "base", "p", (F.col("p") * F.col("_ic")).alias("height"))
