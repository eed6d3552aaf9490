"""Term enrichment of ranked genes, and peak sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionspark.functions.columns import parse_range
from regionspark.operators import ranges, stats


def ranked_genes(markers: DataFrame) -> DataFrame:
    """sign(log_fc) * -log10(p) of each gene and group; infinite ranks become the greatest finite one."""
    r = F.signum("log_fc") * -F.log10(F.when(F.col("pvalue") > 0, F.col("pvalue")))
    top = F.coalesce(F.max(r).over(Window.partitionBy("grp")), F.lit(0.0))
    low = F.coalesce(F.min(r).over(Window.partitionBy("grp")), F.lit(0.0))
    return markers.select("grp", "gene", F.coalesce(r, F.when(F.col("log_fc") >= 0, top).otherwise(low)).alias("rank"))


def enriched_terms(ranked: DataFrame, terms: DataFrame, n_perm: int = 200, top: int = 10, seed: int = 1234, max_padj: float = 0.05) -> DataFrame:
    """Gene-set enrichment of terms (term, gene) by group: running-sum score against permuted sets of the
    same size (a documented stand-in for an adaptive multilevel test); NES > 0 and adjusted p below
    max_padj, best ``top`` by NES. One group's genes, a genome at most, meet in a task."""
    sets = terms.groupBy("term").agg(F.collect_set("gene").alias("genes"))
    lib = {r.term: set(r.genes) for r in sets.toLocalIterator()}  # the term library

    def gsea(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "gene"], ascending=[False, True], ignore_index=True)
        w = np.abs(pdf["rank"].to_numpy())
        rng, out = np.random.default_rng(seed), []
        for term, genes in sorted(lib.items()):
            hit = pdf["gene"].isin(genes).to_numpy()
            k = int(hit.sum())
            if not k or k == len(hit):
                continue

            def score(h):
                up = np.cumsum(np.where(h, w, 0)) / max(w[h].sum(), 1e-300)
                d = up - np.cumsum(~h) / (len(h) - k)
                return d[np.abs(d).argmax()]

            es = score(hit)
            null = np.array([score(np.isin(np.arange(len(hit)), rng.choice(len(hit), k, replace=False))) for _ in range(n_perm)])
            same = null[np.sign(null) == np.sign(es)]
            nes = es / max(np.abs(same).mean() if len(same) else 1.0, 1e-12)
            out.append((pdf["grp"].iloc[0], term, float(es), float(nes), float((np.sum(np.abs(same) >= abs(es)) + 1) / (len(same) + 1))))
        return pd.DataFrame(out, columns=["grp", "term", "es", "nes", "pvalue"])

    got = ranked.groupBy("grp").applyInPandas(gsea, f"grp {dict(ranked.dtypes)['grp']}, term string, es double, nes double, pvalue double")
    w = Window.partitionBy("grp")
    got = got.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.rank().over(w.orderBy("pvalue")) + F.count(F.lit(1)).over(Window.partitionBy("grp", "pvalue")) - 1)
    got = got.withColumn("p_adjust", F.least(F.lit(1.0), F.min(F.col("pvalue") * F.col("_n") / F.col("_r")).over(w.orderBy(F.desc("_r")).rangeBetween(Window.unboundedPreceding, 0))))
    best = got.filter((F.col("nes") > 0) & (F.col("p_adjust") < max_padj)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("nes"), "p_adjust", "term")))
    return best.filter(F.col("_k") <= top).drop("_n", "_r", "_k")


def combine_peaks(peaks: DataFrame) -> DataFrame:
    """Reduce peaks called by group (chrom, start, end, ident); peak_called_in lists the groups."""
    joined = ranges._islands(peaks, ["chrom"], 1)
    return joined.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.sort_array(F.collect_set("ident")), ",").alias("peak_called_in")).drop("_island")


def poisson_tail(k: int, rate: float) -> float:
    """P(X >= k) of a Poisson count. Terms fall from the summed side's first one on, so the sum runs until
    they no longer add to it: upwards from k above the rate, else one less the sum downwards from k - 1."""
    if k <= 0:
        return 1.0
    if rate <= 0:
        return 0.0
    up = k > rate
    i = k if up else k - 1
    scale = i * math.log(rate) - rate - math.lgamma(i + 1)
    term = total = 1.0
    while term > total * 1e-17:
        if up:
            i += 1
            term *= rate / i
        else:
            term *= i / rate
            i -= 1
        total += term
    part = min(math.exp(min(scale + math.log(total), 0.0)), 1.0)
    return part if up else 1.0 - part


def call_peaks_poisson(fragments: DataFrame, genome_size: float, width: int = 200, shift: int = 100, q: float = 0.05, min_count: int = 3) -> DataFrame:
    """A native caller, not equal to the external one: cut sites widened to ``width``, tiles of half a
    width above the genome-wide Poisson rate at adjusted p < q, neighbours merged."""
    half = width // 2
    cuts = fragments.select("chrom", F.explode(F.array("start", "end")).alias("pos"))
    tiles = cuts.groupBy("chrom", F.floor(F.col("pos") / half).alias("tile")).agg(F.count(F.lit(1)).alias("n"))
    total = cuts.count()
    rate = total * half / genome_size

    @F.pandas_udf("double")
    def tail(n: pd.Series) -> pd.Series:
        known = {k: poisson_tail(int(k), rate) for k in n.unique()}
        return n.map(known).astype("float64")

    hot = tiles.filter(F.col("n") >= min_count).withColumn("pvalue", tail(F.col("n").cast("double")))
    hot = stats.adjust(hot, method="bonferroni").filter(F.col("p_adjust") < q)
    return ranges.reduce(hot.select("chrom", (F.col("tile") * half + 1).alias("start"), ((F.col("tile") + 1) * half).alias("end")))


def feature_names_to_ranges(features: DataFrame, name: str = "name", sep=("-", "-")) -> DataFrame:
    return features.withColumn("_r", parse_range(F.col(name), sep)).select("*", "_r.*").drop("_r")
