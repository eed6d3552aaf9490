"""Operators that no SQL expresses, on small inputs with a known answer."""

import gzip
import random

import numpy as np
import pytest

from regionspark.functions.columns import correlation
from regionspark.operators import assay, enrich, mito, normalize, stats
from regionspark.operators.running import with_ranks
from regionspark.sources import genomics


def test_clonotypes_of_planted_clones(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", f"v{i % 3}_{k}", rng.uniform(0.2, 1.0)) for i in range(45) for k in range(6) if rng.random() < 0.8 or k == 0]
    got = {r.cell_id: r.clonotype for r in mito.find_clonotypes(spark.createDataFrame(rows, "cell_id string, variant string, frequency double"), 5).collect()}
    assert len(got) == 45
    for clone in range(3):
        own = {got[f"c{i}"] for i in range(clone, 45, 3)}
        other = {got[f"c{i}"] for i in range(45) if i % 3 != clone}
        assert not own & other


def test_match_region_stats_moves_the_pool_to_the_query(spark):
    rng = np.random.default_rng(2)
    pool = [(i, float(x)) for i, x in enumerate(rng.normal(50, 10, 3000))]
    query = [(i, float(x)) for i, x in enumerate(rng.normal(60, 3, 400))]
    df = lambda rows: spark.createDataFrame(rows, "feature_id long, gc double")
    got = stats.match_region_stats(df(query), df(pool), ["gc"], 200).select("feature_id", "gc").collect()
    assert len({r.feature_id for r in got}) == 200 and {tuple(r) for r in got} <= set(pool)
    x = np.array([r.gc for r in got])
    assert abs(x.mean() - 60) < 1 and 2 < x.std() < 5
    again = stats.match_region_stats(df(query).repartition(5), df(pool).repartition(3), ["gc"], 200).select("feature_id", "gc").collect()
    assert sorted(again) == sorted(got)


def test_planted_term_is_enriched(spark):
    ranked = spark.createDataFrame([("a", f"g{i}", float(100 - i)) for i in range(200)], "grp string, gene string, rank double")
    terms = [("top", f"g{i}") for i in range(15)] + [("low", f"g{i}") for i in range(180, 200)] + [("mixed", f"g{i}") for i in range(0, 200, 12)]
    got = enrich.enriched_terms(ranked, spark.createDataFrame(terms, "term string, gene string")).collect()
    assert [r.term for r in got][:1] == ["top"] and "low" not in {r.term for r in got} and got[0].es > 0.9


def test_mean_variance_finds_the_variable_features(spark):
    rng = np.random.default_rng(3)
    rows = []
    for f in range(300):
        mean = rng.uniform(1, 8)
        x = rng.poisson(mean, 60) if f % 50 else np.where(rng.random(60) < 0.5, 0, rng.poisson(2 * mean, 60))
        rows += [(f, c, float(v)) for c, v in enumerate(x) if v]
    counts = spark.createDataFrame(rows, "feature_id long, cell_id long, value double")
    got = normalize.mean_variance(spark.range(300).withColumnRenamed("id", "feature_id"), counts, 60).orderBy("rank").select("feature_id").limit(6).collect()
    assert {r.feature_id for r in got} == set(range(0, 300, 50))


def test_variants_of_a_planted_table(spark):
    """Six variants by hand: two that few cells carry with confidence (heteroplasmic), one that all have."""
    rows = []
    for c in range(20):
        for pos in range(1, 7):
            alt = {1: 10 if c < 4 else 0, 2: 9 if c in (5, 6, 7) else 0, 3: 20}.get(pos, 0)
            ref = 20 - alt
            rows += [(pos, f"c{c}", "A", ref // 2, ref - ref // 2)] if ref else []
            rows += [(pos, f"c{c}", "G", alt // 2, alt - alt // 2)] if alt else []
    counts = spark.createDataFrame(rows, "pos long, cell_id string, base string, fwd long, rev long")
    ref = spark.createDataFrame([(p, "A") for p in range(1, 7)], "pos long, ref string")
    cells = spark.createDataFrame([(f"c{c}",) for c in range(20)], "cell_id string")
    got = {r.variant: r for r in mito.high_confidence(mito.identify_variants(counts, ref, cells), min_cells=3).collect()}
    assert set(got) == {"1A>G", "2A>G", "3A>G"}
    assert (got["1A>G"].n_cells_conf_detected, got["1A>G"].mean, got["1A>G"].n_cells_over_20) == (4, 0.1, 4)
    assert got["3A>G"].mean == 1.0 and got["3A>G"].variance == 0.0 and got["3A>G"].strand_correlation is None
    assert got["1A>G"].variance == pytest.approx(np.var([0.5] * 4 + [0.0] * 16, ddof=1), abs=1e-7)


def test_read_mito(spark, tmp_path):
    for b, lines in {"A": "1,x,2,3\n2,y,0,1\n", "C": "1,y,5,0\n", "G": "", "T": "2,x,1,1\n"}.items():
        with gzip.open(tmp_path / f"s.{b}.txt.gz", "wt") as f:
            f.write(lines)
    (tmp_path / "s_refAllele.txt").write_text("1 a\n2 t\n")
    (tmp_path / "s.depthTable.txt").write_text("x\t12.5\ny\t3\n")
    counts, ref, depth = genomics.read_mito(spark, str(tmp_path))
    assert sorted(map(tuple, counts.collect())) == [(1, "x", "A", 2, 3), (1, "y", "C", 5, 0), (2, "x", "T", 1, 1), (2, "y", "A", 0, 1)]
    assert sorted(map(tuple, ref.collect())) == [(1, "A"), (2, "T")] and sorted(map(tuple, depth.collect())) == [("x", 12.5), ("y", 3.0)]


def test_ranks_against_brute_force(spark):
    rng = random.Random(4)
    values = [rng.choice([None, 0.0, 1.5, -2.0, 7.0, rng.random()]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(5)
    key = lambda v: (v is not None, v or 0.0)
    got = {r.id: (r.r, r.e) for r in with_ranks(df, df.v, rank="r", ecdf="e").collect()}
    for i, v in enumerate(values):
        below, same = sum(key(x) < key(v) for x in values), sum(key(x) == key(v) for x in values)
        assert got[i] == (below + (same + 1) / 2, (below + same) / 500)
    assert with_ranks(df.limit(0), df.v, rank="r").collect() == []


def test_adjusted_p_against_brute_force(spark):
    rng = random.Random(5)
    p = [rng.choice([0.001, 0.02, 0.02, 0.5, rng.random(), 1.0]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(p)), "id long, pvalue double").repartition(6)
    order = sorted(range(200), key=lambda i: -p[i])
    want, low = {}, 1.0
    for k, i in enumerate(order):
        low = min(low, p[i] * 200 / (200 - k))
        want[i] = low
    for i in range(200):  # equal p values share the least
        want[i] = min(want[j] for j in range(200) if p[j] == p[i])
    got = {r.id: r.p_adjust for r in stats.adjust(df).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in range(200))
    got = {r.id: r.p_adjust for r in stats.adjust(df, method="bonferroni").collect()}
    assert all(got[i] == pytest.approx(min(1.0, p[i] * 200)) for i in range(200))


def test_correlation_of_what_does_not_vary(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 9.0), ("b", 3.0, 6.0)], "k string, x double, y double")
    got = {r.k: r.c for r in df.groupBy("k").agg(correlation(df.x, df.y).alias("c")).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_creation_warns_of_overlapping_features(spark):
    counts = spark.createDataFrame([("f1", "c", 1.0), ("f2", "c", 1.0)], "feature_id string, cell_id string, value double")
    df = lambda end: spark.createDataFrame([("f1", "x", 1, end), ("f2", "x", 11, 20)], "feature_id string, chrom string, start long, end long")
    with pytest.warns(UserWarning, match="overlap"):
        assay.create_assay(counts, df(11), check_disjoint=True)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assay.create_assay(counts, df(10), check_disjoint=True)
