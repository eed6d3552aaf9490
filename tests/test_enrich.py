from math import exp, fsum, lgamma, log, sqrt

import pytest

from regionspark.operators import enrich


@pytest.mark.parametrize("rate", [10, 1000, 100_000])
def test_poisson_tail_against_brute_force(rate):
    top = rate + int(60 * sqrt(rate)) + 100
    terms = [exp(i * log(rate) - rate - lgamma(i + 1)) for i in range(top)]
    for k in {0, 1, rate // 2, int(rate * 0.9), rate - 1, rate, rate + 1, rate + int(3 * sqrt(rate)), rate + int(8 * sqrt(rate))}:
        assert enrich.poisson_tail(k, rate) == pytest.approx(fsum(terms[k:]), rel=1e-6)


def test_tiles_below_the_rate_are_no_peaks(spark):
    # 1,000 cuts a tile on average; one tile holds 400 and one 3,000
    cuts = spark.range(20).selectExpr("'c' AS chrom", "id", "CASE id WHEN 3 THEN 200 WHEN 7 THEN 1500 ELSE 465 END AS k")
    f = cuts.selectExpr("chrom", "id * 100 + 10 AS start", "id * 100 + 20 AS end", "explode(sequence(1, k)) AS i")
    total = 2 * f.count()
    got = enrich.call_peaks_poisson(f, total * 100 / 1000).collect()
    assert [(r.start, r.end) for r in got] == [(701, 800)]
