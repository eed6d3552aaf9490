import random
import re

import numpy as np
import pytest

from regionspark.llm import mixing as m


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {s: 0.0 for s in names}, float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        share, total = left, sum(w[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            out[s] += share * w[s] / total
        for s in list(free):
            if out[s] >= cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                free.discard(s)
    return out


def rows(n=900, seed=1):
    rng = random.Random(seed)
    src = ["big"] * 6 + ["a", "ä", "zz", None, "b c", "tiny"]
    out = []
    for i in range(n):
        s = rng.choice(src)
        k = 1 if s == "tiny" and i % 5 else rng.randint(0, 60)
        out.append((i, None if rng.random() < 0.02 else " ".join(["w"] * k) + rng.choice(["", "\n", " \t"]), s, 7))
    return out + [(1, "same row", "a", 7)] * 3 + [(5000, "", "empty", 1)]


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 1000, 500).tolist()
    p0 = [0.37] * 500
    p = m.fly(size, list(p0), np.random.default_rng(2), False)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(sum(p0)) and np.dot(p, size) == pytest.approx(np.dot(p0, size))
    p = m.fly(size, list(p0), np.random.default_rng(2), True)
    assert set(p) <= {0.0, 1.0} and abs(np.dot(p, size) - np.dot(p0, size)) <= max(size)
    assert m.fly([5, 5, 5, 5], [0.5] * 4, np.random.default_rng(3), True).count(1.0) == 2
    assert m.fly([], [], np.random.default_rng(3), True) == []
    mean = np.mean([m.fly(size[:9], [0.3] * 9, np.random.default_rng(i), True) for i in range(4000)], 0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int").repartition(4)
    got = m.mix_sources(df, block=64).collect()
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    assert len(got) == len(data)
    taken = {}
    for r in got:
        s = None if r.skey == "n" else r.skey[1:]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, x in taken.items():
        assert abs(x - want[s]) <= 61, s
    again = m.mix_sources(df.repartition(7), block=64).collect()
    assert sorted(again) == sorted(got)
    assert m.mix_sources(df.limit(0)).collect() == []
