import random
import re

import numpy as np
import pytest

from regionspark.llm import decontaminate as m


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))


def least_distance(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for w in t:
        cur = [0]
        for i, x in enumerate(p):
            cur.append(min(prev[i] + (x != w), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
        best = min(best, prev[-1])
    return best


def corpus(rng):
    voc = ["the", "of", "a", "b", "être", "x1", "end."] + [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 3, 5, 9, 15, 40, 70, 100])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[5][1]), (103, "...")]
    docs = []
    for i in range(150):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 120))]
        if i % 2:
            p = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, max(1, len(p) // 3))):
                j = rng.randrange(len(p) + 1)
                rng.choice([lambda: p.insert(j, "new"), lambda: p.pop(min(j, len(p) - 1)) if len(p) > 1 else None, lambda: p.__setitem__(min(j, len(p) - 1), "other")])()
            j = rng.randint(0, len(w))
            w = w[:j] + [x.upper() + rng.choice(["", "!!", ","]) if rng.random() < 0.5 else x for x in p] + w[j:]
        docs.append((i, (" " if i % 3 else "\n").join(w), "s", i))
    return items, docs + [(500, None, "s", 1), (501, "", "s", 1), (1, docs[1][1], "s", 1)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_against_dynamic_programming(spark, block_bytes):
    items, docs = corpus(random.Random(4))
    d = spark.createDataFrame(docs, "doc_id int, text string, item_id string, distance int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in m.find_contamination(d, b, block_bytes=block_bytes).collect())
    want = []
    for i, t, *_ in docs:
        for k, p in items:
            p = words(p)
            if p and (x := least_distance(p, words(t))) <= int(0.2 * len(p)):
                want.append((i, k, x))
    assert got == sorted(want) and len({x[2] for x in want}) > 3
    clean = sorted(r.doc_id for r in m.drop_contaminated(d, b, block_bytes=block_bytes).collect())
    hit = {w[0] for w in want}
    assert clean == sorted(i for i, *_ in docs if i not in hit)
    assert m.drop_contaminated(d, b).columns == d.columns


def test_span_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "zero one Two, three four five six seven")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "two three extra four five six")], "item_id long, text string")
    assert [tuple(r) for r in m.find_contamination(d, b).collect()] == [(1, 7, 1, 2, 6)]
    assert m.find_contamination(d, b.limit(0)).collect() == [] and m.find_contamination(d.limit(0), b).collect() == []
    assert m.drop_contaminated(d, b.limit(0)).count() == 1


def test_long_and_short_patterns_agree():
    rng = np.random.default_rng(2)
    for _ in range(200):
        p, t = rng.integers(0, 6, rng.integers(1, 64)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 90)).astype(np.uint64)
        for anchored in (False, True):
            d, e = m.approximate(p, t, np.array([0]), np.array([len(t)]), 9, anchored)
            assert (int(d[0]), int(e[0])) == m._approximate_long(p, t, anchored)
        assert m.approximate(p, t, np.array([0]), np.array([len(t)]), 9)[0][0] == least_distance(p.tolist(), t.tolist())
