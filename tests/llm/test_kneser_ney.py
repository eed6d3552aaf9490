import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from regionspark.llm import kneser_ney as m


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")), None]


def brute(rows, order=2):
    train = [tokens(t) for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    big_n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    triples = Counter(p for t in train for p in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))
    after, total3 = defaultdict(list), Counter()
    for (a, b, _), n in triples.items():
        after[a, b].append(n)
        total3[a, b] += n
    if order == 3:
        pairs = Counter(p[1:] for p in triples)
    follow, total, ends = defaultdict(list), Counter(), Counter()
    for (a, b), n in pairs.items():
        follow[a].append(n)
        total[a] += n
        ends[b] += 1
    cc = lambda values: [sum(x == i for x in values) for i in (1, 2, 3, 4)]
    d2, d1 = m.discounts(*cc(pairs.values())), m.discounts(*cc(ends.values()))
    d3 = m.discounts(*cc(triples.values()))
    disc = lambda n, d: 0 if n == 0 else d[min(n, 3) - 1]
    out = []
    for k, t in rows:
        t = tokens(t)
        base = sum(math.log10((c[w] + 1) / (big_n + v + 1)) for w in t)
        score = 0.0
        for z, a, w in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False):
            p = max(ends[w] - disc(ends[w], d1), 0) / len(pairs) + sum(disc(x, d1) for x in ends.values()) / len(pairs) / (v + 1) if pairs else 1 / (v + 1)
            if total[a]:
                p = max(pairs[a, w] - disc(pairs[a, w], d2), 0) / total[a] + sum(disc(x, d2) for x in follow[a]) / total[a] * p
            if order == 3 and total3[z, a]:
                p = max(triples[z, a, w] - disc(triples[z, a, w], d3), 0) / total3[z, a] + sum(disc(x, d3) for x in after[z, a]) / total3[z, a] * p
            score += math.log10(p)
        out.append((k, len(t), sum(c[w] > 0 for w in t), big_n, base, score))
    return out


def check(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, order):
    rng = random.Random(5)
    voc = ["the", "The", "of", "être", "x"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(voc[: rng.randint(2, 45)]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words"), (7, rows[7][1]), (None, "the of")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, score int, n int").repartition(5)
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in m.score(df, order=order).collect()]
    check(got, brute(rows, order))
    assert m.score(df.limit(0), order=order).collect() == []
    few = [(k, t) for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 7 == 2][:3]
    d = spark.createDataFrame(few, "doc_id long, text string")
    check([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in m.score(d, order=order).collect()], brute(few, order))


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        k = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for c in (rng.integers(1, 9, len(k)), rng.integers(1, 10**12, len(k))):
            a, b = m._unpack(*m._pack(k, c))
            assert (a == k).all() and (b == c).all()


def test_counts_beyond_32_bits(tmp_path):
    import numpy as np

    from regionspark.llm import kneser_ney as m

    big = 2**33
    part = m._pack(np.array([5, 9], np.uint64), np.array([big, 3]))
    batch = m._batch(m._BLOB, [(0, 0, *part), (0, 0, *part)])
    done = next(m._store(f"file://{tmp_path}", "words")([batch])).to_pylist()[0]
    assert (done["n"], done["total"]) == (2, 2 * big + 6)
    assert m._open_counts(f"file://{tmp_path}/words-00000.n", 2).tolist() == [2 * big, 6]
    pair = m._pack(np.array([1 << 32 | 2, 2 << 32 | 1], np.uint64), np.array([big, 1]))
    rows = list(m._store_pairs(f"file://{tmp_path}", 1, 4)([m._batch(m._BLOB, [(0, 0, *pair)])]))
    list(m._store_sums(f"file://{tmp_path}", 1, 4)(rows))
    sums = m._open_counts(f"file://{tmp_path}/sums-00000", 20).reshape(-1, 5)
    assert sums[1].tolist() == [0, 0, 1, 1, big] and sums[2].tolist() == [1, 0, 0, 1, 1]
    assert m._open_counts(f"file://{tmp_path}/pairs-00000.n", 2).tolist() == [big, 1]


def test_order_three_knows_more(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(lines) for _ in range(20))) for i in range(60)], "doc_id long, text string")
    two, three = (sum(r.score for r in m.score(df, order=k).collect() if r.held_out) for k in (2, 3))
    assert three > two
    with pytest.raises(ValueError, match="order"):
        m.train(df, order=4)
