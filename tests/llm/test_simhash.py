import random

import numpy as np
import pyarrow as pa
import xxhash

from regionspark.llm import simhash as m
from regionspark.llm.components import components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_classes(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(fps))]


def texts(rng, n=60):
    words = ["the", "of", "Älpha", "beta", "gamma-delta", "x", "y" * 40, "zeta,"]
    out = ["", None, " \t\n", "one", "two words", "The OF x", "Straße ÄB a b c d"]
    for _ in range(n):
        t = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
        out.append(" ".join(t))
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "changed"
            out.append("\n".join(t))
    return out


def test_fingerprints():
    t = texts(random.Random(3)) + [" ".join(str(i) for i in range(70000))]
    assert m.fingerprints(pa.array(t)).tolist() == [brute_fp(x) for x in t]
    assert m.fingerprints(pa.array(t[-1:])).tolist() == [brute_fp(t[-1])]


def test_golay_shares_within_two_bits():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 1 << 23, 3000)
    e = (1 << rng.integers(0, 23, 3000)) | (1 << rng.integers(0, 23, 3000))
    for x, y in zip(m.golay_indices(w), m.golay_indices(w ^ e), strict=True):
        assert (set(x) & set(y)) - {-1}


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 4000, dtype=np.int64).view(np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    both = []
    for fp in (x, y):
        key, row = m.candidate_keys(fp)
        got = [set() for _ in fp]
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            got[r].add(k)
        assert max(map(len, got)) <= 86
        both.append(got)
    assert all(a & b for a, b in zip(*both, strict=True))


def test_against_brute_force(spark):
    rng = random.Random(9)
    t = texts(rng, 120)
    t += [t[10]] * 40
    ids = rng.sample(range(1000), len(t))
    df = spark.createDataFrame([(i, x, "s", 1) for i, x in zip(ids, t, strict=True)], "doc_id int, text string, fp string, root int").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in m.digest(m.near_duplicates(df)).collect()}
    fps = [brute_fp(x) for x in t]
    want = brute_classes(fps, ids)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, want, strict=True)}
    assert m.near_duplicates(df.limit(0)).collect() == []


def test_chain_and_hot_run(spark):
    base = random.Random(4).getrandbits(64)
    chain = [base]
    for i in range(60):  # each step changes one bit: one class
        chain.append(chain[-1] ^ (1 << i))
    far = [random.Random(i).getrandbits(64) for i in range(50)]
    fp = np.array(chain + far, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in fp], "fp long")
    roots = {r.node: r.root for r in components(m.fingerprint_links(df)).collect()}
    assert len({roots[x] for x in fp[: len(chain)]}) == 1
    want = brute_classes([*chain, *far], list(range(len(fp))))
    assert len({roots.get(x, x) for x in fp}) == len(set(want))


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t"), (None, "a b c d e")], "doc_id long, text string")
    got = m.near_duplicates(df).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {1}


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(11)
    t = texts(rng, 40)
    rows = [(i % 50, x, f"s{i}") for i, x in enumerate(t + t[:20])] + [(3, t[3], "s3"), (None, t[5], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    kept = m.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    cls = brute_classes([brute_fp(r[1]) for r in rows], list(range(len(rows))))
    of = {(r[0], r[1]): c for r, c in zip(rows, cls, strict=True)}
    assert sorted(of[r.doc_id, r.text] for r in got) == sorted(set(cls))
    least = {}
    for r, c in zip(rows, cls, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert all(r.doc_id == least[of[r.doc_id, r.text]] for r in got)
