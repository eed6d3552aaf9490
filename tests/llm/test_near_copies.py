import random

import corpus_pipeline
from regionspark.llm import near_copies as m


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def corpus(rng):
    rows = []
    for _ in range(60):
        base = [rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(rng.randint(20, 300))]
        for edits in (0, 1, 1, 3, 8):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = "changed" + str(rng.randrange(9))
            rows.append(" ".join(t))
    return [*rows, *rows[:20], "", None, " ", "One two", "one  TWO"]


def want(rows):
    return sorted(i for i, x in rows if not any(j < i and similar(x, y) for j, y in rows))


def test_stage_against_brute_force(spark):
    t = corpus(random.Random(5))
    rows = list(zip(random.Random(6).sample(range(5000), len(t)), t, strict=True))
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(5)
    got = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == want(rows)
    assert corpus_pipeline.near_dedup_stage(spark, df.limit(0), "").collect() == []


def test_large_group_takes_rounds(spark):
    # one common passage, own endings: 70 of similarity below 0.8 among themselves, each with a near copy
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(70):
        t = passage + [f"q{i}x{k}" for k in range(25)]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join([*t, f"end{i}"]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in m.keep_one(df).collect()) == want(rows) == list(range(0, 140, 2))


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t"), (None, "a b c d e f"), (None, "u v")]
    got = m.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a b c d e f"), (1, "q r s t"), (None, "u v")]


def test_bound_loses_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (20, 150, 3000):
        base = rng.integers(0, 2**32, n, dtype=np.uint32)
        sets = []
        for _ in range(40):
            keep = rng.random(n) < rng.uniform(0.8, 1)
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**32, int((~keep).sum()), dtype=np.uint32)])))
        size = np.array([len(x) for x in sets])
        bins = np.stack([np.frombuffer(m.bins_of(x) or bytes(256), np.uint8) for x in sets])
        known = np.array([bool(m.bins_of(x)) for x in sets])
        i, j = np.triu_indices(40, 1)
        may = m.may_be_similar(size[i], bins[i], known[i], size[j], bins[j], known[j])
        alike = np.array([len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
        assert not (alike & ~may).any() and alike.any() and (n > 1000 or (~may).any())


def test_large_group_of_many_edits(spark):
    """One base and 300 edited copies of one to eight edits: as on brute force, through the large bands."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(i % 8 + 1):
            t[rng.randrange(len(t))] = f"e{rng.randrange(4000)}"
        rows.append((i * 3 + 1, " ".join(t)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in m.keep_one(df).collect())
    assert got == want(rows) and 20 < len(got) < 280


def test_fingerprints_find_what_shares_no_band(spark):
    """A passage ten times over and two endings: similarity 0.8, no band in common, at most four bits apart."""
    import numpy as np
    import pyarrow as pa

    from regionspark.llm.simhash import fingerprints

    rows = []
    for i in (14843, 17159, 18017, 47925):
        passage = [f"w{i}x{k}" for k in range(40)] * 10
        rows += [(2 * i + n, " ".join(passage + [f"{end}{i}x{k}" for k in range(5)])) for n, end in enumerate("ab")]
    text = pa.array([x for _, x in rows])
    keys, fp = m.band_keys(*m.shingle_sets(text)), fingerprints(text, m.SHINGLE)
    assert not (keys[::2] == keys[1::2]).any() and (np.bitwise_count(fp[::2] ^ fp[1::2]) <= 4).all()
    assert all(similar(a, b) for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == want(rows) == [i for i, _ in rows[::2]]


def test_near_fingerprints_alone_take_nothing(spark):
    """One passage many times over, with endings that outweigh it as sets: near fingerprints, below 0.8."""
    from regionspark.llm.simhash import near_duplicates

    passage = [f"p{k}" for k in range(20)] * 40
    rows = [(i, " ".join(passage + [f"e{i}x{k}" for k in range(12)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(df, shingle=m.SHINGLE).select("root").distinct().count() < 10
    assert sorted(r.doc_id for r in m.keep_one(df).collect()) == want(rows) == list(range(40))


def test_similar_rows_of_one_id_keep_one(spark):
    """Both steps and both kinds of band order rows that share an id alike, so one of two stays."""
    rows = []
    for i in range(16):
        t = [f"w{i}x{k}" for k in range(60)] * 3
        rows += [(i, " ".join([*t, "a"])), (i, " ".join([*t, "b"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in m.keep_one(df).collect()) == list(range(16))
