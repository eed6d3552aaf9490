import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from regionspark.llm import quality_rules as m


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cov), "n_chars": len(text), "n_lines": len(lines), "n_distinct_words": len(set(w))}


def test_stats():
    rng = random.Random(2)
    t = ["", None, "\n", "\n\n", "a", "a\n", "a\na", " a\na\n\na \na\n", "a b c a b c", "a a a a", "x|y <z> é#日 *", "a\r\na\r\n", "b\n\n\nb"]
    t += ["".join(rng.choice("ab é\n\t ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    got = m.text_stats(pa.array(t, pa.string()))
    for i, x in enumerate(t):
        assert {k: int(got[k][i]) for k in brute(x)} == brute(x), repr(x)
    assert all(len(v) == 0 for v in m.text_stats(pa.array([], pa.string())).values())


def test_rules_find_planted_classes():
    rng = np.random.default_rng(3)
    n = 3000
    x = {k: rng.random(n) for k in m.RATIOS}
    bad = (x["upper_share"] > 0.9) | ((x["symbols_per_word"] > 0.8) & (x["word_length"] <= 0.3))
    rules = m.learn_rules(x, bad, np.arange(n) % 3)
    got = np.logical_or.reduce([r.mask(x) for r in rules])
    assert (got & bad).sum() / bad.sum() > 0.9 and (got & ~bad).sum() / got.sum() < 0.05
    assert m.learn_rules(x, np.zeros(n, bool), np.arange(n) % 3) == []


def test_judge(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
        junk = i % 4 == 0
        rows.append((i, " ".join(x + "###" for x in w) if junk else " ".join(w), "x"))
        if i % 2 == 0:
            labels.append((i, 0 if junk else 1))
    rows += [(900, None, "x"), (901, "short", "x"), (902, "a b c " * 40, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    lab = spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")
    got = m.judge(docs, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.doc_id in (900, 901, 902))
        assert r.kept == (not r.base_failed and (r.doc_id % 4 != 0))
    assert all(r.kept for r in m.judge(docs, lab.limit(0)).collect() if not r.base_failed)
    assert m.judge(docs.limit(0), lab).collect() == []


def test_best_test_against_all_tests():
    rng = np.random.default_rng(11)
    for trial in range(30):
        n = 60
        x = {k: rng.integers(0, 8, n) / 4 if trial % 2 else rng.random(n) for k in list(m.RATIOS)[:4]}
        bad = rng.random(n) < (0.2 + 0.6 * (x["words"] > np.median(x["words"])))
        rows = np.flatnonzero(rng.random(n) < 0.8)
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        best = 0.0
        for k, v in x.items():
            for cut in np.unique(v[rows])[:-1]:
                for mask in (v[rows] <= cut, v[rows] > cut):
                    p, q = (bad[rows] & mask).sum(), (~bad[rows] & mask).sum()
                    if p >= m.MIN_COVER / 2:
                        best = max(best, p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))))
        t = m.best_test(x, bad, rows)
        mask = t.mask({t.feature: x[t.feature][rows]})
        p, q = (bad[rows] & mask).sum(), (~bad[rows] & mask).sum()
        assert np.isclose(p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))), best)


def test_rules_end_with_what_they_cover():
    """The list as sequential covering makes it: each rule's counts are of rows no earlier rule covers."""
    rng = np.random.default_rng(4)
    n = 3000
    x = {k: rng.random(n) for k in m.RATIOS}
    bad = np.logical_or.reduce([x[k] > 0.96 for k in list(x)[:6]])
    rules = m.learn_rules(x, bad, np.arange(n) % 3)
    free = np.ones(n, bool)
    for r in rules:
        hit = r.mask(x) & free
        assert r.rejected >= m.MIN_COVER and r.rejected / (r.rejected + r.wrongly) >= m.MIN_PRECISION
        assert (bad & hit).sum() >= r.rejected and len(r.tests) >= 1
        free &= ~hit
    got = np.logical_or.reduce([r.mask(x) for r in rules])
    assert len(rules) > 3 and (got & ~bad).sum() <= 0.1 * got.sum()
