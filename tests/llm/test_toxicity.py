import random

import numpy as np
import pyarrow as pa

from regionspark.llm import toxicity as m


def test_composition_equals_reading_one_after_the_other():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(6) for _ in range(rng.randint(0, 15))]
        want = [1.0] * len(s)
        for t in (m.NEGATE, m.REPORTED, m.TARGETED):
            want = [a * w for a, (_, w) in zip(want, t.run(s), strict=True)]
        assert np.allclose([w for _, w in m.GRAMMAR.run(s)], want)


def test_grammar_weighs_context():
    i, t, n, r, o, x = m.INSULT, m.TARGET, m.NEGATION, m.REPORT, m.OTHER, m.THREAT
    score = lambda s: m.clause_score(s, [1.0] * len(s))
    assert score([t, o, i]) == score([i, o, t]) > score([o, i]) > score([r, o, i]) > score([n, i]) > 0
    assert score([x, t]) > score([x, o, o, o, o, t]) and score([o, t, n]) == 0 and score([]) == 0


def corpus(rng, n=1200):
    base = ["the", "day", "Haus", "grün", "maison", "señor", "walk", "paper", "river", "über", "were", "tree"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(base) + rng.choice(["", "er", "ing", "ñ"]) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["grolb", "grolber", "grolbä", "wexu", "wexura"]))
        docs.append((i, " ".join(w) + ".", "en", 1.0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_on_one_side_and_scores_the_other(spark):
    docs, labels = corpus(random.Random(2))
    docs += [(9001, None, "en", 1.0), (9002, "", "en", 1.0), (9003, "You stupid idiot, you pathetic moron!", "en", 1.0), (3, docs[3][1], "en", 1.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1), (4, None)], "doc_id long, toxic int")
    got = m.score(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert len(held) > 200 and sum(p == y for p, y in held) / len(held) > 0.97
    assert by[9003].predicted == 1 and by[9001].predicted == by[9002].predicted == 0
    model = m.fit(d, lab)
    assert {r.doc_id for r in m.drop_toxic(d, model).collect()} == {i for i, r in by.items() if not r.predicted}
    none = m.score(d, lab.limit(0)).collect()
    assert {r.doc_id: r.predicted for r in none}[9003] == 1 and sum(r.predicted for r in none) == 1
    assert m.score(d.limit(0), lab).collect() == []


def test_features_by_hand():
    seed = m._seed_hashes(m.INSULT)
    model = m.Model(seed, np.ones(len(seed)), (), m._seed_hashes(m.THREAT), {k: m._seed_hashes(k) for k in (m.TARGET, m.NEGATION, m.REPORT)})
    x = np.expm1(m.text_features(pa.array(["stupid plan. fine day. you clown", None, "fine"]), model))
    assert np.allclose(x[0, :3], [2.4, 1.4, 2]) and not x[1:].any()


def brute_terms(rows):
    """Terms and weights from labelled texts, by plain counting: whole words and beginnings of longer ones."""
    import math

    seen = {}
    for _, text, label in rows:
        own = set()
        for w in "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text).split():
            w = "".join(c.lower() if ord(c) < 128 else c for c in w)
            own |= {(0, w)} | {(k, w[:k]) for k in m.PREFIXES if len(w) > k}
        for t in own:
            seen.setdefault(t, [0, 0])[1 - label] += 1
    n_t, n_c = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
    toxic = {k: v for k, v in seen.items() if v[0]}
    out = {}
    for k, (t, c) in toxic.items():
        cells = [(o, n * (t + c) / (n_t + n_c) if yes else n * (1 - (t + c) / (n_t + n_c))) for o, n, yes in ((t, n_t, 1), (c, n_c, 1), (n_t - t, n_t, 0), (n_c - c, n_c, 0))]
        g2 = 2 * sum(o * math.log(o / e) for o, e in cells if o and e)
        ratio = math.log((t + 0.5) / (n_t + 1)) - math.log((c + 0.5) / (n_c + 1))
        if ratio > 2 and g2 >= 2 * math.log(len(toxic)) + 6:
            out[k] = ratio
    for w in (m.SEEDS[m.INSULT] + " " + m.SEEDS[m.THREAT]).split():
        t, c = toxic.get((0, w), (0, 0))
        ratio = math.log((t + 3) / (n_t + 10)) - math.log((c + 0.05) / (n_c + 10))
        if ratio > 1:
            out[0, w] = max(out.get((0, w), 0), min(ratio, 6.0))
    return out


def term_hash(length, word):
    from regionspark.llm._words import U64, mix, word_hashes

    raw = np.frombuffer(word.encode(), np.uint8)
    h = word_hashes(raw, np.array([0]), np.array([len(raw)]))
    return int((mix(h + U64(length)) if length else h)[0])


def test_fit_against_plain_counting(spark):
    docs, labels = corpus(random.Random(7), 500)
    label = dict(labels)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    import zlib

    rows = [(i, t, label[i]) for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    # texts of one label that share a sketch count once, by the smallest (signed) hash
    import xxhash

    sketch = next(m._sketch([pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], ["label", "text"])]))["sketch"].to_pylist()
    once = {}
    for r, s in zip(rows, sketch, strict=True):
        h = (xxhash.xxh64_intdigest(r[1], 42) + 2**63) % 2**64
        once[r[2], s] = min(once.get((r[2], s), (h, r)), (h, r))
    rows = [r for _, r in once.values()]
    want = {term_hash(*k): v for k, v in brute_terms(rows).items()}
    model = m.fit(d, lab)
    assert dict(zip(model.terms.tolist(), model.weights.round(9).tolist(), strict=True)) == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 40 and {term_hash(0, "grolber"), term_hash(4, "grol"), term_hash(5, "wexur")} <= set(want)
    # scores by hand from the model, and the same model from other partitions and with copies in the fit
    again = m.fit(d.union(d).repartition(2), lab)
    assert again.curve == model.curve and again.terms.tolist() == model.terms.tolist()
    x = m.text_features(pa.array([docs[0][1]]), model)[0]
    z = model.curve[0] + sum(a * b for a, b in zip(x, model.curve[1:], strict=True))
    got = [r.score for r in m.score_texts(d.filter("doc_id = 0").select("doc_id", "text"), model).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_empty_documents_and_clashing_columns(spark):
    docs, labels = corpus(random.Random(3), 60)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    d = spark.createDataFrame([(i, t, "x", 1, "y", 2.0) for i, t, *_ in docs], "doc_id long, text string, label string, sketch int, term string, predicted double")
    assert len(m.score(d, lab).collect()) == 60
    model = m.fit(d.limit(0), lab)
    assert m.drop_toxic(d, model).columns == d.columns and m.score(d.limit(0), lab).count() == 0
