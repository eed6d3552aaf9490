import random

import corpus_pipeline
from tests.llm.test_decontaminate import least_distance, words
from tests.llm.test_simhash import brute_classes, brute_fp
from tests.llm.test_token_output import brute


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(8)
    voc = [f"{a}{b}" for a in "bcdfgklm" for b in ("al", "er", "on", "ish", "ty")]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        docs.append([i, text(rng.randint(30, 90)), rng.choice(["a", "a", "b", None])])
    bench = [(j, text(20)) for j in range(5)]
    toxic = set(range(0, 60, 3))
    for i in toxic:
        docs[i][1] += " idiot moron scum " + rng.choice(["stupid", "loser"])
    for i in range(200, 205):
        docs[i][1] += " " + bench[i - 200][1]
    for i in range(250, 260):
        docs[i][1] = docs[100][1]
    labels = [(i, int(i in toxic), 1) for i in range(300)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, source string"), ("labels", labels, "doc_id long, toxic int, quality int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != "token_output":
            assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = d.collect()
    assert {r.doc_id for r in seen["toxicity"]} == set(range(300)) - toxic
    before = seen["toxicity"]
    classes = brute_classes([brute_fp(r.text) for r in before], [r.doc_id for r in before])
    assert sorted(r.doc_id for r in seen["simhash"]) == sorted(set(classes))
    clean = [r for r in seen["simhash"] if all(least_distance(words(b), words(r.text)) > 4 for _, b in bench)]
    assert sorted(seen["decontamination"], key=lambda r: r.doc_id) == sorted(clean, key=lambda r: r.doc_id) and len(clean) == len(seen["simhash"]) - 5
    assert {r for r in seen["mixing"]} <= set(clean)
    total = sum(len(r.text.split()) for r in clean)
    assert abs(sum(len(r.text.split()) for r in seen["mixing"]) - total) < 300
    got = sorted(map(tuple, seen["token_output"]), key=lambda r: r[1])
    assert got == brute([(r.doc_id, r.text) for r in seen["mixing"]])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1]) == got


def test_copies_are_shared_out(spark):
    from regionspark.llm.mixing import mix_sources, take_copies

    rows = [(1, "a b c", "x", i) for i in range(5)] + [(i, "w " * i, "y", 0) for i in range(20)] + [(None, "q", "z", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    mixed = mix_sources(d)
    out = take_copies(d, mixed)
    assert out.columns == d.columns
    assert out.count() == mixed.selectExpr("sum(copies)").first()[0]
    assert max(r["count"] for r in out.groupBy(*d.columns).count().collect()) <= 3
