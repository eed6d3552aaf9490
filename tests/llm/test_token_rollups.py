import re

import pytest

from regionspark.llm.token_rollups import TokenRollups

COUNT = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z]+|[0-9]|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"}


def brute(docs):
    out = {}
    for _, s, la, t in docs:
        for v in ("words-1", "pieces-1", "bytes-1"):
            x = out.setdefault((s, la, v), [0, 0])
            x[0] += 1
            x[1] += len((t or "").encode()) if v == "bytes-1" else len(re.findall(COUNT[v], t or ""))
    return {k: tuple(v) for k, v in out.items()}


def test_batches(spark):
    rollups = TokenRollups(spark)
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollups.totals().collect()}
    assert totals() == {}
    one = [(1, "a", "en", "Hello, wörld 42"), (2, "a", None, None), (3, None, "de", ""), (3, None, "de", "x  y\tz"), (4, "b", "en", "q")]
    df = lambda rows: spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, lang string, text string, n_tokens int")
    assert rollups.commit("b1", df(one)) and totals() == brute(one)
    assert not rollups.commit("b1", df(one)) and totals() == brute(one)
    changes = [("delete", 2, "a", None, None), ("revise", 3, "c", "fr", "un deux"), ("insert", 5, "a", "en", "w w"), ("delete", 99, "a", "en", "")]
    cdf = spark.createDataFrame(changes, "change string, doc_id long, source string, lang string, text string")
    now = [one[0], one[4], (3, "c", "fr", "un deux"), (5, "a", "en", "w w")]
    assert rollups.commit("b2", cdf, op="change") and totals() == brute(now)
    assert not rollups.commit("b2", cdf, op="change")
    assert rollups.commit("b3", df(one).limit(0)) and totals() == brute(now)
    again = spark.createDataFrame([("revise", 3, "a", "en", "z")], "change string, doc_id long, source string, lang string, text string")
    assert rollups.commit("b4", again, op="change") and totals() == brute([*now[:2], (3, "a", "en", "z"), now[3]])


def test_unknown_ops_are_refused(spark):
    rollups = TokenRollups(spark)
    rollups.commit("b1", spark.createDataFrame([(1, "a", "en", "x y")], "doc_id long, source string, lang string, text string"))
    before = rollups.totals().collect()
    for op in (None, "INSERT", "upsert"):
        bad = spark.createDataFrame([("insert", 2, "a", "en", "q"), (op, 3, "a", "en", "q")], "op string, doc_id long, source string, lang string, text string")
        with pytest.raises(Exception, match="insert, delete or revise expected"):
            rollups.commit("b2", bad, op="op")
        assert rollups.committed() == ["b1"] and rollups.totals().collect() == before
    assert rollups.commit("b2", bad.filter("op = 'insert'"), op="op")


def test_hot_key_and_null_key(spark):
    rollups = TokenRollups(spark, buckets=3)
    rows = [(7, "a", "en", "x y")] * 300 + [(None, "a", "en", "z")] * 3 + [(k, "b", "de", "w") for k in range(10, 30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(4)
    rollups.commit("b1", df)
    log = spark.read.parquet(f"{rollups.folder}/documents/b1")
    assert log.filter("key = '7'").count() == 3  # one row for each tokenizer, not for each document
    gone = spark.createDataFrame([("delete", 7, "", "", ""), ("delete", None, "", "", ""), ("delete", 10, "", "", "")], "op string, doc_id long, source string, lang string, text string")
    rollups.commit("b2", gone, op="op")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rollups.totals().collect()} == brute(rows[304:])
