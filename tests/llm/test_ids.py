"""Null ids and ids beyond the whole numbers of a double, in one block, and ids of text, in every operator."""

import public_tokenizers
import pytest

from regionspark.llm import decontaminate, kneser_ney, mixing, near_copies, quality_rules, secrets, simhash, token_output, token_rollups, toxicity

BIG = 2**60
IDS = [None, BIG + 1, BIG + 3, BIG + 5, 4]
ITEM = "one two three four five six seven eight nine ten"


def labels(spark, kind="long"):
    return spark.createDataFrame([(str(BIG + 1) if kind == "string" else BIG + 1, 0, 1), (None, 0, 1), ("9" if kind == "string" else 9, 1, 0)], f"doc_id {kind}, quality int, toxic int")


def rollup(df, spark):
    r = token_rollups.TokenRollups(spark)
    r.commit("a", df)
    return spark.read.parquet(f"{r.folder}/documents/a").filter("tokenizer_version = 'words-1'").selectExpr("cast(key as long) doc_id")


OPERATORS = {
    "secrets": lambda df, spark: secrets.digest(secrets.BlobLedger(spark).scan(df, ["doc_id"], "text")),
    "rollups": rollup,
    "kneser_ney": lambda df, spark: kneser_ney.score(df),
    "quality": lambda df, spark: quality_rules.judge(df, labels(spark)),
    "toxicity": lambda df, spark: toxicity.score(df, labels(spark)),
    "tokens": lambda df, spark: token_output.token_output(df, public_tokenizers.path("word_bpe_49k.json")),
    "decontaminate": lambda df, spark: decontaminate.find_contamination(df, spark.createDataFrame([(BIG + 7, ITEM)], "item_id long, text string")),
    "mixing": lambda df, spark: mixing.mix_sources(df),
    "simhash": lambda df, spark: simhash.near_duplicates(df),
    "near_copies": lambda df, spark: near_copies.keep_one(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids(spark, name):
    texts = [f"{ITEM} and words {'abc' * (i + 1)} of its own, text {i} q{i} w{i}" for i in range(len(IDS))]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in zip(IDS, texts, strict=True)], "doc_id long, text string, source string, lang string").coalesce(1)
    got = [r.doc_id for r in OPERATORS[name](df, spark).select("doc_id").collect()]
    assert sorted(got, key=lambda x: (x is not None, x or 0)) == sorted(IDS, key=lambda x: (x is not None, x or 0))


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("secrets", "rollups")])
def test_ids_of_text_are_refused(spark, name):
    df = spark.createDataFrame([("x1", "a b", "s", "en")], "doc_id string, text string, source string, lang string")
    with pytest.raises(TypeError, match="whole numbers"):
        OPERATORS[name](df, spark)


def test_copies_of_null_and_large_ids(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a") for i in IDS], "doc_id long, text string, source string").coalesce(1)
    mixed = mixing.mix_sources(df)
    want = {r.doc_id: r.copies for r in mixed.collect()}
    got = [r.doc_id for r in mixing.take_copies(df, mixed).collect()]
    assert {i: got.count(i) for i in IDS} == want


def test_op_ids_of_text_work_where_ids_are_only_carried(spark):
    df = spark.createDataFrame([("x1", "password = abcdefg1", "s", "en")], "doc_id string, text string, source string, lang string")
    assert [r.doc_id for r in OPERATORS["secrets"](df, spark).collect()] == ["x1"]
