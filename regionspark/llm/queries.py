"""One query for each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.token_output import token_output

    return token_output(_table(spark, sf_dir, "documents"), word_bpe_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.simhash import digest, near_duplicates

    return digest(near_duplicates(_table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.secrets import BlobLedger, digest

    return digest(BlobLedger(spark).scan(_table(spark, sf_dir, "documents"), ["doc_id"], "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.quality_rules import judge

    out = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.decontaminate import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.kneser_ney import score

    return score(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


_BLANK, _RUN, _KEY = r"[\x20\x09-\x0D]+", r"\n", r"AKIA[A-Z0-9]+|[0-9a-f]{24}|(password|secret|token|api_key)[^a-z]"


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionspark.llm.token_rollups import TokenRollups

    rollups = TokenRollups(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollups.commit("load", docs)
    # texts of several lines are revised to one line, those that look like holding a secret are taken
    # back; both are told by the text, so that no text is shuffled
    revised = docs.filter(F.col("text").rlike(_RUN)).withColumn("text", F.regexp_replace("text", _BLANK, " "))
    rollups.commit("revise", revised.withColumn("op", F.lit("revise")), op="op")
    for _ in range(2):  # delivered again: nothing changes
        rollups.commit("take-back", docs.filter(F.col("text").rlike(_KEY)).withColumn("op", F.lit("delete")), op="op")
    return rollups.totals()


QUERIES = {
    "op7_token_output": op7_token_output,
    "op10_simhash": op10_simhash,
    "op2_token_rollups": op2_token_rollups,
    "op6_html_text": op6_html_text,
    "op3_kneser_ney": op3_kneser_ney,
    "op5_toxicity": op5_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op1_secrets": op1_secrets,
    "op4_quality_rules": op4_quality_rules,
    "op9_mixing": op9_mixing,
}
_PIECES = r"[A-Za-z]+|[0-9]|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"
ORACLE: dict[str, str] = {
    "op2_token_rollups": rf"""
        WITH kept AS (
            SELECT source, lang, CASE WHEN regexp_matches(text, '{_RUN}') THEN regexp_replace(text, '{_BLANK}', ' ', 'g') ELSE text END AS text
            FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '{_KEY}'))
        )
        SELECT source, lang, v.tokenizer_version, count(*) AS n_docs, CAST(sum(v.n_tokens) AS BIGINT) AS n_tokens
        FROM (
            SELECT source, lang, 'words-1' AS tokenizer_version, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM kept
            UNION ALL SELECT source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '{_PIECES}')), 0) FROM kept
            UNION ALL SELECT source, lang, 'bytes-1', coalesce(strlen(text), 0) FROM kept
        ) AS v GROUP BY source, lang, v.tokenizer_version""",
}
