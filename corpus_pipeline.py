"""The corpus pipeline: documents to token files, by five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionspark.llm import decontaminate, mixing, near_copies, token_output, toxicity
from regionspark.llm._shared import new_dir
from regionspark.llm.queries import word_bpe_path

#: No SQL expresses a learned grammar, min-hash bands or balanced sampling.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes if one of a smaller doc_id is a near copy: Jaccard 0.8 or more of five-word shingles,
    by SimHash and Golay codes first, then by bands for what these leave."""
    return near_copies.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, within its error budget, go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, up to three times."""
    return mixing.take_copies(docs, mixing.mix_sources(docs))


def token_output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what is read back from them for each document."""
    return token_output.token_output(docs, word_bpe_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_output", token_output_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns goes to the shared folder and is read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
