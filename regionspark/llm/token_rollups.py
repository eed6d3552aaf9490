"""Token counts as delta-maintained rollups.

A batch of changes (insert, delete, revise) is turned into signed deltas: an insert adds a document's
counts, a delete takes back what the log holds for its key, a revision does both. A batch writes its
deltas by document, their sums by (source, lang, tokenizer_version), and last a commit mark; a batch
that has its mark is skipped, one that lacks it is written anew, so a batch counts once however often
it is delivered. Totals are the sums of the committed sums, and no total is computed again from texts.

The log of documents is kept in ``buckets`` by hash of the key. A commit with deletes or revisions reads
the buckets of their keys, so a few changes read a small part of the log. One key's deltas are
one row for each group and batch, however many documents share the key.

Defined cases: a null text has no tokens; null source and lang are groups of their own, a null key is a
key; inserts with a key that is there already add a document each; deletes of unknown keys change
nothing; several revisions of one key in a batch replace the old documents once; a null or unknown op
is an error, and nothing of its batch is committed; an empty batch commits nothing but its mark; other
columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.llm._shared import _fs, new_dir, settle, shuffle_parts, write_bytes

#: Tokenizer versions: the token count of a text column.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")),
    "pieces-1": lambda t: F.regexp_count(t, F.lit(r"[A-Za-z]+|[0-9]|[^\x00-\x7F]+|[!-/:-@\[-`{-~]")),
    "bytes-1": lambda t: F.octet_length(t),
}
GROUP = ("source", "lang", "tokenizer_version")
INSERT, DELETE, REVISE = "insert", "delete", "revise"
BUCKETS = 16
_LOG = "key string, source string, lang string, tokenizer_version string, n_docs long, n_tokens long, bucket int"
_SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollups:
    """Additive totals by source, language and tokenizer version, below one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder or new_dir(spark, "rollups"), buckets

    def committed(self) -> list[str]:
        from pyarrow.fs import FileSelector

        fs, path = _fs(f"{self.folder}/commits")
        return sorted(f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if not f.base_name.startswith("."))

    def _read(self, what: str, schema: str) -> DataFrame | None:
        paths = [f"{self.folder}/{what}/{b}" for b in self.committed()]
        if not paths:
            return None
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])

    def commit(self, batch: str, changes: DataFrame, versions: tuple[str, ...] = tuple(TOKENIZERS), key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", op: str | None = None) -> bool:
        """Apply a batch; column ``op`` names the change of each row (none: all are inserts). Returns
        False if the batch was committed before."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError("a batch is named by letters, digits, _ and -")
        if batch in self.committed():
            return False
        kinds = (INSERT, DELETE, REVISE)
        kind = F.lit(INSERT)
        if op:
            known = F.coalesce(F.col(op).cast("string").isin(*kinds), F.lit(False))
            kind = F.when(known, F.col(op).cast("string")).otherwise(F.raise_error(F.concat(F.lit(f"column {op}: insert, delete or revise expected, not "), F.coalesce(F.col(op).cast("string"), F.lit("null")))))
        body = F.col(text).cast("string")
        rows = changes.select(F.col(key).cast("string").alias("key"), kind.alias("op"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), body.alias("text"))
        counts = F.array(*(F.struct(F.lit(v).alias("tokenizer_version"), F.coalesce(TOKENIZERS[v](F.col("text")), F.lit(0)).cast("long").alias("n_tokens")) for v in versions))
        signed = (
            rows.filter(F.col("op") != DELETE).select("key", "source", "lang", F.explode(counts).alias("c"))
            .select("key", "source", "lang", "c.tokenizer_version", F.lit(1).cast("long").alias("n_docs"), "c.n_tokens")
        )
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")
        before = self._read("documents", _LOG) if op else None
        if before is not None:
            gone = settle(rows.filter(F.col("op") != INSERT).select(F.col("key").alias("gone")).distinct(), "rollup-keys")
            touched = [r.bucket for r in gone.select(F.pmod(F.xxhash64("gone"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct().collect()]
            old = before.filter(F.col("bucket").isin(touched)).join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_semi")
            signed = signed.unionByName(old.select("key", *GROUP, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        per_key = signed.groupBy("key", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")
        parts = max(self.buckets, shuffle_parts(self.spark))
        spread = F.pmod(F.hash("key"), F.lit(parts // self.buckets))
        per_key.withColumn("bucket", bucket).repartition(parts, "bucket", spread).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/documents/{batch}")
        deltas = self.spark.read.schema(_LOG).parquet(f"{self.folder}/documents/{batch}")
        deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sums/{batch}")
        write_bytes(f"{self.folder}/commits/{batch}", b"")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of the groups that hold documents."""
        sums = self._read("sums", _SUMS)
        if sums is None:
            return self.spark.createDataFrame([], _SUMS)
        return sums.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0")
