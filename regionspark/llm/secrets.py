"""Secret scans over an incremental blob ledger.

Texts are content-addressed (SHA-256 of their UTF-8 bytes). The ledger holds, for each blob and rule
version that was ever scanned, the findings of that scan. A run hashes the given versions, scans one
copy of each (blob, rule version) pair that the ledger lacks, appends the new findings as one
committed batch, and joins findings back to every path that holds the blob. Blobs that repeat, across
paths, versions or runs, are scanned once.

Rules. Spans are code points, end exclusive. ``assign``, ``access`` and ``hex`` are the base kinds;
``jwt``, ``pem``, ``github``, ``slack`` and ``url`` are added by this scanner's rule set.

Defined cases: a null text is the empty blob; rows that share a path give a row each; an empty table
gives no rows; columns of the input other than the keys and the text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import BROADCAST_ROWS, _fs, new_dir, settle, skew_join

RULE_VERSION = "2024-1"
BASE = ("assign", "access", "hex")
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES: dict[str, tuple[str, int, int]] = {  # pattern, group that is measured, least length of it
    "assign": (_ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]{6,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}", 0, 0),
    "pem": (r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "url": (r"[a-z][a-z0-9+]{1,20}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", 0, 0),
}
#: A text without any of a rule's anchors can't match it. Lower case where the rule ignores case.
_ANCHORS = {"access": "AKIA", "jwt": "eyJ", "pem": "-----BEGIN", "github": "gh", "slack": "xox", "url": "://"}
_FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"
_FOUND = f"blob string, findings {_FINDINGS}"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start, then kind as listed."""
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        if kind in _ANCHORS and _ANCHORS[kind] not in text:
            continue
        for m in re.finditer(pattern, text, re.ASCII):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find_secrets(t or "")] for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["blob"], pa.array(found, kind)], ["blob", "findings"])


class BlobLedger:
    """Findings by (blob, rule version), in batches below one folder."""

    def __init__(self, spark, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_dir(spark, "ledger")

    def read(self, rule_version: str) -> DataFrame | None:
        """Findings by blob; None if nothing was scanned with these rules yet."""
        from pyarrow.fs import FileSelector

        fs, path = _fs(f"{self.folder}/rule_version={rule_version}")
        done = [f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if fs.get_file_info(f"{f.path}/_SUCCESS").is_file]
        return self.spark.read.schema(_FOUND).parquet(*(f"{self.folder}/rule_version={rule_version}/{b}" for b in sorted(done))) if done else None

    def scan(self, versions: DataFrame, keys: list[str], text: str, rule_version: str = RULE_VERSION) -> DataFrame:
        """Scan what is unseen; returns keys, blob and findings of every row of ``versions``."""
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        named = versions.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), body.alias("text"))
        names = [f"k{i}" for i in range(len(keys))]
        manifest = settle(named.select(*names, F.sha2(F.encode("text", "utf-8"), 256).alias("blob")), "manifest")
        known = self.read(rule_version)
        blobs = settle(manifest.groupBy("blob").agg(F.min(F.struct(*names)).alias("first"), F.count(F.lit(1)).alias("paths")), "blobs")
        unseen = blobs if known is None else blobs.join(known.select("blob"), "blob", "left_anti")
        unseen = settle(unseen.select("blob", *(F.col(f"first.{n}").alias(f"f{i}") for i, n in enumerate(names))), "unseen")
        # the text of one path for each unseen blob; a path may hold several texts, so the blob is compared
        # too. Few unseen blobs are broadcast: then the texts that are known stay where they are
        on = [F.col(f"k{i}").eqNullSafe(F.col(f"f{i}")) for i in range(len(keys))]
        hinted = F.broadcast(unseen) if unseen.count() <= BROADCAST_ROWS else unseen.hint("shuffle_hash")
        texts = named.join(hinted, on).filter(F.sha2(F.encode("text", "utf-8"), 256) == F.col("blob")).select("blob", "text")
        found = texts.mapInArrow(_scan, _FOUND)
        batch = hashlib.sha256(f"{new_dir(self.spark, 'batch')}".encode()).hexdigest()[:16]
        found.write.parquet(f"{self.folder}/rule_version={rule_version}/batch={batch}")
        findings = self.read(rule_version).groupBy("blob").agg(F.first("findings").alias("findings"))
        # most blobs have no findings; of those that have, the ones of very many paths are joined apart
        findings = settle(findings.filter(F.size("findings") > 0).join(blobs.select("blob", "paths"), "blob"), "findings")
        joined = skew_join(manifest, findings, "blob", "paths", "left")
        return joined.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "blob", F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans, and all spans."""
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    kinds = F.transform("findings", lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in BASE]
    counts = [(F.size("findings") - n).cast("long").alias(f"n_{k}") for k, n in zip(BASE, counts, strict=True)]
    return scanned.select(key, *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))
