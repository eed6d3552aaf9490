"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's 64-bit fingerprint is the majority bit of the XXH64 values of its word shingles. Texts
link where fingerprints differ in at most four bits; classes are the connected components.

Candidate keys. A fingerprint is cut into A (23 bits), B (23 bits) and C (18 bits). A 23-bit segment
also has *Golay indices*: the message part of the codeword of the perfect (23,12,7) code nearest to
the segment, and nearest to each of its one-bit changes - one to six indices. Two segments within
two bits share an index (that of the word between them). The pigeonhole principle over at most four
errors leaves these cases, each with a key both fingerprints have:

* A exact: (A, index of B), or, if B has three errors or more, C has at most one: (A, half of C);
* B exact: the same with A and B exchanged;
* C exact: one of A, B has at most one error: (C, half of A) or (C, half of B); else both have two:
  (C, index of A);
* none exact: at most one has two errors, the others one each, so a half of those is exact:
  (index of A, half of B, half of C), (half of A, index of B, half of C) or
  (half of A, half of B, third of C).

That makes at most 86 keys of 24 to 35 bits for each distinct fingerprint. Equal keys meet in a
task, the distance is verified there, and only links that join something new leave it.

Defined cases: fewer words than a shingle make one shingle of them all; no words (or null) give
fingerprint zero, linked like any other; rows that share a doc_id or a text each give a row; an
empty table gives no rows; a null doc_id is never a component's smallest unless it is alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionspark.llm._shared import settle, shuffle_parts, skew_join, whole_id
from regionspark.llm._words import LOWER, U64, mix, slices, spaced, text_bytes, word_bounds, xxh64
from regionspark.llm.components import components

SHINGLE = 4
MAX_BITS = 4
_GENERATOR = 0xC75
_CHUNK = 1 << 16


def shingle_hashes(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of the word shingles of all texts of an Arrow column, offsets of each text)."""
    buf, off = text_bytes(column)
    starts, ends, n = word_bounds(buf, off)
    buf, starts, ends = spaced(LOWER[buf], starts, ends)
    first = np.cumsum(n) - n
    shingles = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    to = np.concatenate([[0], np.cumsum(shingles)])
    a = np.repeat(first - to[:-1], shingles) + np.arange(to[-1])
    z = np.minimum(a + shingle, np.repeat(first + n, shingles)) - 1
    return xxh64(buf, starts[a], ends[z]), to


def fingerprints(column, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text of an Arrow column."""
    return majority(*shingle_hashes(column, shingle))


def majority(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each text's hashes."""
    shingles = np.diff(to)
    out = np.zeros(len(shingles), U64)
    doc = 0
    while doc < len(shingles):
        upto = max(doc + 1, int(np.searchsorted(to, to[doc] + _CHUNK, "right")) - 1)
        counts = np.zeros((upto - doc, 64), np.int64)
        if upto - doc == 1:
            for at in range(to[doc], to[upto], _CHUNK):
                counts[0] += _bits(h[at : min(at + _CHUNK, to[upto])]).sum(0, dtype=np.int64)
        else:
            some = shingles[doc:upto] > 0
            if some.any():
                counts[some] = np.add.reduceat(_bits(h[to[doc] : to[upto]]), (to[doc:upto] - to[doc])[some], dtype=np.int32)
        set_bits = counts * 2 > shingles[doc:upto, None]
        out[doc:upto] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]
        doc = upto
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


@lru_cache(1)
def golay_tables() -> tuple[list[np.ndarray], np.ndarray]:
    """(syndrome of each byte position, XOR patterns from a segment to its codewords by syndrome)."""

    def syndrome(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= _GENERATOR << (i - 11)
        return w

    single = [syndrome(1 << i) for i in range(23)]
    leader = np.zeros(2048, np.int64)
    for i in range(23):
        leader[single[i]] = 1 << i
        for j in range(i):
            leader[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    patterns = np.full((2048, 6), -1, np.int64)
    for s in range(2048):
        got = sorted({int(leader[s]), *(1 << i ^ int(leader[s ^ single[i]]) for i in range(23))})
        patterns[s, : len(got)] = got
    tables = [np.array([syndrome(b << at) if b << at < 1 << 23 else 0 for b in range(256)], np.int64) for at in (0, 8, 16)]
    return tables, patterns


def golay_indices(segment: np.ndarray) -> np.ndarray:
    """Up to six 12-bit indices of each 23-bit segment, missing ones -1."""
    tables, patterns = golay_tables()
    segment = segment.astype(np.int64)
    s = tables[0][segment & 255] ^ tables[1][segment >> 8 & 255] ^ tables[2][segment >> 16]
    p = patterns[s]
    return np.where(p < 0, -1, (segment[:, None] ^ p) >> 11)


def candidate_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of fp) of all candidate keys."""
    x = fp.astype(U64)
    a, b, c = ((x >> U64(s) & U64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    col = lambda *v: np.stack(v, 1)
    ga, gb = golay_indices(a), golay_indices(b)
    # a part's value carries which part it is: halves and thirds get their number in front
    ha, hb, hc = col(a & 4095, 1 << 12 | a >> 12), col(b & 4095, 1 << 12 | b >> 12), col(c & 511, 1 << 9 | c >> 9)
    tc = col(c & 63, 1 << 6 | c >> 6 & 63, 2 << 6 | c >> 12)
    a, b, c = a[:, None], b[:, None], c[:, None]
    families = [((a, 23), (gb, 12)), ((a, 23), (hc, 10)), ((b, 23), (ga, 12)), ((b, 23), (hc, 10)), ((c, 18), (ha, 13)), ((c, 18), (hb, 13)), ((c, 18), (ga, 12)), ((ga, 12), (hb, 13), (hc, 10)), ((ha, 13), (gb, 12), (hc, 10)), ((ha, 13), (hb, 13), (tc, 8))]
    keys, rows = [], []
    for number, parts in enumerate(families):
        key = np.full((len(x), 1), number, np.int64)
        for part, bits in parts:
            both = (key[:, :, None] << bits) | part[:, None, :]
            both[(key[:, :, None] < 0) | (part[:, None, :] < 0)] = -1
            key = both.reshape(len(x), -1)
        row, at = np.nonzero(key >= 0)
        keys.append(key[row, at])
        rows.append(row)
    return np.concatenate(keys).astype(U64), np.concatenate(rows)


def near_links(fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that give the same classes as all links within max_bits."""
    left = np.arange(len(fp))
    u, v, queue = [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[-1])], left[:-1]
        at = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
        got = left[near]
        if len(got):
            u.append(np.full(len(got), at))
            v.append(got)
            queue += got.tolist()
            left = left[~near]
        if not len(left):
            break
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _emit_keys(n_buckets: int):
    def run(batches):
        for b in batches:
            all_fp = b["fp"].to_numpy().view(U64)
            for at in range(0, len(all_fp), 8192):
                fp = all_fp[at : at + 8192]
                key, row = candidate_keys(fp)
                bucket = (mix(key) % U64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                packed = np.stack([key[order], fp[row[order]]], 1)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())], ["bucket", "pairs"])

    return run


def _links_of(packed: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    packed = packed[np.lexsort((packed[:, 1], packed[:, 0]))]
    key, fp = packed[:, 0], packed[:, 1]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    u, v = [], []
    small = size <= 24
    for d in range(1, int(size[small].max(initial=0))):  # the d-th neighbour within each small run
        run = first[small & (size > d)]
        n = size[small & (size > d)] - d
        at = np.repeat(run - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ok = np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits
        u.append(fp[at[ok]])
        v.append(fp[at[ok] + d])
    for at, n in zip(first[~small], size[~small], strict=True):
        own = fp[at : at + n]
        i, j = near_links(own, max_bits)
        u.append(own[i])
        v.append(own[j])
    if not u:
        return np.zeros(0, U64), np.zeros(0, U64)
    pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _verify(max_bits: int):
    def links(parts):
        u, v = _links_of(np.frombuffer(b"".join(parts), U64).reshape(-1, 2), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches):
        bucket, parts = None, []
        for b in batches:
            for k, pairs in zip(b["bucket"].to_pylist(), b["pairs"].to_pylist(), strict=True):
                if parts and k != bucket:
                    yield links(parts)
                    parts = []
                bucket = k
                parts.append(pairs)
        if parts:
            yield links(parts)

    return run


def _fingerprint_batches(text: str, shingle: int):
    def run(batches):
        for b in slices(batches, text):
            fp = fingerprints(b[text], shingle)
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n != text), pa.array(fp.view(np.int64))], [*(n for n in b.schema.names if n != text), "fp"])

    return run


def fingerprint_links(fp: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) among the distinct values of column ``fp``; their components are the classes of
    all pairs within ``max_bits`` (at most 4)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys cover at most 4 differing bits")
    distinct = fp.select("fp").distinct()
    n = distinct.count()
    # 86 keys of 16 bytes each: buckets of about 32 MB
    buckets = max(shuffle_parts(fp.sparkSession), n * 86 * 16 // (32 << 20) + 1)
    return (
        distinct.mapInArrow(_emit_keys(buckets), "bucket int, pairs binary")
        .repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
        .mapInArrow(_verify(max_bits), "u long, v long")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, h (hash of the text), fp (signed 64-bit), root (of the class), component_id (smallest
    doc_id of the class) of every row. Classes are told apart by root: where rows share a doc_id, two
    classes may have the same smallest one."""
    named = docs.select(whole_id(docs, key).alias("doc_id"), text_hash(F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
    fp = settle(named.mapInArrow(_fingerprint_batches("text", shingle), "doc_id long, h long, fp long"), "fingerprints")
    return classes(fp, "doc_id", max_bits).select("doc_id", "h", "fp", "root", F.col("first").alias("component_id"))


def classes(fp: DataFrame, of: str, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``fp`` (settled) with the root of their fingerprint's class and the first, which is the
    smallest value of column ``of`` in the class."""
    per = settle(fp.groupBy("fp").agg(F.min(of).alias("least"), F.count(F.lit(1)).alias("rows")), "fingerprint-classes")
    roots = components(fingerprint_links(per, max_bits))
    joined = settle(per.join(roots, per.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    whole = settle(joined.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members")), "fingerprint-components")
    by_fp = settle(skew_join(joined, whole, "root", "members").select("fp", "root", "first", "rows"), "fingerprint-class")
    return skew_join(fp, by_fp, "fp", "rows").drop("rows")


def text_hash(text: Column) -> Column:
    """64-bit hash that tells the texts of rows with one doc_id apart; null as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class, all columns: that of the smallest id (null last), then text hash."""
    near = near_duplicates(docs, key, text, **how)
    least = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("x"))
    keep = least.select(F.col("x.doc_id").alias("_kept_id"), F.col("x.h").alias("_kept_h")).distinct()
    return keep_rows(docs, keep, key, text)


def keep_rows(docs: DataFrame, keep: DataFrame, key: str, text: str) -> DataFrame:
    """One row, all columns, for each (_kept_id, _kept_h) of ``keep``."""
    on = ["_kept_null", "_kept_of", "_kept_h"]  # plain columns: the window needs no shuffle of its own
    parts = lambda c: [c.isNull().alias("_kept_null"), F.coalesce(c, F.lit(0)).alias("_kept_of")]
    rows = docs.select("*", *parts(F.col(key).cast("long")), text_hash(F.col(text)).alias("_kept_h"))
    rows = rows.join(keep.select(*parts(F.col("_kept_id")), "_kept_h"), on)
    # equal id and text, perhaps other columns: the smallest hash of the row stays
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64(*docs.columns)))
    return rows.withColumn("_kept_rank", rank).filter("_kept_rank = 1").select(*docs.columns)


def digest(near: DataFrame) -> DataFrame:
    """With the fingerprint as 16 lowercase hex digits."""
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
