"""Near copies by word shingles: five words, Jaccard similarity of 0.8 or more, verified.

A text's shingles are its runs of five words (bytes lowered as in ``simhash``), kept as the set of
their 32-bit hashes. Texts of one set are one node. Candidates come from two steps, and the similarity
of each candidate pair is then computed from the two whole sets. A node goes if one of a smaller doc_id
is similar to it.

First, SimHash by Golay-code fuzzy hashing (``simhash``, all its steps): fingerprints of the five-word
shingles, repeats included, classes of those at most four bits apart, and each node of a class is
compared with the class's first.

At a similarity of 0.8 fingerprints seldom come so near. So what shares a band of min-hashes is compared
as well: 24 bands of five, so that a pair of similarity 0.8 is found with
probability 0.9999 and a more similar one surer. Bands of up to ``_SMALL`` nodes are compared
whole. In a larger one the nodes, ranked by doc_id, are dealt out in blocks, and each block gets the
band's centres - the first ones, in rounds of ever more - to compare its nodes with. What has gone is not
compared again. A pair is passed on by the first band that it shares, and only if it can be similar: the
sum over 256 hash bins of the smaller of two nodes' shingle counts bounds what they have in common, so
no similar pair is lost. The rounds end when every node that stays has met all before it.

Defined cases: fewer than five words make one shingle of them all; texts without words are copies of
each other; a null doc_id comes last; rows that share a doc_id or a text each count as a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionspark.llm._shared import settle, shuffle_parts, skew_join, trimmed, whole_id
from regionspark.llm._words import U64, mix, slices
from regionspark.llm.simhash import classes, keep_rows, majority, shingle_hashes, text_hash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 5
_SMALL = 32
_BINS = 256
_BLOCK = 4096
_CENTRES = 1 << 16
_CHUNK = 1 << 16
_SALTS = 32
_LAST = 2**63 - 1


def shingle_sets(column, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingle hashes of all texts, sorted and distinct by text, offsets of each text)."""
    return distinct_hashes(*shingle_hashes(column, shingle))


def distinct_hashes(h: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 32 bits of the hashes, sorted and distinct by text, and the offsets of each text."""
    n = len(to) - 1
    both = np.unique(np.repeat(np.arange(n), np.diff(to)).astype(U64) << U64(32) | h >> U64(32))
    return both.astype(np.uint32), np.searchsorted(both >> U64(32), np.arange(n + 1).astype(U64))


def band_keys(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The keys (64-bit) of each set's bands, one row a set; an empty set has keys of its own."""
    k = BANDS * BAND_ROWS
    seeds = mix(np.arange(1, k + 1, dtype=U64))
    low = np.full((len(off) - 1, k), ~U64(0), U64)
    at = 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(off, off[at] + _CHUNK, "right")) - 1)
        some = np.flatnonzero(np.diff(off[at : to + 1])) + at
        if len(some):
            x = mix(values[off[at] : off[to]].astype(U64))
            cut = off[some] - off[at]
            for i, seed in enumerate(seeds):
                low[some, i] = np.minimum.reduceat((x ^ seed) * (seed | U64(1)), cut)
        at = to
    keys = np.zeros((len(low), BANDS), U64)
    for i in range(BAND_ROWS):
        keys = mix(keys ^ low[:, i::BAND_ROWS]) + U64(i)
    return mix(keys ^ np.arange(BANDS, dtype=U64))


def _sets(batches):
    for b in slices(batches):
        h, to = shingle_hashes(b["text"], SHINGLE)
        values, off = distinct_hashes(h, to)
        fp = majority(h, to).view(np.int64)
        keys = band_keys(values, off)
        own = [values[off[i] : off[i + 1]].tobytes() for i in range(b.num_rows)]
        node = np.array([xxhash.xxh64_intdigest(x) for x in own], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], pa.array(node), pa.array(fp), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array(own, pa.binary())], ["doc_id", "h", "node", "fp", "keys", "own"])


def _emit(n_buckets: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                key = np.frombuffer(b"".join(part["keys"].to_pylist()), U64)
                who = np.stack([part[c].to_numpy().astype(np.int64).view(U64) for c in ("least", "node")], 1)
                packed = np.column_stack([key, np.repeat(who, BANDS, 0)])
                bucket = (mix(key) % U64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                packed = packed[order]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())], ["bucket", "packed"])

    return run


def small_bands(packed: np.ndarray, low: int = 2, small: int = _SMALL):
    """From rows (key, doc_id, node): pairs (u, v) of nodes of the bands of ``low`` to ``small`` nodes, u
    before v, and the rows (key, node) of larger bands."""
    packed = packed[np.lexsort((packed[:, 2].view(np.int64), packed[:, 1].view(np.int64), packed[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], packed[1:, 0] != packed[:-1, 0]]))
    size = np.diff(np.append(first, len(packed)))
    node = packed[:, 2].view(np.int64)
    u, v = [], []
    for d in range(1, int(size[size <= small].max(initial=0))):
        run, n = (x[(size <= small) & (size > d)] for x in (first, size))
        n = n - d
        at = np.repeat(run - (np.cumsum(n) - n), n) + np.arange(n.sum())
        u.append(node[at])
        v.append(node[at + d])
    large = np.repeat(size > small, size)
    empty = np.zeros(0, np.int64)
    return np.concatenate(u) if u else empty, np.concatenate(v) if v else empty, packed[large, 0].view(np.int64), node[large]


def _first_round(parts):
    u, v, key, node = small_bands(np.frombuffer(b"".join(parts), U64).reshape(-1, 3))
    pairs = np.unique(np.stack([u, v], 1), axis=0)
    kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(key)])
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([pairs[:, 0], key])), pa.array(np.concatenate([pairs[:, 1], node]))], ["kind", "u", "v"])


def _pairs(batches):
    bucket, parts = None, []
    for b in batches:
        for k, packed in zip(b["bucket"].to_pylist(), b["packed"].to_pylist(), strict=True):
            if parts and k != bucket:
                yield _first_round(parts)
                parts = []
            bucket = k
            parts.append(packed)
    if parts:
        yield _first_round(parts)


def bins_of(own: np.ndarray) -> bytes:
    """Shingles of a set by hash bin; empty where a bin holds more than a byte counts."""
    n = np.bincount(own & np.uint32(_BINS - 1), minlength=_BINS)
    return n.astype(np.uint8).tobytes() if n.max() <= 255 else b""


def may_be_similar(size_a, bins_a, known_a, size_b, bins_b, known_b) -> np.ndarray:
    """Which rows of two tables of sets can have the similarity. No similar pair is left out."""
    least = SIMILARITY / (1 + SIMILARITY) * (size_a + size_b)
    common = np.minimum(bins_a, bins_b).sum(1, dtype=np.int64)
    common = np.where(known_a & known_b, common, np.minimum(size_a, size_b))
    return common >= least - 1e-9


def _signatures(batches):
    for b in batches:
        sets = [np.frombuffer(x, np.uint32) for x in b["own"].to_pylist()]
        marks = [_marks(np.frombuffer(x, U64)).tobytes() for x in b["keys"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["node"], pa.array([len(x) for x in sets], pa.int64()), pa.array([bins_of(x) for x in sets], pa.binary()), pa.array(marks, pa.binary())], ["node", "size", "bins", "marks"])


def _marks(keys: np.ndarray) -> np.ndarray:
    """32 bits of each band key."""
    return (keys >> U64(32)).astype(np.uint32)


def _table(b):
    bins = b["bins"].to_pylist()
    known = np.array([len(x) > 0 for x in bins], bool)
    marks = np.frombuffer(b"".join(b["marks"].to_pylist()), np.uint32).reshape(-1, BANDS)
    return {"marks": marks, "rank": b["rank"].to_numpy(), "node": b["node"].to_numpy(), "size": b["size"].to_numpy(), "bins": np.frombuffer(b"".join(x or bytes(_BINS) for x in bins), np.uint8).reshape(-1, _BINS), "known": known}


def block_pairs(centres: dict, members: dict, key: int):
    """Pairs (u, v) of a centre and a member of a larger rank that may be similar, if the band of ``key``
    is the first that both are in (smaller bands were compared before)."""
    mark = _marks(np.array([key], np.int64).view(U64))
    step = max(1, _CHUNK // 4 // max(1, len(centres["node"])))
    for at in range(0, len(members["node"]), step):
        s = slice(at, at + step)
        j, i = np.nonzero(members["rank"][s, None] > centres["rank"][None, :])
        j += at
        ok = may_be_similar(*(centres[c][i] for c in ("size", "bins", "known")), *(members[c][j] for c in ("size", "bins", "known")))
        i, j = i[ok], j[ok]
        shared = centres["marks"][i] == members["marks"][j]
        ok = centres["marks"][i, shared.argmax(1)] == mark
        yield centres["node"][i[ok]], members["node"][j[ok]]


def _compare(batches):
    """Rows sorted by band and block, centres (centre 0) before members (1) in each."""
    of, centres = None, None
    for b in batches:
        key = np.stack([b[c].to_numpy().astype(np.int64) for c in ("key", "block", "member")], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else []
        for a, z in zip(cuts, cuts[1:], strict=False):
            own, part = tuple(key[a, :2]), _table(b.slice(a, z - a))
            if key[a, 2] == 0:
                centres = {c: np.concatenate([centres[c], part[c]]) for c in part} if of == own else part
                of = own
            elif of == own:
                for u, v in block_pairs(centres, part, own[0]):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _similar(batches):
    for b in batches:
        out = []
        for node, x, y in zip(b["v"], b["a"], b["b"], strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint32) for s in (x, y))
            n, m = len(x), len(y)
            if min(n, m) < SIMILARITY * max(n, m):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= SIMILARITY * (n + m - common):
                out.append(node.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(node, doc_id, h of each node's first row; nodes that go)."""
    spark = docs.sparkSession
    named = docs.select(whole_id(docs, key).alias("doc_id"), text_hash(F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
    sets = named.mapInArrow(trimmed(_sets), "doc_id long, h long, node long, fp long, keys binary, own binary")
    # rows of one node have one set, so any of them gives it; copies are put together before the shuffle
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("x")
    keyed = settle(sets.groupBy("node").agg(least, F.collect_set("fp").alias("fps"), F.first("keys").alias("keys"), F.first("own").alias("own")).select("node", "x.doc_id", "x.h", F.coalesce("x.doc_id", F.lit(_LAST)).alias("least"), "fps", "keys", "own"), "shingle-keys")
    nodes = keyed.select("node", "doc_id", "h")
    # 24 keys of 24 bytes each: buckets of about 32 MB
    buckets = max(shuffle_parts(spark), nodes.count() * BANDS * 24 // (32 << 20) + 1)
    dealt = keyed.select("node", "least", "keys").mapInArrow(trimmed(_emit(buckets)), "bucket int, packed binary").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    met = settle(dealt.mapInArrow(trimmed(_pairs), "kind int, u long, v long"), "shingle-bands")
    # the sets of both steps' pairs are fetched once
    pairs = settle(class_pairs(keyed).unionByName(met.filter("kind = 0").select("u", "v")).distinct(), "shingle-pairs")
    gone = settle(_verified(pairs, keyed), "shingle-gone")
    large = met.filter("kind = 1").select(F.col("u").alias("key"), F.col("v").alias("node"))
    if large.isEmpty():
        return nodes, gone
    among = keyed.join(large.select("node").distinct(), "node", "left_semi")
    signatures = settle(among.select("node", "own", "keys").mapInArrow(trimmed(_signatures), "node long, size long, bins binary, marks binary").join(among.select("node", "least"), "node"), "shingle-signatures")
    in_order = Window.partitionBy("key").orderBy("least", "node")
    ranked = large.join(signatures.select("node", "least"), "node").select("key", "node", F.row_number().over(in_order).cast("long").alias("rank"))
    ranked = settle(ranked, "shingle-ranks")
    blocks = settle(ranked.groupBy("key").agg(F.max("rank").alias("most")).withColumn("blocks", F.ceil(F.col("most") / _BLOCK)), "shingle-blocks")
    ranked = settle(skew_join(ranked, blocks, "key", "most"), "shingle-ranks")
    low, high = 0, 64
    while True:
        # those from low + 1 to high are centres; what stands behind low and has not gone meets them
        centres = ranked.filter((F.col("rank") > low) & (F.col("rank") <= high)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.lit(0))
        members = ranked.filter(F.col("rank") > low + 1).join(gone, "node", "left_anti").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("member", F.lit(1))
        both = centres.unionByName(members).select("key", "node", "rank", F.col("block").cast("long").alias("block"), "member").join(signatures.drop("least"), "node")
        pairs = both.repartition("key", "block").sortWithinPartitions("key", "block", "member").mapInArrow(trimmed(_compare), "u long, v long")
        pairs = settle(pairs.distinct(), "shingle-pairs")
        gone = settle(gone.unionByName(_verified(pairs, keyed)).distinct(), "shingle-gone")
        if ranked.filter(F.col("rank") > high + 1).join(gone, "node", "left_anti").isEmpty():
            return nodes, gone
        low, high = high, high + min(16 * high, _CENTRES)


def class_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (u, v): the first node of each class of fingerprints with the class's other nodes."""
    fp = settle(keyed.select(F.struct("least", "node").alias("who"), F.explode("fps").alias("fp")), "shingle-fingerprints")
    return classes(fp, "who").select(F.col("first.node").alias("u"), F.col("who.node").alias("v")).filter("u <> v")


def _verified(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)))
    # only the sets of nodes in a pair are moved
    met = settle(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "shingle-met")
    sets = keyed.select("node", "own").join(met, "node", "left_semi")
    # a node that many are compared with is dealt out with its set
    left = salted.select("u", "salt").distinct().join(sets.toDF("u", "a"), "u")
    return salted.join(left, ["u", "salt"]).join(sets.toDF("v", "b"), "v").select("v", "a", "b").mapInArrow(trimmed(_similar), "node long").distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows, all columns, of the nodes that stay: of each that of the smallest id (null last), then text
    hash."""
    nodes, gone = near_copies(docs, key, text)
    keep = nodes.join(gone, "node", "left_anti").select(F.col("doc_id").alias("_kept_id"), F.col("h").alias("_kept_h")).distinct()
    return keep_rows(docs, keep, key, text)
