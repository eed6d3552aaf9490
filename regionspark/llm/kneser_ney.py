"""Interpolated modified Kneser-Ney language model: counted in Spark, stored as sorted hash arrays,
memory-mapped by the workers that score.

The model is of order two (a word after a word) or three (after two); a text begins after start marks
and ends with an end token. Jobs:

1. *words*: distinct word hashes and counts of the training texts, merged by range of the hash and
   stored sorted; a word's place in that order is its id.
2. *pairs*: distinct (word before, word) ids and counts, dealt by hash - so that a frequent word's
   pairs spread over all tasks - merged, and stored sorted by their 64-bit key.
3. *sums*: in the same job, per id, how many pairs it starts, by count (1, 2, 3 and more), and how many
   it ends; stored as arrays by id.
4. Discounts come from counts of counts (a few numbers per task reach the driver), and texts are scored
   by looking their pairs up in the mapped arrays, in sorted order.

With order three, job 2 counts triples instead, dealt by the hash of their last two words: a task then
has all words found before a pair, so it stores the triples and the pairs with continuation counts. Job
3 also sums, per pair that starts triples, how many there are by count, and all tokens after it. Triples
are known by a hash of 64 bits, within the bucket of their pair.

Tasks exchange packed, sorted, compressed arrays, not a row for each n-gram. Arrays are files of the
shared folder; what the model holds grows with the corpus. Counts have no upper bound (eight bytes where
four are too few); ids are of 32 bits, and more words than that are an error. From a store that can't be
mapped, each task reads the arrays instead.

Probabilities. p(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) p(w), with g(v) the discounts taken from v's
pairs; p(w) is the same over continuation counts (how many different words w follows), down to 1 / (V + 1).
An unknown word has what is left there; after an unknown word p(w) counts. With order three, p(w | u v)
is of that form over triples, p(w | v) is what it backs off to, and c(vw) there is the number of different
words (or the start mark) found before the pair; after words not seen together p(w | v) counts.

Defined cases: a null or empty text is its end token alone; rows that share a doc_id or a text count
each; without training tokens every probability is 1 / (V + 1) = 1; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import new_dir, open_array, shuffle_parts, write_bytes, whole_id
from regionspark.llm._words import LOWER, U64, mix, slices, text_bytes, word_bounds, word_hashes

#: Hash of the end token: of a space, which no word of up to eight bytes has.
END = mix(np.array([0x20], U64))[0]
_SLICE = 24 << 20


def held_out(key: Column) -> Column:
    return (F.crc32(key.cast("string")) % 7) == 2


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, each with its end token; tokens per text)."""
    buf, off = text_bytes(column)
    buf = LOWER[buf]
    starts, ends, n = word_bounds(buf, off)
    out = np.full(len(starts) + len(n), END, U64)
    at = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
    out[at] = word_hashes(buf, starts, ends)
    return out, n + 1


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as compressed differences, by byte planes; counts as bytes where they fit."""
    z = zstandard.ZstdCompressor(1)
    step = np.diff(keys, prepend=U64(0))
    planes = step.view(np.uint8).reshape(-1, 8).T
    return z.compress(np.ascontiguousarray(planes).tobytes()), z.compress(counts.astype("<u8" if counts.max(initial=0) > 255 else "u1").tobytes())


def _unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    planes = np.frombuffer(z.decompress(keys), np.uint8).reshape(8, -1)
    step = np.ascontiguousarray(planes.T).view("<u8")[:, 0]
    raw = z.decompress(counts)
    c = np.frombuffer(raw, "<u8" if len(raw) == 8 * len(step) else "u1")
    return np.cumsum(step, dtype=U64), c.astype(np.int64)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal keys."""
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _batch(names: dict, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], list(names))


_BLOB = {"bucket": pa.int32(), "kind": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
_BLOB_SQL = "bucket int, kind int, keys binary, counts binary"


def _deal(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, n: int, kind: int = 0):
    """Rows of _BLOB; keys are sorted."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(k, kind, *_pack(keys[order[cut[k] : cut[k + 1]]], counts[order[cut[k] : cut[k + 1]]])) for k in range(n) if cut[k] < cut[k + 1]]


def _by_bucket(batches):
    """(bucket, {kind: parts}) of rows sorted by bucket."""
    bucket, parts = None, {}
    for b in batches:
        for k, kind, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if parts and k != bucket:
                yield bucket, parts
                parts = {}
            bucket = k
            parts.setdefault(kind, []).append((keys, counts))
    if parts:
        yield bucket, parts


def _hash_bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash."""
    return np.minimum((h >> U64(32)).astype(np.int64) * n >> 32, n - 1)


def _count_words(n: int):
    def run(batches):
        for b in slices(batches, "text", _SLICE):
            h, c = np.unique(_tokens(b["text"])[0], return_counts=True)
            yield _batch(_BLOB, _deal(h, c, _hash_bucket(h, n), n))

    return run


_DONE = {"bucket": pa.int32(), "n": pa.int64(), "total": pa.int64(), "n1": pa.int64(), "n2": pa.int64(), "n3": pa.int64(), "n4": pa.int64()}
_DONE_SQL = "bucket int, n long, total long, n1 long, n2 long, n3 long, n4 long"


def _done(bucket, counts):
    return (bucket, len(counts), int(counts.sum()), *(int((counts == i).sum()) for i in (1, 2, 3, 4)))


def _count_bytes(counts: np.ndarray) -> bytes:
    """Counts of four bytes where all fit, else of eight; a reader tells by the size of the file."""
    return counts.astype("<u4" if counts.max(initial=0) < 2**32 else "<u8").tobytes()


def _open_counts(uri: str, n: int) -> np.ndarray:
    raw = open_array(uri, "u1")
    return raw.view("<u8" if len(raw) == 8 * n else "<u4") if n else np.empty(0, "<u4")


def _store(folder: str, name: str):
    def run(batches):
        for bucket, parts in _by_bucket(batches):
            keys, counts = merge([_unpack(*p) for p in parts[0]])
            write_bytes(f"{folder}/{name}-{bucket:05d}.key", keys.astype("<u8").tobytes())
            write_bytes(f"{folder}/{name}-{bucket:05d}.n", _count_bytes(counts))
            yield _batch(_DONE, [_done(bucket, counts)])

    return run


class _Words:
    """Ids of word hashes; -1 for unknown ones."""

    def __init__(self, folder: str, words: list[tuple[int, int]]):
        self.parts = {b: open_array(f"{folder}/words-{b:05d}.key", "<u8") for b, _ in words}
        self.first = dict(zip((b for b, _ in words), np.cumsum([0, *(n for _, n in words)]).tolist(), strict=False))
        self.buckets = max((b for b, _ in words), default=-1) + 1

    def ids(self, h: np.ndarray, n: int) -> np.ndarray:
        """h is sorted."""
        out = np.full(len(h), -1, np.int64)
        cut = np.searchsorted(_hash_bucket(h, n), np.arange(n + 1))
        for b, keys in self.parts.items():
            own = h[cut[b] : cut[b + 1]]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out[cut[b] : cut[b + 1]] = np.where(keys[at] == own, at + self.first[b], -1)
        return out


def _token_ids(column, words: _Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, per = _tokens(column)
    u, back = np.unique(h, return_inverse=True)
    return words.ids(u, n)[back], per


def _before(ids: np.ndarray, per: np.ndarray, start: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(per) - per] = start
    return out


def _pair_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys) % U64(n)).astype(np.int64)


def _count_pairs(folder: str, words: list, n_words: int, n: int):
    start = sum(c for _, c in words)

    def run(batches):
        known = _Words(folder, words)
        for b in slices(batches, "text", _SLICE):
            ids, per = _token_ids(b["text"], known, n_words)
            key = _before(ids, per, start).astype(U64) << U64(32) | ids.astype(U64)
            keys, counts = np.unique(key, return_counts=True)
            yield _batch(_BLOB, _deal(keys, counts, _pair_bucket(keys, n), n))

    return run


def _pair_rows(folder: str, bucket: int, keys: np.ndarray, counts: np.ndarray, n: int, ids: int) -> list:
    """Store a bucket of pairs; rows of what it adds to each id's sums. Kinds: 0, figures that pass on
    to the driver; 1-3, pairs begun with count 1, 2, 3 and more; 4, pairs ended; 5, all tokens after."""
    per = -(-ids // n) or 1
    write_bytes(f"{folder}/pairs-{bucket:05d}.key", keys.astype("<u8").tobytes())
    write_bytes(f"{folder}/pairs-{bucket:05d}.n", _count_bytes(counts))
    before, after = keys >> U64(32), keys & U64(0xFFFFFFFF)
    rows = [(bucket % n, 0, b"", np.array(_done(bucket, counts), "<i8").tobytes())]
    for kind, ok in ((1, counts == 1), (2, counts == 2), (3, counts > 2), (4, None), (5, None)):
        if kind == 4:
            u, c = np.unique(after, return_counts=True)
        elif kind == 5:
            u, first = np.unique(before, return_index=True)
            c = np.add.reduceat(counts, first) if len(first) else counts
        else:
            u, c = np.unique(before[ok], return_counts=True)
        rows += _deal(u, c, (u // U64(per)).astype(np.int64), n, kind)
    return rows


def _store_pairs(folder: str, n: int, ids: int):
    def run(batches):
        for bucket, parts in _by_bucket(batches):
            keys, counts = merge([_unpack(*p) for p in parts[0]])
            del parts
            yield _batch(_BLOB, _pair_rows(folder, bucket, keys, counts, n, ids))

    return run


def _triple_keys(before: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return mix(mix(pairs) + before)


def _sum_triples(before: np.ndarray, pairs: np.ndarray, counts: np.ndarray):
    """Distinct triples, sorted by (pair, word before), and their counts."""
    order = np.lexsort((before, pairs))
    before, pairs, counts = before[order], pairs[order], counts[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(new)
    return before[first], pairs[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_triples(folder: str, words: list, n_words: int, n: int):
    """Rows of _BLOB, where keys are the pairs and then the words before them, and counts have zeros
    for the second half."""
    start = sum(c for _, c in words)

    def run(batches):
        known = _Words(folder, words)
        for b in slices(batches, "text", _SLICE):
            ids, per = _token_ids(b["text"], known, n_words)
            one = _before(ids, per, start)
            two = _before(one, per, start).astype(U64)
            two, pairs, counts = _sum_triples(two, one.astype(U64) << U64(32) | ids.astype(U64), np.ones(len(ids), np.int64))
            bucket = _pair_bucket(pairs, n)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(n + 1))
            rows = [order[cut[k] : cut[k + 1]] for k in range(n)]
            yield _batch(_BLOB, [(k, 0, *_pack(np.concatenate([pairs[r], two[r]]), np.concatenate([counts[r], np.zeros(len(r), np.int64)]))) for k, r in enumerate(rows) if len(r)])

    return run


#: Kinds of rows that carry sums of a pair: triples begun with count 1, 2, 3 and more; all tokens after.
_CONTEXT = (11, 12, 13, 14)


def _store_triples(folder: str, n: int, ids: int, n_pairs: int):
    """Store a bucket of triples and of the pairs they end with; deal out sums of ids and of pairs. The
    figures of triples go under the bucket's number plus n_pairs."""

    def run(batches):
        for bucket, parts in _by_bucket(batches):
            got = [_unpack(*p) for p in parts[0]]
            del parts
            halves = [(k[len(k) // 2 :], k[: len(k) // 2], c[: len(c) // 2]) for k, c in got]
            before, pairs, counts = _sum_triples(*(np.concatenate(x) for x in zip(*halves, strict=True)))
            del got, halves
            keys, stored = merge([(_triple_keys(before, pairs), counts)])
            write_bytes(f"{folder}/triples-{bucket:05d}.key", keys.astype("<u8").tobytes())
            write_bytes(f"{folder}/triples-{bucket:05d}.n", _count_bytes(stored))
            context = before << U64(32) | pairs >> U64(32)
            rows = [(bucket % n, 0, b"", np.array(_done(bucket + n_pairs, counts), "<i8").tobytes())]
            for kind, ok in zip(_CONTEXT, (counts == 1, counts == 2, counts > 2, None), strict=True):
                u, c = merge([(context, counts) if ok is None else (context[ok], np.ones(int(ok.sum()), np.int64))])
                rows += _deal(u, c, _pair_bucket(u, n_pairs), n_pairs, kind)
            yield _batch(_BLOB, rows)
            del context, keys, stored
            u, c = np.unique(pairs, return_counts=True)
            yield _batch(_BLOB, _pair_rows(folder, bucket, u, c, n, ids))

    return run


def _store_contexts(folder: str, bucket: int, parts: dict) -> None:
    """Keys of a bucket of pairs that start triples, and four sums of each."""
    sums = {k: merge([_unpack(*p) for p in parts.pop(k, [])]) for k in _CONTEXT}
    keys = sums[_CONTEXT[-1]][0]  # every one has tokens after it
    out = np.zeros((len(keys), len(_CONTEXT)), np.int64)
    for i, (u, c) in enumerate(sums.values()):
        out[np.searchsorted(keys, u), i] = c
    if len(keys):
        write_bytes(f"{folder}/contexts-{bucket:05d}.key", keys.astype("<u8").tobytes())
        write_bytes(f"{folder}/contexts-{bucket:05d}.n", _count_bytes(out))


#: Added to a bucket's number where a row says that it has stored contexts.
_CONTEXTS = 1 << 30


def _store_sums(folder: str, n: int, ids: int):
    per = -(-ids // n) or 1

    def run(batches):
        for bucket, parts in _by_bucket(batches):
            figures = [np.frombuffer(p[1], "<i8").tolist() for p in parts.pop(0, [])]
            yield _batch(_DONE, [(-1 - b, *rest) for b, *rest in figures]) if figures else pa.RecordBatch.from_pylist([], pa.schema(_DONE))
            if _CONTEXT[-1] in parts:
                _store_contexts(folder, bucket, parts)
                yield _batch(_DONE, [(_CONTEXTS + bucket, *[0] * 6)])
            if not parts:
                continue
            size = min(per, ids - bucket * per)
            sums = np.zeros((6, size), np.int64)
            for kind, got in parts.items():
                for p in got:
                    u, c = _unpack(*p)
                    sums[kind, u.astype(np.int64) - bucket * per] += c
            write_bytes(f"{folder}/sums-{bucket:05d}", _count_bytes(sums[1:].T.copy()))
            ends = sums[4][sums[4] > 0]
            yield _batch(_DONE, [_done(bucket, ends)])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; where counts of counts are missing, one of half."""
    if not (n1 and n2):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return tuple(min(max(x, 0.0), i + 1.0) for i, x in enumerate(d))


def _discount(c: np.ndarray, d) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


class Model:
    """What a worker needs to score: mapped arrays and a few numbers."""

    def __init__(self, spec: dict):
        self.s = spec
        f = spec["folder"]
        self.words = _Words(f, spec["words"])
        self.counts = [_open_counts(f"{f}/words-{b:05d}.n", n) for b, n in spec["words"]]
        self.first = np.cumsum([0, *(n for _, n in spec["words"])])

        def stores(name: str, buckets: list, width: int = 1) -> dict:
            keys = {b: open_array(f"{f}/{name}-{b:05d}.key", "<u8") for b in buckets}
            return {b: (k, _open_counts(f"{f}/{name}-{b:05d}.n", width * len(k)).reshape(len(k), width)) for b, k in keys.items()}

        self.pairs = stores("pairs", spec["pairs"])
        if spec["order"] == 3:
            self.triples, self.contexts = stores("triples", spec["pairs"]), stores("contexts", spec["contexts"], 4)
        self.per = -(-spec["ids"] // spec["n_sums"]) or 1
        self.sums = {b: _open_counts(f"{f}/sums-{b:05d}", 5 * min(self.per, spec["ids"] - b * self.per)).reshape(-1, 5) for b in spec["sums"]}

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted ids, 0 for unknown ones."""
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self.first)
        for k, c in enumerate(self.counts):
            out[cut[k] : cut[k + 1]] = c[ids[cut[k] : cut[k + 1]] - self.first[k]]
        return out

    def id_sums(self, ids: np.ndarray) -> np.ndarray:
        """(pairs begun with count 1, 2, 3+; pairs ended; tokens after) of sorted ids; unknown zero."""
        out = np.zeros((len(ids), 5), np.int64)
        cut = np.searchsorted(ids, np.arange(self.s["n_sums"] + 1) * self.per)
        for b, a in self.sums.items():
            out[cut[b] : cut[b + 1]] = a[ids[cut[b] : cut[b + 1]] - b * self.per]
        return out

    def find(self, stores: dict, keys: np.ndarray, bucket: np.ndarray, width: int = 1) -> np.ndarray:
        """What is stored for keys in buckets, 0 where nothing is."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.lexsort((keys, bucket))
        cut = np.searchsorted(bucket[order], np.arange(self.s["n_pairs"] + 1))
        for b, (k, c) in stores.items():
            rows = order[cut[b] : cut[b + 1]]
            own = keys[rows]
            at = np.minimum(np.searchsorted(k, own), len(k) - 1)
            hit = k[at] == own
            out[rows[hit]] = c[at[hit]].reshape(-1, width)
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        return self.find(self.pairs, keys, _pair_bucket(keys, self.s["n_pairs"]))[:, 0]

    def after_two(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities after two words, where lower are those after one."""
        s = self.s
        known = np.flatnonzero((one >= 0) & (two >= 0))
        context, back = np.unique(two[known].astype(U64) << U64(32) | one[known].astype(U64), return_inverse=True)
        sums = self.find(self.contexts, context, _pair_bucket(context, s["n_pairs"]), 4)[back]
        known, sums = known[sums[:, 3] > 0], sums[sums[:, 3] > 0]
        n = np.zeros(len(known), np.int64)
        word = ids[known] >= 0
        at = known[word]
        pairs = one[at].astype(U64) << U64(32) | ids[at].astype(U64)
        n[word] = self.find(self.triples, _triple_keys(two[at].astype(U64), pairs), _pair_bucket(pairs, s["n_pairs"]))[:, 0]
        d = s["triple_discounts"]
        p = lower.copy()
        p[known] = (np.maximum(n - _discount(n, d), 0) + sums[:, :3] @ np.array(d) * lower[known]) / sums[:, 3]
        return p

    def score(self, column):
        """Per text: tokens, known tokens, base score, score."""
        s = self.s
        ids, per = _token_ids(column, self.words, s["n_words"])
        u, back = np.unique(ids, return_inverse=True)
        c = self.word_counts(u)
        known = (c > 0)[back]
        base = np.log10((c + 1) / (s["train_tokens"] + (s["vocabulary"] + 1)))[back]
        ends = self.id_sums(u)[:, 3]
        uniform = 1.0 / (s["vocabulary"] + 1)
        d1, d2 = s["word_discounts"], s["pair_discounts"]
        if s["pair_types"]:
            lower = (np.maximum(ends - _discount(ends, d1), 0) + s["word_left"] * uniform) / s["pair_types"]
        else:
            lower = np.full(len(u), uniform)
        lower = lower[back]
        before = _before(ids, per, s["ids"] - 1)
        v, back = np.unique(before, return_inverse=True)
        sums = self.id_sums(v)
        total = sums[:, 4]
        left = sums[:, :3] @ np.array(d2)
        ok = (before >= 0) & (total[back] > 0)
        key, where = np.unique(before[ok & (ids >= 0)].astype(U64) << U64(32) | ids[ok & (ids >= 0)].astype(U64), return_inverse=True)
        n = np.zeros(len(ids), np.int64)
        n[ok & (ids >= 0)] = self.pair_counts(key)[where]
        p = lower.copy()
        t = total[back][ok]
        p[ok] = np.maximum(n[ok] - _discount(n[ok], d2), 0) / t + left[back][ok] / t * lower[ok]
        if s["order"] == 3:
            p = self.after_two(ids, before, _before(before, per, s["ids"] - 1), p)
        at = np.cumsum(per) - per
        return per, np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


def train(texts: DataFrame, text: str = "text", folder: str | None = None, order: int = 2) -> dict:
    """Count the model; returns what Model needs: the folder, bucket sizes and a few numbers."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = texts.sparkSession
    folder = folder or new_dir(spark, "kneser-ney")
    texts = texts.select(F.col(text).cast("string").alias("text"))
    n = shuffle_parts(spark)
    deal = lambda df, m: df.repartitionById(m, F.col("bucket")).sortWithinPartitions("bucket")
    got = deal(texts.mapInArrow(_count_words(n), _BLOB_SQL), n).mapInArrow(_store(folder, "words"), _DONE_SQL).collect()  # a row for each bucket, here and below
    words = sorted((r.bucket, r.n) for r in got)
    vocabulary, tokens = sum(c for _, c in words), sum(r.total for r in got)
    if vocabulary >= 2**32 - 2:
        raise ValueError("ids are of 32 bits")
    ids = vocabulary + 1  # and the start mark
    m = max(n, tokens // 4_000_000)
    count, store = (_count_pairs, _store_pairs(folder, n, ids)) if order == 2 else (_count_triples, _store_triples(folder, n, ids, m))
    parts = deal(texts.mapInArrow(count(folder, words, n, m), _BLOB_SQL), m).mapInArrow(store, _BLOB_SQL)
    done = deal(parts, n if order == 2 else m).mapInArrow(_store_sums(folder, n, ids), _DONE_SQL).collect()
    figures = {-1 - r.bucket: np.array(r[1:]) for r in done if r.bucket < 0}
    stats = {b: x for b, x in figures.items() if b < m}
    sums = [r for r in done if 0 <= r.bucket < _CONTEXTS]
    total = lambda of: np.sum(list(of), 0) if of else np.zeros(6, int)
    pair, triple = total(list(stats.values())), total([x for b, x in figures.items() if b >= m])
    word = [sum(r[f"n{i}"] for r in sums) for i in (1, 2, 3, 4)]
    types = int(pair[0])
    d1 = discounts(*word)
    ended = sum(r.n for r in sums)
    left = d1[0] * word[0] + d1[1] * word[1] + d1[2] * (ended - word[0] - word[1])
    return {
        "folder": folder, "order": order, "contexts": sorted(r.bucket - _CONTEXTS for r in done if r.bucket >= _CONTEXTS), "triple_discounts": discounts(*map(int, triple[2:6])), "words": words, "n_words": n, "n_pairs": m, "pairs": sorted(stats), "n_sums": n, "sums": sorted(r.bucket for r in sums), "ids": ids, "train_tokens": tokens, "vocabulary": vocabulary,
        "pair_types": types, "pair_discounts": discounts(*map(int, pair[2:6])), "word_discounts": d1, "word_left": left,
    }


def score_texts(docs: DataFrame, spec: dict, text: str = "text") -> DataFrame:
    """All columns but the text, and n_tokens, n_known, base_score, score."""
    kept = [c for c in docs.columns if c != text]
    names = [*kept, "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        model = None
        for b in slices(batches, text, _SLICE // 2):
            model = model or Model(spec)
            n, known, base, score = model.score(b[text])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], names)

    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), *(StructField(c, t) for c, t in zip(names[-4:], (LongType(), LongType(), DoubleType(), DoubleType()), strict=True))]))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of all rows,
    by a model of those that aren't held out."""
    named = docs.select(whole_id(docs, key).alias("doc_id"), F.coalesce(held_out(F.col(key).cast("long")), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    spec = train(named.filter(~F.col("held_out")), order=order)
    out = score_texts(named, spec)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(spec["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
