"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some stretch of its words is within the item's error
budget: ``floor(error_rate * words of the item)`` word edits (insert, delete, replace). An item with
budget k is split into k + 1 pieces; k edits leave one of them intact, so exact piece hits find every
match. Around each hit the distance is verified by Myers' bit-parallel algorithm, over words, for many
windows at a time.

Words here are runs of ASCII letters and digits, letters in lower case, and of bytes from 0x80 up;
everything else parts words, so case, punctuation and layout don't hide a copy.

The index of the stated items is made once, by blocks of at most ``BLOCK_BYTES`` of item text, so the
driver holds one block at a time. Each block is a file of sorted arrays in the shared folder, which the
workers memory-map; documents are read once, whatever the number of blocks.

Defined cases: null or empty texts and items match nothing; items of fewer than 1 / error_rate words
are searched without errors; equal items and rows that share a doc_id each give their own matches;
a null item_id counts as no item; empty tables give no rows; columns other than the keys and texts are
not read, and all columns of the documents pass ``drop_contaminated`` unchanged.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import new_dir, open_array, trimmed, whole_id, write_bytes
from regionspark.llm._words import U64, mix, slices, text_bytes, word_bounds, word_hashes

ERROR_RATE = 0.2
BLOCK_BYTES = 4 << 20
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
MATCH = "item_id long, distance int, first_word long, last_word long"


def plain_words(column) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, first word of each text, with the total at the end)."""
    buf, off = text_bytes(column)
    buf = _PLAIN[buf]
    starts, ends, n = word_bounds(buf, off)
    return word_hashes(buf, starts, ends), np.concatenate([[0], np.cumsum(n)])


def pack_arrays(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """One file of named arrays, each at a multiple of eight bytes."""
    parts, about, at = [], {}, 0
    for name, a in arrays.items():
        raw = a.tobytes()
        about[name] = (a.dtype.str, at, len(a))
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(about).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return [struct.pack("<Q", len(head)), head, *parts]


def unpack_arrays(raw: np.ndarray) -> dict[str, np.ndarray]:
    size = int(raw[:8].view("<u8")[0])
    return {k: raw[8 + size + at :][: n * np.dtype(t).itemsize].view(t) for k, (t, at, n) in json.loads(raw[8 : 8 + size].tobytes()).items()}


def index_arrays(keys: list[int], texts: list[str], error_rate: float = ERROR_RATE) -> dict[str, np.ndarray]:
    """A block of items: their keys, words and budgets, and pieces by length, sorted by hash."""
    h, to = plain_words(pa.array(texts, pa.string()))
    m = np.diff(to)
    items = np.flatnonzero(m)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    budget = []
    for number, i in enumerate(items.tolist()):
        n = int(m[i])
        k = int(error_rate * n + 1e-9)
        budget.append(k)
        cuts = [j * n // (k + 1) for j in range(k + 2)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                rows.setdefault(z - a, []).append((int(_gram(h[to[i] + a : to[i] + z])), number, a))
    out = {"keys": np.array(keys, np.int64)[items], "words": h, "first": to[items], "size": m[items], "budget": np.array(budget, np.int64), "lengths": np.array(sorted(rows), np.int64)}
    for length, got in rows.items():
        got.sort()
        hashes = np.array([x[0] for x in got], U64)
        slots = np.zeros(1 << max(12, (32 * len(got)).bit_length()), bool)
        slots[hashes & U64(len(slots) - 1)] = True
        out |= {f"hash{length}": hashes, f"item{length}": np.array([x[1] for x in got], np.int64), f"at{length}": np.array([x[2] for x in got], np.int64), f"slot{length}": slots}
    return out


class Index:
    """Blocks of items, searched together."""

    def __init__(self, blocks: list[dict[str, np.ndarray]]):
        self.blocks = blocks
        self.lengths = sorted({int(x) for b in blocks for x in b["lengths"]})

    def candidates(self, h: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
        """For each block (item, text, word where the item would start) of all exact piece hits, distinct
        and sorted. A run of words is hashed once for all blocks."""
        found = [[] for _ in self.blocks]
        gram = h
        for length in range(1, max(self.lengths, default=0) + 1):
            if length > 1:
                if len(gram) < 2:
                    break
                gram = mix(gram[:-1]) + h[length - 1 :]
            if length not in self.lengths:
                continue
            for b, out in zip(self.blocks, found, strict=True):
                if f"hash{length}" not in b:
                    continue
                hashes, item, offset, slots = (b[f"{k}{length}"] for k in ("hash", "item", "at", "slot"))
                at = np.flatnonzero(slots[gram & U64(len(slots) - 1)])
                lo, hi = np.searchsorted(hashes, gram[at], "left"), np.searchsorted(hashes, gram[at], "right")
                n = hi - lo
                at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
                which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = np.repeat(at, n)
                text = np.searchsorted(to, at, "right") - 1
                ok = at + length <= to[text + 1]
                out.append(np.stack([item[which[ok]], text[ok], at[ok] - offset[which[ok]]]))
        return [np.unique(np.concatenate(out, 1), axis=1) if out else np.zeros((3, 0), np.int64) for out in found]

    def matches(self, h: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Best match of each (text, item): text, item key, distance, first and last word."""
        got = [self._matches(b, c, h, to) for b, c in zip(self.blocks, self.candidates(h, to), strict=True) if c.shape[1]]
        return np.concatenate(got, 1) if got else np.zeros((5, 0), np.int64)

    def _matches(self, b: dict[str, np.ndarray], found: np.ndarray, h: np.ndarray, to: np.ndarray) -> np.ndarray:
        item, text, start = found
        cut = [*np.flatnonzero(np.diff(item, prepend=-1)).tolist(), len(item)]
        out = []
        for begin, end_ in zip(cut, cut[1:], strict=False):
            i = int(item[begin])
            words, budget = b["words"][b["first"][i] :][: b["size"][i]], int(b["budget"][i])
            own, at = text[begin:end_], start[begin:end_]
            # starts of one diagonal band share a window
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] - at[:-1] > budget)]))
            first, last, doc = at[new], np.maximum.reduceat(at, new), own[new]
            a = np.maximum(first - budget, to[doc])
            z = np.minimum(last + len(words) + budget, to[doc + 1])
            for at_ in range(0, len(doc), 20_000):
                s = slice(at_, at_ + 20_000)
                d, end = approximate(words, h, a[s], z[s], budget)
                ok = np.flatnonzero(d <= budget)
                if len(ok):
                    out.append(np.stack([doc[s][ok], np.full(len(ok), i), d[ok], a[s][ok], end[ok]]))
        if not out:
            return np.zeros((5, 0), np.int64)
        got = np.concatenate(out, 1)
        got = got[:, np.lexsort((got[4], got[2], got[1], got[0]))]
        got = got[:, np.concatenate([[True], (got[:2, 1:] != got[:2, :-1]).any(0)])]
        for j in range(got.shape[1]):  # the match read backwards from its end gives its start
            i = got[1, j]
            words = b["words"][b["first"][i] :][: b["size"][i]]
            back = h[got[3, j] : got[4, j] + 1][::-1]
            _, end = approximate(words[::-1], back, np.array([0]), np.array([len(back)]), int(b["budget"][i]), anchored=True)
            got[3, j] = got[4, j] - end[0]
        got[3:] -= to[got[0]]
        got[1] = b["keys"][got[1]]
        return got


def _gram(words: np.ndarray) -> np.uint64:
    g = words[:1]
    for i in range(1, len(words)):
        g = mix(g) + words[i : i + 1]
    return g[0]


def approximate(pattern: np.ndarray, h: np.ndarray, a: np.ndarray, z: np.ndarray, budget: int, anchored: bool = False):
    """Least edit distance of ``pattern`` to a stretch of each window h[a:z], and where it ends (the
    first such place). anchored: the stretch starts where the window does."""
    if len(pattern) > 64:
        got = [_approximate_long(pattern, h[i:j], anchored) for i, j in zip(a, z, strict=True)]
        return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64) + a
    m = len(pattern)
    known, back = np.unique(pattern, return_inverse=True)
    masks = np.zeros(len(known) + 1, U64)
    np.bitwise_or.at(masks, back, U64(1) << np.arange(m, dtype=U64))
    n = z - a
    vp = np.full(len(a), U64((1 << m) - 1))
    vn = np.zeros(len(a), U64)
    score = np.full(len(a), m, np.int64)
    best, where = score.copy(), a - 1
    top, one = U64(m - 1), U64(1)
    carry = U64(1 if anchored else 0)
    with np.errstate(over="ignore"):
        for j in range(int(n.max(initial=0))):
            live = j < n
            w = h[np.minimum(a + j, z - 1)]
            at = np.searchsorted(known, w)
            eq = masks[np.where(known[np.minimum(at, len(known) - 1)] == w, at, len(known))]
            x = eq | vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hp = vn | ~(vp | d0)
            hn = vp & d0
            score = np.where(live, score + (hp >> top & one).astype(np.int64) - (hn >> top & one).astype(np.int64), score)
            hp = hp << one | carry
            hn = hn << one
            vp = hn | ~(hp | d0)
            vn = hp & d0
            better = live & (score < best)
            best = np.where(better, score, best)
            where = np.where(better, a + j, where)
    return best, where


def _approximate_long(pattern: np.ndarray, window: np.ndarray, anchored: bool) -> tuple[int, int]:
    """The same for a pattern of any length, over Python's integers."""
    m = len(pattern)
    full = (1 << m) - 1
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    vp, vn, score, best, where = full, 0, m, m, -1
    for j, w in enumerate(window.tolist()):
        x = masks.get(w, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hp, hn = (vn | ~(vp | d0)) & full, vp & d0
        score += (hp >> (m - 1) & 1) - (hn >> (m - 1) & 1)
        hp = (hp << 1 | anchored) & full
        hn = hn << 1 & full
        vp, vn = (hn | ~(hp | d0)) & full, hp & d0
        if score < best:
            best, where = score, j
    return best, where


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """Yields (keys, texts) of blocks of items, each of about ``block_bytes`` at most."""
    named = benchmark.select(whole_id(benchmark, key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null and k is not null")
    total = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        rows = named.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).orderBy("k", "t").collect()
        if rows:
            yield [r.k for r in rows], [r.t for r in rows]


def store_index(benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, key: str = "item_id", text: str = "text") -> list[str]:
    """Write the index of all items; returns the URIs of its blocks."""
    folder = new_dir(benchmark.sparkSession, "decontaminate")
    out = []
    for keys, texts in item_blocks(benchmark, key, text, block_bytes):
        out.append(f"{folder}/block-{len(out):05d}")
        write_bytes(out[-1], *pack_arrays(index_arrays(keys, texts, error_rate)))
    return out


def _open(uris: list[str]) -> Index:
    return Index([unpack_arrays(open_array(u, "u1")) for u in uris])


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, first_word, last_word: the best match of each row and item."""
    named = docs.select(whole_id(docs, key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    uris = store_index(benchmark, error_rate, block_bytes)

    def run(batches):
        index = _open(uris)
        for b in slices(batches, "text", 8 << 20):
            row, item, d, first, last = index.matches(*plain_words(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row)), pa.array(item), pa.array(d.astype(np.int32)), pa.array(first), pa.array(last)], ["doc_id", "item_id", "distance", "first_word", "last_word"])

    return named.mapInArrow(run, f"doc_id long, {MATCH}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item."""
    uris = store_index(benchmark, error_rate, block_bytes)

    def run(batches):
        index = _open(uris)
        for b in slices(batches, text):
            keep = np.ones(b.num_rows, bool)
            keep[index.matches(*plain_words(b[text]))[0]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
