"""Vectorised work on the bytes of whole text columns: word bounds, word hashes, XXH64.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 none of those bytes is ever part
of another character, so byte runs and code-point runs are the same. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_TAKE = 1 << 18
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: By size of a short word: which of eight bytes are its own, and the space that closes it.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_CLOSE = np.array([0x20 << 8 * n if n < 8 else 0 for n in range(9)], U64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets of each text), nulls empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    a = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches, text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``size`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch[text])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text)."""
    n = len(buf)
    ink = ~WS[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cut = off[off < n]
    first[cut] = ink[cut]
    cut = off[off > 0] - 1
    last[cut] = ink[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: of up to eight bytes one that no other such word has (its bytes, closed
    by a space where shorter, which no word holds, through a bijection), of more bytes XXH64."""
    out = np.empty(len(starts), U64)
    sizes = ends - starts
    short = sizes <= 8
    u8 = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))
    n = sizes[short].astype(U64)
    out[short] = mix((u8[starts[short]] & _KEEP[n]) | _CLOSE[n])
    long = np.flatnonzero(~short)
    out[long] = xxh64(buf, starts[long], ends[long], 7)
    return out


def line_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of byte ranges that may hold spaces."""
    return xxh64(buf, starts, ends, 7)


def take_ranges(src: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """src[s : s + n] of all ranges, end to end."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return src[:0]
    out = np.empty(int(ends[-1]), src.dtype)
    shift = starts - (ends - sizes)
    at = done = 0
    while at < len(ends):  # so many at a time, as each item's place takes eight bytes, twice
        z = max(at + 1, int(np.searchsorted(ends, done + _TAKE, "right")))
        to = int(ends[z - 1])
        if z == at + 1:
            out[done:to] = src[starts[at] : starts[at] + (to - done)]
        else:
            out[done:to] = src[np.repeat(shift[at:z], sizes[at:z]) + np.arange(done, to)]
        at, done = z, to
    return out


def same_ranges(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of each pair of ranges, of one size each, are equal. Sizes are above zero."""
    out = np.ones(len(sizes), bool)
    to = np.cumsum(sizes)
    at = 0
    while at < len(sizes):  # so many bytes at a time
        z = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + (4 << 20), "right")))
        n = sizes[at:z]
        differ = take_ranges(a, a_at[at:z], n) != take_ranges(b, b_at[at:z], n)
        out[at:z] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        at = z
    return out


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None):
    """(hash, row of one occurrence, count) of each distinct word, and which of them each word is.

    Words are told apart by their bytes: where those of one hash differ, they are entries of their
    own. Entries are sorted by hash."""
    h = word_hashes(buf, starts, ends) if h is None else h
    keys, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    sizes = ends - starts
    rep = first[back]
    odd = sizes != sizes[rep]
    # two words of at most eight bytes never share a hash
    check = np.flatnonzero(~odd & (sizes > 8) & (count[back] > 1))
    odd[check] = ~same_ranges(buf, starts[check], buf, starts[rep[check]], sizes[check])
    odd = np.flatnonzero(odd)
    if not len(odd):
        return keys, first, count, back
    more: dict[bytes, int] = {}
    for i in odd.tolist():
        count[back[i]] -= 1
        word = buf[starts[i] : ends[i]].tobytes()
        if word not in more:
            more[word] = len(first)
            keys, first, count = np.append(keys, h[i]), np.append(first, i), np.append(count, 0)
        back[i] = more[word]
        count[more[word]] += 1
    order = np.argsort(keys, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return keys[order], first[order], count[order], place[back]


def spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space after each word and nothing else between, and the words' new bounds."""
    if not len(starts):
        return np.zeros(0, np.uint8), starts, ends
    ink = np.zeros(len(buf) + 2, np.int8)
    sizes = ends - starts
    new_end = np.cumsum(sizes + 1) - 1
    new_start = new_end - sizes
    ink[starts] += 1
    ink[ends] -= 1
    keep = np.cumsum(ink[: len(buf)], dtype=np.int8).astype(bool)
    out = np.full(int(new_end[-1]) + 1, 32, np.uint8)
    gap = np.ones(len(out), bool)
    gap[new_end] = False
    out[gap] = buf[keep]
    return out, new_start, new_end


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rol(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc, lane):
    return _rol(acc + lane * _P2, 31) * _P1


def _xxh64_same(u8, u4, buf, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    seed = U64(seed)
    pos = 0
    if size >= 32:
        acc = [np.full(len(at), v, U64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while pos + 32 <= size:
            acc = [_round(a, u8[at + (pos + 8 * i)]) for i, a in enumerate(acc)]
            pos += 32
        h = _rol(acc[0], 1) + _rol(acc[1], 7) + _rol(acc[2], 12) + _rol(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros_like(a), a)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5, U64)
    h = h + U64(size)
    while pos + 8 <= size:
        h = _rol(h ^ _round(U64(0), u8[at + pos]), 27) * _P1 + _P4
        pos += 8
    if pos + 4 <= size:
        h = _rol(h ^ (u4[at + pos].astype(U64) * _P1), 23) * _P2 + _P3
        pos += 4
    while pos < size:
        h = _rol(h ^ (buf[at + pos].astype(U64) * _P5), 11) * _P1
        pos += 1
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range; equal lengths are hashed together."""
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u8 = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))
    u4 = np.ndarray(len(buf) + 1, "<u4", padded, 0, (1,))
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    at = 0
    with np.errstate(over="ignore"):
        for size, n in zip(*np.unique(sizes, return_counts=True), strict=True):
            rows = order[at : at + n]
            at += n
            if n < 16:
                out[rows] = [xxhash.xxh64_intdigest(buf[s : s + size].tobytes(), seed) for s in starts[rows]]
            else:
                out[rows] = _xxh64_same(u8, u4, padded, starts[rows], int(size), seed)
    return out
