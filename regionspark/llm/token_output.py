"""Token-id / binary output: frequency-ranked ids in byte-aligned variable-length coding.

File format. A run writes one folder:

* ``words-NNNNN.*``: the word table. For each distinct word of the texts (sorted 64-bit word hash, and
  the word's bytes) the token ids the tokenizer gives it; made once per word, memory-mapped by the
  encoders. A word is looked up by hash and then compared byte by byte, so words that share a hash
  keep their own ids.
* ``ranks``: little-endian u32, token id by rank; rank 0 is the most frequent id of the corpus.
* ``shard-NNNNN``: texts in ascending doc_id order. ``RSVB`` + u32 version + u64 documents + u64
  control bytes + u64 data bytes; then i64 doc ids, u64 ids per document, control bytes, data bytes.
  Each document starts a new control byte. A control byte holds four 2-bit lengths (0-3: one to four
  data bytes), the lowest bits first; data bytes hold ranks, little-endian. Decoding looks control
  bytes up in a 256 x 4 table.

The tokenizer splits at white space and sees no context across it, so ids of a text are the ids of
its words end to end; each distinct word goes through the tokenizer once.

Defined cases: null or empty text encodes to the end id alone; rows that share a doc_id stay apart,
ordered by their coded bytes; a null doc_id comes first; an empty table gives no rows; other columns
of the input are never read.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import new_dir, open_array, read_bytes, settle, shuffle_parts, trimmed, write_bytes, whole_id
from regionspark.llm._words import distinct_words, same_ranges, slices, take_ranges, text_bytes, word_bounds

END_ID = 1
SHARD_BYTES = 64 << 20
_PIECE = 2 << 20
_HEAD = "<4sIQQQ"
#: Data bytes of each of the four ids of a control byte.
LENGTHS = np.array([[(b >> (2 * i) & 3) + 1 for i in range(4)] for b in range(256)], np.uint8)


def code_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2-bit length codes, one per rank; data bytes)."""
    ranks = ranks.astype("<u4")
    codes = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    four = ranks.view(np.uint8).reshape(-1, 4)
    return codes, four[np.arange(4) <= codes[:, None]]


def pack_codes(codes: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    q = padded.reshape(-1, 4)
    return q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents that follow each other, ``counts`` ids each."""
    per = -(-counts // 4)
    lengths = LENGTHS[control].reshape(-1)
    if len(counts) != 1 or counts[0] != len(lengths):
        first = (np.cumsum(per) - per) * 4
        real = np.zeros(len(lengths) + 1, np.int8)
        np.add.at(real, first, 1)
        np.add.at(real, first + counts, -1)
        lengths = lengths[np.cumsum(real[:-1], dtype=np.int8).astype(bool)]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(lengths > i)
        out[more] |= data[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_words(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, ids per word). Many words go through the tokenizer in one call,
    parted by a word whose single id no other word of the call has."""
    sizes = np.zeros(len(words), np.int64)
    out: list[np.ndarray] = []
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        mark, mark_id = "", -1
        text = "\n".join(part)
        for c in "‡§†¶¬Ŧ":
            got = tokenizer.encode(c, add_special_tokens=False).ids
            if c not in text and len(got) == 1:
                mark, mark_id = c, got[0]
                break
        if mark:
            ids = np.array(tokenizer.encode(f" {mark} ".join(part), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == mark_id)
            if len(cut) == len(part) - 1:
                out.append(np.delete(ids, cut))
                sizes[at : at + len(part)] = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                continue
        each = tokenizer.encode_batch(part, add_special_tokens=False)
        sizes[at : at + len(part)] = [len(x.ids) for x in each]
        out.append(np.array([i for x in each for i in x.ids], np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32), sizes


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts: hashes, sorted, sizes, counts, and bytes end to end."""
    buf, off = text_bytes(column)
    starts, ends, _ = word_bounds(buf, off)
    h, first, count, _ = distinct_words(buf, starts, ends)
    starts, sizes = starts[first], (ends - starts)[first]
    return h, sizes, count, take_ranges(buf, starts, sizes)


def merge_words(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Several tables of distinct words, as ``words_of`` gives them, as one; counts are added."""
    h, sizes, count, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = sizes.astype(np.int64)
    at = np.cumsum(sizes) - sizes
    keys, first, _, back = distinct_words(words, at, at + sizes, h)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, count)
    return keys, sizes[first], total, take_ranges(words, at[first], sizes[first])


def _distinct_words(n: int, text: str):
    """Per slice of texts and hash range: its distinct words, their hashes and counts. A slice goes by
    small pieces, put together by hash range, as arrays of all its words take many times the text's size."""
    edges = (np.arange(n + 1) * (2**64 / n)).clip(0, 2**64 - 2048).astype(np.uint64)

    def run(batches):
        for b in slices(batches, text, 16 << 20):
            pieces = []
            for piece in slices([b], text, _PIECE):
                own = words_of(piece[text])
                cuts = np.searchsorted(own[0], edges)
                cuts[-1] = len(own[0])
                pieces.append((own, cuts, np.concatenate([[0], np.cumsum(own[1])])[cuts]))
            rows = []
            for k in range(n):
                parts = [[*(x[c[k] : c[k + 1]] for x in own[:3]), own[3][to[k] : to[k + 1]]] for own, c, to in pieces if c[k] < c[k + 1]]
                if parts:
                    h, sizes, count, words = merge_words(parts)
                    rows.append((k, h.tobytes(), sizes.astype("<u4").tobytes(), count.astype("<i8").tobytes(), words.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "h", "n", "c", "words"])

    return run


def _encode_table(folder: str, tokenizer_path: str):
    """One bucket's word table; yields the counts of its ids."""

    def finish(bucket, parts, tokenizer):
        keys, n, total, words = merge_words([[np.frombuffer(x, t) for x, t in zip(p, (np.uint64, "<u4", "<i8", np.uint8), strict=True)] for p in parts])
        to = np.cumsum(n)
        ids, sizes = [], []
        for a in range(0, len(keys), 20_000):
            rows = slice(a, a + 20_000)
            got = encode_words(tokenizer, [words[z - k : z].tobytes().decode() for z, k in zip(to[rows].tolist(), n[rows].tolist(), strict=True)])
            ids.append(got[0])
            sizes.append(got[1])
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        name = f"{folder}/words-{bucket:05d}"
        write_bytes(f"{name}.hash", keys.tobytes())
        write_bytes(f"{name}.to", to.astype("<i8").tobytes())
        write_bytes(f"{name}.words", words.tobytes())
        write_bytes(f"{name}.end", np.cumsum(sizes).astype("<i8").tobytes())
        write_bytes(f"{name}.ids", ids.astype("<u4").tobytes())
        used, back = np.unique(ids, return_inverse=True)
        return bucket, len(keys), used.astype("<u4").tobytes(), np.bincount(back, np.repeat(total, sizes), len(used)).astype("<i8").tobytes()

    def run(batches):
        tokenizer, bucket, parts, rows = _tokenizer(tokenizer_path), None, [], []
        for b in batches:
            for k, *part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if parts and k != bucket:
                    rows.append(finish(bucket, parts, tokenizer))
                    parts = []
                bucket = k
                parts.append(part)
        if parts:
            rows.append(finish(bucket, parts, tokenizer))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n_words", "ids", "counts"])

    return run


def _id_counts(batches):
    """Sums of the counts of each id, per task."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for ids, n in zip(b["ids"].to_pylist(), b["counts"].to_pylist(), strict=True):
            ids, n = np.frombuffer(ids, "<u4"), np.frombuffer(n, "<i8")
            if len(ids) and ids.max() >= len(total):
                total = np.concatenate([total, np.zeros(int(ids.max()) + 1 - len(total), np.int64)])
            total[ids] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


class _Table:
    """Maps words to coded ids; arrays are memory-mapped, looked up in order of the hash."""

    def __init__(self, folder: str, buckets: list[int]):
        self.rank = np.empty(0, np.uint32)
        ranks = open_array(f"{folder}/ranks", "<u4")
        self.rank = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
        self.rank[ranks] = np.arange(len(ranks), dtype=np.uint32)
        self.parts = [[open_array(f"{folder}/words-{b:05d}.{x}", t) for x, t in (("hash", np.uint64), ("end", "<i8"), ("ids", "<u4"), ("to", "<i8"), ("words", "u1"))] for b in buckets]
        self.first = np.array([p[0][0] for p in self.parts], np.uint64)

    def ranks_of(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks end to end, ranks per word) of words given by hash, sorted, and bytes; all are known."""
        which = np.searchsorted(self.first, keys, "right") - 1
        ranks, counts = [], []
        for k in np.unique(which):
            h, end, ids, to, words = self.parts[k]
            own = np.flatnonzero(which == k)
            at = np.searchsorted(h, keys[own])
            todo = np.arange(len(own))
            while len(todo):  # the next of the same hash where the bytes differ
                here, of = at[todo], own[todo]
                word = np.where(here > 0, to[np.maximum(here - 1, 0)], 0)
                same = to[here] - word == sizes[of]
                some = np.flatnonzero(same & (sizes[of] > 8))
                same[some] = same_ranges(words, word[some], buf, starts[of[some]], sizes[of[some]])
                todo = todo[~same]
                at[todo] += 1
            z = end[at]
            a = np.where(at > 0, end[np.maximum(at - 1, 0)], 0)
            ranks.append(self.rank[take_ranges(ids, a, z - a)])
            counts.append(z - a)
        return (np.concatenate(ranks), np.concatenate(counts)) if ranks else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _coded(b: pa.RecordBatch, table: _Table, bounds: np.ndarray, key: str, text: str, end_id: int) -> pa.RecordBatch:
    """One slice of documents, coded."""
    buf, off = text_bytes(b[text])
    starts, ends, n_words = word_bounds(buf, off)
    keys, first, _, back = distinct_words(buf, starts, ends)
    ranks, sizes = table.ranks_of(keys, buf, starts[first], (ends - starts)[first])
    codes, data = code_ranks(ranks)
    ids_at = np.cumsum(sizes) - sizes
    bytes_to = np.concatenate([[0], np.cumsum(codes.astype(np.int64) + 1)])
    data_at, data_n = bytes_to[ids_at], bytes_to[ids_at + sizes] - bytes_to[ids_at]
    end_codes, end_data = code_ranks(table.rank[[end_id]])
    word_to = np.concatenate([[0], np.cumsum(n_words)])
    out = []
    doc = 0
    while doc < b.num_rows:  # so many words at a time that the arrays stay small
        to = max(doc + 1, int(np.searchsorted(word_to, word_to[doc] + 500_000, "right")) - 1)
        w = back[word_to[doc] : word_to[to]]
        c, d = take_ranges(codes, ids_at[w], sizes[w]), take_ranges(data, data_at[w], data_n[w])
        c_to = np.concatenate([[0], np.cumsum(sizes[w])])[word_to[doc : to + 1] - word_to[doc]]
        d_to = np.concatenate([[0], np.cumsum(data_n[w])])[word_to[doc : to + 1] - word_to[doc]]
        for i in range(to - doc):
            own = np.concatenate([c[c_to[i] : c_to[i + 1]], end_codes])
            out.append((len(own), pack_codes(own).tobytes(), d[d_to[i] : d_to[i + 1]].tobytes() + end_data.tobytes()))
        doc = to
    ids = b[key].cast(pa.int64())
    shard = np.searchsorted(bounds, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
    n, control, data_ = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(n, pa.int64()), pa.array(control, pa.binary()), pa.array(data_, pa.binary())], ["shard", "doc_id", "n_tokens", "control", "data"])


def _encode_docs(folder: str, buckets: list[int], bounds: list[int], key: str, text: str, end_id: int):
    def run(batches):
        table = None
        for b in slices(batches, text):
            table = table or _Table(folder, buckets)
            yield _coded(b, table, np.array(bounds, np.int64), key, text, end_id)

    return run


def _write_shards(folder: str):
    def finish(shard, parts):
        t = pa.Table.from_batches(parts)
        ids = t["doc_id"].combine_chunks()
        null = ids.null_count
        control, data = (t[c].combine_chunks() for c in ("control", "data"))
        control, data = (b"".join(x.to_pylist()) for x in (control, data))
        n = t["n_tokens"].to_numpy()
        write_bytes(f"{folder}/shard-{shard:05d}", struct.pack(_HEAD, b"RSVB", 1, len(n), len(control), len(data)), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), n.astype("<u8").tobytes(), control, data)
        return shard, len(n), int(n.sum()), null

    def run(batches):
        shard, parts, rows = None, [], []
        for b in batches:
            s = b["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if parts and s[a] != shard:
                    rows.append(finish(shard, parts))
                    parts = []
                shard = int(s[a])
                parts.append(b.slice(a, z - a))
        if parts:
            rows.append(finish(shard, parts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)], ["shard", "n_docs", "n_tokens", "n_null"])

    return run


def read_shard(uri: str, ranks: np.ndarray):
    """Yields (doc_id, ids) of one shard file, in file order."""
    for doc, ids in _shard_chunks(uri, ranks):
        yield from zip(doc.tolist(), ids, strict=True)


def _shard_chunks(uri: str, ranks: np.ndarray, chunk: int = 1 << 20):
    raw = read_bytes(uri)
    magic, version, docs, n_control, n_data = struct.unpack_from(_HEAD, raw)
    if magic != b"RSVB" or version != 1:
        raise ValueError(f"{uri} is not a token shard")
    at = struct.calcsize(_HEAD)
    doc = np.frombuffer(raw, "<i8", docs, at)
    n = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
    control = np.frombuffer(raw, np.uint8, n_control, at + 16 * docs)
    data = np.frombuffer(raw, np.uint8, n_data, at + 16 * docs + n_control)
    c_to = np.concatenate([[0], np.cumsum(-(-n // 4))])
    n_to = np.concatenate([[0], np.cumsum(n)])
    a = d = 0
    while a < docs:
        z = max(a + 1, int(np.searchsorted(n_to, n_to[a] + chunk, "right")) - 1)
        got = decode(control[c_to[a] : c_to[z]], data[d:], n[a:z])
        d += int(len(got) + (got > 0xFF).sum() + (got > 0xFFFF).sum() + (got > 0xFFFFFF).sum())
        ids = ranks[got].astype("<u4")
        yield doc[a:z], np.split(ids, np.cumsum(n[a:z])[:-1])
        a = z


def _read_back(folder: str):
    def run(batches):
        for b in batches:
            for shard, start, null in zip(*(b[c].to_pylist() for c in ("shard", "start", "n_null")), strict=True):
                ranks = open_array(f"{folder}/ranks", "<u4")
                for doc, ids in _shard_chunks(f"{folder}/shard-{shard:05d}", ranks):
                    n = np.array([len(x) for x in ids], np.int64)
                    keys = pa.array(doc, pa.int64(), mask=np.arange(len(doc)) < null)
                    null = max(0, null - len(doc))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(n.sum())

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encode ``docs`` to a folder of token files. Returns the folder and its manifest
    (shard, start, n_docs, n_tokens, n_null), one row for each shard file."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    docs = docs.select(whole_id(docs, key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = shuffle_parts(spark)
    made = (
        docs.select("text").mapInArrow(trimmed(_distinct_words(parts, "text")), "bucket int, h binary, n binary, c binary, words binary")
        .repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")
        .mapInArrow(trimmed(_encode_table(folder, tokenizer_path)), "bucket int, n_words long, ids binary, counts binary")
    )
    made = settle(made, "token-words")
    buckets = [r.bucket for r in made.select("bucket").collect()]
    total = made.mapInArrow(_id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # of the size of the vocabulary at most
    ids, n = total["id"].to_numpy(), total["n"].to_numpy()
    counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    counts[ids] = n
    buckets.sort()
    if len(counts) <= end_id:
        counts = np.concatenate([counts, np.zeros(end_id + 1 - len(counts), np.int64)])
    counts[end_id] += 1
    used = np.flatnonzero(counts)
    write_bytes(f"{folder}/ranks", used[np.lexsort((used, -counts[used]))].astype("<u4").tobytes())
    n_shards = max(parts, int(counts.sum() * 2 // SHARD_BYTES))
    cuts = docs.select(F.percentile_approx("doc_id", [i / n_shards for i in range(1, n_shards)] or [0.5], 10 * n_shards).alias("q")).first().q or []
    bounds = sorted(set(cuts))
    rows = (
        docs.mapInArrow(trimmed(_encode_docs(folder, buckets, bounds, "doc_id", "text", end_id)), "shard int, doc_id long, n_tokens long, control binary, data binary")
        .repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "control", "data")
        .mapInArrow(trimmed(_write_shards(folder)), "shard int, n_docs long, n_tokens long, n_null long").collect()
    )  # a row for each shard
    start, manifest = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        manifest.append((r.shard, start, r.n_docs, r.n_tokens, r.n_null))
        start += r.n_tokens
    out = spark.createDataFrame(manifest, "shard int, start long, n_docs long, n_tokens long, n_null long")
    write_bytes(f"{folder}/manifest.csv", ("shard,start,n_docs,n_tokens,n_null\n" + "".join(",".join(map(str, m)) + "\n" for m in manifest)).encode())
    return folder, out


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens, ids_crc32 of each document."""
    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.repartition(n).mapInArrow(trimmed(_read_back(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Write, then read back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    return read_tokens(*write_tokens(docs, tokenizer_path, **how))
