import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from regionspark.llm import token_output as m

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    for counts in ([0, 1, 5], [4], [3, 0, 0, 9, 1000], []):
        docs = [rng.choice([0, 200, 255, 256, 65535, 65536, 2**24, 2**32 - 1], n).astype(np.uint32) for n in counts]
        coded = [m.code_ranks(d) for d in docs]
        control = np.concatenate([m.pack_codes(c) for c, _ in coded] or [np.zeros(0, np.uint8)])
        data = np.concatenate([d for _, d in coded] or [np.zeros(0, np.uint8)])
        assert m.decode(control, data, np.array(counts, np.int64)).tolist() == [x for d in docs for x in d.tolist()]


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


TEXTS = ["", None, "Hello  World\tit's 42!", "Ünïcode ‡ § é ÉCOLE\n\n<|endoftext|> x<|startoftext|>y", "a\u0085b c d ́x", "日本語 テキスト 😀", "w" * 3000, "the and " * 4000]


@pytest.mark.parametrize("keys", [range(8), [5, 3, 1, 0, -2, 9, 8, 7], [None, 1, 2, 3, 4, 5, 6, 7]])
def test_against_tokenizer(spark, keys):
    rows = list(zip(keys, TEXTS, strict=True))
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, start int, n_tokens int").repartition(3)
    got = sorted(map(tuple, m.token_output(df, PATH).collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (1, "zz")], "doc_id long, text string")
    got = sorted(map(tuple, m.token_output(df, PATH).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [1, 1, 1, 2] and got[-1][1] == sum(g[2] for g in got[:-1])
    assert m.token_output(df.limit(0), PATH).collect() == []


def test_files(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    folder, manifest = m.write_tokens(df, PATH)
    ranks = m.open_array(f"{folder}/ranks", "<u4")
    t = Tokenizer.from_file(PATH)
    got = {}
    for r in manifest.collect():
        for k, ids in m.read_shard(f"{folder}/shard-{r.shard:05d}", ranks):
            got[k] = ids.tolist()
    assert got == {k: [*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in enumerate(TEXTS)}


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate({97: "b", 98: "a"})
    return w


def test_words_of_one_hash_keep_their_ids(spark, monkeypatch):
    from regionspark.llm import _words as w

    a = thue_morse(1024)
    texts = [a, a.translate({97: "b", 98: "a"}), f"{a} x", "a", "a\0", "\0" * 8, "abcdefgh", "abcdefg", "abcdefghi"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, m.token_output(df, PATH).collect())) == brute(list(enumerate(texts)))
    # every long word of one hash: told apart by their bytes
    monkeypatch.setattr(w, "xxh64", lambda buf, s, e, seed=42: np.full(len(s), 5, np.uint64))
    words = ["internationally", "extraordinaries", "internationally", "ab", "unquestionable", "incomprehensibly", "extraordinaries"]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = w.word_bounds(raw, np.array([0, len(raw)]))
    h, first, count, back = w.distinct_words(raw, s, e)
    assert [words[first[i]] for i in back] == words and sorted(count.tolist()) == [1, 1, 1, 2, 2] and (np.diff(h.astype(float)) >= 0).all()


def counted(batches):
    got = {}
    for b in batches:
        for h, n, c, words in zip(*(b[x].to_pylist() for x in ("h", "n", "c", "words")), strict=True):
            n, at = np.frombuffer(n, "<u4"), 0
            assert (np.diff(np.frombuffer(h, np.uint64).astype(float)) >= 0).all()
            for size, count in zip(n.tolist(), np.frombuffer(c, "<i8").tolist(), strict=True):
                word = words[at : at + size]
                at += size
                assert word not in got  # once, as all texts are one slice
                got[word] = count
            assert at == len(words)
    return got


@pytest.mark.parametrize("one_hash", [False, True])
def test_pieces_are_put_together(monkeypatch, one_hash):
    from regionspark.llm import _words as w

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" * (1 + i % 7) for i in rng.zipf(1.5, 60) % 300) for _ in range(50)] + ["", None, "v" * 500, "é ü é"]
    monkeypatch.setattr(m, "_PIECE", 900, raising=False)
    monkeypatch.setattr(w, "_TAKE", 64, raising=False)
    if one_hash:
        monkeypatch.setattr(w, "xxh64", lambda buf, s, e, seed=42: np.full(len(s), 5, np.uint64))
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert counted(m._distinct_words(5, "text")([batch])) == Counter(x for t in texts for x in (t or "").encode().split())


def test_ranges_are_taken_a_part_at_a_time(monkeypatch):
    from regionspark.llm import _words as w

    rng = np.random.default_rng(4)
    src = rng.integers(0, 256, 1000).astype(np.uint8)
    starts, sizes = rng.integers(0, 900, 200), rng.choice([0, 0, 1, 5, 99], 200)
    want = np.concatenate([src[s : s + n] for s, n in zip(starts, sizes, strict=True)])
    for most in (1, 7, 100, 1 << 18):
        monkeypatch.setattr(w, "_TAKE", most, raising=False)
        assert (w.take_ranges(src, starts, sizes) == want).all() and len(w.take_ranges(src, starts[:0], sizes[:0])) == 0


def test_workers_stay_small(tmp_path):
    rng = np.random.default_rng(5)
    voc = ["".join(rng.choice(list("abdegiklmnorstu"), n)) for n in rng.integers(2, 11, 60_000)]
    texts = [" ".join(voc[i] for i in rng.integers(0, len(voc), 600)) for _ in range(4_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    size = sum(map(len, texts))
    assert 14 << 20 < size < 24 << 20

    def peak(gen):
        tracemalloc.start()
        for _ in gen:
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / size

    folder = str(tmp_path)
    list(m._encode_table(folder, PATH)(m._distinct_words(1, "text")([batch])))
    m.write_bytes(f"{folder}/ranks", np.arange(60_000, dtype="<u4").tobytes())
    words, coded = peak(m._distinct_words(32, "text")([batch])), peak(m._encode_docs(folder, [0], [], "doc_id", "text", 1)([batch]))
    assert words < 6 and coded < 6, (words, coded)
