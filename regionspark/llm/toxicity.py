"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause as a string of symbols: INSULT, THREAT, TARGET, NEGATION, REPORT or
OTHER. Each part of the grammar is a transducer that rewrites symbols and weighs them; composed, they
score the insults and threats of a clause by where they stand:

* negation: a match within three words after a negation counts less;
* reported speech: a match after a verb of saying, in the same clause, counts less;
* target: a match within three words of an addressee or person counts more;
* threat: without a target near by, a threat counts little.

Clause scores make four features of a text, and a logistic curve fitted on labelled rows maps them to
a score. Function words of the grammar are stated here for four languages. Insults are learned: words
and word beginnings that are significantly more frequent in documents labelled toxic (G-test, with a
threshold that rises with the number of candidates), weighted by their log likelihood ratio.

Bounds: the fit uses at most ``MAX_LABELLED`` labelled rows (those of the smallest hash of doc_id);
copies among them, found by their least shingle hash, count once, by the text of the smallest hash. All
terms of these rows are candidates, and all significant ones are kept. Every text is scored whole.
The weights of the transducers are stated, not learned. The same rows give the same model.

Defined cases: null and empty texts score like texts without matches; rows with a null label or
doc_id take no part in the fit; repeated rows give a row each; without labels of both classes, the
stated seed terms alone decide; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import settle, trimmed, whole_id
from regionspark.llm._words import U64, mix, slices, text_bytes, word_bounds, word_hashes

MAX_LABELLED = 20_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {
    INSULT: "idiot idiots moron morons stupid imbecile loser losers scum trash worthless pathetic disgusting clown dumb fool filth vermin dummkopf arschloch trottel abschaum connard imbécile salaud ordure estúpido imbécil basura escoria",
    THREAT: "kill murder strangle stab shoot burn destroy töten umbringen vernichten tuer égorger matar destruir",
    TARGET: "you your yours yourself he she him her they them these those people du dich dir dein ihr euch sie leute tu toi vous ton votre ils eux gens tú usted ustedes ellos ellas gente",
    NEGATION: "not no never nobody isn aren wasn don doesn didn nicht nie kein keine niemand ne pas jamais aucun nunca jamás nadie ningún",
    REPORT: "said says claimed claims called wrote reported quoted alleged sagte behauptete schrieb nannte zitierte dit disait affirmait écrivait dijo dice afirmó escribió llamó",
}
#: Evidence that a seed counts with before any label is seen: toxic and clean documents.
SEED_EVIDENCE = (3.0, 0.05)
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".!?;:\n")] = True


@dataclass(frozen=True)
class Transducer:
    """step[state][symbol] = (next state, symbol out, weight). State 0 is the start."""

    step: tuple[tuple[tuple[int, int, float], ...], ...]

    def __matmul__(self, then: Transducer) -> Transducer:
        """Composition: ``then`` reads what this one writes; weights multiply."""
        pairs, rows = {(0, 0): 0}, []
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop(0)
            row = []
            for s in range(6):
                a2, out, w = self.step[a][s]
                b2, out2, w2 = then.step[b][out]
                if (a2, b2) not in pairs:
                    pairs[a2, b2] = len(pairs)
                    todo.append((a2, b2))
                row.append((pairs[a2, b2], out2, w * w2))
            rows.append(tuple(row))
        return Transducer(tuple(rows))

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        state, out = 0, []
        for s in symbols:
            state, o, w = self.step[state][s]
            out.append((o, w))
        return out


def near(mark: int, weight: dict[int, float], far: dict[int, float], window: int | None = 3) -> Transducer:
    """Weighs symbols by whether ``mark`` stood among the last ``window`` symbols (None: anywhere before)."""
    states = (window or 1) + 1
    rows = []
    for left in range(states):
        row = []
        for s in range(6):
            then = states - 1 if s == mark else (left if window is None else max(0, left - 1))
            row.append((then, s, (weight if left else far).get(s, 1.0)))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


NEGATE = near(NEGATION, {INSULT: 0.4, THREAT: 0.3}, {})
REPORTED = near(REPORT, {INSULT: 0.6, THREAT: 0.5}, {}, None)
TARGETED = near(TARGET, {INSULT: 1.4}, {THREAT: 0.25})
GRAMMAR = NEGATE @ REPORTED @ TARGETED


def clause_score(symbols: list[int], weights: list[float]) -> float:
    """Sum of the weights of a clause's insults and threats, as the grammar weighs them. A target may
    stand on either side: the clause is read in both directions."""
    ahead = GRAMMAR.run(symbols)
    plain = (NEGATE @ REPORTED).run(symbols)
    back = TARGETED.run(symbols[::-1])[::-1]
    return sum(w * max(a[1], p[1] * b[1]) for s, w, a, p, b in zip(symbols, weights, ahead, plain, back, strict=True) if s in (INSULT, THREAT))


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes of words and of word beginnings
    weights: np.ndarray
    lengths: tuple[int, ...]  # of the beginnings among the terms
    threats: np.ndarray
    marks: dict[int, np.ndarray] = field(default_factory=dict)
    curve: tuple[float, ...] = (-3.0, 1.2, 0.4, 0.4, 0.0)


def _words_of(column):
    """(bytes, starts, ends, words per text, clause of each word)."""
    raw, off = text_bytes(column)
    buf = _LETTERS[raw]
    starts, ends, n = word_bounds(buf, off)
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[raw], dtype=np.int64)])
    doc = np.repeat(np.arange(len(n)), n)
    return buf, starts, ends, n, breaks[starts] + doc


def _beginnings(buf, starts, ends, length: int):
    """Hash of the first ``length`` characters of each longer word, and which words are longer. The
    length is mixed in, so a beginning never equals a whole word."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = np.searchsorted(at, starts)
    ok = np.flatnonzero(first + length < len(at))
    ok = ok[at[first[ok] + length] < ends[ok]]
    return mix(word_hashes(buf, starts[ok], at[first[ok] + length]) + U64(length)), ok


def text_features(column, model: Model) -> np.ndarray:
    """Four features of each text, from the scores of its matched clauses."""
    buf, starts, ends, n, clause = _words_of(column)
    out = np.zeros((len(n), 4))
    if not len(starts):
        return out
    h, first, back = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    weight = np.zeros(len(h))
    symbol = np.zeros(len(h), np.int64)
    for mark, known in model.marks.items():
        symbol[np.isin(h, known)] = mark

    def look(keys, rows):
        if len(model.terms):
            at = np.minimum(np.searchsorted(model.terms, keys), len(model.terms) - 1)
            hit = model.terms[at] == keys
            np.maximum.at(weight, rows[hit], model.weights[at[hit]])

    look(h, np.arange(len(h)))
    for k in model.lengths:
        look(*_beginnings(buf, starts[first], ends[first], k))
    symbol[weight > 0] = INSULT
    symbol[(weight > 0) & np.isin(h, model.threats)] = THREAT
    hits = np.flatnonzero(weight[back] > 0)
    matched = np.unique(clause[hits])
    a, z = np.searchsorted(clause, matched), np.searchsorted(clause, matched, "right")
    doc_of = np.searchsorted(np.cumsum(n), a, "right")
    for d, i, j in zip(doc_of.tolist(), a.tolist(), z.tolist(), strict=True):
        w = back[i:j]
        score = clause_score(symbol[w].tolist(), weight[w].tolist())
        out[d, 0] += score
        out[d, 1] = max(out[d, 1], score)
        out[d, 2] += 1
    out[:, 3] = out[:, 0] / np.sqrt(np.maximum(n, 1))
    return np.log1p(out)


def _curve(x: np.ndarray, curve) -> np.ndarray:
    z = curve[0] + x @ np.array(curve[1:])
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit_curve(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a ridge on all but the constant."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, *[l2] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _seed_hashes(kind: int) -> np.ndarray:
    buf, starts, ends, _, _ = _words_of(pa.array([SEEDS[kind]]))
    return np.unique(word_hashes(buf, starts, ends))


def _terms_of(column) -> list[np.ndarray]:
    """Distinct hashes of the words and word beginnings of each text."""
    buf, starts, ends, n, _ = _words_of(column)
    doc = np.repeat(np.arange(len(n)), n)
    keys, docs = [word_hashes(buf, starts, ends)], [doc]
    for k in PREFIXES:
        h, ok = _beginnings(buf, starts, ends, k)
        keys.append(h)
        docs.append(doc[ok])
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]) if len(keys) else np.zeros(0, bool)
    return np.split(keys[first], np.searchsorted(docs[first], np.arange(1, len(n)))) if len(n) else []


def _count_terms(batches):
    """Toxic and clean documents that hold each term, per slice."""
    for b in slices(batches, "text"):
        each = _terms_of(b["text"])
        label = b["label"].to_numpy()
        h, back = np.unique(np.concatenate(each), return_inverse=True)
        toxic = np.bincount(back, np.repeat(label, [len(x) for x in each]), len(h)).astype(np.int64)
        n = np.bincount(back, minlength=len(h))
        for at in range(0, len(h), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(toxic[s]), pa.array(n[s] - toxic[s])], ["term", "t", "c"])


def _sketch(batches):
    """Least hash of the three-word shingles of each text: copies and near copies mostly share it."""
    for b in slices(batches, "text"):
        buf, starts, ends, n, _ = _words_of(b["text"])
        h = word_hashes(buf, starts, ends)
        to = np.concatenate([[0], np.cumsum(n)])
        if len(h) > 2:
            s = np.concatenate([mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]), h[-2:]])
        else:
            s = h
        out = [int(s[a : max(a + 1, z - 2)].min().view(np.int64)) if z > a else 0 for a, z in zip(to[:-1], to[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b["label"], pa.array(out, pa.int64()), b["text"]], ["label", "sketch", "text"])


def held_out(key: Column) -> Column:
    return (F.crc32(key.cast("string")) % 4) == 2


def _g2(n_t: int, n_c: int) -> Column:
    """G statistic of the table of documents with and without a term, by label."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    p = (t + c) / (n_t + n_c)
    parts = ((t, n_t * p), (c, n_c * p), (n_t - t, n_t * (1 - p)), (n_c - c, n_c * (1 - p)))
    return 2 * sum((F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(F.lit(0.0)) for o, e in parts), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    known = labels.select(whole_id(labels, key).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("label").alias("least")).filter("label = least").select("doc_id", "label")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    named = docs.select(whole_id(docs, key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = named.join(F.broadcast(known), "doc_id").select("label", "text")  # at most max_labelled rows of 12 bytes are sent
    rows = rows.mapInArrow(_sketch, "label int, sketch long, text string")
    rows = settle(rows.groupBy("label", "sketch").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic-fit")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    seeds, threats = np.union1d(_seed_hashes(INSULT), _seed_hashes(THREAT)), _seed_hashes(THREAT)
    counted = settle(rows.select("label", "text").mapInArrow(_count_terms, "term long, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t > 0"), "toxic-terms")
    found: dict[int, float] = {}
    if n_t and n_c:
        least = 2 * math.log(max(2, counted.count())) + 6
        ratio = F.ln((F.col("t") + 0.5) / (n_t + 1)) - F.ln((F.col("c") + 0.5) / (n_c + 1))
        got = counted.filter((ratio > 2) & (_g2(n_t, n_c) >= least)).select("term", ratio.alias("ratio")).toArrow()  # significant terms of max_labelled texts
        found = dict(zip(got["term"].to_numpy().view(U64).tolist(), got["ratio"].to_pylist(), strict=True))
    of_seed = {r.term % 2**64: (r.t, r.c) for r in counted.filter(F.col("term").isin(seeds.view(np.int64).tolist())).collect()}
    for term in seeds.tolist():
        t, c = of_seed.get(term, (0, 0))
        t, c = t + SEED_EVIDENCE[0], c + SEED_EVIDENCE[1]
        ratio = math.log(t / (n_t + 10)) - math.log(c / (n_c + 10))
        if ratio > 1:
            found[term] = max(found.get(term, 0.0), min(ratio, 6.0))
    terms = np.fromiter(found, U64, len(found))
    order = np.argsort(terms)
    model = Model(terms[order], np.fromiter(found.values(), float, len(found))[order], PREFIXES, threats, {k: _seed_hashes(k) for k in (TARGET, NEGATION, REPORT)})
    if n_t and n_c:
        sent = rows.sparkSession.sparkContext.broadcast(model)

        def features(batches):
            for b in slices(batches, "text"):
                x = text_features(b["text"], sent.value)
                yield pa.RecordBatch.from_arrays([b["label"], *(pa.array(x[:, i]) for i in range(4))], ["label", "a", "b", "c", "d"])

        got = rows.mapInArrow(features, "label int, a double, b double, c double, d double").toArrow()  # max_labelled rows at most
        got = got.sort_by([(k, "ascending") for k in got.column_names])
        x = np.stack([got[k].to_numpy() for k in "abcd"], 1)
        model.curve = _fit_curve(x, got["label"].to_numpy().astype(float))
    return model


def score_texts(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns but the text, and the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text]

    def run(batches):
        for b in slices(batches, text):
            s = _curve(text_features(b[text], sent.value), sent.value.curve)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(s)], [*kept, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), StructField(name, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, key, text, label)
    named = docs.select(whole_id(docs, key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = score_texts(named, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, text):
            yield b.filter(pa.array(_curve(text_features(b[text], sent.value), sent.value.curve) < threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
