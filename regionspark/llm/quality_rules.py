"""Quality rules: a decision list learned by sequential covering.

Statistics of each whole text come from one pass over its bytes. From the statistics of labelled
rows, rules for the rejected class are learned one after another: a conjunction of threshold tests
grows by FOIL gain on two thirds of the rows, is pruned on the other third, and is kept while it is
precise there; rows it covers are set aside and the next rule is grown. Every threshold between two
values is tried, a conjunction grows while there is gain, and rules are learned while ``MIN_COVER`` rows
of the rejected class are left. The list becomes one Spark conditional expression, its branches in order.

The fit uses at most ``MAX_LABELLED`` labelled rows (those of the smallest hash of the id), so the
driver holds a bounded table; rules then apply to all rows inside Spark.

Defined cases: a null text has no words; rows that share an id give a row each, and in the fit a row
each; labels other than 0 and 1 are left out; no labels, or one class only, give an empty list that
keeps what the base tests keep; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import whole_id
from regionspark.llm._words import U64, line_hashes, mix, slices, text_bytes, word_bounds, word_hashes

MAX_LABELLED = 200_000
#: A rule stays if this share of what it rejects, on the rows kept for pruning, is labelled bad.
MIN_PRECISION = 0.9
MIN_COVER = 4
STATS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_chars": "long", "n_lines": "long", "n_upper": "long", "n_digits": "long", "n_marks": "long", "n_distinct_words": "long",
}
#: What thresholds are set on: ratios of statistics, so that a rule means the same at any length.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
}
_SYMBOLS, _MARKS, _DIGITS, _UPPER = (np.zeros(256, bool) for _ in range(4))
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS[list(b"!?")] = True
_DIGITS[48:58] = True
_UPPER[65:91] = True


def _per(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[off])


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a (doc, h) that an earlier or later row has; and which aren't the first."""
    key = mix(h ^ mix(doc.astype(U64) + U64(1)))
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(h), bool)
    later[first] = False
    return n[back] > 1, later


def text_stats(column) -> dict[str, np.ndarray]:
    """All STATS of each text of an Arrow column."""
    buf, off = text_bytes(column)
    n = len(off) - 1
    starts, ends, n_words = word_bounds(buf, off)
    char = (buf & 0xC0) != 0x80
    ink = np.zeros(len(buf) + 1, np.int8)
    ink[starts] += 1
    ink[ends] -= 1
    ink = np.cumsum(ink[:-1], dtype=np.int8).astype(bool)
    # lines: from each text's start or after each \n
    br = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], br + 1]))
    line_start = line_start[line_start < len(buf)]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(buf)), off[line_doc + 1])
    after = np.searchsorted(br, line_start)
    cut = np.append(br, len(buf))[after]
    line_end = np.minimum(line_end, np.maximum(cut, line_start))
    written = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[written], line_end[written], line_doc[written]
    again = _repeated(line_hashes(buf, line_start, line_end), line_doc)[1] if len(line_start) else np.zeros(0, bool)
    word_doc = np.repeat(np.arange(n), n_words)
    h = word_hashes(buf, starts, ends)
    distinct = ~_repeated(h, word_doc)[1] if len(h) else np.zeros(0, bool)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        own = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        three = mix(mix(mix(h[own]) + h[own + 1]) + h[own + 2])
        hit = own[_repeated(three, word_doc[own])[0]] if len(own) else own
        for i in range(3):
            covered[hit + i] = True
    count = lambda doc, mask=None: np.bincount(doc if mask is None else doc[mask], minlength=n).astype(np.int64)
    return {
        "n_words": n_words.astype(np.int64), "word_chars": _per(char & ink, off), "n_symbols": _per(_SYMBOLS[buf], off), "n_dup_lines": count(line_doc, again), "n_repeat_words": count(word_doc, covered),
        "n_chars": _per(char, off), "n_lines": count(line_doc), "n_upper": _per(_UPPER[buf], off), "n_digits": _per(_DIGITS[buf], off), "n_marks": _per(_MARKS[buf], off), "n_distinct_words": count(word_doc, distinct),
    }


def with_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and all STATS of each row."""

    def run(batches):
        for b in slices(batches, "text"):
            got = text_stats(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(got[k], pa.int64()) for k in STATS)], ["doc_id", *STATS])

    named = docs.select(whole_id(docs, key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in STATS.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self) -> Column:
        return ratio(self.feature) > self.value if self.above else ratio(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    rejected: int
    wrongly: int

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.mask(x) for t in self.tests])

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def best_test(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Test | None:
    """The test of largest FOIL gain on ``rows`` (none: no gain); of equal ones the first by feature, then
    the lowest threshold, then ``<=``."""
    p0, n0 = int(bad[rows].sum()), int((~bad[rows]).sum())
    best, most = None, 1e-9
    for k, v in x.items():
        order = np.argsort(v[rows], kind="stable")
        value, own = v[rows][order], bad[rows][order]
        at = np.flatnonzero(value[1:] > value[:-1])
        if not len(at):
            continue
        below = np.cumsum(own)[at]
        for above, p, n in ((False, below, at + 1 - below), (True, p0 - below, n0 - (at + 1 - below))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= MIN_COVER / 2, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
            i = int(gain.argmax())
            if gain[i] > most or (gain[i] == most and best.feature == k and value[at[i]] < best.value):
                a, b = float(value[at[i]]), float(value[at[i] + 1])
                mid = a + (b - a) / 2
                best, most = Test(k, above, mid if a <= mid < b else a), gain[i]
    return best


def _grow(x, bad, rows) -> list[Test]:
    tests, covered = [], rows
    while (~bad[covered]).any() and (best := best_test(x, bad, covered)) is not None:
        tests.append(best)
        covered = covered[best.mask({best.feature: x[best.feature][covered]})]
    return tests


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Ordered rules for ``bad`` rows; fold 0 of ``fold`` is kept for pruning."""
    grow, prune = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    rules: list[Rule] = []
    while bad[grow].sum() >= MIN_COVER:
        tests = _grow(x, bad, grow)
        if not tests:
            break

        def worth(some):
            m = np.logical_and.reduce([t.mask({t.feature: x[t.feature][prune]}) for t in some])
            p, n = bad[prune][m].sum(), (~bad[prune][m]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        rule = Rule(tuple(tests), 0, 0)
        hit = rule.mask(x)
        rows = np.concatenate([grow, prune])
        p, n = int(bad[rows][hit[rows]].sum()), int((~bad[rows][hit[rows]]).sum())
        pp, pn = int(bad[prune][hit[prune]].sum()), int((~bad[prune][hit[prune]]).sum())
        ok = p >= MIN_COVER and p / (p + n) >= MIN_PRECISION and (pp + pn == 0 or pp / (pp + pn) >= MIN_PRECISION) and pp + pn > 0
        if not ok:  # what it covers is not to be found again by the same tests
            grow = grow[~hit[grow]]
            if not hit[grow].any() and p + n == 0:
                break
            continue
        rules.append(Rule(rule.tests, p, n))
        grow, prune = grow[~hit[grow]], prune[~hit[prune]]
    return rules


def keep_expression(rules: list[Rule]) -> Column:
    """Base tests first, then the rules in order; the rest is kept."""
    out = F.when(base_failed(), F.lit(False))
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from labelled rows (label 0: rejected)."""
    known = labels.select(whole_id(labels, key).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("label").alias("least")).filter("label = least")
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # rows of 12 bytes, max_labelled at most
    named = docs.select(whole_id(docs, key).alias("doc_id"), F.col(text).cast("string").alias("text")).join(known, "doc_id", "left_semi")
    stats = with_stats(named).join(known, "doc_id").filter(~base_failed()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = stats.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), *(ratio(k).alias(k) for k in RATIOS)).toArrow()
    if not rows.num_rows:
        return []
    x = {k: rows[k].to_numpy() for k in RATIOS}
    return learn_rules(x, rows["label"].to_numpy() == 0, rows["fold"].to_numpy())


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, all STATS, base_failed and kept of every row."""
    rules = fit(docs, labels, key, text, label)
    return with_stats(docs, key, text).withColumn("base_failed", base_failed()).withColumn("kept", keep_expression(rules))
