"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words; a document is taken ``copies`` times, where every document of a
source has the same expected number of copies, target / words of the source. The whole part of that
rate is taken outright. The fractional part is an inclusion probability, and the cube method turns
the probabilities into zeros and ones: the flight phase moves three documents at a time along the
null space of the two constraints (words, documents), by a random step that keeps expectations and
ends with one of the three decided. So totals of words and documents stay as they are until at most
two documents are left; the landing phase drops the constraint on documents, then that on words.

At scale each source is flown in blocks of about ``BLOCK`` documents, dealt by hash; what a block
leaves undecided (two documents at most) flies again with the leavings of the other blocks, until a
source's rest fits one block and lands. No task holds more than a block.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and is not taken; rows that share a doc_id are documents of their own; an
empty table gives no rows. The same rows give the same mix, in any order or partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionspark.llm._shared import settle, whole_id

BLOCK = 4096
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
_EPS = 1e-9


def fly(size: Sequence[float], p: list[float], rng: np.random.Generator, land: bool) -> list[float]:
    """Move probabilities to 0 or 1 under the totals of size and count; land decides the rest too."""
    p = [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x for x in p]
    rest = _flight(size, p, [i for i, x in enumerate(p) if 0 < x < 1], rng, count=True)
    if land:
        rest = _flight(size, p, rest, rng, count=False)
        for i in rest:
            p[i] = 1.0 if rng.random() < p[i] else 0.0
    return p


def _flight(size, p, open_, rng, count: bool) -> list[int]:
    most = 3 if count else 2
    draws = iter(rng.random(len(open_) * 2 + 2).tolist())
    queue = iter(open_)
    active: list[int] = []
    while True:
        while len(active) < most and (i := next(queue, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        elif len(active) == 2 and not count:
            a, b = (size[i] for i in active)
            u = (b, -a) if a or b else (1.0, -1.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1.0, -1.0)
        else:
            return active
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(active, u, strict=True):
            x = p[i] + step * d
            p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        active = [i for i in active if 0 < p[i] < 1]


def _block(level: int, land: bool):
    def run(key, rows):  # Arrow, as ids may be null and beyond the whole numbers of a double
        rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        rng = np.random.default_rng([zlib.crc32(key[0].as_py().encode()), level, key[1].as_py()])
        p = fly(rows["size"].to_pylist(), rows["p"].to_pylist(), rng, land)
        return rows.select(["doc_id", "h", "skey", "size", "copies"]).append_column("p", pa.array(p, pa.float64()))

    return run


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """(skey, source_size, n_docs, target) from rows (source, skey, size).

    Sources in code-point order, null last, get ``weights`` in turn. Targets share ``share`` of all
    words by weight; none is above max_repeats times its source, the excess is shared again by
    weight. The closed form: sources are capped in order of cap / weight until the level that the
    others share lies below the next one's."""
    total = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # one row for each source from here on
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = total.withColumn("level", left / weight)
    total = total.withColumn("free", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))
    level = F.first("free", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return total.select("skey", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS, share: float = 1.0, block: int = BLOCK) -> DataFrame:
    """doc_id, h (hash of the text), skey, size, source_size, target, copies, taken of every row."""
    sizes = settle(
        docs.select(
            whole_id(docs, key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("skey"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ), "mix-sizes",
    )
    targets = settle(source_targets(sizes, weights, max_repeats, share), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    rows = (
        sizes.join(targets, "skey").withColumn("rate", rate)
        .withColumn("copies", F.floor(F.col("rate") + F.lit(_EPS)).cast("long"))
        .withColumn("p", F.greatest(F.col("rate") - F.col("copies"), F.lit(0.0)))
        .select("doc_id", "h", "skey", "size", "copies", "p", "n_docs")
    )
    done, level = None, 0
    while True:
        n = F.ceil(F.col("n_docs") / F.lit(block))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(level)), n)).select("doc_id", "h", "skey", "size", "copies", "p", "block")
        land = level > 0 and rows.agg(F.max("n_docs")).first()[0] in (None, *range(block + 1))
        flown = settle(dealt.groupBy("skey", "block").applyInArrow(_block(level, land), "doc_id long, h long, skey string, size long, copies long, p double"), "mix-flown")
        decided = flown.filter("p = 0 or p = 1")
        done = decided if done is None else done.unionByName(decided)
        if land:
            break
        rows = flown.filter("p > 0 and p < 1")
        rows = rows.join(rows.groupBy("skey").agg(F.count(F.lit(1)).alias("n_docs")), "skey")
        level += 1
    done = done.withColumn("copies", F.col("copies") + F.col("p").cast("long"))
    return done.join(targets, "skey").select("doc_id", "h", "skey", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_copies(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as ``mixed`` takes it. Rows of equal id
    and text share their copies out evenly."""
    taken = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    own = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.withColumn("_own", own).join(taken, F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_h")))
    at = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.xxhash64(*docs.columns)))
    n = F.floor(F.col("_copies") / F.col("_rows")).cast("int") + (at <= F.col("_copies") % F.col("_rows")).cast("int")
    return rows.withColumn("_n", n).filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)
