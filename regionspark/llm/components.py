"""Connected components of a link table, in Spark: alternating large-star and small-star rounds
(Kiveris et al., 2014) until no link changes. Links stay distributed; each round is written to the
shared folder, so a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionspark.llm._shared import settle, skew_join


def _stats(df: DataFrame):
    return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of a link; root is the component's smallest node.

    Self-links and repeated links are allowed; no links give no rows.
    """
    pairs = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    pairs = settle(pairs, "links")
    before = _stats(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest of a node's neighbours and itself
        # (a hub's links are many: its smallest neighbour is sent to them where they lie)
        low = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        large = (
            skew_join(both.filter("v > u"), low.select("u", F.least("u", "m").alias("m"), "n"), "u", "n", "left")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: smaller neighbours and the node itself go to the smallest of them
        large = settle(large, "links")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = (
            skew_join(large, low, "u", "n").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*").filter("u <> v").distinct()
        )
        pairs = settle(small, "links")
        now = _stats(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots)
