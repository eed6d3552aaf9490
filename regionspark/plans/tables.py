"""Stand-ins for genomic inputs, made from the driver's tables; for each, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.functions.columns import range_name
from regionspark.operators import ranges

PEAK_BIN = 1 << 9


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """events as fragments: seconds of the month as bases, one chromosome for each type."""
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return table(spark, d, "events").select(
        F.col("event_type").alias("chrom"), at.alias("start"), (at + 1 + F.floor("value")).alias("end"), F.col("user_id").cast("string").alias("barcode"),
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("long").alias("read_count"), "value", "event_id",
    )


FRAG = """frag AS (SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s, CAST(floor(epoch(ts)) AS BIGINT) - 1704067199 + CAST(floor(value) AS BIGINT) AS e,
    CAST(user_id AS VARCHAR) AS barcode, user_id % 5 AS grp, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS reads, value, event_id FROM events)"""


def islands(source: str, out: str, gap: int = 1, extra: str = "") -> str:
    """SQL of reduce: source has chrom, a, b, id."""
    return f"""{out} AS (SELECT chrom, min(a) AS a, max(b) AS b{extra} FROM (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY a, b, id) AS isl
    FROM (SELECT *, max(b) OVER (PARTITION BY chrom ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source})) GROUP BY chrom, isl)"""


def peaks(spark: SparkSession, d: str, above: int = 60) -> DataFrame:
    """Reduced long fragments, with an id (dense, by place) and a name."""
    from pyspark.sql import Window

    f = fragments(spark, d).filter(F.col("value") > above)
    r = ranges.reduce(f.select("chrom", (F.col("start") + 1).alias("start"), "end"))
    n = F.row_number().over(Window.partitionBy("chrom").orderBy("start"))
    k = r.withColumn("_n", n)
    return k.select("chrom", "start", "end", (F.pmod(F.crc32("chrom"), F.lit(1000)) * 10_000_000 + F.col("_n")).alias("id"), range_name().alias("feature_id"))


def sql_peaks(name: str = "peak", above: int = 60) -> str:
    return f"""_{name} AS (SELECT chrom, s + 1 AS a, e AS b, event_id AS id FROM frag WHERE value > {above}), {islands(f"_{name}", f"{name}_r")},
    {name} AS (SELECT *, chrom || '-' || a || '-' || b AS name FROM {name}_r)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a matrix: parts by suppliers."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))


MAT = "m AS (SELECT l_partkey AS f, l_suppkey AS c, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"


def brand_counts(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of few rows: brands by suppliers; a value is the orders above five."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = x.groupBy(F.col("p_brand").alias("feature_id"), F.col("l_suppkey").alias("cell_id")).agg(F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("n"))
    return n.select("feature_id", "cell_id", F.greatest(F.col("n") - 8, F.lit(0)).cast("double").alias("value")).filter("value > 0")


BRAND = """b AS (SELECT f, c, v FROM (SELECT p_brand AS f, l_suppkey AS c, CAST(greatest(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) - 8, 0) AS DOUBLE) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE v > 0)"""


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 5).cast("string").alias("ident"), "s_nationkey", "s_acctbal")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), "p_brand", "p_size", "p_retailprice")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """The letters A, C, G and T of texts."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("feature_id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("sequence"))


SEQ = "seq AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS q FROM documents)"


def annotation(spark: SparkSession, d: str) -> DataFrame:
    """orders as transcripts: a span of days for each order of a customer, the customer is the gene."""
    at = F.expr("datediff(cast(o_orderdate as date), DATE '1990-01-01')").cast("long") * 100
    biotype = F.when(F.col("o_custkey") % 3 == 0, "lncRNA").otherwise("protein_coding")
    return table(spark, d, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("chrom"), (at + 1).alias("start"), (at + F.col("o_orderkey") % 50 + 1).alias("end"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("o_orderkey").cast("string").alias("tx_id"), F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("gene_name"), F.col("o_custkey").cast("string").alias("gene_id"), biotype.alias("gene_biotype"), F.lit("exon").alias("type"),
    )


GENE = """tx AS (SELECT 'c' || (o_custkey % 7) AS chrom, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 100 + 1 AS a, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 100 + o_orderkey % 50 + 1 AS b,
    CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(o_custkey AS VARCHAR) AS gene_id, CASE WHEN o_custkey % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS biotype, o_orderkey AS id FROM orders),
    gene AS (SELECT gene_id, min(chrom) AS chrom, min(a) AS a, max(b) AS b, min(strand) AS strand, min(biotype) AS biotype FROM tx GROUP BY gene_id)"""


def mito(spark: SparkSession, d: str, positions: int = 1 << 40) -> DataFrame:
    """lineitem as strand counts: parts (modulo ``positions``) as positions, flags as bases, statuses as strands."""
    n = lambda s: F.sum(F.when(F.col("l_linestatus") == s, 1).otherwise(0))
    base = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "C").otherwise("T")
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % positions).alias("pos"), base.alias("base"), F.col("l_suppkey").alias("cell_id")).agg(n("F").alias("fwd"), n("O").alias("rev"))


MITO = """mt AS (SELECT l_partkey AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'T' END AS base, l_suppkey AS c, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS fw, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS rv
    FROM lineitem GROUP BY 1, 2, 3), cov AS (SELECT pos, c, sum(fw + rv) AS n FROM mt GROUP BY 1, 2)"""


def reference(spark: SparkSession, d: str, positions: int = 1 << 40) -> DataFrame:
    pos = table(spark, d, "part").select((F.col("p_partkey") % positions).alias("pos")).distinct()
    return pos.select("pos", F.when(F.col("pos") % 2 == 0, "A").otherwise("G").alias("ref"))
