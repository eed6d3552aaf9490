"""Registered queries over the driver's tables and the SQL they must equal."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionspark.functions.columns import parse_range, seeded
from regionspark.functions.lineage import cut
from regionspark.operators import assay, enrich, footprint, linalg, links, mito, motifs, normalize, qc, quantify, ranges, stats, tracks
from regionspark.operators.running import with_ranks
from regionspark.plans import tables as t
from regionspark.sources import fragments as files
from regionspark.sources import genomics

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def closed(f: DataFrame) -> DataFrame:
    """Fragments as ranges with an id."""
    return f.select(F.col("event_id").alias("id"), "chrom", (F.col("start") + 1).alias("start"), "end")


def long_ranges(s, d) -> DataFrame:
    return closed(t.fragments(s, d).filter("value > 60"))


def short_ranges(s, d) -> DataFrame:
    return closed(t.fragments(s, d).filter("value <= 60"))


W = f"WITH {t.FRAG}, q AS (SELECT event_id AS id, chrom, s + 1 AS a, e AS b FROM frag WHERE value > 60), z AS (SELECT event_id AS id, chrom, s + 1 AS a, e AS b FROM frag WHERE value <= 60)"
P = f"WITH {t.FRAG}, {t.sql_peaks()}"
HIT = "q.chrom = z.chrom AND q.a <= z.b AND z.a <= q.b"

# ---- scans, projections ----


@query(f"WITH {t.FRAG} SELECT barcode, count(*) AS frequency_count, CAST(sum(CASE WHEN e - s > 147 AND e - s < 294 THEN 1 ELSE 0 END) AS BIGINT) AS mononucleosomal, CAST(sum(CASE WHEN e - s < 147 THEN 1 ELSE 0 END) AS BIGINT) AS nucleosome_free, CAST(sum(reads) AS BIGINT) AS reads_count FROM frag GROUP BY barcode")
def count_fragments(s, d):
    return qc.count_fragments(t.fragments(s, d))


@query(f"WITH {t.FRAG} SELECT chrom, s AS start, e AS \"end\", barcode, reads AS read_count FROM frag WHERE CAST(barcode AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def filter_cells(s, d):
    cells = t.table(s, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("barcode"))
    return files.filter_cells(t.fragments(s, d), cells).select("chrom", "start", "end", "barcode", "read_count")


@query(f"WITH {t.FRAG} SELECT grp, chrom, count(*) AS n, min(s) AS first, max(e) AS last FROM frag GROUP BY grp, chrom")
def split_groups(s, d):
    f = t.fragments(s, d)
    groups = f.select("barcode", (F.col("barcode").cast("long") % 5).alias("grp")).distinct()
    return files.split_by_group(f, groups).groupBy("grp", "chrom").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(f"WITH {t.FRAG} SELECT chrom, s AS start, e AS \"end\", barcode, e - s AS length FROM frag WHERE chrom = 'click' AND s < 400000 AND e >= 100000")
def region_scan(s, d):
    return files.region_rows(t.fragments(s, d), "click", 100_000, 400_000).select("chrom", "start", "end", "barcode", "length")


@query(f"WITH {t.FRAG} SELECT DISTINCT barcode AS cell_id, barcode FROM frag")
def default_cells(s, d):
    return t.fragments(s, d).select(F.col("barcode").alias("cell_id"), "barcode").distinct()


@query(f"WITH {t.FRAG} SELECT c_custkey AS barcode, coalesce(n, 0) AS frequency_count, coalesce(r, 0) AS reads_count FROM customer LEFT JOIN (SELECT CAST(barcode AS BIGINT) AS bc, count(*) AS n, CAST(sum(reads) AS BIGINT) AS r FROM frag GROUP BY 1) ON bc = c_custkey")
def whitelist_counts(s, d):
    cells = t.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("barcode"))
    return qc.count_fragments(t.fragments(s, d), cells).select(F.col("barcode").cast("long").alias("barcode"), "frequency_count", "reads_count")


# ---- interval algebra ----


@query(f"{W} SELECT q.id AS q_id, z.id AS s_id FROM q JOIN z ON {HIT}")
def find_overlaps(s, d):
    return ranges.find_overlaps(long_ranges(s, d), short_ranges(s, d), bin_size=t.PEAK_BIN).select("q_id", "s_id")


@query(f"{W} SELECT q.id AS q_id, z.id AS s_id FROM q JOIN z ON q.chrom = z.chrom AND z.a >= q.a AND z.b <= q.b")
def overlaps_within(s, d):
    return ranges.find_overlaps(short_ranges(s, d), long_ranges(s, d), kind="within", bin_size=t.PEAK_BIN).select(F.col("s_id").alias("q_id"), F.col("q_id").alias("s_id"))


@query(f"{W} SELECT q.id AS q_id, min(z.id) AS s_id FROM q JOIN z ON q.chrom = z.chrom AND q.a <= z.b + 101 AND z.a <= q.b + 101 GROUP BY q.id")
def overlaps_first(s, d):
    return ranges.find_overlaps(long_ranges(s, d), short_ranges(s, d), maxgap=100, select="first", order="id", bin_size=t.PEAK_BIN).select("q_id", "s_id")


@query(f"{W} SELECT q.id, count(z.id) AS n_overlaps FROM q LEFT JOIN z ON {HIT} GROUP BY q.id")
def count_overlaps(s, d):
    return ranges.count_overlaps(long_ranges(s, d), short_ranges(s, d), bin_size=t.PEAK_BIN).select("id", "n_overlaps")


@query(f"{W} SELECT id, chrom, a AS start, b AS \"end\" FROM q WHERE EXISTS (SELECT 1 FROM z WHERE {HIT})")
def subset_by_overlaps(s, d):
    return ranges.subset_by_overlaps(long_ranges(s, d), short_ranges(s, d), bin_size=t.PEAK_BIN)


@query(f"{W} SELECT id, chrom, a AS start, b AS \"end\" FROM q WHERE NOT EXISTS (SELECT 1 FROM z WHERE {HIT})")
def subset_inverted(s, d):
    return ranges.subset_by_overlaps(long_ranges(s, d), short_ranges(s, d), invert=True, bin_size=t.PEAK_BIN)


@query(f"""{W} SELECT q.id, arg_min(z.id, greatest(0, z.a - q.b - 1, q.a - z.b - 1) * 2.0 * 1000000000 + CASE WHEN {HIT} THEN -1000000000 ELSE 0 END + z.id) AS subject_id, min(greatest(0, z.a - q.b - 1, q.a - z.b - 1)) AS distance
    FROM q JOIN z ON q.chrom = z.chrom GROUP BY q.id""")
def nearest(s, d):
    return ranges.nearest(long_ranges(s, d), short_ranges(s, d), bin_size=t.PEAK_BIN).filter("subject_id is not null").select("id", "subject_id", "distance")


@query(f"{W} SELECT q.id, min(z.a - q.b - 1) AS gap FROM q JOIN z ON q.chrom = z.chrom AND z.a > q.b GROUP BY q.id")
def precede(s, d):
    z = short_ranges(s, d)
    got = ranges.precede(long_ranges(s, d), z).filter("subject_id is not null")
    return got.join(z.select(F.col("id").alias("subject_id"), F.col("start").alias("_s")), "subject_id").select("id", (F.col("_s") - F.col("end") - 1).alias("gap"))


@query(f"{W} SELECT q.id, min(q.a - z.b - 1) AS gap FROM q JOIN z ON q.chrom = z.chrom AND z.b < q.a GROUP BY q.id")
def follow(s, d):
    z = short_ranges(s, d)
    got = ranges.follow(long_ranges(s, d), z).filter("subject_id is not null")
    return got.join(z.select(F.col("id").alias("subject_id"), F.col("end").alias("_e")), "subject_id").select("id", (F.col("start") - F.col("_e") - 1).alias("gap"))


@query(f"{W} SELECT q.id, greatest(0, z.a - q.b - 1, q.a - z.b - 1) AS distance FROM q JOIN z ON z.id = q.id + 1 AND z.chrom = q.chrom")
def distance(s, d):
    z = short_ranges(s, d).select((F.col("id") - 1).alias("id"), F.col("chrom").alias("c2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    x = long_ranges(s, d).join(z, "id").select("id", ranges.distance("chrom", "start", "end", "c2", "s2", "e2").alias("distance"))
    return x.filter("distance is not null")


@query(f"WITH {t.FRAG}, x AS (SELECT chrom, s + 1 AS a, e AS b, event_id AS id FROM frag), {t.islands('x', 'r')} SELECT chrom, a AS start, b AS \"end\" FROM r")
def reduce(s, d):
    return ranges.reduce(closed(t.fragments(s, d)))


@query(f"WITH {t.FRAG}, x AS (SELECT chrom, s + 1 AS a, e AS b, event_id AS id FROM frag), {t.islands('x', 'r', 300)} SELECT chrom, a AS start, b AS \"end\" FROM r")
def reduce_gap(s, d):
    return ranges.reduce(closed(t.fragments(s, d)), min_gap=300)


@query(f"WITH {t.FRAG}, x AS (SELECT chrom, s + 1 AS a, e AS b, event_id AS id FROM frag), {t.islands('x', 'r')}, g AS (SELECT chrom, coalesce(lag(b) OVER (PARTITION BY chrom ORDER BY a), 0) + 1 AS start, a - 1 AS \"end\" FROM r UNION ALL SELECT chrom, max(b) + 1, 2678400 FROM r GROUP BY chrom) SELECT * FROM g WHERE start <= \"end\"")
def gaps(s, d):
    f = closed(t.fragments(s, d))
    return ranges.gaps(f, f.select("chrom").distinct().withColumn("length", F.lit(2_678_400).cast("long")))


_SWEEP = f"WITH {t.FRAG}, x AS (SELECT chrom, s + 1 AS p, 1 AS n FROM frag UNION ALL SELECT chrom, e + 1, -1 FROM frag), y AS (SELECT chrom, p, sum(n) AS n FROM x GROUP BY 1, 2)"


@query(f"{_SWEEP}, w AS (SELECT chrom, p, sum(n) OVER (PARTITION BY chrom ORDER BY p) AS d, lead(p) OVER (PARTITION BY chrom ORDER BY p) - 1 AS \"end\" FROM y) SELECT chrom, p AS start, \"end\" FROM w WHERE d > 0")
def disjoin(s, d):
    return ranges.disjoin(closed(t.fragments(s, d)))


@query(f"{_SWEEP}, w AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) - 1 AS \"end\", CAST(sum(n) OVER (PARTITION BY chrom ORDER BY p) AS BIGINT) AS depth FROM y WHERE n <> 0) SELECT * FROM w WHERE \"end\" IS NOT NULL")
def coverage(s, d):
    return ranges.coverage(closed(t.fragments(s, d)))


@query(f"WITH {t.FRAG} SELECT chrom, min(s) + 1 AS start, max(e) AS \"end\" FROM frag GROUP BY chrom")
def range_span(s, d):
    return ranges.range_span(closed(t.fragments(s, d)))


@query(f"WITH {t.FRAG}, x AS (SELECT s + 1 <= max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM frag) SELECT coalesce(sum(CASE WHEN o THEN 1 ELSE 0 END), 0) = 0 AS is_disjoint FROM x")
def is_disjoint(s, d):
    return ranges.is_disjoint(closed(t.fragments(s, d)))


@query(f"{_SWEEP}, w AS (SELECT chrom, sum(n) OVER (PARTITION BY chrom ORDER BY p) AS d FROM y) SELECT chrom, CAST(max(d) AS BIGINT) AS lanes FROM w GROUP BY chrom")
def disjoint_bins(s, d):
    return ranges.disjoint_bins(closed(t.fragments(s, d))).groupBy("chrom").agg(F.max("bin").alias("lanes"))


@query(f"WITH {t.GENE} SELECT gene_id, chrom, CASE WHEN strand = '-' THEN a - 10 ELSE a - 500 END AS start, CASE WHEN strand = '-' THEN b + 500 ELSE b + 10 END AS \"end\", strand FROM gene")
def extend(s, d):
    return ranges.extend(quantify.gene_spans(t.annotation(s, d)), 500, 10).select("gene_id", "chrom", "start", "end", "strand")


@query(f"WITH {t.GENE} SELECT gene_id, chrom, CASE WHEN strand = '-' THEN b ELSE a END AS tss FROM gene WHERE biotype = 'protein_coding'")
def tss(s, d):
    return genomics.tss_positions(t.annotation(s, d)).select("gene_id", "chrom", F.col("start").alias("tss"))


@query(f"WITH {t.GENE} SELECT gene_id, chrom, a AS start, b AS \"end\", strand, biotype AS gene_biotype, 'g' || gene_id AS gene_name FROM gene")
def gene_span(s, d):
    return quantify.gene_spans(t.annotation(s, d)).select("gene_id", "chrom", "start", "end", "strand", "gene_biotype", "gene_name")


@query("SELECT 'c' || n_regionkey AS chrom, g.start, least(g.start + 999, 10000 + n_nationkey * 100) AS \"end\", n_nationkey AS nation FROM nation, generate_series(1, 13000, 1000) AS g(start) WHERE g.start <= 10000 + n_nationkey * 100")
def tile_genome(s, d):
    info = t.table(s, d, "nation").select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string"), F.lit("|"), F.col("n_nationkey").cast("string")).alias("chrom"), (10_000 + F.col("n_nationkey") * 100).cast("long").alias("length"))
    x = F.split("chrom", r"\|")
    return ranges.tile_genome(info, 1000).select(x[0].alias("chrom"), "start", "end", x[1].cast("int").alias("nation"))


@query(f"{P} SELECT name, chrom, a AS start, b AS \"end\" FROM peak")
def range_strings(s, d):
    return t.peaks(s, d).select(F.col("feature_id").alias("name"), parse_range(F.col("feature_id")).alias("_r")).select("name", "_r.*")


_NEAR = f"WITH {t.FRAG}, {t.sql_peaks('p', 60)}, {t.sql_peaks('w', 90)}"


@query(f"{_NEAR} SELECT p.name, min(greatest(0, w.a - p.b - 1, p.a - w.b - 1)) AS distance FROM p JOIN w ON p.chrom = w.chrom GROUP BY p.name HAVING min(greatest(0, w.a - p.b - 1, p.a - w.b - 1)) <= 5000")
def intersecting_features(s, d):
    p = t.peaks(s, d)
    got = ranges.intersecting_features(p.select("id", "chrom", "start", "end"), t.peaks(s, d, 90).select("id", "chrom", "start", "end"), 5000)
    return got.join(p.select(F.col("id").alias("a_id"), "feature_id"), "a_id").select(F.col("feature_id").alias("name"), "distance")


@query(f"{_NEAR} SELECT p.name AS query_region, min(greatest(0, w.a - p.b - 1, p.a - w.b - 1)) AS distance FROM p JOIN w ON p.chrom = w.chrom GROUP BY p.name")
def closest_feature(s, d):
    return ranges.closest_feature(t.peaks(s, d).select("id", "chrom", "start", "end"), t.peaks(s, d, 90).select("id", "chrom", "start", "end")).select("query_region", "distance")


@query(f"WITH {t.FRAG}, {t.sql_peaks('p', 60)}, {t.sql_peaks('w', 30)}, x AS (SELECT chrom, a, b, 1 AS id FROM p UNION ALL SELECT chrom, a, b, 2 FROM w), {t.islands('x', 'u')} SELECT chrom, a AS start, b AS \"end\" FROM u")
def unify_peaks(s, d):
    return ranges.unify_peaks([t.peaks(s, d), t.peaks(s, d, 30)])


@query(f"WITH {t.FRAG}, x AS (SELECT chrom, s + 1 AS a, e AS b, event_id AS id, grp FROM frag WHERE value > 60), {t.islands('x', 'u', 1, ', string_agg(DISTINCT CAST(grp AS VARCHAR), chr(44) ORDER BY CAST(grp AS VARCHAR)) AS peak_called_in')} SELECT chrom, a AS start, b AS \"end\", peak_called_in FROM u")
def combine_peaks(s, d):
    f = t.fragments(s, d).filter("value > 60")
    return enrich.combine_peaks(f.select("chrom", (F.col("start") + 1).alias("start"), "end", (F.col("barcode").cast("long") % 5).cast("string").alias("ident")))


# ---- quantification ----
TILE = 86_400


@query(f"WITH {t.FRAG} SELECT chrom, tile, barcode AS cell_id, count(*) AS value FROM (SELECT chrom, barcode, unnest(generate_series(s // {TILE}, (e - 1) // {TILE})) AS tile FROM frag) GROUP BY 1, 2, 3")
def bin_matrix(s, d):
    return quantify.bin_matrix(t.fragments(s, d), TILE)


_TILES = f"""WITH {t.FRAG}, x AS (SELECT chrom, barcode, unnest(generate_series(s // 3600, (e - 1) // 3600)) AS tile FROM frag), k AS (SELECT chrom, tile FROM x GROUP BY 1, 2 HAVING count(*) > 3),
    i AS (SELECT *, tile - row_number() OVER (PARTITION BY chrom ORDER BY tile) AS isl FROM k), w AS (SELECT chrom, isl, min(tile) * 3600 + 1 AS start, (max(tile) + 1) * 3600 AS "end" FROM i GROUP BY 1, 2)"""


@query(f"{_TILES} SELECT w.chrom, w.start, w.\"end\", x.barcode AS cell_id, count(*) AS value FROM x JOIN i ON x.chrom = i.chrom AND x.tile = i.tile JOIN w ON w.chrom = i.chrom AND w.isl = i.isl GROUP BY ALL")
def aggregate_tiles(s, d):
    return quantify.aggregate_tiles(t.fragments(s, d), 3600, 3)


_FM = f"{P}, fm AS (SELECT p.name AS f, g.barcode AS c, count(*) AS v FROM peak p JOIN frag g ON g.chrom = p.chrom AND g.s < p.b AND g.e >= p.a GROUP BY 1, 2)"


def peak_matrix(s, d):
    return quantify.feature_matrix(t.fragments(s, d), t.peaks(s, d), bin_size=t.PEAK_BIN)


@query(f"{_FM} SELECT f AS feature_id, c AS cell_id, v AS value FROM fm")
def feature_matrix(s, d):
    return peak_matrix(s, d)


@query(f"WITH {t.FRAG}, {t.GENE}, g AS (SELECT 'click' AS chrom, gene_id, CASE WHEN strand = '-' THEN a ELSE a - 2000 END AS a, CASE WHEN strand = '-' THEN b + 2000 ELSE b END AS b FROM gene WHERE biotype = 'protein_coding' AND b - a + 1 < 500000) SELECT 'g' || gene_id AS gene_name, barcode AS cell_id, count(*) AS value FROM g JOIN frag ON frag.chrom = g.chrom AND frag.s < g.b AND frag.e >= g.a GROUP BY 1, 2")
def gene_activity(s, d):
    return quantify.gene_activity(t.fragments(s, d), t.annotation(s, d).withColumn("chrom", F.lit("click")))


@query(f"{_FM}, w AS (SELECT p.name AS f, count(*) AS k FROM peak p JOIN (SELECT chrom, s + 1 AS a, e AS b FROM frag WHERE value > 120) z ON p.chrom = z.chrom AND p.a <= z.b AND z.a <= p.b GROUP BY 1), i AS (SELECT c, sum(v * k) AS n FROM fm JOIN w USING (f) GROUP BY c) SELECT c AS cell_id, CAST(coalesce(n, 0) AS BIGINT) AS in_region, CAST(tot AS BIGINT) AS total, round(coalesce(n, 0) / tot, 6) AS fraction FROM (SELECT c, sum(v) AS tot FROM fm GROUP BY c) LEFT JOIN i USING (c)")
def fraction_in_region(s, d):
    wide = closed(t.fragments(s, d).filter("value > 120"))
    return r6(quantify.fraction_in_region(peak_matrix(s, d), t.peaks(s, d), wide, bin_size=t.PEAK_BIN), "fraction")


@query(f"{_FM}, w AS (SELECT p.name AS f, count(*) AS k FROM peak p JOIN (SELECT chrom, s + 1 AS a, e AS b FROM frag WHERE value > 120) z ON p.chrom = z.chrom AND p.a <= z.b AND z.a <= p.b GROUP BY 1), i AS (SELECT c, sum(v * k) AS n FROM fm JOIN w USING (f) GROUP BY c) SELECT c AS cell_id, CAST(coalesce(n, 0) AS BIGINT) AS in_region FROM (SELECT DISTINCT c FROM fm) LEFT JOIN i USING (c)")
def counts_in_region(s, d):
    return quantify.counts_in_region(peak_matrix(s, d), t.peaks(s, d), closed(t.fragments(s, d).filter("value > 120")), bin_size=t.PEAK_BIN)


@query(f"{_FM} SELECT barcode AS cell_id, round(coalesce(v, 0) / n, 6) AS frip FROM (SELECT barcode, count(*) AS n FROM frag GROUP BY 1) LEFT JOIN (SELECT c, sum(v) AS v FROM fm GROUP BY 1) ON c = barcode")
def frip(s, d):
    total = t.fragments(s, d).groupBy(F.col("barcode").alias("cell_id")).agg(F.count(F.lit(1)).alias("fragments"))
    return r6(quantify.frip(peak_matrix(s, d), total), "frip")


_OVER = f"WITH {t.FRAG}, x AS (SELECT chrom, s + 1 AS a, e AS b, event_id AS id, barcode FROM frag WHERE value > 60), {t.islands('x', 'r')}"


@query(f"{_OVER} SELECT r.chrom, r.a AS start, r.b AS \"end\", x.barcode AS cell_id, CAST(count(*) AS DOUBLE) AS value FROM x JOIN r ON x.chrom = r.chrom AND x.a >= r.a AND x.b <= r.b GROUP BY ALL")
def merge_overlapping(s, d):
    f = long_ranges(s, d).withColumnRenamed("id", "feature_id")
    m = t.fragments(s, d).filter("value > 60").select(F.col("event_id").alias("feature_id"), F.col("barcode").alias("cell_id"), F.lit(1.0).alias("value"))
    return quantify.merge_overlapping(m, f)


@query(f"{P} SELECT 'm' || (length(name) % 4) AS motif_id, barcode AS cell_id, count(*) AS value FROM (SELECT *, a + (b - a + 1) // 2 AS mid FROM peak) p JOIN frag g ON g.chrom = p.chrom AND g.s < p.mid + 500 AND g.e >= p.mid - 500 GROUP BY 1, 2")
def motif_counts(s, d):
    p = t.peaks(s, d).select(F.concat(F.lit("m"), (F.length("feature_id") % 4).cast("string")).alias("motif_id"), "chrom", "start", "end")
    return quantify.motif_counts(t.fragments(s, d), p, bin_size=1 << 11)


# ---- assay ----


@query(f"WITH {t.MAT}, k AS (SELECT c FROM m GROUP BY c HAVING count(*) >= 400), x AS (SELECT * FROM m WHERE c IN (SELECT c FROM k)), g AS (SELECT f FROM x GROUP BY f HAVING count(*) >= 10 AND count(*) <= (SELECT count(*) FROM k) * 90 / 100.0) SELECT f AS feature_id, c AS cell_id, v AS value FROM x WHERE f IN (SELECT f FROM g)")
def create_assay_filters(s, d):
    return assay.create_filters(t.counts(s, d), 400, 10, "q90")


@query(f"WITH {t.MAT}, a AS (SELECT f FROM m GROUP BY f HAVING count(*) > 24 AND max(v) < 5), k AS (SELECT c FROM m GROUP BY c HAVING count(*) > 500 AND max(v) < 7) SELECT f AS feature_id, c AS cell_id, v AS value FROM m WHERE f IN (SELECT f FROM a) AND c IN (SELECT c FROM k)")
def subset_matrix(s, d):
    return assay.subset_matrix(t.counts(s, d), 24, 500, 5, 7)


@query(f"WITH {t.MAT} SELECT f AS feature_id, count(*) AS n_cells FROM m WHERE c % 2 = 0 GROUP BY f HAVING count(*) > 10")
def accessible_peaks(s, d):
    return assay.accessible_features(t.counts(s, d), t.suppliers(s, d).filter("cell_id % 2 = 0"))


@query(f"WITH {t.MAT} SELECT f AS feature_id, c AS cell_id, 1.0 AS value FROM m")
def binarize(s, d):
    return assay.binarize(t.counts(s, d))


@query(f"WITH {t.MAT} SELECT s_suppkey AS cell_id, coalesce(n, 0) AS n_count, coalesce(k, 0) AS n_feature FROM supplier LEFT JOIN (SELECT c, sum(v) AS n, count(*) AS k FROM m GROUP BY c) ON c = s_suppkey")
def cell_stats(s, d):
    return assay.cell_stats(t.suppliers(s, d).select("cell_id"), t.counts(s, d))


@query(f"{_FM} SELECT f AS feature_id, c AS cell_id, v AS value FROM fm JOIN (SELECT name FROM peak p JOIN (SELECT chrom, s + 1 AS a, e AS b FROM frag WHERE value > 120) z ON p.chrom = z.chrom AND p.a <= z.b AND z.a <= p.b) ON name = f")
def intersect_matrix(s, d):
    return assay.intersect_matrix(peak_matrix(s, d), t.peaks(s, d), closed(t.fragments(s, d).filter("value > 120")), bin_size=t.PEAK_BIN).select("feature_id", "cell_id", "value")


@query(f"{_FM} SELECT f AS feature_id, c AS cell_id, v AS value FROM fm WHERE f NOT IN (SELECT name FROM peak p JOIN (SELECT chrom, s + 1 AS a, e AS b FROM frag WHERE value > 120) z ON p.chrom = z.chrom AND p.a <= z.b AND z.a <= p.b)")
def intersect_matrix_inverted(s, d):
    return assay.intersect_matrix(peak_matrix(s, d), t.peaks(s, d), closed(t.fragments(s, d).filter("value > 120")), invert=True, bin_size=t.PEAK_BIN).select("feature_id", "cell_id", "value")


@query("SELECT ident, round(avg(s_acctbal), 6) AS mean_count FROM (SELECT CAST(s_nationkey % 5 AS VARCHAR) AS ident, s_acctbal FROM supplier) GROUP BY ident")
def average_counts(s, d):
    return r6(assay.average_counts(t.suppliers(s, d), "ident", "s_acctbal"), "mean_count")


@query("SELECT ident, count(*) AS n_cells FROM (SELECT CAST(s_nationkey % 5 AS VARCHAR) AS ident FROM supplier) GROUP BY ident UNION ALL SELECT NULL, 0")
def cells_per_group(s, d):
    return assay.cells_per_group(t.suppliers(s, d))


@query(f"WITH {t.MAT}, k AS (SELECT s_suppkey AS c, CAST(s_nationkey % 5 AS VARCHAR) AS ident FROM supplier), n AS (SELECT ident, count(*) AS n FROM k GROUP BY 1) SELECT f AS feature_id, ident, round(sum(v) / any_value(n), 6) AS mean FROM m JOIN k USING (c) JOIN n USING (ident) GROUP BY f, ident")
def average_count_matrix(s, d):
    return r6(assay.average_matrix(t.counts(s, d), t.suppliers(s, d)), "mean")


@query(f"WITH {t.BRAND}, k AS (SELECT s_suppkey AS c, CASE WHEN s_nationkey < 12 THEN 1 ELSE 2 END AS g FROM supplier), n AS (SELECT sum(CASE WHEN g = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN g = 2 THEN 1 ELSE 0 END) AS n2 FROM k), x AS (SELECT p_brand AS f, coalesce(sum(CASE WHEN g = 1 THEN v END), 0) AS s1, coalesce(sum(CASE WHEN g = 2 THEN v END), 0) AS s2, count(CASE WHEN g = 1 THEN 1 END) AS k1, count(CASE WHEN g = 2 THEN 1 END) AS k2 FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN b ON f = p_brand LEFT JOIN k USING (c) GROUP BY 1) SELECT f AS feature_id, round(log2(s1 / n1 + 0.0001) - log2(s2 / n2 + 0.0001), 6) AS log_fc, round(k1 / n1, 6) AS pct_1, round(k2 / n2, 6) AS pct_2 FROM x, n")
def fold_change(s, d):
    return r6(assay.fold_change(t.brand_counts(s, d), two_groups(s, d), brands(s, d)), "log_fc", "pct_1", "pct_2")


def two_groups(s, d):
    return t.suppliers(s, d).select("cell_id", F.when(F.col("s_nationkey") < 12, 1).otherwise(2).alias("grp"))


def brands(s, d):
    return t.table(s, d, "part").select(F.col("p_brand").alias("feature_id")).distinct()


@query("SELECT 1 AS assay, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem) UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def assay_dimensions(s, d):
    c = t.counts(s, d)
    f = c.select("feature_id").distinct().select(F.col("feature_id").cast("string").alias("feature_id"), F.lit("p").alias("chrom"), (F.col("feature_id") * 10 + 1).alias("start"), (F.col("feature_id") * 10 + 5).alias("end"))
    a = assay.create_assay(c.withColumn("feature_id", F.col("feature_id").cast("string")), f)
    n = lambda x, i: x.agg(F.lit(i).alias("assay"), F.count(F.lit(1)).alias("n"))
    return n(a.features, 1).unionByName(n(a.cells, 2))


_MERGE = f"WITH {t.FRAG}, x AS (SELECT CASE WHEN event_id % 2 = 0 THEN '1_' ELSE '2_' END || barcode AS c, chrom, s + 1 AS a, e AS b, event_id AS id FROM frag), {t.islands('x', 'r')}"


@query(f"{_MERGE} SELECT r.chrom || '-' || r.a || '-' || r.b AS feature_id, c AS cell_id, CAST(count(*) AS DOUBLE) AS value FROM x JOIN r ON x.chrom = r.chrom AND x.a >= r.a AND x.b <= r.b GROUP BY 1, 2")
def merge_assays(s, d):
    f = t.fragments(s, d)
    both = []
    for i in (0, 1):
        own = f.filter(F.col("event_id") % 2 == i)
        feats = closed(own).select(F.col("id").alias("feature_id"), "chrom", "start", "end")
        both.append(assay.create_assay(own.select(F.col("event_id").alias("feature_id"), F.col("barcode").alias("cell_id"), F.lit(1.0).alias("value")), feats))
    return assay.merge(both).counts.select("feature_id", "cell_id", "value")


# ---- QC ----


@query(f"WITH {t.FRAG}, x AS (SELECT barcode, sum(CASE WHEN e - s > 147 AND e - s < 294 THEN 1 ELSE 0 END) AS mono, sum(CASE WHEN e - s < 147 THEN 1 ELSE 0 END) AS free FROM frag GROUP BY 1) SELECT barcode, round(CASE WHEN free > 0 THEN mono / free END, 6) AS signal FROM x")
def nucleosome_signal(s, d):
    return r6(qc.nucleosome_signal(t.fragments(s, d)), "signal").select("barcode", "signal")


_SITES = "site AS (SELECT chrom, a AS p FROM (SELECT chrom, s + 1 AS a FROM frag WHERE value > 100) GROUP BY 1, 2)"


def sites(s, d):
    return t.fragments(s, d).filter("value > 100").select("chrom", (F.col("start") + 1).alias("start")).distinct()


@query(f"""WITH {t.FRAG}, {_SITES}, cut AS (SELECT chrom, barcode, s AS p FROM frag UNION ALL SELECT chrom, barcode, e FROM frag), h AS (SELECT barcode, cut.p - site.p + 1000 AS k FROM cut JOIN site ON cut.chrom = site.chrom AND cut.p BETWEEN site.p - 1000 AND site.p + 1000),
    x AS (SELECT barcode, count(CASE WHEN k BETWEEN 500 AND 1500 THEN 1 END) AS center, count(CASE WHEN k < 100 OR k > 1900 THEN 1 END) AS flank FROM (SELECT DISTINCT barcode FROM frag) LEFT JOIN h USING (barcode) GROUP BY 1), a AS (SELECT avg(flank) / 200 AS m FROM x)
    SELECT barcode AS cell_id, center, flank, round(center / (CASE WHEN flank > 0 THEN flank / 200 ELSE m END) / 1001, 6) AS tss_enrichment FROM x, a""")
def tss_enrichment(s, d):
    return r6(qc.tss_enrichment(t.fragments(s, d), sites(s, d), bin_size=1 << 11), "tss_enrichment").select("cell_id", "center", "flank", "tss_enrichment")


_TWO = ", ".join(f"len(list_filter(two, lambda x: x = '{x}')) AS {x}" for x in qc.DINUCLEOTIDES)


@query(f"WITH {t.SEQ}, y AS (SELECT doc_id, q, list_transform(range(1, greatest(length(q), 2)), lambda i: substr(q, CAST(i AS BIGINT), 2)) AS two FROM seq) SELECT doc_id AS feature_id, length(q) AS sequence_length, round(CASE WHEN length(q) > 0 THEN 100.0 * (length(q) - length(replace(replace(q, 'G', ''), 'C', ''))) / length(q) END, 6) AS gc_percent, {_TWO} FROM y")
def region_stats(s, d):
    return r6(qc.region_stats(t.sequences(s, d)), "gc_percent")


@query("SELECT i AS component, round(corr(x, n), 6) AS correlation FROM (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(vec_id % 97 AS DOUBLE) AS n FROM embeddings) WHERE i <= 10 GROUP BY i")
def depth_correlation(s, d):
    e = t.table(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    cells = e.select("cell_id", (F.col("cell_id") % 97).cast("double").alias("n_count"))
    return r6(qc.depth_correlation(e, cells, 10), "correlation")


@query(f"WITH {t.FRAG} SELECT grp, least((e - s) * 200 // 800, 199) AS bin, count(*) AS n FROM frag WHERE e - s BETWEEN 0 AND 800 GROUP BY 1, 2")
def fragment_histogram(s, d):
    f = t.fragments(s, d)
    return qc.fragment_histogram(f, f.select("barcode", (F.col("barcode").cast("long") % 5).alias("grp")).distinct())


@query("""WITH p AS (SELECT s_suppkey AS cell_id, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), b AS (SELECT min(x) AS x0, min(y) AS y0, (max(x) - min(x)) / 999 AS dx, (max(y) - min(y)) / 999 AS dy FROM p),
    g AS (SELECT p.*, CAST(floor((x - x0) / dx + 0.5) AS INT) AS i, CAST(floor((y - y0) / dy + 0.5) AS INT) AS j FROM p, b), c AS (SELECT i, j, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT cell_id, g.x, g.y, round((SELECT sum(n * exp(-0.5 * (((c.i - g.i) * dx) ** 2 + ((c.j - g.j) * dy) ** 2))) FROM c) / (2 * pi() * (SELECT count(*) FROM p)), 6) AS density FROM g, b""")
def density_scatter(s, d):
    x = t.suppliers(s, d).select("cell_id", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return r6(qc.density_scatter(x), "density")


# ---- normalisation ----
_TF = f"WITH {t.MAT}, cs AS (SELECT c, sum(v) AS cs FROM m GROUP BY c), rs AS (SELECT f, (SELECT count(*) FROM cs) / sum(v) AS idf FROM m GROUP BY f)"


def _tfidf(method: int, expr: str):
    def f(s, d):
        return r6(normalize.tfidf(t.counts(s, d), method=method), "value")

    f.__name__ = f"tfidf_m{method}"
    query(f"{_TF} SELECT m.f AS feature_id, m.c AS cell_id, round({expr}, 6) AS value FROM m JOIN cs USING (c) JOIN rs USING (f)")(f)


for _m, _e in ((1, "ln(1 + v / cs * idf * 10000)"), (2, "v / cs * ln(1 + idf)"), (3, "ln(1 + v / cs * 10000) * ln(1 + idf)"), (4, "v * idf")):
    _tfidf(_m, _e)


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS f FROM documents), m AS (SELECT f, doc_id AS c, count(*) AS v FROM w GROUP BY 1, 2), cs AS (SELECT c, sum(v) AS cs FROM m GROUP BY 1), rs AS (SELECT f, (SELECT count(*) FROM cs) / sum(v) AS idf FROM m GROUP BY 1)
    SELECT f AS feature_id, c AS cell_id, round(ln(1 + v / cs * idf * 10000), 6) AS value FROM m JOIN cs USING (c) JOIN rs USING (f)""")
def tfidf_documents(s, d):
    w = t.table(s, d, "documents").select(F.col("doc_id").alias("cell_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("feature_id"))
    return r6(normalize.tfidf(w.groupBy("feature_id", "cell_id").agg(F.count(F.lit(1)).cast("double").alias("value"))), "value")


@query(f"WITH {t.MAT}, x AS (SELECT p_partkey AS f, coalesce(sum(v), 0) AS n FROM part LEFT JOIN m ON f = p_partkey GROUP BY 1), y AS (SELECT f, n, cume_dist() OVER (ORDER BY n) AS p FROM x) SELECT f AS feature_id, n AS count, round(p, 6) AS percentile, p > 0.5 AS variable FROM y")
def top_features(s, d):
    return r6(normalize.top_features(t.parts(s, d), t.counts(s, d), "q50"), "percentile")


@query(f"""WITH {t.MAT}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM supplier), mu AS (SELECT f, sum(v) AS tot, sum(v) / any_value(n) AS mu FROM m, n GROUP BY f), sd AS (SELECT f, tot, mu, sqrt(mu + mu * mu / 10) AS sd FROM mu),
    x AS (SELECT f, tot, n, mu, sd, count(*) AS k, sum(least(greatest((v - mu) / sd, -sqrt(n)), sqrt(n))) AS s, sum(pow(least(greatest((v - mu) / sd, -sqrt(n)), sqrt(n)), 2)) AS q FROM m JOIN sd USING (f), n GROUP BY ALL),
    y AS (SELECT f, tot, n, s + (n - k) * greatest(-mu / sd, -sqrt(n)) AS s, q + (n - k) * pow(greatest(-mu / sd, -sqrt(n)), 2) AS q FROM x) SELECT p_partkey AS feature_id, coalesce(tot, 0) AS count, round(coalesce(q / n - pow(s / n, 2), 0), 6) AS residual_variance FROM part LEFT JOIN y ON f = p_partkey""")
def pearson_residual_var(s, d):
    return r6(normalize.pearson_residual_variance(t.parts(s, d), t.counts(s, d), t.table(s, d, "supplier").count()), "residual_variance")


@query(f"WITH {t.MAT}, n AS (SELECT count(*) AS n FROM supplier), x AS (SELECT p_partkey AS f, coalesce(sum(v), 0) / any_value(n) AS mean, (coalesce(sum(v * v), 0) - pow(coalesce(sum(v), 0), 2) / any_value(n)) / (any_value(n) - 1) AS variance FROM part LEFT JOIN m ON f = p_partkey, n GROUP BY 1) SELECT f AS feature_id, round(mean, 6) AS mean, round(greatest(variance, 0), 6) AS variance FROM x")
def mean_var(s, d):
    return r6(normalize.mean_variance(t.parts(s, d), t.counts(s, d), t.table(s, d, "supplier").count()), "mean", "variance").select("feature_id", "mean", "variance")


@query()
def mean_var_rank(s, d):
    return r6(normalize.mean_variance(t.parts(s, d), t.counts(s, d), t.table(s, d, "supplier").count()), "residual").select("feature_id", "residual", "rank")


# ---- similarity ----


@query(f"WITH {t.BRAND}, s AS (SELECT f, count(*) AS n FROM b GROUP BY f) SELECT x.f AS a, y.f AS b, round(CASE WHEN x.n + y.n - coalesce(i, 0) <> 0 THEN coalesce(i, 0) / (x.n + y.n - coalesce(i, 0)) END, 6) AS jaccard FROM s x CROSS JOIN s y LEFT JOIN (SELECT u.f AS p, w.f AS q, count(*) AS i FROM b u JOIN b w ON u.c = w.c GROUP BY 1, 2) ON p = x.f AND q = y.f")
def jaccard(s, d):
    b = assay.binarize(t.brand_counts(s, d))
    return r6(linalg.jaccard(b, b, "feature_id", "cell_id"), "jaccard")


_DENSE = f"WITH {t.BRAND}, k AS (SELECT s_suppkey AS c FROM supplier), g AS (SELECT DISTINCT f FROM b), x AS (SELECT g.f, k.c, coalesce(b.v, 0) AS v FROM g CROSS JOIN k LEFT JOIN b ON b.f = g.f AND b.c = k.c)"


@query(f"{_DENSE} SELECT u.f AS a, w.f AS b, round(covar_samp(u.v, w.v), 6) AS covariance, round(corr(u.v, w.v), 6) AS correlation FROM x u JOIN x w ON u.c = w.c WHERE EXISTS (SELECT 1 FROM b p JOIN b q ON p.c = q.c AND p.f = u.f AND q.f = w.f) GROUP BY 1, 2")
def corr(s, d):
    b = t.brand_counts(s, d)
    return r6(linalg.correlation(b, b, t.table(s, d, "supplier").count()), "covariance", "correlation")


@query(f"{_DENSE}, r AS (SELECT f, c, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2 AS v FROM x) SELECT u.f AS a, w.f AS b, round(corr(u.v, w.v), 6) AS correlation FROM r u JOIN r w ON u.c = w.c WHERE EXISTS (SELECT 1 FROM b p JOIN b q ON p.c = q.c AND p.f = u.f AND q.f = w.f) GROUP BY 1, 2")
def spearman(s, d):
    b = t.brand_counts(s, d)
    return r6(linalg.spearman(b, b, t.table(s, d, "supplier").count()), "correlation").select("a", "b", "correlation")


@query(f"{_DENSE} SELECT f AS feature_id, round(var_samp(v), 6) AS variance FROM x GROUP BY f")
def row_variance(s, d):
    return r6(linalg.variances(t.brand_counts(s, d), t.table(s, d, "supplier").count()), "variance")


@query("SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS cosine FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e")
def cosine(s, d):
    e = t.table(s, d, "embeddings")
    return r6(linalg.cosine(e, e.filter("vec_id % 20 = 0")), "cosine")


@query()
def svd(s, d):
    m = normalize.tfidf(t.counts(s, d))
    cells, _, _ = linalg.svd(m, 5, t.parts(s, d), t.suppliers(s, d))
    return cells


# ---- enrichment and links ----


@query(f"{_DENSE}, y AS (SELECT f, v, CASE WHEN s_nationkey < 12 THEN 1 ELSE 2 END AS g, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2 AS r FROM x JOIN supplier ON s_suppkey = c), z AS (SELECT f, count(CASE WHEN g = 1 THEN 1 END) AS n1, sum(CASE WHEN g = 1 THEN r ELSE 0 END) AS r1 FROM y GROUP BY f) SELECT f AS feature_id, round(r1 - n1 * (n1 + 1) / 2, 6) AS u FROM z")
def wilcoxon(s, d):
    b = t.brand_counts(s, d)
    return r6(stats.wilcoxon(b, two_groups(s, d), b.select("feature_id").distinct()), "u").select("feature_id", "u")


_MOT = """WITH h AS (SELECT DISTINCT l_partkey AS f, l_suppkey % 25 AS k FROM lineitem WHERE l_quantity > 40), q AS (SELECT p_partkey AS f FROM part WHERE p_size <= 10), nq AS (SELECT count(*) AS nq FROM q), nb AS (SELECT count(*) AS nb FROM part),
    x AS (SELECT k, count(CASE WHEN f IN (SELECT f FROM q) THEN 1 END) AS o, count(*) AS b FROM h GROUP BY k)"""


@query(f"""{_MOT}, p AS (SELECT k, sum(exp(lgamma(b + 1) - lgamma(i + 1) - lgamma(b - i + 1) + lgamma(nb - b + 1) - lgamma(nq - i + 1) - lgamma(nb - b - nq + i + 1) - lgamma(nb + 1) + lgamma(nq + 1) + lgamma(nb - nq + 1))) AS p
    FROM (SELECT k, b, nq, nb, unnest(generate_series(greatest(o, nq - nb + b), least(b, nq))) AS i FROM x, nq, nb) GROUP BY k)
    SELECT x.k AS motif_id, o AS observed, b AS background, round(100.0 * o / nq, 6) AS percent_observed, round(100.0 * b / nb, 6) AS percent_background, round((100.0 * o / nq) / (100.0 * b / nb), 6) AS fold_enrichment, round(least(p, 1), 6) AS pvalue,
    round(least(1, min(least(p, 1) * (SELECT count(*) FROM x) / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjust FROM (SELECT *, row_number() OVER (ORDER BY p, k) AS r FROM p) p JOIN x USING (k), nq, nb""")
def find_motifs(s, d):
    hits = t.table(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("feature_id"), (F.col("l_suppkey") % 25).alias("motif_id")).distinct()
    p = t.parts(s, d)
    return r6(motifs.find_motifs(hits, p.filter("p_size <= 10"), p), "percent_observed", "percent_background", "fold_enrichment", "pvalue", "p_adjust")


@query()
def motif_scan(s, d):
    letters = [("m1", i, b, 9 if b == c else 1) for i, c in enumerate("ACATTA") for b in "ACGT"] + [("m2", i, b, 20 if b == c else 0) for i, c in enumerate("TAATCG") for b in "ACGT"]
    pwm = motifs.pfm_to_pwm(s.createDataFrame(letters, "motif_id string, pos int, base string, n int"))
    return motifs.motif_matrix(motifs.scan(t.sequences(s, d), pwm, 1e-3), "counts")


@query()
def match_region_stats(s, d):
    p = t.parts(s, d).select("feature_id", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("price"))
    return stats.match_region_stats(p.filter("p_size <= 10"), p, ["p_size"], 100).select("feature_id", "p_size")


@query("WITH x AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey AS feature_id, p_size FROM x WHERE p_size > 5")
def weighted_sample(s, d):
    p = t.parts(s, d).select("feature_id", "p_size").withColumn("w", F.when(F.col("p_size") > 5, seeded(F.col("feature_id"), 7) + 1).otherwise(0.0))
    return stats.weighted_sample(p, p.count(), "w", "feature_id").select("feature_id", "p_size")


_GENE_OF = f"WITH {t.BRAND}, gx AS (SELECT 'g' || s_nationkey AS g, s_suppkey AS c, 1.0 * s_suppkey AS v FROM supplier WHERE s_suppkey > 0)"


def link_inputs(s, d):
    """Peaks: brands laid along three chromosomes; genes: nations, expressed by their suppliers."""
    b = t.brand_counts(s, d)
    n = F.regexp_extract("feature_id", r"(\d+)", 1).cast("long")
    f = b.groupBy("feature_id").agg(F.sum("value").alias("count")).select("feature_id", F.concat(F.lit("c"), (n % 3).cast("string")).alias("chrom"), (n * 1000).alias("start"), (n * 1000 + 200).alias("end"), (n % 7).cast("double").alias("gc_percent"), "count", F.lit(201).alias("sequence_length"))
    g = t.suppliers(s, d).filter("cell_id > 0").select(F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("gene"), "cell_id", F.col("cell_id").cast("double").alias("value"))
    where = t.table(s, d, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("gene"), F.concat(F.lit("c"), (F.col("n_nationkey") % 3).cast("string")).alias("chrom"), (F.col("n_nationkey") * 1000).cast("long").alias("start"), (F.col("n_nationkey") * 1000 + 500).cast("long").alias("end"), F.lit("+").alias("strand"))
    return b, g, f, where


@query("WITH f AS (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS n FROM part), g AS (SELECT 'g' || n_nationkey AS gene, n_nationkey AS k FROM nation) SELECT p_brand AS feature_id, gene FROM f JOIN g ON n % 3 = k % 3 AND n * 1000 <= k * 1000 + 5000 AND n * 1000 + 200 >= k * 1000 - 5000 AND NOT (n * 1000 <= k * 1000 + 1000 AND n * 1000 + 200 >= k * 1000 - 1000)")
def distance_pairs(s, d):
    _, _, _, where = link_inputs(s, d)
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    f = t.table(s, d, "part").select(F.col("p_brand").alias("feature_id"), F.concat(F.lit("c"), (n % 3).cast("string")).alias("chrom"), (n * 1000).alias("start"), (n * 1000 + 200).alias("end")).distinct()
    return links.distance_pairs(f, where, 5000, 1000)


@query(f"{_GENE_OF}, k AS (SELECT s_suppkey AS c FROM supplier), p AS (SELECT DISTINCT b.f, gx.g FROM b, gx WHERE CAST(regexp_extract(b.f, '([0-9]+)', 1) AS BIGINT) % 5 = CAST(substr(gx.g, 2) AS BIGINT) % 5) SELECT p.f AS feature_id, p.g AS gene, round(corr(coalesce(b.v, 0), coalesce(gx.v, 0)), 6) AS score FROM p CROSS JOIN k LEFT JOIN b ON b.f = p.f AND b.c = k.c LEFT JOIN gx ON gx.g = p.g AND gx.c = k.c GROUP BY 1, 2")
def pair_correlation(s, d):
    b, g, _, _ = link_inputs(s, d)
    x = b.select("feature_id", (F.regexp_extract("feature_id", r"(\d+)", 1).cast("long") % 5).alias("k")).distinct()
    y = g.select("gene", (F.substring("gene", 2, 9).cast("long") % 5).alias("k")).distinct()
    return r6(links.pair_correlation(x.join(y, "k").select("feature_id", "gene"), b, g, t.table(s, d, "supplier").count()), "score")


@query(f"""{_GENE_OF}, k AS (SELECT s_suppkey AS c FROM supplier), br AS (SELECT f, CAST(regexp_extract(f, '([0-9]+)', 1) AS BIGINT) AS n FROM b GROUP BY f HAVING count(*) > 1), gn AS (SELECT 'g' || n_nationkey AS g, n_nationkey AS n FROM nation WHERE 'g' || n_nationkey IN (SELECT g FROM gx GROUP BY g HAVING count(*) > 1)),
    pr AS (SELECT f, g, br.n AS fn, gn.n AS gn FROM br JOIN gn ON br.n % 3 = gn.n % 3 AND br.n * 1000 <= gn.n * 1000 + 8000 AND br.n * 1000 + 200 >= gn.n * 1000 - 8000), p2 AS (SELECT * FROM pr WHERE g IN (SELECT g FROM pr GROUP BY g HAVING count(*) >= 2)),
    al AS (SELECT br.f, x.g, corr(coalesce(b.v, 0), coalesce(gx.v, 0)) AS r FROM br CROSS JOIN (SELECT DISTINCT g FROM p2) x CROSS JOIN k LEFT JOIN b ON b.f = br.f AND b.c = k.c LEFT JOIN gx ON gx.g = x.g AND gx.c = k.c GROUP BY 1, 2),
    sc AS (SELECT p2.*, r FROM p2 JOIN al USING (f, g) WHERE abs(r) > 0), z AS (SELECT sc.f, sc.g, any_value(sc.fn) AS fn, any_value(sc.gn) AS gn, any_value(sc.r) AS r, (any_value(sc.r) - avg(al.r)) / stddev_samp(al.r) AS z FROM sc JOIN br ON br.n % 3 <> sc.fn % 3 JOIN al ON al.f = br.f AND al.g = sc.g GROUP BY 1, 2)
    SELECT 'c' || (fn % 3) AS chrom, least(gn * 1000, (fn * 2000 + 200) // 2) AS start, greatest(gn * 1000, (fn * 2000 + 200) // 2) AS \"end\", round(r, 6) AS score, g AS gene, f AS peak, round(z, 6) AS zscore,
    round(0.5 - list_sum(list_transform(generate_series(0, 120), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(abs(z)) - lgamma(i + 1) - i * ln(2.0)) / (2 * i + 1))) / sqrt(2 * pi()), 6) AS pvalue FROM z""")
def link_peaks(s, d):
    b, g, f, where = link_inputs(s, d)
    out = links.link_peaks(b, g, f, where, t.table(s, d, "supplier").count(), distance=8000, min_cells=1, n_sample=20, pvalue_cutoff=0.9, score_cutoff=0.0, bins=1)
    return r6(out, "score", "zscore", "pvalue")


_CON = "con AS (SELECT 'c' || (l_partkey % 3) || '-' || l_partkey * 10 || '-' || (l_partkey * 10 + 7) AS peak1, 'c' || (l_suppkey % 3) || '-' || l_suppkey * 10 || '-' || (l_suppkey * 10 + 4) AS peak2, l_discount AS co, l_partkey AS i, l_suppkey AS j FROM lineitem)"


def connections(s, d):
    name = lambda k, w: F.concat(F.lit("c"), (F.col(k) % 3).cast("string"), F.lit("-"), (F.col(k) * 10).cast("string"), F.lit("-"), (F.col(k) * 10 + w).cast("string"))
    return t.table(s, d, "lineitem").select(name("l_partkey", 7).alias("peak1"), name("l_suppkey", 4).alias("peak2"), F.col("l_discount").alias("coaccess"), "l_partkey", "l_suppkey")


@query(f"WITH {_CON}, x AS (SELECT 'c' || (i % 3) AS chrom, i * 10 + 3.5 AS a, j * 10 + 2.0 AS b, co, CASE WHEN i % 4 = 0 THEN 'k' || i END AS g FROM con WHERE co > 0.05 AND i % 3 = j % 3) SELECT chrom, least(a, b) AS start, greatest(a, b) AS \"end\", co AS score, g AS grp FROM x")
def connections_to_links(s, d):
    c = connections(s, d)
    groups = c.filter("l_partkey % 4 = 0").select(F.col("peak1").alias("peak"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("ccan")).distinct()
    return links.connections_to_links(c, groups, 0.05)


_LNK = "lnk AS (SELECT 'g' || l_suppkey AS gene, 'p' || l_partkey AS peak, l_discount - 0.05 AS score FROM lineitem)"


def simple_links(s, d):
    return t.table(s, d, "lineitem").select(F.concat(F.lit("g"), F.col("l_suppkey").cast("string")).alias("gene"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("peak"), (F.col("l_discount") - 0.05).alias("score"))


@query(f"WITH {_LNK} SELECT DISTINCT peak FROM lnk WHERE abs(score) > 0.03 AND gene IN (SELECT 'g' || s_suppkey FROM supplier WHERE s_nationkey < 3)")
def linked_peaks(s, d):
    genes = t.suppliers(s, d).filter("s_nationkey < 3").select(F.concat(F.lit("g"), F.col("cell_id").cast("string")).alias("gene"))
    return links.linked_peaks(simple_links(s, d), genes, 0.03)


@query(f"WITH {_LNK} SELECT DISTINCT gene FROM lnk WHERE abs(score) > 0.03 AND peak IN (SELECT 'p' || p_partkey FROM part WHERE p_size = 1)")
def linked_genes(s, d):
    p = t.parts(s, d).filter("p_size = 1").select(F.concat(F.lit("p"), F.col("feature_id").cast("string")).alias("peak"))
    return links.linked_genes(simple_links(s, d), p, 0.03)


@query()
def enriched_terms(s, d):
    b = t.brand_counts(s, d)
    f = b.select("feature_id").distinct()
    m = stats.wilcoxon(b, two_groups(s, d), f).join(assay.fold_change(b, two_groups(s, d), f), "feature_id").select(F.lit("1").alias("grp"), F.col("feature_id").alias("gene"), "log_fc", "pvalue")
    terms = f.select(F.concat(F.lit("t"), (F.length("feature_id") % 3).cast("string")).alias("term"), F.col("feature_id").alias("gene")).unionByName(f.select(F.concat(F.lit("u"), F.substring("feature_id", -1, 1)).alias("term"), F.col("feature_id").alias("gene")))
    return enrich.enriched_terms(enrich.ranked_genes(m), terms, max_padj=1.1)


@query(f"""WITH {t.FRAG}, cut AS (SELECT chrom, s AS p FROM frag UNION ALL SELECT chrom, e FROM frag), tl AS (SELECT chrom, p // 3600 AS tile, count(*) AS n FROM cut GROUP BY 1, 2), rt AS (SELECT (SELECT count(*) FROM cut) * 3600 / 13392000.0 AS r),
    h AS (SELECT *, list_sum(list_transform(generate_series(n, n + 800), lambda k: exp(k * ln(r) - r - lgamma(k + 1)))) AS p FROM tl, rt WHERE n >= 3), hot AS (SELECT chrom, tile * 3600 + 1 AS a, (tile + 1) * 3600 AS b, tile AS id FROM h WHERE n > r AND p * (SELECT count(*) FROM h) < 0.05), {t.islands("hot", "isl")} SELECT chrom, a AS start, b AS \"end\" FROM isl""")
def call_peaks(s, d):
    return enrich.call_peaks_poisson(t.fragments(s, d), 5 * 2_678_400, 7200, q=0.05)


# ---- mitochondrial variants ----


@query(f"WITH {t.MITO}, v AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'T' END AS alt, p_partkey || CASE WHEN p_partkey % 2 = 0 THEN 'A>C' ELSE 'G>T' END AS variant FROM part) SELECT variant, cov.c AS cell_id, round(coalesce(fw + rv, 0) / n, 6) AS frequency FROM v JOIN cov USING (pos) LEFT JOIN mt ON mt.pos = v.pos AND mt.base = v.alt AND mt.c = cov.c")
def allele_freq(s, d):
    k = F.col("pos").cast("string")
    v = t.reference(s, d).select(F.concat(k, "ref", F.when(F.col("ref") == "A", ">C").otherwise(">T")).alias("variant"))
    return r6(mito.allele_frequency(t.mito(s, d), v), "frequency")


_VAR = f"""WITH {t.MITO}, ref AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'G' END AS ref FROM part), v AS (SELECT pos, ref, alt FROM ref, (VALUES ('A'), ('T'), ('C'), ('G')) x(alt) WHERE ref <> alt AND pos IN (SELECT pos FROM cov)), nc AS (SELECT count(*) AS nc FROM supplier),
    y AS (SELECT v.pos, ref, alt, s_suppkey AS c, coalesce(n, 0) AS n, coalesce(fw, 0) AS fw, coalesce(rv, 0) AS rv FROM v CROSS JOIN supplier LEFT JOIN cov ON cov.pos = v.pos AND cov.c = s_suppkey LEFT JOIN mt ON mt.pos = v.pos AND mt.base = alt AND mt.c = s_suppkey),
    bk AS (SELECT pos, alt, sum(fw + rv) / sum(n) AS bulk FROM y GROUP BY 1, 2), w AS (SELECT y.*, bulk, CASE WHEN n < 3 THEN bulk ELSE (fw + rv) / n END AS af, CASE WHEN n > 0 THEN (fw + rv) / n ELSE 0 END AS raw FROM y JOIN bk USING (pos, alt))"""


@query(f"""{_VAR} SELECT pos || ref || '>' || alt AS variant, CAST(round(CAST(any_value(bulk) AS DECIMAL(18, 12)), 7) AS DOUBLE) AS mean, CAST(round(CAST(var_samp(af) AS DECIMAL(18, 12)), 7) AS DOUBLE) AS variance, count(CASE WHEN fw >= 2 AND rv >= 2 THEN 1 END) AS n_cells_conf_detected, count(CASE WHEN fw + rv > 0 THEN 1 END) AS n_cells_detected,
    count(CASE WHEN raw > 0.2 THEN 1 END) AS n_cells_over_20, round(avg(n), 6) AS mean_coverage FROM w GROUP BY pos, ref, alt""")
def identify_variants(s, d):
    out = mito.identify_variants(t.mito(s, d), t.reference(s, d), t.suppliers(s, d), low_coverage=3)
    return r6(out, "mean_coverage").select("variant", "mean", "variance", "n_cells_conf_detected", "n_cells_detected", "n_cells_over_20", "mean_coverage")


@query(f"{_VAR} SELECT pos || ref || '>' || alt AS variant, count(CASE WHEN fw >= 2 AND rv >= 2 THEN 1 END) AS n_cells, var_samp(af) / (any_value(bulk) + 1e-11) > 0.01 AND coalesce(nullif(corr(fw, rv) FILTER (fw + rv > 0), 'nan'::DOUBLE), 0) > 0.65 AS high_confidence FROM w GROUP BY pos, ref, alt")
def variant_filter(s, d):
    """All positions; no cell of these tables has two reads on each strand, so none is asked for."""
    found = mito.identify_variants(t.mito(s, d), t.reference(s, d), t.suppliers(s, d), low_coverage=3)
    return mito.high_confidence(found, min_cells=0).select("variant", F.col("n_cells_conf_detected").alias("n_cells"), "high_confidence")


@query()
def find_clonotypes(s, d):
    b = t.brand_counts(s, d)
    f = b.select("cell_id", F.col("feature_id").alias("variant"), (F.col("value") / 100).alias("frequency"))
    return mito.find_clonotypes(f, 5)


# ---- pileups and tracks ----
_CUT = f"""{P}, cut AS (SELECT chrom, barcode, s AS p FROM frag UNION ALL SELECT chrom, barcode, e FROM frag), cm AS (SELECT name, b - a + 1 AS w, barcode, p - a - 1 AS pos, count(*) AS n FROM cut JOIN peak ON cut.chrom = peak.chrom AND p - a - 1 > 0 AND p - a - 1 <= b - a + 1 GROUP BY ALL)"""


def peak_cuts(s, d):
    return footprint.cut_matrix(t.fragments(s, d), t.peaks(s, d).withColumnRenamed("feature_id", "region_id").select("region_id", "chrom", "start", "end"), bin_size=t.PEAK_BIN)


@query(f"{_CUT} SELECT name AS region_id, barcode AS cell_id, pos AS position, n AS value FROM cm")
def cut_matrix(s, d):
    return peak_cuts(s, d).select("region_id", "cell_id", "position", "value")


_FIX = f"WITH {t.FRAG}, reg AS (SELECT chrom, event_id AS id, s + 1 - 100 AS a, s + 1 + 100 AS b, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM frag WHERE value > 150), cut AS (SELECT chrom, barcode, grp, s AS p FROM frag UNION ALL SELECT chrom, barcode, grp, e FROM frag)"


def fixed_regions(s, d):
    return t.fragments(s, d).filter("value > 150").select(F.col("event_id").alias("region_id"), "chrom", (F.col("start") - 99).alias("start"), (F.col("start") + 101).alias("end"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))


_PILE = f"{_FIX}, pl AS (SELECT barcode, grp, CASE WHEN strand = '-' THEN 202 - (p - a - 1) ELSE p - a - 1 END - 100 AS pos, count(*) AS n FROM cut JOIN reg ON cut.chrom = reg.chrom AND p - a - 1 BETWEEN 1 AND 201 GROUP BY ALL)"


def fixed_pile(s, d):
    return footprint.region_pileup(t.fragments(s, d), fixed_regions(s, d), bin_size=t.PEAK_BIN)


def user_groups(s, d):
    return t.fragments(s, d).select(F.col("barcode").alias("cell_id"), "barcode", (F.col("barcode").cast("long") % 5).alias("grp")).distinct()


@query(f"{_PILE} SELECT barcode AS cell_id, pos AS position, CAST(n AS BIGINT) AS value FROM pl")
def pileup(s, d):
    return fixed_pile(s, d)


@query(f"{_PILE}, sc AS (SELECT grp, CAST(sum(n) AS DOUBLE) AS s FROM (SELECT grp, count(*) AS n FROM frag GROUP BY grp) GROUP BY 1), md AS (SELECT median(s) AS md FROM sc) SELECT grp, pos AS position, CAST(sum(n) AS BIGINT) AS count, round(sum(n) / any_value(s) * any_value(md), 6) AS norm FROM pl JOIN sc USING (grp), md GROUP BY 1, 2")
def pileup_by_group(s, d):
    n = t.fragments(s, d).groupBy(F.col("barcode").alias("cell_id")).agg(F.count(F.lit(1)).alias("n_count"))
    g = user_groups(s, d)
    return r6(footprint.by_group(fixed_pile(s, d), g, footprint.group_scales(g.join(n, "cell_id"))), "norm")


@query(f"""WITH {t.FRAG}, reg AS (SELECT chrom, event_id AS id, s + 1 - 1000 AS a FROM frag WHERE value > 150), h AS (SELECT DISTINCT grp, id, frag.s - a AS p, frag.e - a AS q FROM frag JOIN reg ON frag.chrom = reg.chrom AND frag.s - a > 0 AND frag.e - a > 0 AND frag.s - a < 2001 AND frag.e - a < 2001),
    x AS (SELECT DISTINCT grp, id, 'a' AS side, p FROM h UNION ALL SELECT DISTINCT grp, id, 'z', q FROM h) SELECT grp, id AS region_id, p AS position, count(*) AS value FROM x GROUP BY 1, 2, 3""")
def region_matrix(s, d):
    return footprint.region_matrix(t.fragments(s, d), site_regions(s, d), user_groups(s, d), 1000, 1000, bin_size=1 << 11)


def site_regions(s, d):
    return t.fragments(s, d).filter("value > 150").select(F.col("event_id").alias("region_id"), "chrom", (F.col("start") + 1).alias("start"), (F.col("start") + 1).alias("end"))


def place_matrix(s, d):
    """The region matrix of one region of each place; with the numbers of regions there, and their ids."""
    reps, members = ranges.representatives(site_regions(s, d), "region_id")
    return footprint.region_matrix(t.fragments(s, d), reps, user_groups(s, d), 1000, 1000, bin_size=1 << 11), reps, members


_HEX = f"{t.SEQ.replace('seq AS', 'WITH seq AS')}, hx AS (SELECT doc_id, i, substr(q, CAST(i AS BIGINT), 6) AS h FROM (SELECT doc_id, q, unnest(range(1, greatest(length(q) - 4, 1))) AS i FROM seq))"


@query(f"{_HEX} SELECT h AS hexamer, round(count(CASE WHEN i % 10 = 1 THEN 1 END) / count(*), 6) AS bias FROM hx GROUP BY h")
def insertion_bias(s, d):
    h = cut(footprint.hexamer_counts(t.sequences(s, d), 10))  # 4,096 rows for each task
    return r6(footprint.insertion_bias(h.select("hexamer", F.col("every").alias("n")), h, complete=False), "bias")


@query(f"WITH {t.SEQ}, z AS (SELECT substr(q, CAST(k * 206 + 1 AS BIGINT), 206) AS q FROM (SELECT q, unnest(range(0, (length(q) + 205) // 206)) AS k FROM seq)), hx AS (SELECT i - 1 AS o, substr(q, CAST(i AS BIGINT), 6) AS h FROM (SELECT q, unnest(range(1, greatest(length(q) - 4, 1))) AS i FROM z)), e AS (SELECT o, sum((ascii(substr(h, 1, 1)) % 7 + 1) * 0.1) AS e FROM hx GROUP BY o), f AS (SELECT avg(e) AS f FROM e WHERE o < 50 OR o >= 150) SELECT o AS offset, round(e / f, 6) AS expected FROM e, f")
def expected_insertions(s, d):
    # all consecutive regions of 206 letters of every whole sequence; the last one may be shorter
    at = F.sequence(F.lit(0), F.ceil(F.length("sequence") / 206).cast("int") - 1)
    q = t.sequences(s, d).filter(F.length("sequence") > 0).select(F.col("sequence").alias("_q"), F.explode(at).alias("_k")).select(F.substring("_q", F.col("_k") * 206 + 1, F.lit(206)).alias("sequence"))
    six = ["".join(x) for x in itertools.product("ACGT", repeat=6)]
    bias = s.createDataFrame([(x, (ord(x[0]) % 7 + 1) * 0.1) for x in six], "hexamer string, bias double")
    return r6(footprint.expected_insertions(q, bias), "expected")


@query(f"""{_PILE}, gs AS (SELECT grp, count(DISTINCT barcode) AS n FROM frag GROUP BY grp), x AS (SELECT grp, p AS position, coalesce(s, 0) / n AS m FROM gs CROSS JOIN generate_series(1, 201) g(p) LEFT JOIN (SELECT grp, pos + 100 AS q, sum(n) AS s FROM pl GROUP BY 1, 2) USING (grp) WHERE FALSE
    UNION ALL SELECT gs.grp, g.p, coalesce(y.s, 0) / gs.n FROM gs CROSS JOIN generate_series(1, 201) g(p) LEFT JOIN (SELECT grp, pos + 100 AS q, sum(n) AS s FROM pl GROUP BY 1, 2) y ON y.grp = gs.grp AND y.q = g.p), f AS (SELECT grp, avg(m) AS f FROM x WHERE position <= 50 OR position >= 151 GROUP BY grp)
    SELECT grp, position, round(CASE WHEN f <> 0 THEN m / f END, 6) AS norm FROM x JOIN f USING (grp)""")
def footprint_data(s, d):
    p = fixed_pile(s, d).withColumn("position", F.col("position") + 100)
    return r6(footprint.footprint_data(p, user_groups(s, d), 201), "norm")


_TRACK = f"""WITH {t.FRAG}, cut AS (SELECT grp, s AS p FROM frag WHERE chrom = 'view' UNION ALL SELECT grp, e FROM frag WHERE chrom = 'view'), n AS (SELECT grp, count(*) AS n FROM frag GROUP BY grp), k AS (SELECT grp, CAST(n AS DOUBLE) AS sc FROM n), md AS (SELECT median(sc) AS md FROM k),
    x AS (SELECT k.grp, g.p AS pos, coalesce(y.c, 0) / sc * md AS v FROM k CROSS JOIN md CROSS JOIN generate_series(1, 100000) g(p) LEFT JOIN (SELECT grp, p - 100002 AS q, count(*) AS c FROM cut GROUP BY 1, 2) y ON y.grp = k.grp AND y.q = g.p),
    r AS (SELECT grp, pos, sum(v) OVER w AS s, count(*) OVER w AS k FROM x WINDOW w AS (PARTITION BY grp ORDER BY pos ROWS BETWEEN 49 PRECEDING AND 50 FOLLOWING))"""


@query(f"{_TRACK} SELECT grp, count(*) AS n, round(sum(s), 4) AS total, round(max(s), 6) AS top FROM r WHERE k = 100 GROUP BY grp")
def coverage_track(s, d):
    f = t.fragments(s, d)
    n = f.groupBy(F.col("barcode").alias("cell_id")).agg(F.count(F.lit(1)).alias("n_count"))
    cells = user_groups(s, d).join(n, "cell_id")
    got = tracks.coverage_track(f, ("view", 100_001, 200_000), cells, downsample=1.0, max_points=1 << 30, ymax=1e9)
    return got.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("coverage"), 4).alias("total"), F.round(F.max("coverage"), 6).alias("top"))


@query(f"""WITH {t.FRAG}, cut AS (SELECT grp, barcode, s - 100002 AS p FROM frag WHERE chrom = 'view' UNION ALL SELECT grp, barcode, e - 100002 FROM frag WHERE chrom = 'view'), c AS (SELECT * FROM cut WHERE p BETWEEN 1 AND 100000), a AS (SELECT DISTINCT grp, barcode FROM frag), n AS (SELECT a.grp, a.barcode, count(c.p) AS n FROM a LEFT JOIN c ON c.barcode = a.barcode GROUP BY 1, 2),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, barcode) AS r FROM n) WHERE r <= 5) SELECT k.grp, k.barcode AS cell_id, (p - 1) // 1000 AS bin, count(*) AS value FROM c JOIN k USING (barcode) GROUP BY 1, 2, 3""")
def tile_plot(s, d):
    return tracks.tile_plot(t.fragments(s, d), ("view", 100_001, 200_000), user_groups(s, d), 1000, 5)


@query(f"{P} SELECT name AS feature_id, greatest(a, 300001) AS start, least(b, 900000) AS \"end\" FROM peak WHERE chrom = 'view' AND a <= 900000 AND b >= 300001")
def peak_track(s, d):
    return tracks.peak_track(t.peaks(s, d), ("view", 300_001, 900_000)).select("feature_id", "start", "end")


@query(f"WITH {_CON}, x AS (SELECT 'c' || (i % 3) AS chrom, i * 10 + 3.5 AS a, j * 10 + 2.0 AS b, co FROM con WHERE co > 0.0 AND i % 3 = j % 3) SELECT chrom, least(a, b) AS start, greatest(a, b) AS \"end\", co AS score FROM x WHERE chrom = 'c1' AND least(a, b) >= 100 AND greatest(a, b) <= 5000 AND abs(co) > 0.02")
def link_track(s, d):
    return tracks.link_track(links.connections_to_links(connections(s, d)), ("c1", 100, 5000), 0.02).select("chrom", "start", "end", "score")


@query(f"WITH {t.GENE}, r AS (SELECT * FROM tx WHERE chrom = 'c3' AND a <= 300000 AND b >= 200001), g AS (SELECT gene_id, min(a) AS a, max(b) AS b FROM r GROUP BY 1) SELECT 'g' || r.gene_id AS gene_name, r.a AS start, r.b AS \"end\", g.a AS gene_start, g.b AS gene_end FROM r JOIN g USING (gene_id)")
def annotation_lanes(s, d):
    return tracks.annotation_track(t.annotation(s, d), ("c3", 200_001, 300_000)).select("gene_name", "start", "end", "gene_start", "gene_end")


@query(f"WITH {t.BRAND} SELECT g AS gene, CAST(s_nationkey % 5 AS VARCHAR) AS grp, s_suppkey AS cell_id, coalesce(v, 0) AS expression FROM supplier CROSS JOIN (VALUES ('Brand#1'), ('Brand#2')) x(g) LEFT JOIN b ON b.f = g AND b.c = s_suppkey")
def expression_plot(s, d):
    e = t.brand_counts(s, d).withColumnRenamed("feature_id", "gene")
    return tracks.expression_plot(e, t.suppliers(s, d).withColumnRenamed("ident", "grp"), ["Brand#1", "Brand#2"])


@query(f"{ORACLE['region_matrix'].rsplit('SELECT grp, id AS region_id', 1)[0]}, rm AS (SELECT grp, id, p, count(*) AS v FROM x GROUP BY 1, 2, 3), k AS (SELECT id FROM rm GROUP BY id HAVING sum(v) >= 2) SELECT grp, id AS region_id, (p - 1) // 100 AS bin, round(sum(v) / any_value(n), 6) AS value FROM rm JOIN (SELECT grp, count(DISTINCT barcode) AS n FROM frag GROUP BY grp) USING (grp) WHERE id IN (SELECT id FROM k) AND p <= 2000 GROUP BY 1, 2, 3")
def region_heatmap(s, d):
    n = user_groups(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"))
    m, _, members = place_matrix(s, d)
    h = r6(tracks.region_heatmap(m, n, 100, 2001, 2), "value").withColumnRenamed("region_id", "_rep")
    return h.join(members, "_rep").select("grp", "region_id", "bin", "value")


@query("WITH c AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS h, sum(value) AS v FROM events GROUP BY 1), g AS (SELECT g.h, coalesce(v, 0) AS v FROM generate_series((SELECT min(h) FROM c), (SELECT max(h) FROM c)) g(h) LEFT JOIN c USING (h)), r AS (SELECT h, avg(v) OVER w AS m, count(*) OVER w AS k FROM g WINDOW w AS (ORDER BY h ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING)) SELECT h AS position, round(CASE WHEN k = 20 THEN m ELSE 0 END, 6) AS score FROM r")
def signal_track(s, d):
    f = t.table(s, d, "events").select(F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("start"), "value").groupBy("start").agg(F.sum("value").alias("score")).select(F.lit("c").alias("chrom"), "start", F.col("start").alias("end"), "score")
    lo, hi = f.agg(F.min("start"), F.max("start")).first()
    return r6(tracks.signal_track(f, ("c", lo, hi), 20), "score")


# ---- ranks ----


@query("SELECT p_partkey AS feature_id, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank FROM part")
def average_ranks(s, d):
    return with_ranks(t.parts(s, d).select("feature_id", "p_size"), F.col("p_size"), rank="rank").select("feature_id", "rank")


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.table(s, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_orderkey", "o_custkey", "rank")




# ---- assay and motif slots, further scans, plots ----


def parts_assay(s, d):
    c = t.counts(s, d).withColumn("feature_id", F.col("feature_id").cast("string"))
    f = t.parts(s, d).select(F.col("feature_id").cast("string").alias("feature_id"), F.lit("p").alias("chrom"), (F.col("feature_id") * 10 + 1).alias("start"), (F.col("feature_id") * 10 + 5).alias("end"))
    return assay.create_assay(c, f)


@query(f"WITH {t.MAT} SELECT CAST(f AS VARCHAR) AS feature_id, c AS cell_id, v AS value FROM m WHERE f IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND c IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def subset_assay(s, d):
    a = parts_assay(s, d)
    return a.subset(t.parts(s, d).filter("p_size <= 10").select(F.col("feature_id").cast("string").alias("feature_id")), t.suppliers(s, d).filter("s_nationkey < 12")).counts.select("feature_id", "cell_id", "value")


@query(f"WITH {t.MAT}, x AS (SELECT * FROM m WHERE c IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)), y AS (SELECT f, sum(v) AS n FROM x GROUP BY f) SELECT CAST(f AS VARCHAR) AS feature_id, n AS count, round(cume_dist() OVER (ORDER BY n), 6) AS percentile FROM (SELECT p_partkey AS f, coalesce(n, 0) AS n FROM part LEFT JOIN y ON f = p_partkey WHERE p_partkey IN (SELECT f FROM m))")
def subset_feature_stats(s, d):
    a = parts_assay(s, d).subset(cells=t.suppliers(s, d).filter("s_nationkey < 12"))
    return r6(a.features.select("feature_id", "count", "percentile"), "percentile")


@query(f"WITH {t.MAT} SELECT CAST(f AS VARCHAR) AS feature_id, CASE WHEN s_nationkey < 12 THEN 'n' || c ELSE CAST(c AS VARCHAR) END AS cell_id, v AS value FROM m JOIN supplier ON s_suppkey = c")
def rename_cells(s, d):
    a = parts_assay(s, d)
    text = lambda x: x.withColumn("cell_id", F.col("cell_id").cast("string"))
    a = assay.replace(a, cells=text(a.cells), counts=text(a.counts))
    names = t.suppliers(s, d).filter("s_nationkey < 12").select(F.col("cell_id").cast("string").alias("cell_id"), F.concat(F.lit("n"), F.col("cell_id").cast("string")).alias("new_id"))
    return a.rename_cells(names).counts.select("feature_id", "cell_id", "value")


@query(f"WITH {t.MAT}, x AS (SELECT * FROM m WHERE f % 5 > 0 AND c % 7 > 0), u AS (SELECT p_partkey AS f, (SELECT min(s_suppkey) FROM supplier) AS c FROM part WHERE p_partkey NOT IN (SELECT f FROM x) UNION SELECT (SELECT min(p_partkey) FROM part), s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c FROM x)) SELECT f AS feature_id, c AS cell_id, v AS value FROM x UNION ALL SELECT f, c, 0 FROM u")
def add_missing(s, d):
    return assay.add_missing(t.counts(s, d).filter("feature_id % 5 > 0 and cell_id % 7 > 0"), t.parts(s, d), t.suppliers(s, d))


_HITS = "hit AS (SELECT DISTINCT l_partkey AS f, 'm' || (l_suppkey % 25) AS k FROM lineitem WHERE l_quantity > 40)"


def part_motifs(s, d):
    hits = t.table(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("feature_id"), F.concat(F.lit("m"), (F.col("l_suppkey") % 25).cast("string")).alias("motif_id")).distinct()
    names = t.table(s, d, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("motif_id"), F.col("n_name").alias("motif_name"))
    return motifs.create_motifs(hits, names=names)


@query(f"WITH {_HITS} SELECT f AS feature_id, k AS motif_id FROM hit WHERE f IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND k IN ('m1', 'm2', 'm3')")
def subset_motifs(s, d):
    keep = s.createDataFrame([("m1",), ("m2",), ("m3",)], "motif_id string")
    return part_motifs(s, d).subset(t.parts(s, d).filter("p_size <= 10"), keep).data


@query(f"WITH {_HITS} SELECT k AS motif_id, n_name AS motif_name FROM (SELECT DISTINCT k FROM hit) LEFT JOIN nation ON 'm' || n_nationkey = k")
def motif_names(s, d):
    m = part_motifs(s, d)
    return m.convert(m.data.select("motif_id").distinct())


_PFM = "pf AS (SELECT p_brand AS k, p_size % 6 AS pos, ('ACGT')[CAST(p_partkey % 4 + 1 AS INT)] AS base, count(*) AS n FROM part GROUP BY 1, 2, 3)"


def brand_pfm(s, d):
    base = F.substring(F.lit("ACGT"), (F.col("feature_id") % 4 + 1).cast("int"), F.lit(1))
    return t.parts(s, d).groupBy(F.col("p_brand").alias("motif_id"), (F.col("p_size") % 6).alias("pos"), base.alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PFM} SELECT k AS motif_id, pos, base, round(log2((n + 0.2) / (sum(n) OVER (PARTITION BY k, pos) + 0.8) / 0.25), 6) AS score FROM pf")
def pfm_to_pwm(s, d):
    return r6(motifs.pfm_to_pwm(brand_pfm(s, d)), "score")


@query(f"WITH {_PFM}, q AS (SELECT *, n / sum(n) OVER (PARTITION BY k, pos) AS p FROM pf) SELECT k AS motif_id, pos, base, round(p, 6) AS p, round(p * (2 + sum(p * log2(p)) OVER (PARTITION BY k, pos)), 6) AS height FROM q")
def motif_plot(s, d):
    return r6(motifs.information_content(brand_pfm(s, d)), "p", "height")


@query(f"WITH {t.FRAG} SELECT event_id AS id, least((row_number() OVER (ORDER BY event_id) - 1) // greatest((SELECT count(*) FROM frag) // 7, 1) + 1, 7) AS chunk FROM frag")
def chunk_ranges(s, d):
    return ranges.chunk(closed(t.fragments(s, d)), 7).select("id", F.col("chunk").cast("long").alias("chunk"))


@query(f"WITH {t.GENE} SELECT chrom, min(a) - 100 AS start, max(b) + 200 AS \"end\" FROM tx WHERE gene_id = '1' GROUP BY chrom UNION ALL SELECT 'c2', 0, 700")
def find_region(s, d):
    got = [ranges.find_region(t.annotation(s, d), x, 100, 200) for x in ("g1", "c2-100-500")]
    return s.createDataFrame([(c, int(a), int(b)) for c, a, b in got], "chrom string, start long, end long")


@query(f"{_TF} SELECT f AS feature_id, c AS cell_id, round(v / cs * (f % 9 + 1), 6) AS value FROM m JOIN cs USING (c)")
def tfidf_precomputed(s, d):
    idf = t.parts(s, d).select("feature_id", (F.col("feature_id") % 9 + 1).cast("double").alias("idf"))
    return r6(normalize.tfidf(t.counts(s, d), method=2, idf=idf), "value")


_TSSF = f"WITH {t.FRAG}, cut AS (SELECT chrom, barcode, s AS p FROM frag UNION ALL SELECT chrom, barcode, e FROM frag), st AS (SELECT chrom, s + 1 AS p, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM frag WHERE value > 150), pl AS (SELECT barcode, CASE WHEN strand = '-' THEN st.p - cut.p ELSE cut.p - st.p END AS pos, count(*) AS n FROM cut JOIN st ON cut.chrom = st.chrom AND cut.p BETWEEN st.p - 1000 AND st.p + 1000 GROUP BY 1, 2)"


def start_sites(s, d):
    return t.fragments(s, d).filter("value > 150").select("chrom", (F.col("start") + 1).alias("start"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))


@query(f"{_TSSF} SELECT barcode AS cell_id, pos AS position, n AS value FROM pl")
def tss_pileup(s, d):
    return qc.tss_pileup(t.fragments(s, d), start_sites(s, d), bin_size=1 << 11)


@query(f"{_TSSF}, x AS (SELECT barcode, sum(CASE WHEN abs(pos) > 900 THEN n ELSE 0 END) / 200 AS f, sum(CASE WHEN abs(pos) <= 500 THEN n ELSE 0 END) AS c FROM pl GROUP BY 1) SELECT barcode AS cell_id, round(coalesce(c / nullif(CASE WHEN f > 0 THEN f ELSE (SELECT avg(f) FROM x) END, 0), 0) / 1001, 6) AS tss_enrichment FROM x")
def tss_enrichment_full(s, d):
    return r6(qc.tss_enrichment_full(qc.tss_pileup(t.fragments(s, d), start_sites(s, d), bin_size=1 << 11)), "tss_enrichment")


@query(f"{_TSSF} SELECT grp, pos AS position, round(sum(n) / any_value(k), 6) AS mean FROM pl JOIN (SELECT DISTINCT barcode, grp FROM frag) USING (barcode) JOIN (SELECT grp, count(DISTINCT barcode) AS k FROM frag GROUP BY 1) USING (grp) GROUP BY 1, 2")
def tss_plot(s, d):
    return r6(tracks.tss_plot(qc.tss_pileup(t.fragments(s, d), start_sites(s, d), bin_size=1 << 11), user_groups(s, d)), "mean")


@query(f"{ORACLE['region_matrix'].rsplit('SELECT grp, id AS region_id', 1)[0]}, rm AS (SELECT grp, id, p, count(*) AS v FROM x GROUP BY 1, 2, 3) SELECT grp, (p - 1) // 100 AS bin, round(sum(v) / any_value(n) / (SELECT count(DISTINCT id) FROM rm), 6) AS mean FROM rm JOIN (SELECT grp, count(DISTINCT barcode) AS n FROM frag GROUP BY grp) USING (grp) WHERE p <= 2000 GROUP BY 1, 2")
def region_plot(s, d):
    n = user_groups(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"))
    m, reps, _ = place_matrix(s, d)
    return r6(tracks.region_plot(m, n, 100, 2001, reps), "mean")


@query(f"SELECT grp, position, round(norm - position / 100.0, 6) AS norm FROM ({ORACLE['footprint_data'].replace('round(CASE WHEN f <> 0 THEN m / f END, 6)', 'CASE WHEN f <> 0 THEN m / f END')})")
def footprint_plot(s, d):
    p = fixed_pile(s, d).withColumn("position", F.col("position") + 100)
    expected = s.range(201).select(F.col("id").alias("offset"), ((F.col("id") + 1) / 100.0).alias("expected"))
    return r6(tracks.footprint_plot(footprint.footprint_data(p, user_groups(s, d), 201, expected)), "norm").select("grp", "position", "norm")


@query(ORACLE["footprint_data"].replace("s + 1 - 100 AS a, s + 1 + 100 AS b", "s - 99 AS a, s + 101 AS b"))
def run_footprint(s, d):
    sites = t.fragments(s, d).filter("value > 150").select(F.col("event_id").alias("region_id"), "chrom", (F.col("start") + 1).alias("start"), (F.col("start") + 1).alias("end"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return r6(footprint.run_footprint(t.fragments(s, d), sites, user_groups(s, d), upstream=100, downstream=100, bin_size=t.PEAK_BIN), "norm")


@query(f"{P} SELECT name AS region_id, peak.chrom, s AS start, e AS \"end\", barcode, reads AS read_count, e - s AS length, CAST(grp AS VARCHAR) AS ident FROM frag JOIN peak ON frag.chrom = peak.chrom AND s < peak.b AND e >= peak.a")
def multi_region_scan(s, d):
    f = t.fragments(s, d).select("chrom", "start", "end", "barcode", "read_count")
    idents = user_groups(s, d).select("barcode", F.col("grp").cast("string").alias("ident"))
    return files.regions_rows(f, t.peaks(s, d).select(F.col("feature_id").alias("region_id"), "chrom", "start", "end"), idents, bin_size=t.PEAK_BIN)


@query(f"SELECT c.*, n.signal AS nucleosome_signal, x.tss_enrichment FROM ({ORACLE['count_fragments']}) c JOIN ({ORACLE['nucleosome_signal']}) n USING (barcode) JOIN ({ORACLE['tss_enrichment']}) x ON x.cell_id = c.barcode")
def cell_quality(s, d):
    return r6(qc.cell_quality(t.fragments(s, d), sites(s, d), bin_size=1 << 11), "nucleosome_signal", "tss_enrichment").drop("tss_percentile", "nucleosome_percentile")


@query(f"WITH {t.MAT} SELECT 'p-' || (f * 10 + 1) || '-' || (f * 10 + 10) AS feature_id, (CASE WHEN c % 2 = 0 THEN '1_' ELSE '2_' END) || (c // 2) AS cell_id, sum(v) AS value FROM m WHERE f IN (SELECT f FROM m GROUP BY f HAVING count(DISTINCT c % 2) = 2) GROUP BY 1, 2")
def merge_identical(s, d):
    """Tiles that adjoin, the same ones in both assays: they are bound, not reduced to one range."""
    c = t.counts(s, d)
    both = c.groupBy("feature_id").agg(F.countDistinct(F.col("cell_id") % 2).alias("n")).filter("n = 2").select("feature_id")
    a = []
    for i in (0, 1):
        own = c.join(both, "feature_id", "left_semi").filter(F.col("cell_id") % 2 == i).groupBy(F.col("feature_id").cast("string").alias("feature_id"), F.floor(F.col("cell_id") / 2).cast("string").alias("cell_id")).agg(F.sum("value").alias("value"))
        where = t.parts(s, d).select(F.col("feature_id").cast("string").alias("feature_id"), F.lit("p").alias("chrom"), (F.col("feature_id") * 10 + 1).alias("start"), (F.col("feature_id") * 10 + 10).alias("end"))
        a.append(assay.create_assay(own, where))
    return assay.merge(a).counts.select("feature_id", "cell_id", "value")


@query(f"WITH {t.MAT} SELECT 'p-' || (f * 10 + 1) || '-' || (f * 10 + 10) AS feature_id, (CASE WHEN f % 2 = 0 THEN '1_' ELSE '2_' END) || c AS cell_id, v AS value FROM m")
def merge_disjoint(s, d):
    """Tiles that adjoin, each in one assay: disjoint, so bound as they are."""
    a = []
    for i in (0, 1):
        own = t.counts(s, d).filter(F.col("feature_id") % 2 == i).select(F.col("feature_id").cast("string").alias("feature_id"), F.col("cell_id").cast("string").alias("cell_id"), "value")
        where = t.parts(s, d).select(F.col("feature_id").cast("string").alias("feature_id"), F.lit("p").alias("chrom"), (F.col("feature_id") * 10 + 1).alias("start"), (F.col("feature_id") * 10 + 10).alias("end"))
        a.append(assay.create_assay(own, where))
    return assay.merge(a).counts.select("feature_id", "cell_id", "value")
