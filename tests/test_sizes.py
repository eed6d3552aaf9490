"""Work that must not grow with the square of copies: many ranges at one place, one common key."""

import pytest
from pyspark.sql import functions as F

from regionspark.operators import assay, footprint, linalg, mito, normalize, qc, quantify, ranges

N = 40  # copies of each place


@pytest.fixture
def pairs(monkeypatch):
    """The rows that overlap joins have made, counted when called."""
    made, join = [], ranges.find_overlaps

    def spy(*args, **how):
        made.append(join(*args, **how))
        return made[-1]

    monkeypatch.setattr(ranges, "find_overlaps", spy)
    return lambda: sum(d.count() for d in made)


@pytest.fixture(scope="module")
def copies(spark):
    """Two fragments in each of N cells, and N sites at one place on each strand."""
    f = spark.range(N).selectExpr("'c' AS chrom", "explode(array(990L, 1010L)) AS start", "start + 30 AS end", "cast(id AS string) AS barcode", "id % 2 AS grp", "1L AS read_count")
    sites = spark.range(2 * N).selectExpr("id AS region_id", "'c' AS chrom", "1000L AS start", "1000L AS end").withColumn("strand", F.when(F.col("region_id") % 2 == 0, "+").otherwise("-"))
    return f, sites


def test_tss_pileup_joins_a_place_once(copies, pairs):
    f, sites = copies
    got = {(r.cell_id, r.position): r.value for r in qc.tss_pileup(f, sites, bin_size=1 << 11).collect()}
    assert got == _brute(f, sites)
    assert pairs() <= 8 * N


def _brute(f, sites):
    from collections import Counter

    n = Counter()
    for r in f.collect():
        for s in sites.collect():
            for p in (r.start, r.end):
                n[(r.barcode, (p - s.start) * (-1 if s.strand == "-" else 1))] += 1
    return dict(n)


def test_tss_enrichment_joins_a_place_once(copies, pairs):
    f, sites = copies
    got = qc.tss_enrichment(f, sites, bin_size=1 << 11).collect()
    assert {(r.center, r.flank) for r in got} == {(4 * 2 * N, 0)} and len(got) == N
    assert pairs() <= 4 * N


def test_region_pileup_equals_the_pileup_of_the_cut_matrix(copies, pairs):
    f, sites = copies
    wide = sites.withColumns({"start": F.col("start") - 50, "end": F.col("end") + 50})
    rows = lambda d: sorted((r.cell_id, r.position, r.value) for r in d.collect())
    got = rows(footprint.region_pileup(f, wide.drop("region_id"), bin_size=512))
    assert pairs() <= 8 * N
    assert got == rows(footprint.pileup(footprint.cut_matrix(f, wide, bin_size=512)))


def test_region_matrix_joins_a_place_once(copies, pairs):
    f, sites = copies
    groups = f.select("barcode", "grp").distinct()
    f = f.drop("grp")
    for dedup in (True, False):
        got = footprint.region_matrix(f, sites, groups, 100, 100, dedup=dedup, bin_size=512).collect()
        assert len(got) == 2 * N * 2 * 4 and {r.region_id for r in got} == set(range(2 * N))
        assert {r.value for r in got} == ({1} if dedup else {N // 2})
    assert pairs() <= 2 * 2 * 2 * 2


def test_gene_activity_shuffles_no_pairs(spark, pairs):
    f = spark.range(300).selectExpr("if(id % 3 = 0, 'c', 'd') AS chrom", "id * 7 AS start", "id * 7 + 20 + id % 11 AS end", "if(id < 100, 'hot', if(id = 299, null, cast(id % 9 AS string))) AS barcode")
    genes = spark.range(60).selectExpr("if(id % 2 = 0, 'c', 'd') AS chrom", "id * 30 AS start", "id * 30 + 900 AS end", "if(id % 3 = 0, '-', '+') AS strand", "concat('g', id) AS gene_name", "cast(id AS string) AS gene_id", "'protein_coding' AS gene_biotype", "cast(id AS string) AS tx_id")
    got = {(r.gene_name, r.cell_id): r.value for r in quantify.gene_activity(f, genes).collect()}
    assert pairs() == 0
    spans = ranges.extend(quantify.gene_spans(genes), 2000, 0).withColumnRenamed("gene_name", "feature_id")
    assert got == {(r.feature_id, r.cell_id): r.value for r in quantify.feature_matrix(f, spans).collect()}
    twice = spans.withColumn("feature_id", F.expr("if(feature_id < 'g3', 'same', feature_id)"))
    rows = lambda d: sorted(map(repr, d.select("feature_id", "cell_id", "value").collect()))
    assert rows(quantify.wide_feature_matrix(f, twice, most=7)) == rows(quantify.feature_matrix(f, twice))


def test_intersect_matrix_joins_a_place_once(spark, pairs):
    features = spark.createDataFrame([("x", "c", 10, 20), ("y", "c", 50, 60)], "feature_id string, chrom string, start long, end long")
    counts = spark.range(N).selectExpr("'x' AS feature_id", "id AS cell_id", "2L AS value")
    regions = spark.range(N).selectExpr("'c' AS chrom", "15L AS start", "16L AS end")
    got = assay.intersect_matrix(counts, features, regions, bin_size=64)
    assert got.columns == ["feature_id", "cell_id", "value"] and got.count() == N * N
    assert {r["count"] for r in got.groupBy("cell_id").count().collect()} == {N}
    assert pairs() == 1


@pytest.mark.parametrize("most", [7, 20_000])
def test_nearest_cells_by_brute_force_with_ties(spark, most):
    rows = [(i, f"v{j}", float(1 + (i % 6) * j % 5)) for i in range(30) for j in range(8) if (i % 6 + j) % 3]
    x = spark.createDataFrame(rows, "cell_id long, variant string, v double")
    of = {}
    for i, j, v in rows:
        of.setdefault(i, {})[j] = v
    size = {i: sum(v * v for v in d.values()) ** 0.5 for i, d in of.items()}
    sim = lambda a, b: round(sum(v * of[b].get(j, 0) for j, v in of[a].items()) / size[a] / size[b], 12)
    want = {(a, b) for a in of for _, b in sorted((-sim(a, b), b) for b in of if b != a and sim(a, b) > 0)[:4]}
    assert {(r.a, r.b) for r in mito.nearest_cells(x, 4, most).collect()} == want


@pytest.fixture
def read(spark):
    """A table through a counter of the rows that are read of it."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return lambda df: df.mapInArrow(run, df.schema), n


def test_cosine_makes_pairs_in_products_of_matrices(spark):
    rows = [(i, None if i == 7 else [] if i == 8 else [0.0, 0.0] if i == 9 else [1.0, None] if i == 10 else [1.0] if i == 11 else [float(i), 2.0]) for i in range(12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = linalg.cosine(v, v.filter("vec_id % 3 < 2"), most=3)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.query_id, r.vec_id): r.cosine for r in got.collect()}
    assert len(found) == 8 * 12
    for (a, b), c in found.items():
        if max(a, b) < 7 or {a, b} == {11}:
            assert c == pytest.approx(1.0 if a == b else (a * b + 4) / ((a * a + 4) * (b * b + 4)) ** 0.5)
        else:
            assert c is None


def test_svd_reads_its_matrix_once(spark, read):
    through, n = read
    x = spark.range(60).selectExpr("id % 10 AS feature_id", "id % 7 AS cell_id", "cast(1 + id % 4 AS double) AS value").groupBy("feature_id", "cell_id").agg(F.sum("value").alias("value"))
    size = x.count()
    linalg.svd(through(x), 2, x.select("feature_id").distinct(), x.select("cell_id").distinct())[0].collect()
    assert n.value == size


def test_variants_read_the_counts_once(spark, read):
    through, n = read
    c = spark.range(200).selectExpr("id % 5 AS pos", "substring('ATCG', cast(id % 4 AS int) + 1, 1) AS base", "id % 40 AS cell_id", "id % 3 AS fwd", "id % 2 AS rev").groupBy("pos", "base", "cell_id").agg(F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev"))
    size = c.count()
    mito.identify_variants(through(c), spark.range(5).selectExpr("id AS pos", "'A' AS ref"), spark.range(40).withColumnRenamed("id", "cell_id")).collect()
    assert n.value == size


def test_tfidf_reads_the_counts_once(spark, read):
    through, n = read
    c = spark.range(50).selectExpr("id % 10 AS feature_id", "id % 7 AS cell_id", "1.0D AS value").distinct()
    size = c.count()
    normalize.tfidf(through(c)).collect()
    assert n.value == size


@pytest.mark.parametrize("apart", [False, True])
def test_merge_reads_the_counts_for_the_filters_alone(spark, read, apart):
    through, n = read
    both, size = [], 0
    for i in (0, 1):
        c = spark.range(40).selectExpr("cast(id % 10 AS string) AS feature_id", f"concat('{i}', id % 8) AS cell_id", "1.0D AS value").distinct()
        f = spark.range(10).selectExpr("cast(id AS string) AS feature_id", "'p' AS chrom", f"id * 10 + {5 * i * apart} AS start", f"id * 10 + 8 + {5 * i * apart} AS end")
        size += c.count()
        both.append(assay.create_assay(through(c), f))
    assert assay.merge(both).counts.agg(F.sum("value")).first()[0] == size
    assert n.value <= 3 * size


def test_region_stats_and_hexamers_of_long_sequences(spark):
    texts = {"a": "ACGTNacgtAAAA", "b": "", "c": "G", "d": None, "e": "éAAéCGCGCG", "f": "ACGTTGCA" * 3000}
    s = spark.createDataFrame(list(texts.items()), "feature_id string, sequence string")
    got = {r.feature_id: r for r in qc.region_stats(s).collect()}
    plan = qc.region_stats(s)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    for k, q in texts.items():
        u = None if q is None else q.upper()
        assert got[k].sequence_length == (None if u is None else len(u))
        for two in qc.DINUCLEOTIDES:
            assert got[k][two] == (None if u is None else sum(u[i : i + 2] == two for i in range(len(u))))
    n = {r.hexamer: (r.n, r.every) for r in footprint.hexamer_counts(s, 10).groupBy("hexamer").agg(F.sum("n").alias("n"), F.sum("every").alias("every")).collect()}
    want = {}
    for q in texts.values():
        u = (q or "").upper()
        for i in range(len(u) - 5):
            if set(u[i : i + 6]) <= set("ACGT"):
                a, b = want.get(u[i : i + 6], (0, 0))
                want[u[i : i + 6]] = (a + 1, b + (i % 10 == 0))
    assert n == want
    at = {(r.offset, r.hexamer): r.n for r in footprint.hexamers_by_offset(s).groupBy("offset", "hexamer").agg(F.sum("n").alias("n")).collect()}
    assert sum(at.values()) == sum(a for a, _ in want.values())
    assert at[(0, "ACGTTG")] == 1 and at[(800, "ACGTTG")] == 1
