"""Hand-sized fixtures with expected values that were worked out without Spark (FIXTURES.md 2 and 3)."""

import hashlib
import random

import pytest

from regionspark.operators import assay, linalg, motifs, normalize, qc, quantify, ranges, stats
from regionspark.operators import footprint as fp
from regionspark.sources import fragments as files
from regionspark.sources import genomics

FRAGMENTS = [("c1", 100, 200, "A", 2), ("c1", 150, 297, "A", 1), ("c1", 300, 448, "B", 3), ("c1", 350, 400, "A", 1), ("c1", 400, 694, "B", 1), ("c1", 900, 1193, "C", 4), ("c2", 10, 60, "A", 1), ("c2", 55, 155, "C", 2)]
REGIONS = [("r1", "c1", 101, 160), ("r2", "c1", 201, 350), ("r3", "c1", 350, 420), ("r4", "c1", 2000, 2100), ("r5", "c2", 60, 60), ("r6", "c2", 61, 70), ("r7", "c3", 1, 10)]
COUNTS = [("f1", "A", 2.0), ("f1", "B", 1.0), ("f2", "B", 3.0), ("f3", "A", 1.0), ("f3", "C", 4.0)]


@pytest.fixture(scope="module")
def frags(spark):
    return spark.createDataFrame(FRAGMENTS, "chrom string, start long, end long, barcode string, read_count long").repartition(3)


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame(REGIONS, "feature_id string, chrom string, start long, end long")


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(COUNTS, "feature_id string, cell_id string, value double").repartition(2)


def features(spark):
    return spark.createDataFrame([("f1",), ("f2",), ("f3",)], "feature_id string")


def test_count_fragments(spark, frags):
    want = {"A": (4, 0, 3, 5), "B": (2, 1, 0, 4), "C": (2, 1, 1, 6)}
    got = {r.barcode: tuple(r)[1:] for r in qc.count_fragments(frags).collect()}
    assert got == want
    cells = spark.createDataFrame([("A",), ("none",)], "barcode string")
    assert {r.barcode: tuple(r)[1:] for r in qc.count_fragments(frags, cells).collect()} == {"A": want["A"], "none": (0, 0, 0, 0)}
    assert qc.count_fragments(frags.limit(0)).collect() == []


def test_feature_matrix(frags, regions):
    got = {(r.feature_id, r.cell_id): r.value for r in quantify.feature_matrix(frags, regions, bin_size=64).collect()}
    assert got == {("r1", "A"): 2, ("r2", "A"): 1, ("r2", "B"): 1, ("r3", "A"): 1, ("r3", "B"): 2, ("r5", "A"): 1, ("r5", "C"): 1, ("r6", "C"): 1}
    twice = {(r.feature_id, r.cell_id): r.value for r in quantify.feature_matrix([frags, frags], regions).collect()}
    assert twice == {k: 2 * v for k, v in got.items()}
    assert {r.feature_id for r in quantify.known_features(regions, frags).collect()} == {f"r{i}" for i in range(1, 7)}
    assert quantify.known_features(regions, frags, keep_all=True).count() == 7


def test_tiles(frags):
    got = {(r.chrom, r.tile, r.cell_id): r.value for r in quantify.bin_matrix(frags, 250).collect()}
    assert got == {("c1", 0, "A"): 2, ("c1", 1, "A"): 2, ("c1", 1, "B"): 2, ("c1", 2, "B"): 1, ("c1", 3, "C"): 1, ("c1", 4, "C"): 1, ("c2", 0, "A"): 1, ("c2", 0, "C"): 1}
    merged = {(r.chrom, r.start, r.end, r.cell_id): r.value for r in quantify.aggregate_tiles(frags, 250, 1).collect()}
    assert merged == {("c1", 1, 500, "A"): 4, ("c1", 1, 500, "B"): 2, ("c2", 1, 250, "A"): 1, ("c2", 1, 250, "C"): 1}


@pytest.mark.parametrize("method, want", [(1, [8.805025, 7.824446, 8.922792, 7.601402, 8.699681]), (2, [0.462098, 0.173287, 0.519860, 0.156668, 0.470004]), (3, [6.103178, 5.423493, 6.184808, 3.812683, 4.328940]), (4, [2, 1, 3, 0.6, 2.4])])
def test_tfidf(counts, method, want):
    got = {(r.feature_id, r.cell_id): r.value for r in normalize.tfidf(counts, method=method).collect()}
    assert [got[f, c] for f, c, _ in COUNTS] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("method, want", [(1, [7.957927, 7.131699, 8.805025]), (2, [0.1980421, 0.0866434, 0.4620981]), (3, [5.516015, 4.943317, 6.103178]), (4, [2, 1, 2])])
def test_tfidf_of_the_five_cell_matrix(spark, method, want):
    rows = [("r1", 2, 2.0), ("r1", 4, 1.0), ("r1", 5, 2.0), ("r2", 1, 3.0), ("r2", 2, 5.0), ("r2", 3, 1.0), ("r2", 4, 7.0), ("r2", 5, 1.0)]
    got = {r.cell_id: r.value for r in normalize.tfidf(spark.createDataFrame(rows, "feature_id string, cell_id int, value double"), method=method).filter("feature_id = 'r1'").collect()}
    assert [got[c] for c in (2, 4, 5)] == pytest.approx(want, rel=1e-3)


def test_feature_statistics(spark, counts):
    got = {r.feature_id: r.residual_variance for r in normalize.pearson_residual_variance(features(spark), counts, 3).collect()}
    assert got == pytest.approx({"f1": 0.606061, "f2": 1.602663, "f3": 1.485714}, abs=1e-6)
    top = {r.feature_id: (r["count"], round(r.percentile, 6)) for r in normalize.top_features(features(spark), counts).collect()}
    assert top == {"f1": (3, 0.666667), "f2": (3, 0.666667), "f3": (5, 1.0)}
    assert {r.value for r in assay.binarize(counts).collect()} == {1.0}


def test_hypergeometric(spark):
    from pyspark.sql import functions as F

    p = spark.range(1).select(stats.hypergeometric_tail(F.lit(3), F.lit(10), F.lit(30), F.lit(8)).alias("p")).first().p
    assert p == pytest.approx(0.311735039, abs=1e-9)


def test_extend_and_strings(spark):
    from pyspark.sql import functions as F

    from regionspark.functions.columns import parse_range, range_name

    x = spark.createDataFrame([("chr1", 1000, 10000, "+"), ("chr1", 1200, 312100, "-")], "chrom string, start long, end long, strand string")
    assert [(r.start, r.end) for r in ranges.extend(x, 500, 1000).orderBy("start").collect()] == [(200, 312600), (500, 11000)]
    names = [r.n for r in x.select(range_name().alias("n")).collect()]
    assert sorted(names) == ["chr1-1000-10000", "chr1-1200-312100"]
    got = spark.createDataFrame([("HLA-A-1-10",), ("bad",)], "n string").select(parse_range(F.col("n")).alias("r")).select("r.*").collect()
    assert tuple(got[0]) == ("HLA-A", 1, 10) and got[1].start is None


def test_lanes_against_first_fit(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), s := rng.randint(1, 300), s + rng.randint(0, 40)) for i in range(200)]
    want = {}
    for c in "ab":
        reach = []
        for i, _, s, e in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[3], r[0])):
            lane = next((k for k, r in enumerate(reach) if r < s), len(reach))
            reach[lane:lane + 1] = [e]
            want[i] = lane + 1
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long").repartition(5)
    assert {r.id: r.bin for r in ranges.disjoint_bins(df).collect()} == want
    assert ranges.disjoint_bins(df.limit(0)).collect() == []


def test_cut_matrix_and_pileup(spark, frags):
    reg = spark.createDataFrame([("a", "c1", 99, 300, "-"), ("b", "c1", 200, 401, "+")], "region_id string, chrom string, start long, end long, strand string")
    want, pile = {}, {}
    for name, _, lo, hi, strand in reg.collect():
        for c, s, e, cell, _ in FRAGMENTS:
            for p in (s, e):
                at = p - lo - 1
                if c == "c1" and 0 < at <= hi - lo + 1:
                    want[name, cell, at] = want.get((name, cell, at), 0) + 1
                    k = cell, (203 - at if strand == "-" else at) - 101
                    pile[k] = pile.get(k, 0) + 1
    cuts = fp.cut_matrix(frags, reg, bin_size=64)
    assert {(r.region_id, r.cell_id, r.position): r.value for r in cuts.collect()} == want
    assert {(r.cell_id, r.position): r.value for r in fp.pileup(cuts).collect()} == pile


def test_svd_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    m = rng.poisson(0.6, (14, 11)).astype(float)  # cells x features
    rows = [(int(j), int(i), float(m[i, j])) for i in range(14) for j in range(11) if m[i, j]]
    x = spark.createDataFrame(rows, "feature_id long, cell_id long, value double")
    f, c = spark.range(11).withColumnRenamed("id", "feature_id"), spark.range(14).withColumnRenamed("id", "cell_id")
    cells, loadings, sd = linalg.svd(x, 3, f, c, scale=False, power=4)
    u, d, vt = np.linalg.svd(m, full_matrices=False)
    assert sd == pytest.approx(d[:3] / np.sqrt(10), rel=1e-3)
    e = np.array([r.embedding for r in cells.orderBy("cell_id").collect()])
    assert np.abs(e) == pytest.approx(np.abs(u[:, :3] * d[:3]), abs=2e-2)
    assert loadings.count() == 11


def test_fragment_files(spark, frags, tmp_path):
    path = str(tmp_path / "fragments.tsv")
    with open(path, "w") as f:
        f.write("# made by a test\n" + "".join("\t".join(map(str, r)) + "\n" for r in FRAGMENTS))
    assert files.validate_columns(spark, path) == 5
    cells = spark.createDataFrame([("x_A", "A"), ("x_B", "B")], "cell_id string, barcode string")
    one = files.FragmentFile.create(spark, path, cells)
    assert sorted(map(tuple, one.read().collect())) == sorted(FRAGMENTS) and one.validate() and one.head(2).count() == 2
    assert files.filter_cells(one.read(), cells).count() == 6
    assert one.subset(cells.filter("cell_id = 'x_B'")).cells.count() == 1
    with pytest.raises(ValueError):
        files.FragmentFile.create(spark, path, spark.createDataFrame([("y", "nobody")], "cell_id string, barcode string"), tolerance=0.0)
    with open(tmp_path / "empty.tsv", "w") as f:
        f.write("# header only\n")
    with pytest.raises(ValueError):
        files.validate_columns(spark, str(tmp_path / "empty.tsv"))
    groups = spark.createDataFrame([("A", "g 1"), ("B", "g/2"), ("C", "g 1")], "barcode string, grp string")
    assert files.split_by_group(frags, groups, str(tmp_path / "split")).count() == 8
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"grp=g_1", "grp=g_2"}
    files.store_parquet(frags, str(tmp_path / "stored"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "stored")).select("chrom", "start", "end", "barcode", "read_count").collect())) == sorted(FRAGMENTS)


def test_other_files(spark, tmp_path):
    (tmp_path / "a.narrowPeak").write_text("chr1\t9\t20\tp1\t5\t.\t1.5\t2\t3\t4\n")
    (tmp_path / "a.bedgraph").write_text("chr1\t0\t10\t2.5\n")
    (tmp_path / "a.gtf").write_text('#!x\nchr1\tsrc\texon\t5\t90\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N"; gene_biotype "protein_coding";\n')
    (tmp_path / "a.fa").write_text(">chr1 first\nACGTAC\nGTNN\n>chr2\nTTTT\n")
    assert genomics.read_peaks(spark, str(tmp_path / "a.narrowPeak")).first().start == 10
    assert tuple(genomics.read_bedgraph(spark, str(tmp_path / "a.bedgraph")).first()) == ("chr1", 1, 10, 2.5)
    gtf = genomics.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert tuple(genomics.tss_positions(gtf).select("chrom", "start", "end").first()) == ("chr1", 90, 90)
    genome = genomics.read_fasta(spark, str(tmp_path / "a.fa"), block=4, overlap=2)
    reg = spark.createDataFrame([("x", "chr1", 2, 8), ("y", "chr2", 1, 4), ("z", "chr9", 1, 2)], "feature_id string, chrom string, start long, end long")
    assert {r.feature_id: r.sequence for r in genomics.region_sequences(genome, reg, block=4).collect()} == {"x": "CGTACGT", "y": "TTTT", "z": None}


def test_motif_scan_against_plain_loop(spark):
    letters = [("m", i, b, 9 if b == c else 1) for i, c in enumerate("ACGT") for b in "ACGT"]
    pwm = motifs.pfm_to_pwm(spark.createDataFrame(letters, "motif_id string, pos int, base string, n int"))
    s = spark.createDataFrame([("a", "TTACGTTTACCT"), ("b", "NNN"), ("c", None)], "feature_id string, sequence string")
    hits = {(r.feature_id, r.offset, r.strand) for r in motifs.scan(s, pwm, 0.005).collect()}
    assert hits == {("a", 2, "+"), ("a", 2, "-")}  # ACGT reads alike on both strands


def test_fragment_stream(spark, tmp_path):
    from regionspark.streaming import fragments as live

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.tsv").write_text("".join("\t".join(map(str, r)) + "\n" for r in FRAGMENTS[i::2]))
    q = live.running_counts(live.fragment_stream(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName("running_counts_test").start()
    q.processAllAvailable()
    q.stop()
    assert {r.barcode: r.frequency_count for r in spark.table("running_counts_test").collect()} == {"A": 4, "B": 2, "C": 2}


def test_fasta_over_splits(spark, tmp_path):
    """Contigs that run over many splits of the file, of one line and of many, with and without bases."""
    rng = random.Random(9)
    text, want = "", {}
    for name, size, width in (("chr1", 3001, 60), ("chr2", 0, 60), ("chr3", 997, 2000), ("chr4", 64, 8), ("chr5", 1, 7)):
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        text += f">{name} some words\n" + "".join(seq[i : i + width] + "\n" for i in range(0, size, width)) + "\n"
        want |= {(name, b): seq[b * 16 : (b + 1) * 16 + 5] for b in range(max(1, -(-size // 16)))}
    (tmp_path / "a.fa").write_text("lost\n" + text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = genomics.read_fasta(spark, str(tmp_path / "a.fa"), block=16)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == len(want) and {(r.chrom, r.block): r.seq for r in rows} == want
    (tmp_path / "none.fa").write_text("")
    assert genomics.read_fasta(spark, str(tmp_path / "none.fa")).collect() == []


def test_file_hashes(spark, tmp_path):
    (tmp_path / "one.tsv").write_bytes(b"chr1\t1\t2\ta\t1\n")
    one = hashlib.md5(b"chr1\t1\t2\ta\t1\n").hexdigest()
    assert files._hashes(spark, str(tmp_path / "one.tsv")) == one
    (tmp_path / "two.tsv").write_bytes(b"")
    assert files._hashes(spark, str(tmp_path)) == hashlib.md5((one + hashlib.md5(b"").hexdigest()).encode()).hexdigest()
    with pytest.raises(FileNotFoundError):
        files._hashes(spark, str(tmp_path / "three.tsv"))


def test_cosine_in_blocks(spark):
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(40)] + [(7, [1.0, 1.0, 1.0]), (50, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda d: sorted((r.query_id, r.vec_id, -1.0 if r.cosine is None else round(r.cosine, 9)) for r in d.collect())
    whole = key(linalg.cosine(v, v))
    assert len(whole) == len(rows) ** 2 and key(linalg.cosine(v, v, most=4)) == whole
