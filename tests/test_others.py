"""Intervals, reads, sequences and alignments, against known outputs of small files."""

import pytest
from pyspark.sql import functions as F

from genoloom.functions import genotype as G
from genoloom.functions import sequence as S
from genoloom.operators import align, annotate, interval_sets, intervals, range_join, reads, stats
from genoloom.sources import bed, fastx, files, sam, tab
from tests.helpers import path

SAM = """@HD\tVN:1.6
@SQ\tSN:chr1\tLN:1000
fwd\t0\tchr1\t10\t60\t4M\t*\t0\t0\tACGT\tIIII\tBC:Z:AAAA\tNM:i:1
rev\t16\tchr1\t20\t60\t4M\t*\t0\t0\tAAAC\tJJJJ\tBC:Z:CCCC
"""


def six(df):
    return list(bed.text(df.select("chrom", "start", "end", "name", "score", "strand")))


def test_bed_columns(spark):
    b = bed.read(spark, path("input.bed"))
    assert list(bed.text(intervals.to_bed3(b))) == ["chr1\t100\t200", "chr2\t50\t75", "chr3\t10\t20", "chr1\t100\t200"]
    assert six(intervals.to_bed6(b)) == ["chr1\t100\t200\t\t0\t+", "chr2\t50\t75\tregionB\t2.9\t-", "chr3\t10\t20\tregionC\t0\t+", "chr1\t100\t200\tregionA\t1.9\t+"]
    cleaned = list(bed.text(intervals.clean(b), ["chrom", "start", "end", "name", "score", "strand"], extras=True))
    assert cleaned == ["chr1\t100\t200\t\t0\t+", "chr2\t50\t75\tregionB\t2\t-", "chr3\t10\t20\tregionC\t0\t+", "chr1\t100\t200\tregionA\t1\t+\tfoo\tbar"]


def test_resize(spark):
    got = six(intervals.to_bed6(intervals.resize(bed.read(spark, path("resize.bed")), five=100)))
    assert got == ["chr1\t900\t2000\tplus\t5\t+", "chr1\t3000\t4100\tminus\t10\t-", "chr2\t0\t150\tnone\t0\t+"]
    with pytest.raises(ValueError):
        intervals.resize(bed.read(spark, path("resize.bed")))


def test_bed_stats(spark):
    r = stats.interval_totals(bed.read(spark, path("stats.bed"))).first()
    assert tuple(r) == (7, 2260, 322.85714285714283, 100, 1000, 10)


def test_median_is_the_maximum_where_half_is_met(spark):
    rows = spark.createDataFrame([("c", 0, n) for n in (1, 2, 3, 4)], "chrom string, start int, end int")
    assert stats.interval_totals(rows).first()["median_size"] == 4


@pytest.mark.parametrize(
    ("mode", "options", "want"),
    [
        ("inter", {}, ["chr1\t10\t20\tA1|B1\t0\t+"]),
        ("union", {}, ["chr1\t0\t30\tA1|B1\t0\t+", "chr1\t50\t60\tA2\t0\t+", "chr2\t0\t10\tB2\t0\t-"]),
        ("sub", {}, ["chr1\t0\t10\tA1\t0\t+", "chr1\t50\t60\tA2\t0\t+"]),
        ("exclusive", {}, ["chr1\t0\t10\tA1\t0\t+", "chr1\t20\t30\tB1\t0\t+", "chr1\t50\t60\tA2\t0\t+", "chr2\t0\t10\tB2\t0\t-"]),
        ("union", {"score": "sum"}, ["chr1\t0\t30\tA1|B1\t5\t+", "chr1\t50\t60\tA2\t1\t+", "chr2\t0\t10\tB2\t5\t-"]),
        ("union", {"score": "count", "label_a": "setA", "label_b": "setB"}, ["chr1\t0\t30\tsetA|setB\t2\t+", "chr1\t50\t60\tsetA\t1\t+", "chr2\t0\t10\tsetB\t1\t-"]),
        ("union", {"flanking": 25}, ["chr1\t0\t60\tA1|A2|B1\t0\t+", "chr2\t0\t10\tB2\t0\t-"]),
    ],
)
@pytest.mark.parametrize("bin_size", [1 << 20, 64])
def test_interval_sets(spark, mode, options, want, bin_size):
    a, b = bed.read(spark, path("setA.bed")), bed.read(spark, path("setB.bed"))
    out = interval_sets.combine(a, b, mode, True, options.get("flanking", 0), bin_size)
    more = {k: v for k, v in options.items() if k != "flanking"}
    assert six(interval_sets.decorate(out, a, b, True, **more).orderBy("chrom", "start")) == want


def test_interval_sets_without_strand(spark):
    a, b = bed.read(spark, path("setA.bed")), bed.read(spark, path("setB.bed"))
    assert list(bed.text(interval_sets.combine(a, b, "inter", False))) == ["chr1\t10\t20"]
    with pytest.raises(ValueError):
        interval_sets.combine(a, b, "inter", flanking=5)
    with pytest.raises(ValueError):
        interval_sets.combine(a, b, "both")


def test_overlap_join_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    make = lambda n: [(f"c{rng.randint(0, 1)}", s := rng.randint(0, 300), s + rng.randint(1, 90), i) for i in range(n)]
    x, y = make(60), make(60)
    a, b = spark.createDataFrame(x, "ac string, s1 int, e1 int, i int"), spark.createDataFrame(y, "bc string, s2 int, e2 int, j int")
    on = ("ac", "s1", "e1"), ("bc", "s2", "e2")
    want = sorted((p[3], q[3]) for p in x for q in y if p[0] == q[0] and p[1] < q[2] and p[2] > q[1])
    for size in (7, 64, 1000):
        got = sorted((r["i"], r["j"]) for r in range_join.overlap_join(a, b, *on, bin_size=size).collect())
        assert got == want
        hit = {i for i, _ in want}
        assert {r["i"] for r in range_join.overlap_join(a, b, *on, "left_semi", size).collect()} == hit
        assert {r["i"] for r in range_join.overlap_join(a, b, *on, "left_anti", size).collect()} == {p[3] for p in x} - hit


def test_bed_to_fasta(spark):
    ref = fastx.read_fasta(spark, path("bedref.fa")).select(F.col("name").alias("contig"), "seq")
    b = bed.read(spark, path("tofasta.bed"))
    assert list(fastx.fasta_text(intervals.to_fasta(b, ref))) == [">plusReg|chr1:0-8\nACGTACGT", ">minusReg|chr1:48-40\nTTTTGGGG", ">noneReg|chr2:0-4\nTTTT", ">|chr1:10-14\nGTAA"]
    assert list(fastx.fasta_text(intervals.to_fasta(b, ref, stranded=False)))[1] == ">minusReg|chr1:40-48\nCCCCAAAA"
    assert list(fastx.fasta_text(intervals.to_fasta(b, ref), 4))[0] == ">plusReg|chr1:0-8\nACGT\nACGT"


def test_fasta(spark):
    f = fastx.read_fasta(spark, path("simple.fa")).orderBy("rec_idx")
    assert list(fastx.fasta_text(f)) == [">seq1 first record\nACGTACGTACGGCCAATTGG", ">seq2\nAAAATTTT", ">seq3 gc-rich\nGGGGCCCC"]
    assert list(fastx.fasta_text(f, 5))[0].endswith("\nACGTA\nCGTAC\nGGCCA\nATTGG")
    assert [tuple(r) for r in fastx.gc(f).collect()] == [("seq1", "0.5500"), ("seq2", "0.0000"), ("seq3", "1.0000")]


def test_fastq(spark, tmp_path):
    p = tmp_path / "in.fq"
    p.write_text("@read1\nACGT\n+\nIIII\n@read2 existing\nTTTT\n+\n@FFF\n")
    q = fastx.read_fastq(spark, str(p)).orderBy("rec_idx")
    assert list(fastx.fastq_text(fastx.tag(q, "BC:Z:ACGT"))) == ["@read1 BC:Z:ACGT\nACGT\n+\nIIII", "@read2 existing\tBC:Z:ACGT\nTTTT\n+\n@FFF"]
    assert [tuple(r) for r in fastx.gc(q).collect()] == [("read1", "0.5000"), ("read2", "0.0000")]


def test_reads(spark, tmp_path):
    p = tmp_path / "in.sam"
    p.write_text(SAM)
    header, r = sam.read(spark, str(p))
    assert header.references == [("chr1", 1000)] and "\n".join(sam.text(header, r)) + "\n" == SAM
    s = reads.to_sequences(r, ["BC"])
    assert list(fastx.fastq_text(s)) == ["@fwd BC:Z:AAAA\nACGT\n+\nIIII", "@rev BC:Z:CCCC\nGTTT\n+\nJJJJ"]
    assert [x["read_name"] for x in reads.select_reads(r, excluded=16).collect()] == ["fwd"]
    assert [x["read_name"] for x in reads.select_reads(r, tags=[("eq", "BC", "CCCC")]).collect()] == ["rev"]
    assert [x["read_name"] for x in reads.select_reads(r, tags=[("not-eq", "NM", "1")]).collect()] == ["rev"]
    assert [x["read_name"] for x in reads.in_region(r, "chr1", 13, 15).collect()] == ["fwd"]
    assert [tuple(x) for x in reads.export(r, ["pos", "read_name"], ["NM"]).collect()] == [("fwd", 10, "1"), ("rev", 20, "")]
    bam = str(tmp_path / "out.bam")
    sam.write(header.with_program("sam-filter"), r, bam)
    h2, r2 = sam.read(spark, bam)
    assert h2.lines[-1].startswith("@PG\tID:sam-filter") and list(sam.text(header, r2)) == SAM.splitlines()
    with pytest.raises(ValueError, match="CRAM"):
        sam.read(spark, "x.cram")


def test_read_stats(spark, tmp_path):
    p = tmp_path / "in.sam"
    rows = [("a", 0, "50M"), ("b", 16, "10M2I10M5S"), ("c", 4, "*"), ("d", 0x400, "50M"), ("e", 0x81, "50M"), ("f", 0x41, "10M100N10M")]
    p.write_text("@SQ\tSN:chr1\tLN:1000\n" + "".join(f"{n}\t{f}\tchr1\t1\t60\t{c}\t*\t0\t0\t*\t*\n" for n, f, c in rows))
    _, r = sam.read(spark, str(p))
    got = stats.reads_profile(r.withColumns({"nh": reads.tag("NH").try_cast("int"), "ih": reads.tag("IH").try_cast("int")})).first()
    assert (got["reads"], got["mapped"], got["unmapped"], got["multiple"], got["bases"], got["flag_duplicate"]) == (4, 3, 1, 0, 92, 1)


def test_reverse_complements_of_random_sequences(spark):
    import random

    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGTNacgtnRYK") for _ in range(n)) for n in range(30)]
    pair = dict(zip("ACGTNacgtnRYK", "TGCANtgcanYRM", strict=True))
    got = spark.createDataFrame([(x,) for x in seqs], "s string").select("s", S.reverse_complement(F.col("s")).alias("r")).collect()
    # codes of several bases are turned round too, or stay: plain bases decide
    plain = [(r["s"], r["r"]) for r in got if not set(r["s"]) & set("RYK")]
    assert len(plain) > 3 and all(x == "".join(pair[c] for c in reversed(s)) for s, x in plain)
    twice = spark.createDataFrame([(x,) for x in seqs], "s string").where(S.reverse_complement(S.reverse_complement(F.col("s"))) != F.col("s"))
    assert twice.where(~F.col("s").rlike("[RYK]")).count() == 0


def test_genotypes_of_every_ploidy(spark):
    """Unphased, in ascending order, what is missing first; held to a rule in Python."""
    import itertools

    alleles = [".", "0", "1", "2", "3"]
    cases = [sep.join(x) for n in (1, 2, 3, 4) for x in itertools.product(alleles, repeat=n) for sep in ("/", "|")] + ["3|0/2", "1/2|0"]
    want = {c: "/".join(sorted(c.replace("|", "/").split("/"), key=lambda x: -1 if x == "." else int(x))) for c in cases}
    rows = spark.createDataFrame([(c,) for c in dict.fromkeys(cases)], "g string").select("g", G.canonical(F.col("g")).alias("c"), G.dosage(F.col("g")).alias("d")).collect()
    assert {r["g"]: r["c"] for r in rows} == want
    for r in rows:
        called = [x for x in r["g"].replace("|", "/").split("/") if x != "."]
        assert r["d"] == (sum(x != "0" for x in called) if called else None), r


def test_classes_stand_in_order(spark):
    names = ["0/0", "0/1", "1/1", "0/2", "1/2", "2/2", "0/3", "1/3", "2/3", "3/3", "./2", "./."]
    turned = [names[(i * 5) % len(names)] for i in range(len(names))]
    got = [r["g"] for r in spark.createDataFrame([(x,) for x in turned], "g string").orderBy(G.class_order(F.col("g"))).collect()]
    assert got == names


def test_alignments(spark):
    one = align.pairwise("ACGTACGTAC", "ACGTACGTAC")
    assert one.query == "ACGTACGTAC" and one.score == 10 and not one.reverse
    assert align.pairwise("GTTTGTACCC", "GGGTACAAAC").reverse
    gap = align.align("ACGTTTACGTACG", "ACGTTTGACGTACG", align.Scores(gap_open=1), global_=True)
    assert gap.query.replace("-", "") == "ACGTTTACGTACG" and gap.target.replace("-", "") == "ACGTTTGACGTACG" and gap.query.count("-") == 1
    assert align.align("TTACGTACGT", "ACGTACGT", align.Scores(clip=(5, 1))).score == 8 - 6
    cheap = align.align("ACGGGGT", "ACGGT", align.Scores(gap_open=3, hp_scale=2, hp_cap=3), global_=True)
    assert cheap.score == 5 and cheap.target == "ACGGT" or cheap.target.count("-") == 2
    assert align.align("ACGTT", "ACGT", align.Scores(ins=(1, 1), dels=(9, 9)), global_=True).score == 3
    assert align.compress("AACGGG") == ("ACG", [2, 1, 3])
    assert align.msa_compressed(["AACGGGT", "ACGT"]) == ["AACGGGT", "A-CG--T"]
    assert align.msa_compressed(["AACGGGT", "ACGT"], expand=False) == ["ACGT", "ACGT"]
    rows = align.msa(["ACGTACGT", "ACGACGT", "ACGTACGT"])
    assert len({len(r) for r in rows}) == 1 and align.consensus(rows) == "ACGTACGT" and [r.replace("-", "") for r in rows] == ["ACGTACGT", "ACGACGT", "ACGTACGT"]
    df = spark.createDataFrame([("ACGT", "TTACGTTT")], "query string, target string")
    assert align.align_pairs(df).first()["query_row"] == "ACGT"
    assert abs(annotate.fisher(8, 2, 1, 5) - 14.5637) < 1e-3 and annotate.fisher(10, 10, 10, 10) < 1e-9  # the first has p = 0.034965
    groups = spark.createDataFrame([(1, "a", "ACGT"), (1, "b", "ACGT")], "g int, name string, seq string")
    assert {r["name"]: r["row"] for r in align.align_groups(groups, "g").collect()} == {"a": "ACGT", "b": "ACGT", "consensus": "ACGT"}


def test_sorted_and_indexed(spark, tmp_path):
    import gzip

    source = tmp_path / "in.bed"
    source.write_text("#head\nchr2\t400\t600\tc\nchr1\t150\t160\tb\nchr1\t90\t110\ta\n")
    out = str(tmp_path / "out.bed.gz")
    tab.write_sorted(spark, str(source), out, tab.PRESETS["bed"])
    assert gzip.open(out, "rt").read() == "#head\nchr1\t90\t110\ta\nchr1\t150\t160\tb\nchr2\t400\t600\tc\n"
    assert gzip.open(f"{out}.tbi").read(4) == b"TBI\1"
    bad = str(tmp_path / "bad.bed.gz")
    with pytest.raises(ValueError, match="not sorted"):
        tab.write_indexed(["chr1\t9\t10", "chr1\t1\t2"], bad, tab.PRESETS["bed"])
    assert (tmp_path / "bad.bed.gz").exists() and not (tmp_path / "bad.bed.gz.tbi").exists()

    def failing():
        yield "x"
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        files.write_lines(str(tmp_path / "half.txt"), failing())
    assert not list(tmp_path.glob("half*"))
