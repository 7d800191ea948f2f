"""Queries through files over tables made here, and the writers and readers they rest on."""

import gzip
import random

import pytest

from genoloom.operators import genotypes
from genoloom.plans import from_files
from genoloom.sources import files, sam, store, vcf


@pytest.fixture
def tables(spark, tmp_path):
    def make(parts, suppliers=(), lines=()):
        spark.createDataFrame([(k, 1 + k % 50) for k in parts], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/t/part.parquet")
        spark.createDataFrame([(k,) for k in suppliers], "s_suppkey long").write.parquet(f"{tmp_path}/t/supplier.parquet")
        spark.createDataFrame(list(lines), "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/t/lineitem.parquet")
        return f"{tmp_path}/t"

    return make


def test_made_contigs_reach_the_last_site(spark, tables):
    d = tables([1, 400_001])
    got = {r["rec_idx"]: r["around"] for r in from_files.annotate_flanking(spark, d).collect()}
    at = lambda pos: (from_files.BASES * 2)[(pos - 3) % 8 :][:5]
    assert got == {1: at(110), 400_001: at(4_000_110)}


def test_tables_of_lines_and_blocked_files(spark, tmp_path, monkeypatch):
    """Parts written by tasks are one file in order, and runs of blocks give each line once, wherever blocks end."""
    rng = random.Random(3)
    text = ["x" * rng.choice((0, 1, 7, 300, 70_000, 200_000)) + str(i) for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(text)), "i int, line string").repartition(7).orderBy("i").select("line")
    monkeypatch.setattr(files, "SPAN", 100_000)
    for name in ("a.txt", "a.txt.gz", "blocked"):
        path = f"{tmp_path}/{name}"
        if name == "blocked":  # without a line break at the end, and told by its bytes
            out = files.Bgzf(path)
            out.write("\n".join(text).encode())
            out.close()
        else:
            files.write_table(rows, path, ["head"])
            data = (gzip.open if name.endswith(".gz") else open)(path, "rb").read()
            assert data.decode() == "".join(f"{x}\n" for x in ["head", *text])
        got = files.lines(spark, path)
        assert (got.rdd.getNumPartitions() > 20) == (name != "a.txt")
        assert [r["value"] for r in got.orderBy("rec_idx").collect()] == ([] if name == "blocked" else ["head"]) + text
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.txt", "a.txt.gz", "blocked"]
    blocks = files.blocks(f"{tmp_path}/a.txt.gz")
    assert sum(b[2] for b in blocks) == len(data) and len(blocks) > 20 and files.blocks(f"{tmp_path}/a.txt") is None


def test_samples_without_values_are_counted_unread(spark, tables, tmp_path):
    """Sites hold what samples without a value leave, and sites and records without any are there."""
    assert store._squeezed([b"c\t1\t.\tA\tC\t.\t.\t.\tGT:DP\t./.:.\t0/1:7\t.\t./.\t\t./.:3\t.|.:.", b"c\t2\t.\tA\tC\t.\t.\t.\tGT\t./.\t.", b"#x\t1"]) == [b"c\t1\t.\tA\tC\t.\t.\t.\tGT:DP\t1:0/1:7\t5:./.:3", b"c\t2\t.\tA\tC\t.\t.\t.\tGT", b"#x\t1"]
    d = tables(range(1, 41), range(1, 8), [(p, s) for p in range(1, 31) for s in range(1, 8) if (p + s) % 3])
    path = f"{tmp_path}/g.vcf.gz"
    vcf.write(from_files._geno(spark, d), path, ordered=False)
    v = vcf.read(spark, path)
    assert {len(r["samples"]) for r in v.records.select("samples").collect()} == {7} and v.records.count() == 40
    plain, told = (store.genotypes_of(x) for x in (v, store.with_values(spark, path)))
    key = lambda g: sorted((r["chrom"], r["pos"], r["sample_id"], r["sample_idx"], r["gt"], r["dp"]) for r in g.collect())
    assert key(plain.where("gt <> './.' or dp is not null")) == key(told) and told.count() < plain.count()
    store.write(spark, [path], f"{tmp_path}/s")
    want = genotypes.site_counts(genotypes.split_alleles(plain)).select("chrom", "pos", "ac", "an", "n_carriers", "n_called", "n_lowdp")
    sites = store.open(spark, f"{tmp_path}/s").sites
    assert sorted(map(tuple, sites.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert max(r["n_lowdp"] for r in sites.collect()) == 7


def test_series_is_written_and_read_in_one_pass(spark, tables):
    d = tables(range(1, 1801))
    got = from_files.vcf_series(spark, d)
    assert got.inputFiles() and len(got.inputFiles()) == 3
    rows = [tuple(r) for r in got.collect()]
    assert [r[2] for r in rows] == [n // 700 for n in range(1800)] and rows == sorted(rows)
    # the plan has one scan, however many files there are
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_states_shuffle_what_is_known_alone(spark):
    """Every locus meets every sample where the rows are made: no exchange holds them."""
    loci = spark.createDataFrame([("c", 10 * n, "A", "C") for n in range(1, 41)], "chrom string, pos int, ref string, alt string")
    roster = spark.createDataFrame([(f"S{n}",) for n in range(50)], "sample_id string")
    spans = spark.createDataFrame([("c", 10, 30, "S1"), ("c", 20, 20, "S2"), ("c", 10, 400, "gone")], "chrom string, start_pos int, end_pos int, sample_id string")
    calls = spark.createDataFrame([("c", 20, "A", "C", "S1", "0/1", 30, None, None), ("c", 30, "A", "C", "S3", "0/1", 3, None, None)], "chrom string, pos int, ref string, alt string, sample_id string, gt string, dp int, ad_ref int, ad_alt int")
    got = genotypes.classify(loci, roster, loci.where("pos <> 10"), spans, calls, genotypes.Gate(min_dp=20))
    states = {(r["pos"], r["sample_id"]): r["state"] for r in got.collect()}
    assert len(states) == got.count() == 2000
    assert {k: v for k, v in states.items() if v != "not_assayed"} == {(20, "S1"): "carrier", (20, "S2"): "non_carrier", (30, "S1"): "non_carrier", (30, "S3"): "below_gate"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_bam_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Runs of blocks that begin with records are read apart, a file cut elsewhere as one; both give the reads in order."""
    head = sam.Header(["@HD\tVN:1.6", "@SQ\tSN:c\tLN:900000"])
    seqs = ["*", "A", "ACGTN", "acgRYZ", "G" * 333]
    rows = [(i, f"r{i}", i % 4096, "c" if i % 9 else "*", 1 + i, i % 60, "*" if i % 7 == 0 else f"{1 + i % 90}M5S", "*", 0, 0, seqs[i % 5], "*" if i % 5 == 0 or i % 11 == 0 else "I" * len(seqs[i % 5]), {"NH": ("i", str(i)), "RG": ("Z", f"g{i % 3}"), "XB": ("B", "s,1,-2")} if i % 4 else {}, ["NH", "RG", "XB"] if i % 4 else []) for i in range(9000)]
    reads = spark.createDataFrame(rows, sam._DDL).repartition(5)
    path = f"{tmp_path}/a.bam"
    sam.write(head, reads, path)
    monkeypatch.setattr(files, "SPAN", 100_000)
    data = gzip.open(path).read()
    cut = files.Bgzf(f"{tmp_path}/cut.bam")
    cut.write(data)
    cut.close()
    shown = lambda r: [tuple(x)[1:] for x in r.orderBy("rec_idx").collect()]
    header, many = sam.read(spark, path)
    assert header.lines == head.lines and many.rdd.getNumPartitions() > 5
    one = sam.read(spark, f"{tmp_path}/cut.bam")[1]
    assert one.rdd.getNumPartitions() == 1 and shown(many) == shown(one)
    want = [(*r[1:10], r[10].upper().replace("Z", "N"), *r[11:]) for r in rows]
    assert [(*x[:11], {k: tuple(v) for k, v in x[11].items()}, x[12]) for x in shown(many)] == want
