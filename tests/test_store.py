"""The store and its queries, and that a VCF answers as the store made from it."""

import pytest
from pyspark.sql import functions as F

from genoloom.operators import combine, genotypes, runs
from genoloom.operators.genotypes import Gate
from genoloom.sources import store, targets, vcf
from tests.helpers import path

BANDS_VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=1000000>
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1
"""


def convert(spark, tmp, *names, **options):
    out = f"{tmp}/store-{'-'.join(names)}-{len(options)}"
    store.write(spark, [path(n) for n in names], out, **options)
    return store.open(spark, out)


def keys(df):
    return [(r["chrom"], r["pos"], r["ref"], r["alt"], r["sample_id"], r["gt"]) for r in df.collect()]


@pytest.fixture(scope="module")
def multi(spark, tmp_path_factory):
    return convert(spark, tmp_path_factory.mktemp("s"), "multiallelic.vcf")


@pytest.fixture(scope="module")
def coverage(spark, tmp_path_factory):
    return convert(spark, tmp_path_factory.mktemp("s"), "coverage.vcf")


def test_split_of_multiallelic_records(multi):
    got = {(r["sample_id"], r["pos"], r["alt"]): r for r in multi.calls.collect()}
    assert (got["S1", 200, "T"]["gt"], got["S1", 200, "T"]["ad_ref"], got["S1", 200, "T"]["ad_alt"]) == ("1/.", 5, 12)
    assert (got["S1", 200, "G"]["gt"], got["S1", 200, "G"]["ad_alt"]) == ("./1", 9)
    assert got["S4", 200, "G"]["gt"] == "1/1" and ("S4", 200, "T") not in got and ("S1", 300, "A") not in got


def test_site_counts(multi):
    got = {(r["pos"], r["alt"]): (r["ac"], r["an"], r["n_carriers"], r["n_called"]) for r in multi.sites.collect()}
    assert got == {(100, "G"): (3, 8, 2, 4), (200, "T"): (2, 8, 2, 4), (200, "G"): (3, 8, 2, 4), (300, "A"): (0, 8, 0, 4)}


def test_states(multi, coverage):
    at = lambda s, *loci: {(r["sample_id"], r["alt"]): r["state"] for r in s.classify(targets.Targets(loci=list(loci))).collect()}
    assert set(at(multi, ("1", 300, "G", "A")).values()) == {"non_carrier"}
    got = at(coverage, ("1", 400, "T", "C"))
    assert got["S1", "C"] == "not_assayed" and got["S2", "C"] == "non_carrier"
    assert at(coverage, ("1", 200, "C", "T"))["S2", "T"] == "not_assayed"
    assert set(at(coverage, ("chr1", 250, "C", "T")).values()) == {"not_assayed"}


def test_hom_ref_is_stricter_than_non_carrier(multi):
    t = targets.parse(["chr1:200:C:G"])
    assert [k[4] for k in keys(multi.query(t, hom_ref=True)) if k[5] == "0/0"] == ["S3"]


@pytest.mark.parametrize("selector", ["1:100:A:G", "1:200:C:T", "1:400:T:C", "chr1", "chr2", "chr1:150-450"])
def test_a_vcf_answers_as_its_store(spark, coverage, selector):
    t = targets.parse([selector])
    direct = store.open(spark, path("coverage.vcf"))
    for samples in (None, ["S1"], ["S2"]):
        assert keys(direct.query(t, samples, Gate(min_dp=10), hom_ref=True)) == keys(coverage.query(t, samples, Gate(min_dp=10), hom_ref=True))
        assert keys(direct.query(t, samples)) == keys(coverage.query(t, samples))


def test_no_target_is_everything(coverage):
    assert len(keys(coverage.query())) == coverage.calls.count()
    with pytest.raises(ValueError, match="no such sample"):
        coverage.query(samples=["S9"])


def test_panel_of_many_targets_equals_few(spark, coverage):
    many = targets.Targets(loci=[("chr1", p, "A", "G") for p in range(1, 100)] + [("chr1", 100, "A", "G")], spans=[("chr1", 499, 500)])
    assert keys(coverage.query(many)) == [("chr1", 100, "A", "G", "S2", "0/1"), ("chr1", 500, "A", "T", "S1", "0/1")]


def test_few_targets_reach_the_scan(spark, coverage):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = coverage._restrict(coverage.calls, targets.parse(["1:150-450"]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    # the contig by the name it has in the store, and both bounds
    assert all(x in pushed for x in ("EqualTo(chrom,chr1)", "LessThanOrEqual(pos,450)", "GreaterThanOrEqual(ref_end,150)")), pushed


def test_order_is_checked_across_ranges(spark):
    rows = lambda xs: spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(xs)], "rec_idx long, chrom string, pos int").repartition(3)
    good = [("a", p // 2) for p in range(40)] + [("b", p) for p in range(9)]
    for span in (1, 4, 1000):
        combine.check_sorted(rows(good), span)
        for bad, word in ((good[:30] + [("a", 3)] + good[30:], "follows"), ([*good, ("a", 99)], "met again")):
            with pytest.raises(ValueError, match=word):
                combine.check_sorted(rows(bad), span)
        assert [r["rec_no"] for r in combine.dense_index(rows(good).where("rec_idx % 3 <> 0"), span=span).orderBy("rec_idx").collect()] == list(range(32))


def test_depth_bands(spark, tmp_path):
    source = tmp_path / "in.vcf"
    source.write_text(BANDS_VCF + "".join(f"chr1\t{p}\t.\tG\tA\t50\tPASS\t.\tGT:DP\t0/0:{d}\n" for p, d in ((100, 12), (200, 15), (300, 30), (400, 35), (500, 60))))
    g = store.genotypes_of(vcf.read(spark, str(source)))
    got = [(r["start_pos"], r["end_pos"], r["min_dp"]) for r in runs.callable_runs(g, 10, [10, 20, 50]).orderBy("start_pos").collect()]
    assert got == [(100, 200, 12), (300, 400, 30), (500, 500, 60)]
    plain = runs.callable_runs(g, 10).collect()
    assert [(r["start_pos"], r["end_pos"], r["min_dp"], r["n_sites"]) for r in plain] == [(100, 500, 12, 5)]
    assert runs.callable_runs(g, 10, shard_sites=2).count() == 3


def test_matrix(spark, tmp_path):
    s = convert(spark, tmp_path, "contigs.vcf")
    got = s.matrix(targets.parse(["chr2"]), gate=Gate(min_dp=10)).where("pos = 200").first()
    assert (got["ac"], got["an"], got["af"], got["ns"], got["nhomalt"]) == (2, 4, 0.5, 2, 1)
    one = s.matrix(targets.parse(["chr2"]), ["S2"], Gate(min_dp=10)).where("pos = 200").first()
    assert (one["an"], one["af"], len(one["gts"])) == (2, 1.0, 1)
    assert [r["chrom"] for r in s.query(hom_ref=True).select("chrom").distinct().collect()] and [k[0] for k in keys(s.query(hom_ref=True))][0] == "chr2"


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="no-callable"):
        store.write(spark, [path("sample.vcf")], f"{tmp_path}/a")
    s = convert(spark, tmp_path, "coverage.vcf", no_callable=True)
    with pytest.raises(store.Unclassifiable, match="not-assayed"):
        s.query(targets.parse(["1:100:A:G"]), hom_ref=True)
    with pytest.raises(ValueError, match="holds a store"):
        convert(spark, tmp_path, "coverage.vcf", no_callable=True)
    with pytest.raises(ValueError, match="gVCF"):
        store.write(spark, [path("sample.g.vcf")], f"{tmp_path}/g")
    with pytest.raises(ValueError, match="not sorted"):
        store.write(spark, [path("unsorted.vcf")], f"{tmp_path}/u")
    with pytest.raises(ValueError, match="differ in samples"):
        store.write(spark, [path("multi_chr1.vcf"), path("multi_chr2_othersamples.vcf")], f"{tmp_path}/o")
    with pytest.raises(ValueError, match="no manifest"):
        store.open(spark, f"{tmp_path}/u")


def test_inputs_in_another_order_of_samples(spark, tmp_path):
    a, b = convert(spark, tmp_path, "multi_chr1.vcf", "multi_chr2.vcf"), convert(spark, tmp_path, "multi_chr1.vcf", "multi_chr2_reordered.vcf")
    assert sorted(keys(a.query())) == sorted(keys(b.query()))


def test_volumes(spark, tmp_path):
    for n in ("multi_chr1", "multi_chr2"):
        store.write(spark, [path(f"{n}.vcf")], f"{tmp_path}/{n}")
    store.create_volumes(spark, str(tmp_path))
    joined, whole = store.open(spark, str(tmp_path)), convert(spark, tmp_path, "multi_chr1.vcf", "multi_chr2.vcf")
    assert sorted(keys(joined.query())) == sorted(keys(whole.query()))
    assert set(store.summary(spark, str(tmp_path))["members"]) == {"multi_chr1", "multi_chr2"}


def test_blocks_answer_for_their_span(spark):
    s = store.open(spark, path("sample.g.vcf"))
    got = [(r["pos"], r["alt"], r["gt"], r["min_dp"]) for r in s.query(targets.parse(["chr1:200-300"])).collect()]
    assert got == [(100, ".", "0/0", 28)]
    low = s.query(targets.parse(["chr1:200-300"]), gate=Gate(min_dp=30)).first()
    assert low["gt"] == "./."


def test_captured_fields(spark, tmp_path):
    out = f"{tmp_path}/cap"
    store.write(spark, [path("annotate.vcf")], out, no_callable=True, info_keys=["DP"])
    assert {r["pos"]: r["info_dp"] for r in store.open(spark, out).sites.collect()} == {100: 30, 140: 10, 150: 25, 300: 25, 500: 40}
    with pytest.raises(ValueError, match="Number"):
        store.write(spark, [path("annotate.vcf")], f"{tmp_path}/bad", no_callable=True, format_keys=["SAC"])


def test_gate_fails_open(spark):
    rows = spark.createDataFrame([("0/1", None, None, None), ("0/1", 5, 1, 9), ("0/1", 30, 9, 1), ("1/1", 30, 5, 5), ("1/1", 30, 0, 20)], "gt string, dp int, ad_ref int, ad_alt int")
    count = lambda g: rows.where(g.test()).count()
    assert count(Gate(min_dp=10)) == 4 and count(Gate(min_ab_het=0.2)) == 4 and count(Gate(max_ref_frac_hom=0.1)) == 4 and count(Gate(min_ad_alt=2)) == 4


def test_target_grammar():
    t = targets.parse(["chr1", "chr1:5-9", "chr1:7", "chr1:7:A:G"])
    assert t.spans == [("chr1", 0, targets.END), ("chr1", 4, 9), ("chr1", 6, 7)] and t.loci == [("chr1", 7, "A", "G")]
    for bad in ("chr1:abc", "chr1:9-5"):
        with pytest.raises(ValueError):
            targets.parse([bad])


def test_nearest_over_ranges(spark):
    rows = spark.createDataFrame([("c", p, i) for i, p in enumerate((5, 9, 40, 41, 900))], "chrom string, pos int, rec_id int")
    for span in (1 << 20, 10):
        assert {r["pos"]: r["vardist"] for r in genotypes.nearest_variant(rows, span).collect()} == {5: 4, 9: 4, 40: 1, 41: 1, 900: 859}
    assert genotypes.nearest_variant(rows.limit(1)).where(F.col("vardist").isNull()).count() == 1
