"""Steps and exports of variant files, against known outputs of small files."""

import pytest
from pyspark.sql import functions as F

from genoloom.operators import annotate, combine, export, filters, genotypes, headers, stats
from genoloom.operators.export import Field
from genoloom.sources import fastx, tab, targets, vcf
from tests.helpers import body, path


def lines(v):
    return list(vcf.text(v))


def rows(df, sep="\t"):
    return [sep.join("" if x is None else str(x) for x in r) for r in df.collect()]


@pytest.fixture(scope="module")
def sample(spark):
    return vcf.read(spark, path("sample.vcf"))


@pytest.fixture(scope="module")
def annotated(spark):
    return vcf.read(spark, path("annotate.vcf"))


def test_untouched_records_are_verbatim(sample):
    assert lines(sample) == open(path("sample.vcf")).read().splitlines()


def test_to_bed(sample):
    assert rows(export.to_bed(sample)) == ["chr1\t99\t100\tSNV", "chr1\t199\t200\tSNV", "chr1\t299\t300\tINS", "chr2\t499\t900\tDEL"]
    assert rows(export.to_bed(sample, passing=True)) == ["chr1\t99\t100\tSNV", "chr1\t299\t300\tINS", "chr2\t499\t900\tDEL"]
    assert rows(export.to_bed(sample, padding=5, include_pos=True))[0] == "chr1\t94\t105\tchr1_100"


def test_region(spark):
    v = vcf.read(spark, path("sample.vcf"), "chr1:200-1000")
    assert rows(export.to_bed(v)) == ["chr1\t199\t200\tSNV", "chr1\t299\t300\tINS"]
    # overlap, not start: the deletion reaches 900; other names of a contig are the same contig
    assert vcf.read(spark, path("sample.vcf"), "2:800-850").records.count() == 1


def test_spans(spark):
    want = ["chr1\t99\t103\tDEL", "chr1\t199\t207\tINS", "chr1\t299\t300\tINS", "chr1\t399\t1400\tDEL", "chr1\t1499\t1750\tDEL"]
    assert rows(export.to_bed(vcf.read(spark, path("spans.vcf")))) == want


def test_blocks_are_no_intervals(spark):
    assert rows(export.to_bed(vcf.read(spark, path("sample.g.vcf")))) == ["chr1\t5000\t5001\tSNV"]


def test_export(sample):
    names, df = export.export(sample, [Field("DP"), Field("AF")], [Field("AD")], id_=True, qual=True, filters=True)
    assert names == ["chrom", "pos", "ref", "alt", "ID", "QUAL", "FILTER", "DP", "AF", "NORMAL:AD", "TUMOR:AD"]
    assert rows(df) == [
        "chr1\t100\tA\tG\trs1\t50.0\tPASS\t30\t0.5\t28,2\t15,15",
        "chr1\t200\tC\tT\t.\t20.0\tlowqual\t10\t0.1\t9,1\t5,5",
        "chr1\t300\tG\tGA\t.\t40.0\tPASS\t25\t\t25,0\t12,13",
        "chr2\t500\tA\t<DEL>\t.\t99.0\tPASS\t\t\t\t",
        "chr2\t1000\tT\tT[chr5:2000[\tbnd1\t60.0\tPASS\t\t\t\t",
    ]


def test_export_parts(sample):
    _, df = export.export(sample, format_fields=[Field("AD", "TUMOR", a) for a in ("sum", "ref", "alt1")])
    assert rows(df)[:3] == ["chr1\t100\tA\tG\t30\t15\t15", "chr1\t200\tC\tT\t10\t5\t5", "chr1\t300\tG\tGA\t25\t12\t13"]
    _, df = export.export(sample, [Field("AF")], only="snvs", missing_blank=True)
    assert rows(df) == ["chr1\t100\tA\tG\t0.5", "chr1\t200\tC\tT\t0.1"]
    for name in ("NOSUCHSAMPLE", "9"):
        with pytest.raises(ValueError, match="no such sample"):
            export.export(sample, format_fields=[Field("GT", name)])


def test_export_samples(sample):
    df = export.export_samples(sample, gt=True, id_=True)
    assert df.columns == ["chrom", "pos", "ID", "ref", "alt", "sample", "GT"]
    assert rows(df)[:2] == ["chr1\t100\trs1\tA\tG\tNORMAL\tA/A", "chr1\t100\trs1\tA\tG\tTUMOR\tA/G"]


def test_counts(spark, annotated):
    first = export.to_counts(annotated, af=True, total=True).first()
    assert (first["ref_count"], first["alt_count"], first["total_count"]) == (14, 1, 15) and first["alt_freq"] == 1 / 15
    assert rows(export.to_counts(vcf.read(spark, path("roao.vcf")), use_ro_ao=True)) == ["chr1\t100\tA\tG\t18\t7", "chr1\t200\tC\tG\t10\t8", "chr1\t200\tC\tT\t10\t4"]
    with pytest.raises(Exception, match="no allele counts"):
        export.to_counts(vcf.read(spark, path("coverage.vcf"))).collect()


def test_reorder(sample):
    got = lines(headers.reorder(sample, ["TUMOR", "NORMAL"]))
    assert got[12].endswith("\tFORMAT\tTUMOR\tNORMAL")
    assert got[13] == "chr1\t100\trs1\tA\tG\t50.0\tPASS\tDP=30;AF=0.5;DB\tGT:AD\t0/1:15,15\t0/0:28,2"
    got = lines(headers.reorder(sample, ["2"]))
    assert got[12].endswith("FORMAT\t2") and got[13].endswith("GT:AD\t0/1:15,15")


def test_rename_chrfix_flags_clear(sample):
    assert lines(headers.rename_samples(sample, {"NORMAL": "GERMLINE", "2": "CANCER"}))[12].endswith("\tGERMLINE\tCANCER")
    fixed = lines(headers.fix_contigs(sample, "ensembl"))
    assert "##contig=<ID=1,length=248956422>" in fixed and body(fixed)[0].startswith("1\t100\t")
    assert not any(x.startswith("2\t") for x in lines(headers.fix_contigs(sample, "ensembl", only=["1"])))
    flags = lines(headers.remove_flags(sample))
    assert "FLAGS=DB" in body(flags)[0] and not any("ID=DB," in x for x in flags) and any("ID=FLAGS," in x for x in flags)
    cleared = lines(headers.clear_filters(sample, ["lowqual"]))
    assert body(cleared)[1].startswith("chr1\t200\t.\tC\tT\t20\tPASS\t") and "CG_CLEARED_FILTER=lowqual" in body(cleared)[1]


def test_header_info(sample):
    assert headers.header_info(sample.header, "filters") == [("PASS", "All filters passed"), ("lowqual", "Low quality, score < 30")]
    assert headers.header_info(sample.header, "sample") == [("NORMAL",), ("TUMOR",)]
    assert headers.header_info(sample.header, "contig") == [("chr1", "248956422"), ("chr2", "242193529")]


def test_strip(spark, sample):
    bare = lines(headers.strip(sample, all_=True))
    assert body(bare)[0] == "chr1\t100\t.\tA\tG\t50\tPASS\t." and not any("##INFO" in x or "GT" in x for x in bare)
    kept = lines(headers.strip(sample, info=["*"], keep_info=["DP"]))
    assert "DP=30" in body(kept)[0] and "AF=" not in body(kept)[0] and any("##INFO=<ID=DP," in x for x in kept)
    g = vcf.read(spark, path("sample.g.vcf"))
    with pytest.warns(UserWarning, match="looks like a gVCF"):
        got = lines(headers.strip(g, all_=True))
    assert "END=5000" in body(got)[0] and "DP=" not in body(got)[0]
    with pytest.warns(UserWarning, match="force-end"):
        assert not any("END=" in x for x in lines(headers.strip(g, all_=True, force_end=True)))


def test_annotators(annotated):
    got = body(lines(annotate.chain(annotated, [annotate.indel, annotate.tstv, annotate.dosage, annotate.auto_id])))
    assert got[0] == "chr1\t100\t1-100-A-G\tA\tG\t50\tPASS\tDP=30;CG_TSTV=TS\tGT:AD:SAC:CG_DS\t0/0:14,1:15,13,1,1:0\t0/1:15,15:8,7,8,7:1"
    assert got[3] == "chr1\t300\t1-300-G-GA\tG\tGA\t40\tPASS\tDP=25;CG_INSERT;CG_INSLEN=1;CG_INDELLEN=1\tGT:AD:SAC:CG_DS\t0/0:25,0:13,12,0,0:0\t0/1:12,13:6,6,7,6:1"
    assert got[4] == "chr2\t500\t2-500-CAT-C\tCAT\tC\t99\tPASS\tDP=40;CG_DELETE;CG_DELLEN=2;CG_INDELLEN=-2\tGT:AD:SAC:CG_DS\t0/0:40,0:20,20,0,0:0\t0/1:20,20:10,10,11,9:1"
    more = body(lines(annotate.chain(annotated, [annotate.vaf, annotate.minor_strand, annotate.fisher_strand, annotate.distance])))
    assert "CG_VARDIST=40" in more[0] and "GT:AD:SAC:CG_VAF:CG_SBPCT:CG_FSB\t" in more[0]


def test_regions_and_tables(spark, annotated):
    regions = tab.read(spark, path("regions.bed"), tab.PRESETS["bed"]).withColumnRenamed("c4", "name")
    scores = tab.read(spark, path("scores.tab"), tab.Layout(1, 2))
    steps = [annotate.bed("REGION", regions), annotate.bed("INREG", regions, flag=True), annotate.table("SCORE", scores, "c5", numeric=True, alt="c4"), annotate.table("LBL", scores, "c6", alt="c4")]
    got = body(lines(annotate.chain(annotated, steps)))
    assert "DP=30;REGION=promoterX;INREG;SCORE=0.91;LBL=hot\t" in got[0]
    assert "DP=25;REGION=promoterX;INREG;SCORE=0.40;LBL=cold\t" in got[2]
    assert "DP=25;REGION=exonY;INREG\t" in got[3]
    one = body(lines(annotate.bed("REGION", regions, sample="NORMAL")(annotated)))
    assert one[0].endswith("GT:AD:SAC:REGION\t0/0:14,1:15,13,1,1:promoterX\t0/1:15,15:8,7,8,7")
    names = tab.column_names(spark, path("scores_hdr.tab"))
    hdr = tab.read(spark, path("scores_hdr.tab"), tab.Layout(1, 2), names=[f"h_{n}" for n in names])
    got = body(lines(annotate.table("LBL", hdr, "h_label", alt="h_alt", ref="h_ref")(annotated)))
    assert "DP=30;LBL=hot\t" in got[0] and "DP=40;LBL=sv\t" in got[4]


def test_other_variants(spark, annotated):
    source = vcf.read(spark, path("source.vcf"))
    steps = [annotate.from_vcf("KAF", source, "AF"), annotate.from_vcf("", source, "@ID"), annotate.from_vcf("KNOWN", source)]
    got = body(lines(annotate.chain(annotated, steps)))
    assert got[0].startswith("chr1\t100\trsA\tA\tG\t50\tPASS\tDP=30;KAF=0.20;KNOWN\t")
    assert got[4].startswith("chr2\t500\trsC\tCAT\tC\t99\tPASS\tDP=40;KNOWN\t")
    only = "\n".join(lines(annotate.from_vcf("KAF", source, "AF", passing=True)(annotated)))
    assert "KAF=0.20" in only and "KAF=0.10" not in only


def test_lists_and_order_of_steps(spark, annotated):
    listed = targets.values(spark, path("dp_set.txt"))
    got = body(lines(annotate.in_file("HIT", "DP", listed)(annotated)))
    assert "DP=30;HIT\t" in got[0] and "DP=10\t" in got[1] and "DP=40\t" in got[4]
    got = body(lines(annotate.in_file("LABEL", "DP", targets.values(spark, path("dp_val.txt")), "c2")(annotated)))
    assert "DP=30;LABEL=common\t" in got[0] and "DP=25;LABEL=rare\t" in got[2]
    gene = annotate.from_vcf("GENE", vcf.read(spark, path("source.vcf")), "GENE")
    panel = annotate.in_file("PANEL", "GENE", targets.values(spark, path("genelist.txt")))
    assert "GENE=BRCA;PANEL" in "".join(lines(annotate.chain(annotated, [gene, panel])))
    assert "PANEL\t" not in "".join(body(lines(annotate.chain(annotated, [panel, gene]))))


def test_flanking(spark):
    ref = fastx.read_fasta(spark, path("flankref.fa")).select(F.col("name").alias("contig"), "seq")
    got = body(lines(annotate.flanking(ref)(vcf.read(spark, path("flank.vcf")))))
    assert [x.split("\t")[7] for x in got] == ["CG_FLANKING=TAC;CG_FLANKING_SUB=G[T>C]A", "CG_FLANKING=ACG;CG_FLANKING_SUB=A[C>A]G", "CG_FLANKING=CAG;CG_FLANKING_SUB=C[T>G]G"]


def _codes(v, *chain, keep=None):
    return {r["pos"]: ";".join(r["filters"]) for r in filters.apply(v.records, list(chain), keep).collect()}


def test_filters(annotated):
    got = _codes(annotated, filters.snv(), filters.quality(30), filters.chrom_fail(["chr2"]))
    assert got == {100: "SNV", 140: "lowqual;SNV;QUAL_lt_30.0", 150: "SNV", 300: "PASS", 500: "CHROM_FAIL_chr2"}
    assert set(_codes(annotated, filters.snv(), keep="passing")) == {300, 500}
    assert set(_codes(annotated, filters.snv(), keep="failing")) == {100, 140, 150}
    assert _codes(annotated, filters.compare("lt", "DP", 25, "INFO"))[140] == "lowqual;DP_lt_25.0_INFO"
    assert _codes(annotated, filters.compare("gte", "DP", 30, "INFO"))[500] == "DP_gte_30.0_INFO"
    assert "PASS" not in _codes(annotated, filters.flag_present("DP")).values()
    tumor = _codes(annotated, filters.compare("eq", "GT", "0/1", "TUMOR", names=annotated.header.samples))
    assert tumor[100] == "GT_eq_0/1_TUMOR" and tumor[150] == "PASS"


def test_filter_combinations(annotated):
    counted = filters.combination_counts(filters.apply(annotated.records, [filters.snv(), filters.quality(30), filters.chrom_fail(["chr2"])])).orderBy("first")
    assert [(r["codes"], r["n"]) for r in counted.collect()] == [("SNV", 2), ("QUAL_lt_30.0,SNV,lowqual", 1), ("CHROM_FAIL_chr2", 1)]


def test_stats(sample):
    r = stats.variant_totals(sample.records).withColumn("ratio", stats.ratio(F.col("ts"), F.col("tv"))).first()
    assert tuple(r) == (5, 1, 4, 2, 3, 0, 2, 0, "-")
    assert [tuple(x) for x in stats.filter_counts(sample.records).collect()] == [("lowqual", 1)]
    assert {tuple(x) for x in stats.info_tally(sample.records, "SVTYPE").collect()} == {("BND", 1), ("DEL", 1), ("*missing*", 3)}


def test_genotype_counts(spark, sample):
    wanted = spark.createDataFrame([(0, "chr1", 100, None, None), (1, "chr1", 300, "G", "GA"), (2, "chr9", 999, None, None), (3, "chr1", 100, "A", "C")], "site_idx int, chrom string, pos int, ref string, alt string")
    from genoloom.sources import store

    got = genotypes.in_class_order(genotypes.genotype_counts(wanted, store.genotypes_of(sample))).drop("site_idx")
    assert rows(got) == ["chr1\t100\tA\tG\t0/0\t1", "chr1\t100\tA\tG\t0/1\t1", "chr1\t300\tG\tGA\t0/0\t1", "chr1\t300\tG\tGA\t0/1\t1", "chr9\t999\t.\t.\t.\t0", "chr1\t100\tA\tC\t.\t0"]


def test_bedpe_and_sv(spark):
    sv = vcf.read(spark, path("sv.vcf"))
    got = rows(export.to_bedpe(sv))
    assert got[0] == "chr1\t50\t51\tchr1\t119\t120\t<DEL>" and got[1] == "chr1\t99\t100\tchr1\t199\t200\tN[chr1:200["
    assert rows(export.to_bedpe(sv, name="@ID", score=Field("SVTYPE", "INFO")))[0].endswith("\tsv_del\tDEL")
    assert export.to_bedpe(sv, unique_event=True).count() == 4
    ref = fastx.read_fasta(spark, path("svref.fa")).select(F.col("name").alias("contig"), "seq")
    seqs = {r["name"]: r["seq"] for r in export.sv_to_fasta(sv, ref, 10).collect()}
    assert len(seqs) == 4 and seqs["sv|chr1|100|chr1|200|bnd_a|BND|3to5"] == "CTAAACCTATAAACCTTTCT"


def test_every_breakend_gives_a_sequence(spark):
    alts = {"3to5": "N[b:{}[", "3to3": "N]b:{}]", "5to3": "]b:{}]N", "5to5": "[b:{}[N"}
    rows = [(n, "a", pos, how, "N", [alt.format(pos2)], ["PASS"], [], [], []) for n, (how, alt, pos, pos2) in enumerate((h, x, p, q) for h, x in alts.items() for p, q in ((4, 6), (4, 900_000), (900_000, 6)))]
    schema = "rec_idx long, chrom string, pos int, id string, ref string, alts array<string>, filters array<string>, info array<struct<k:string,v:string>>, format_keys array<string>, samples array<array<string>>"
    contigs = spark.createDataFrame([("a", "AACCGGTTAC"), ("b", "TTGACCATGA")], "contig string, seq string")
    got = {tuple(x["name"].split("|")[i] for i in (2, 4, 7)): x["seq"] for x in export.sv_to_fasta(vcf.Vcf(vcf.Header(), spark.createDataFrame(rows, schema)), contigs, 3, include_ref=True).where("name like 'sv%'").collect()}
    # bases 2-4 and 5-7 of a are ACC and GGT, bases 4-6 and 7-9 of b are ACC and ATG; beyond the ends there are none
    assert got == {
        ("4", "6", "3to5"): "ACCATG", ("4", "6", "3to3"): "ACCGGT", ("4", "6", "5to3"): "ACCGGT", ("4", "6", "5to5"): "CATGGT",
        ("4", "900000", "3to5"): "ACC", ("4", "900000", "3to3"): "ACC", ("4", "900000", "5to3"): "GGT", ("4", "900000", "5to5"): "GGT",
        ("900000", "6", "3to5"): "ATG", ("900000", "6", "3to3"): "GGT", ("900000", "6", "5to3"): "ACC", ("900000", "6", "5to5"): "CAT",
    }


def test_concat_merge_split(spark, sample, tmp_path):
    a, b = vcf.read(spark, path("concat_a.vcf")), vcf.read(spark, path("concat_b.vcf"))
    got = combine.concat([a.records, b.records], a.header.contigs)
    assert [f"{r['chrom']}:{r['pos']}" for r in got.collect()] == ["chr1:100", "chr1:200", "chr1:300", "chr1:400", "chr2:500", "chr2:600"]
    with pytest.raises(ValueError, match="overlapping"):
        combine.concat([a.records, a.records], a.header.contigs)
    ma, mb = vcf.read(spark, path("merge_a.vcf")), vcf.read(spark, path("merge_b.vcf"))
    merged = vcf.Vcf(ma.header.union(mb.header), combine.merge(ma.records, [mb.records]))
    assert body(lines(merged))[0] == "chr1\t100\trs100\tA\tG\t50\tPASS\tAA=1;BB=2\tGT:AD:DP\t0/0:28,2:30\t0/1:15,15:30"
    noid = vcf.read(spark, path("merge_noid.vcf"))
    assert [x.split("\t")[2] for x in body(lines(vcf.Vcf(noid.header, combine.merge(noid.records, [mb.records]))))] == ["rs1", "rs2"]
    with pytest.raises(ValueError, match="out of order"):
        combine.merge(ma.records, [b.records])
    sizes = combine.chunks(sample.records, 2).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r["chunk"], r["count"]) for r in sizes] == [(1, 2), (2, 2), (3, 1)]
    with pytest.raises(ValueError, match="not sorted"):
        combine.check_sorted(vcf.read(spark, path("unsorted.vcf")).records)


def test_write_and_index(spark, sample, tmp_path):
    out = str(tmp_path / "out.vcf.gz")
    vcf.write(sample, out, tbi=True)
    assert (tmp_path / "out.vcf.gz.tbi").exists()
    assert lines(vcf.read(spark, out)) == lines(sample)
    renamed = str(tmp_path / "out.bgz")
    (tmp_path / "out.vcf.gz").rename(renamed)
    assert vcf.read(spark, renamed).records.count() == 5
    with pytest.raises(ValueError, match="remote locator"):
        vcf.write(sample, "s3://bucket/out.vcf")
    assert vcf.check(sample) == 5
