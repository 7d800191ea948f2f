"""Queries of steps over whole variant records, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import annotate, combine, export, headers, intervals, runs, stats
from genoloom.operators.export import Field
from genoloom.sources.vcf import Header, Vcf

from .views import sql, view

QUERIES: dict = {}
ORACLES: dict = {}

_HEADER = Header(
    [
        "##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="">', '##INFO=<ID=AF,Number=A,Type=Float,Description="">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="">', '##FORMAT=<ID=SAC,Number=.,Type=Integer,Description="">',
    ],
    ["N", "T"],
)

#: by rule of the view: an insertion where the number is a multiple of 5, a flag where it is even
_COLUMNS = {
    "rec_idx": "cast(rec_id as bigint)",
    "chrom": "chrom", "pos": "pos", "ref": "ref",
    "alt": "case when rec_id % 5 = 0 then concat(ref, alt, 'TT') else alt end",
    "filt": "filt", "qual": "qual",
    "n_ad0": "rec_id % 30", "n_ad1": "rec_id % 17", "t_ad0": "rec_id % 23", "t_ad1": "rec_id % 19 + 1",
}
_REC = "rec as (select " + ", ".join(f"{e} as {c}" for c, e in _COLUMNS.items()) + " from g_sites)"


def _sql(body: str, *views: str) -> str:
    return sql("\0" + body, "g_sites", *views).replace(" \0", f", {_REC} ")


def _vcf(spark: SparkSession, d: str) -> Vcf:
    text = lambda c: F.col(c).cast("string")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    rows = view(spark, d, "g_sites").selectExpr(*[f"{e} as {c}" for c, e in _COLUMNS.items()])
    sample = lambda s, gt: F.array(F.lit(gt), F.concat_ws(",", text(f"{s}_ad0"), text(f"{s}_ad1")), F.concat_ws(",", text(f"{s}_ad0"), text(f"{s}_ad1"), text(f"{s}_ad1"), F.lit("1")))
    flag = F.when(F.col("rec_idx") % 2 == 0, entry("DB", F.lit(None).cast("string")))
    records = rows.select(
        "rec_idx", F.lit(0).alias("contig_idx"), "chrom", "pos", F.lit(".").alias("id"), "ref", F.array("alt").alias("alts"), F.col("qual").cast("double").alias("qual"), text("qual").alias("qual_raw"), F.split("filt", ",").alias("filters"),
        F.array_compact(F.array(entry("DP", text("qual")), flag)).alias("info"), F.array(F.lit("GT"), F.lit("AD"), F.lit("SAC")).alias("format_keys"), F.array(sample("n", "0/0"), sample("t", "0/1")).alias("samples"), F.lit(None).cast("string").alias("raw"),
    )
    return Vcf(_HEADER, records)


def _info() -> F.Column:
    return F.array_join(F.transform("info", lambda e: F.concat_ws("=", e["k"], e["v"])), ";").alias("info")


def _query(oracle: str | None = None, *views: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = _sql(oracle, *views)
        return f

    return keep


_DB = "case when rec_idx % 2 = 0 then ';DB' else '' end"


@_query("""select chrom, pos, ref, alt, replace(filt, ',', ';') as filter_codes, cast(qual as varchar) as dp, case when rec_idx % 2 = 0 then 'DB' else '' end as db,
    cast(t_ad0 + t_ad1 as varchar) as total, cast(n_ad0 as varchar) as n_ref, cast(t_ad1 as varchar) as t_alt, cast(least(t_ad0, t_ad1) as varchar) as lowest from rec""")
def export_columns(spark, d) -> DataFrame:
    _, df = export.export(_vcf(spark, d), [Field("DP"), Field("DB")], [Field("AD", "T", "sum"), Field("AD", "N", "ref"), Field("AD", "T", "alt1"), Field("AD", "T", "min")], filters=True)
    return df.toDF("chrom", "pos", "ref", "alt", "filter_codes", "dp", "db", "total", "n_ref", "t_alt", "lowest")


@_query("""select chrom, pos, ref, alt, 'N' as sample, ref || '/' || ref as gt, concat(n_ad0, ',', n_ad1) as ad from rec
    union all select chrom, pos, ref, alt, 'T', ref || '/' || alt, concat(t_ad0, ',', t_ad1) from rec""")
def export_sample_rows(spark, d) -> DataFrame:
    return export.export_samples(_vcf(spark, d), ["AD"], gt=True).withColumnsRenamed({"GT": "gt", "AD": "ad"})


@_query("select chrom, pos, ref, alt, cast(t_ad0 as integer) as ref_count, cast(t_ad1 as integer) as alt_count, round(t_ad1 / (t_ad0 + t_ad1), 6) as alt_freq, cast(t_ad0 + t_ad1 as integer) as total_count from rec")
def allele_read_counts(spark, d) -> DataFrame:
    return export.to_counts(_vcf(spark, d), "T", af=True, total=True).withColumn("alt_freq", F.round("alt_freq", 6))


@_query("select chrom, greatest(0, pos - 1 - 5) as start_pos, pos + 5 as end_pos, case when rec_idx % 5 = 0 then 'INS' else 'SNV' end as name from rec where filt = 'PASS'")
def variant_intervals(spark, d) -> DataFrame:
    return export.to_bed(_vcf(spark, d), padding=5, passing=True).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@_query("select chrom as chrom1, pos - 1 as start1, pos as stop1, chrom as chrom2, pos - 1 as start2, pos as stop2, alt as name, cast(qual as varchar) as score from rec")
def variant_pairs(spark, d) -> DataFrame:
    return export.to_bedpe(_vcf(spark, d), score=Field("DP", "INFO"))


@_query(f"""select rec_idx, replace(chrom, 'chr', '') || '-' || pos || '-' || ref || '-' || alt as id, 'DP=' || qual || {_DB} || case when rec_idx % 5 = 0 then ';CG_INSERT;CG_INSLEN=3;CG_INDELLEN=3'
    when ref || alt in ('AG', 'GA', 'CT', 'TC') then ';CG_TSTV=TS' else ';CG_TSTV=TV' end || ';SRC=x' as info, '1' as dosage from rec""")
def annotate_alleles(spark, d) -> DataFrame:
    v = annotate.chain(_vcf(spark, d), [annotate.auto_id, annotate.indel, annotate.tstv, annotate.tag("SRC", "x"), annotate.dosage])
    return v.records.select("rec_idx", "id", _info(), F.get(F.get("samples", F.lit(1)), F.lit(3)).alias("dosage"))


@_query("""select rec_idx, round((1 + t_ad1) / (t_ad0 + 2 * t_ad1 + 1), 6) as vaf, round(least(1, t_ad1) / (1 + t_ad1), 6) as minor,
    case when n_ad0 + n_ad1 > 0 then round(log2(cast(t_ad0 + t_ad1 as double) / (n_ad0 + n_ad1)), 4) end as ratio from rec""")
def annotate_reads(spark, d) -> DataFrame:
    v = annotate.chain(_vcf(spark, d), [annotate.vaf, annotate.minor_strand, annotate.copy_logratio("T", "N")])
    at = lambda i: F.round(F.get(F.get("samples", F.lit(1)), F.lit(i)).try_cast("double"), 6)
    cnlr = F.try_element_at(F.filter("info", lambda e: e["k"] == "CG_CNLR"), F.lit(1))["v"].try_cast("double")
    return v.records.select("rec_idx", at(3).alias("vaf"), at(4).alias("minor"), F.round(cnlr, 4).alias("ratio"))


@_query(f"""select rec_idx, case when filt like 'lowq%' then case when filt like '%hotspot' then 'hotspot' else 'PASS' end else filt end as codes,
    'DP=' || qual || {_DB} || case when filt like 'lowq%' then ';CG_CLEARED_FILTER=lowq' else '' end as info from rec""")
def clear_filter(spark, d) -> DataFrame:
    return headers.clear_filters(_vcf(spark, d), ["lowq"]).records.select("rec_idx", F.array_join("filters", ",").alias("codes"), _info())


@_query("select rec_idx, 'DP=' || qual || case when rec_idx % 2 = 0 then ';FLAGS=DB' else '' end as info from rec")
def remove_flags(spark, d) -> DataFrame:
    return headers.remove_flags(_vcf(spark, d)).records.select("rec_idx", _info())


@_query("select rec_idx, case when rec_idx % 2 = 0 then 'DB' else '' end as info, 'GT' as keys, '0/1' as tumor from rec where filt = 'PASS'")
def strip_annotations(spark, d) -> DataFrame:
    v = headers.strip(_vcf(spark, d), info=["D*"], keep_info=["DB"], formats=["AD", "SAC"], samples=["N"], passing=True)
    return v.records.select("rec_idx", _info(), F.array_join("format_keys", ":").alias("keys"), F.array_join(F.get("samples", F.lit(0)), ":").alias("tumor"))


@_query("""select r.rec_idx, max(b.end_pos - b.start_pos) as longest from rec r left join g_bed_b b on b.chrom = r.chrom
    and r.pos - 1 - 10 < b.end_pos and r.pos + length(r.ref) - 1 + 10 > b.start_pos group by r.rec_idx""", "g_bed_b")
def annotate_table_max(spark, d) -> DataFrame:
    rows = view(spark, d, "g_bed_b").select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), (F.col("end_pos") - F.col("start_pos")).alias("size"))
    v = annotate.table("LONGEST", rows, "size", mode="max", extend=10)(_vcf(spark, d))
    return v.records.select("rec_idx", F.try_element_at(F.filter("info", lambda e: e["k"] == "LONGEST"), F.lit(1))["v"].cast("int").alias("longest"))


@_query("select r.rec_idx, n.n_name as label from rec r left join nation n on n.n_nationkey = r.qual")
def annotate_from_list(spark, d) -> DataFrame:
    listed = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("c1"), F.col("n_name").alias("c2"))
    v = annotate.in_file("LABEL", "DP", listed, "c2")(_vcf(spark, d))
    return v.records.select("rec_idx", F.try_element_at(F.filter("info", lambda e: e["k"] == "LABEL"), F.lit(1))["v"].alias("label"))


@_query(f"select rec_idx, 'DP=' || qual || {_DB} || ';SRC=b' as info, 'GT:AD:SAC:CG_DS' as keys, '1' as dosage from rec")
def merge_annotations(spark, d) -> DataFrame:
    one = _vcf(spark, d)
    two = annotate.chain(one, [annotate.tag("SRC", "b"), annotate.dosage])
    return combine.merge(one.records, [two.records]).select("rec_idx", _info(), F.array_join("format_keys", ":").alias("keys"), F.get(F.get("samples", F.lit(1)), F.lit(3)).alias("dosage"))


@_query("select chrom, count(*) as n, min(pos) as lo, max(pos) as hi, count(*) filter (where rec_idx % 2 = 1) as second from rec group by chrom")
def concatenated(spark, d) -> DataFrame:
    v = _vcf(spark, d).records
    both = combine.concat([v.where("rec_idx % 2 = 0"), v.where("rec_idx % 2 = 1")], [f"chr{i}" for i in range(1, 6)])
    return both.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_if(F.col("part") == 1).alias("second"))


@_query("""select sample_id, chrom, min(pos) as start_pos, max(pos) as end_pos, count(*) as n_sites, min(dp) as min_dp from (
    select *, rec_no - row_number() over (partition by sample_id, chrom, shard order by rec_no) as island from (
    select g.*, r.rec_no, (r.rec_no - 1) // 50 as shard from g_geno g
    join (select rec_id, row_number() over (partition by chrom order by pos, rec_id) as rec_no from (select distinct chrom, rec_id, pos from g_geno)) r using (rec_id)
    where gt <> './.' and dp >= 20)) group by sample_id, chrom, shard, island""", "g_geno")
def callable_runs_in_shards(spark, d) -> DataFrame:
    return runs.callable_runs(view(spark, d, "g_geno"), 20, None, shard_sites=50)


@_query("""select cast(doc_id as varchar) as contig, case when doc_id % 2 = 0 then substring(seq, cast(length(seq) // 4 as integer) + 1, cast(length(seq) // 2 - length(seq) // 4 as integer))
    else reverse(translate(substring(seq, cast(length(seq) // 4 as integer) + 1, cast(length(seq) // 2 - length(seq) // 4 as integer)), 'ACGTN', 'TGCAN')) end as seq from g_seq where length(seq) // 2 > length(seq) // 4""", "g_seq")
def intervals_to_sequences(spark, d) -> DataFrame:
    s = view(spark, d, "g_seq").withColumn("n", F.length("seq"))
    at = s.select(F.col("doc_id").cast("string").alias("chrom"), F.floor(F.col("n") / 4).cast("int").alias("start"), F.floor(F.col("n") / 2).cast("int").alias("end"), F.lit("x").alias("name"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    out = intervals.to_fasta(at.where("end > start"), s.select(F.col("doc_id").cast("string").alias("contig"), "seq"))
    return out.select(F.regexp_extract("name", r"\|(.*):", 1).alias("contig"), "seq")


@_query("""select cast(coalesce(nh, -1) as varchar) as value, count(*) as n from g_reads where ((flag & 1) = 0 or (flag & 64) <> 0) and (flag & 3584) = 0 group by 1""", "g_reads")
def read_tag_tally(spark, d) -> DataFrame:
    return stats.tag_tally(view(spark, d, "g_reads"), F.col("nh").cast("string"), numeric=True)


@_query("""select floor(quantile_cont(abs(pos % 700 - 350), 0.5) filter (where (flag & 2) <> 0 and ref_name = 'chr1'))::bigint as median_insert from g_reads
    where ((flag & 1) = 0 or (flag & 64) <> 0) and (flag & 3584) = 0""", "g_reads")
def median_insert_size(spark, d) -> DataFrame:
    r = view(spark, d, "g_reads").withColumns({"insert_len": F.col("pos") % 700 - 350, "ref_next": F.when(F.col("ref_name") == "chr1", "=").otherwise("chrX"), "cigar": F.lit("10M")})
    return stats.median_insert(r)
