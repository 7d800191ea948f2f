"""Queries of the operators over the derived views, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions import contigs as C
from genoloom.functions import genotype as G
from genoloom.functions import sequence as S
from genoloom.functions import variant as V
from genoloom.operators import combine, filters, genotypes, interval_sets, intervals, range_join, reads, runs, stats

from . import from_files
from . import records as record_plans
from .views import sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIN_DP, BANDS = 10, [10, 20, 50]


def _query(oracle: str | None = None, views: tuple[str, ...] = ()):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *views)
        return f

    return keep


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g_sites as variant records."""
    s = view(spark, sf_dir, "g_sites")
    return s.select("rec_id", F.col("rec_id").cast("long").alias("rec_idx"), "chrom", "pos", "ref", "alt", F.array("alt").alias("alts"), F.col("qual").cast("double").alias("qual"), F.split("filt", ",").alias("filters"), F.array(F.struct(F.lit("DP").alias("k"), F.col("qual").cast("string").alias("v"))).alias("info"))


def _carried_of(g: DataFrame) -> DataFrame:
    return g.where(G.dosage(F.col("gt")) > 0).withColumn("ref_end", F.col("pos"))


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that carry the alternate."""
    return _carried_of(view(spark, sf_dir, "g_geno"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genotypes, kept for a plan that needs them several times: they are a distinct and a join."""
    return view(spark, sf_dir, "g_geno").persist()


_AC = "list_sum(list_transform(string_split(replace(gt, '|', '/'), '/'), lambda x: case when x = '1' then 1 else 0 end))"
_AN = "list_sum(list_transform(string_split(replace(gt, '|', '/'), '/'), lambda x: case when x <> '.' then 1 else 0 end))"


@_query(f"""select chrom, pos, ref, alt, cast(sum({_AC}) as bigint) as ac, cast(sum({_AN}) as bigint) as an,
    count(*) filter (where {_AC} > 0) as n_carriers,
    count(*) filter (where {_AN} > 0 and coalesce(dp >= {MIN_DP}, false)) as n_called,
    count(*) filter (where not ({_AN} > 0 and coalesce(dp >= {MIN_DP}, false))) as n_lowdp
    from g_geno group by all""", ("g_geno",))
def site_allele_counts(spark, d):
    return genotypes.site_counts(view(spark, d, "g_geno").withColumn("allele", F.lit(1)), MIN_DP)


@_query(f"select rec_id, sample_id, gt, case when {_AN} > 0 then cast({_AC} as integer) end as dosage from g_geno", ("g_geno",))
def genotype_dosage(spark, d):
    return view(spark, d, "g_geno").select("rec_id", "sample_id", "gt", G.dosage(F.col("gt")).alias("dosage"))


@_query("""select chrom, case when gt = './.' then './.' when gt in ('0/1', '1|0', '0|1') then '0/1' else gt end as gt_class,
    count(*) as n from g_geno group by all""", ("g_geno",))
def genotype_classes(spark, d):
    return view(spark, d, "g_geno").groupBy("chrom", G.canonical(F.col("gt")).alias("gt_class")).agg(F.count(F.lit(1)).alias("n"))


@_query("""select rec_id, sample_id, replace(replace(replace(gt, '0', ref), '1', alt), '.', '.') as bases from g_geno""", ("g_geno",))
def genotype_bases(spark, d):
    return view(spark, d, "g_geno").select("rec_id", "sample_id", G.bases(F.col("gt"), F.col("ref"), F.array("alt")).alias("bases"))


@_query("""select rec_id, sample_id, 2 as allele, replace(gt, '1', '.') as recoded from g_geno
    union all select rec_id, sample_id, 1, gt from g_geno""", ("g_geno",))
def genotype_split(spark, d):
    g = view(spark, d, "g_geno").withColumn("allele", F.explode(F.array(F.lit(1), F.lit(2))))
    return g.select("rec_id", "sample_id", "allele", G.recode(F.col("gt"), F.col("allele")).alias("recoded"))


@_query(f"""select sample_id, chrom, min(pos) as start_pos, max(pos) as end_pos, count(*) as n_sites, min(dp) as min_dp from (
    select *, rec_no - row_number() over (partition by sample_id, chrom, band order by rec_no) as island from (
    select g.*, r.rec_no, (dp >= 10)::int + (dp >= 20)::int + (dp >= 50)::int as band from g_geno g
    join (select rec_id, row_number() over (partition by chrom order by pos, rec_id) as rec_no from (select distinct chrom, rec_id, pos from g_geno)) r using (rec_id)
    where gt <> './.' and dp >= {MIN_DP})) group by sample_id, chrom, band, island""", ("g_geno",))
def callable_runs(spark, d):
    return runs.callable_runs(view(spark, d, "g_geno"), MIN_DP, BANDS)


@_query(f"select chrom, pos, ref, alt, sample_id, gt from g_geno where gt = '0/0' and dp >= {MIN_DP}", ("g_geno",))
def hom_ref_reconstruction(spark, d):
    g = _held(spark, d)
    sites = view(spark, d, "g_sites").select(*genotypes.LOCUS)
    return genotypes.hom_ref(sites, runs.callable_runs(g, MIN_DP, BANDS), _carried_of(g))


@_query(f"""select s.chrom, s.pos, s.ref, s.alt, x.sample_id, case when {_AC} > 0 then 'carrier' when gt = '0/0' and dp >= {MIN_DP} then 'non_carrier' else 'not_assayed' end as state
    from (select * from g_sites where filt <> 'PASS') s cross join (select concat('S', cast(s_suppkey as varchar)) as sample_id from supplier) x
    left join g_geno g on g.rec_id = s.rec_id and g.sample_id = x.sample_id""", ("g_sites", "g_geno"))
def observed_states(spark, d):
    """Every sample at the loci that a filter marks."""
    g, sites = _held(spark, d), view(spark, d, "g_sites")
    roster = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_id"))
    return genotypes.classify(sites.where("filt <> 'PASS'"), roster, sites.select(*genotypes.LOCUS), runs.callable_runs(g, MIN_DP), _carried_of(g))


@_query(f"""select chrom, pos, ref, alt, sample_id, gt, dp from g_geno where {_AC} > 0 and coalesce(dp >= 20, true)""", ("g_geno",))
def gated_calls(spark, d):
    return _carried(spark, d).where(genotypes.Gate(min_dp=20).test(ad_ref=None, ad_alt=None)).select("chrom", "pos", "ref", "alt", "sample_id", "gt", "dp")


@_query(f"""select g.chrom, g.pos, g.ref, g.alt, g.sample_id, g.gt from g_geno g
    semi join (select chrom, pos, ref, alt from g_sites where filt <> 'PASS') l on g.chrom = l.chrom and g.pos = l.pos and g.ref = l.ref and g.alt = l.alt
    where {_AC} > 0""", ("g_sites", "g_geno"))
def locus_panel(spark, d):
    loci = view(spark, d, "g_sites").where("filt <> 'PASS'")
    return genotypes.lookup_loci(_carried(spark, d), loci).select("chrom", "pos", "ref", "alt", "sample_id", "gt")


@_query(f"""select g.chrom, g.pos, g.sample_id, g.gt from g_geno g where {_AC} > 0
    and exists (select 1 from g_bed_b b where b.chrom = g.chrom and g.pos - 1 < b.end_pos and g.pos > b.start_pos)""", ("g_geno", "g_bed_b"))
def span_panel(spark, d):
    spans = view(spark, d, "g_bed_b").select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return genotypes.lookup_spans(_carried(spark, d), spans).select("chrom", "pos", "sample_id", "gt")


@_query(f"""select chrom, pos, ref, alt, cast(sum({_AC}) as bigint) as ac, cast(sum({_AN}) as bigint) as an,
    case when sum({_AN}) > 0 then round(sum({_AC}) / sum({_AN}), 6) end as af,
    count(*) filter (where {_AN} > 0) as ns, count(*) filter (where gt = '1/1') as nhomalt,
    coalesce(max(gt) filter (where sample_id = 'S1'), './.') || ',' || coalesce(max(gt) filter (where sample_id = 'S2'), './.') || ',' || coalesce(max(gt) filter (where sample_id = 'S3'), './.') as gts
    from g_geno where sample_id in ('S1', 'S2', 'S3') group by chrom, pos, ref, alt""", ("g_geno",))
def sample_matrix(spark, d):
    m = genotypes.matrix(view(spark, d, "g_geno"), ["S1", "S2", "S3"])
    return m.withColumns({"af": F.round("af", 6), "gts": F.array_join("gts", ",")})


@_query(f"""select chrom, pos, ref, alt, count(*) filter (where {_AC} > 0) as alt_calls, count(*) filter (where not {_AC} > 0) as ref_calls
    from g_geno where gt <> './.' group by all""", ("g_geno",))
def call_tally(spark, d):
    return genotypes.tally(view(spark, d, "g_geno").where(G.has_call(F.col("gt"))))


@_query("""select s.rec_id as site_idx, s.chrom, s.pos, coalesce(g.ref, s.ref) as ref, s.alt,
    coalesce(case when g.gt in ('0/1', '1|0', '0|1') then '0/1' else g.gt end, '.') as gt, count(g.gt) as count
    from g_sites s left join g_geno g on g.chrom = s.chrom and g.pos = s.pos and g.ref = s.ref and g.alt = s.alt group by all""", ("g_sites", "g_geno"))
def site_genotype_counts(spark, d):
    sites = view(spark, d, "g_sites").select(F.col("rec_id").alias("site_idx"), "chrom", "pos", "ref", "alt")
    g = view(spark, d, "g_geno").withColumn("alts", F.array("alt"))
    return genotypes.genotype_counts(sites, g)


@_query("""select rec_id, chrom, pos, least(pos - lag(pos) over w, lead(pos) over w - pos) as vardist
    from g_sites window w as (partition by chrom order by pos, rec_id)""", ("g_sites",))
def variant_distance(spark, d):
    return genotypes.nearest_variant(view(spark, d, "g_sites").select("rec_id", "chrom", "pos"))


@_query("""select rec_id, case when chrom = 'chr2' then concat_ws(',', old, 'SNV', case when qual < 30 then 'QUAL_lt_30.0' end, 'CHROM_FAIL_chr2', case when qual < 10 then 'DP_lt_10.0_INFO' end)
    else concat_ws(',', old, 'SNV', case when qual < 30 then 'QUAL_lt_30.0' end, case when qual < 10 then 'DP_lt_10.0_INFO' end) end as codes
    from (select *, case when filt <> 'PASS' then filt end as old from g_sites)""", ("g_sites",))
def filter_chain(spark, d):
    chain = [filters.snv(), filters.quality(30), filters.chrom_fail(["chr2"]), filters.compare("lt", "DP", 10, "INFO")]
    return filters.apply(_records(spark, d), chain).select("rec_id", F.array_join("filters", ",").alias("codes"))


@_query("select rec_id, chrom, pos from g_sites where filt = 'PASS' and qual >= 30 and chrom in ('chr1', 'chr3')", ("g_sites",))
def filter_passing(spark, d):
    chain = [filters.quality(30), filters.chrom_pass(["chr1", "chr3"])]
    return filters.apply(_records(spark, d), chain, "passing").select("rec_id", "chrom", "pos")


@_query("""select codes, count(*) as n, min(cast(rec_id as bigint)) as first from (select rec_id, case when filt like '%hotspot%' then case when qual < 30 then 'QUAL_lt_30.0,hotspot,lowq' else 'hotspot,lowq' end
    when filt = 'lowq' then case when qual < 30 then 'QUAL_lt_30.0,lowq' else 'lowq' end when qual < 30 then 'QUAL_lt_30.0' end as codes from g_sites) where codes is not null group by codes""", ("g_sites",))
def filter_combinations(spark, d):
    return filters.combination_counts(filters.apply(_records(spark, d), [filters.quality(30)]))


@_query("""select count(*) as total, count(*) filter (where filt <> 'PASS') as filtered, count(*) filter (where filt = 'PASS') as passing, count(*) as snv,
    0::bigint as indel, 0::bigint as ref_only, count(*) filter (where ref || alt in ('AG', 'GA', 'CT', 'TC')) as ts, count(*) filter (where ref || alt not in ('AG', 'GA', 'CT', 'TC')) as tv from g_sites""", ("g_sites",))
def variant_stats(spark, d):
    return stats.variant_totals(_records(spark, d))


@_query("select unnest(string_split(filt, ',')) as code, count(*) as n from g_sites where filt <> 'PASS' group by 1", ("g_sites",))
def filter_code_counts(spark, d):
    return stats.filter_counts(_records(spark, d))


@_query("select cast(qual as varchar) as value, count(*) as n from g_sites group by 1", ("g_sites",))
def info_value_tally(spark, d):
    return stats.info_tally(_records(spark, d), "DP")


@_query("""select chrom, count(*) filter (where ref || alt in ('AG', 'GA', 'CT', 'TC')) as ts, count(*) filter (where ref || alt not in ('AG', 'GA', 'CT', 'TC')) as tv,
    case when ref || alt in ('AG', 'GA', 'CT', 'TC') then -1 else 1 end as cls from g_sites group by chrom, cls""", ("g_sites",))
def transition_counts(spark, d):
    s = view(spark, d, "g_sites")
    ref, alt = F.col("ref"), F.col("alt")
    return s.groupBy("chrom", V.tstv(ref, alt).alias("cls")).agg(F.count_if(V.is_transition(ref, alt)).alias("ts"), F.count_if(V.is_transversion(ref, alt)).alias("tv")).select("chrom", "ts", "tv", "cls")


@_query(f"""select chrom, count(*) as genotypes, count(dp) as with_dp, count(*) filter (where {_AN} = 0) as no_call, count(*) filter (where dp < {MIN_DP}) as below from g_geno group by chrom""", ("g_geno",))
def field_census(spark, d):
    return combine.field_census(view(spark, d, "g_geno"), MIN_DP)


_SWEEP = """, ends as (select chrom{k}, start_pos as p, 1 as a, 0 as b from g_bed_a union all select chrom{k}, end_pos, -1, 0 from g_bed_a
    union all select chrom{k}, start_pos, 0, 1 from g_bed_b union all select chrom{k}, end_pos, 0, -1 from g_bed_b),
    steps as (select chrom{k}, p, sum(a) as a, sum(b) as b from ends group by all),
    segs as (select chrom{k}, p as s, lead(p) over w as e, sum(a) over w as a, sum(b) over w as b from steps window w as (partition by chrom{k} order by p)),
    kept as (select *, case when s > lag(e) over (partition by chrom{k} order by s) + {gap} then 1 else 0 end as fresh from segs where e is not null and {keep}),
    isl as (select *, sum(fresh) over (partition by chrom{k} order by s) as i from kept)
    select chrom{k}, cast(min(s) as integer) as start_pos, cast(max(e) as integer) as end_pos from isl group by chrom{k}, i"""


def _bed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return view(spark, d, name).select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "name", F.lit(1.0).alias("score"), "strand")


def _set(mode: str, keep: str, stranded: bool, flanking: int = 0) -> None:
    def run(spark, d):
        out = interval_sets.combine(_bed(spark, d, "g_bed_a"), _bed(spark, d, "g_bed_b"), mode, stranded, flanking, bin_size=4096)
        keys = ["chrom", "strand"] if stranded else ["chrom"]
        return out.select(*keys, F.col("start").cast("int").alias("start_pos"), F.col("end").cast("int").alias("end_pos"))

    run.__name__ = f"bed_{mode}" + ("_stranded" if stranded else "") + ("_flanking" if flanking else "")
    text = _SWEEP.format(k=", strand" if stranded else "", keep=keep, gap=flanking)
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = sql(text, "g_bed_a", "g_bed_b").replace(" , ends as", ", ends as")


_set("inter", "a > 0 and b > 0", True)
_set("union", "(a > 0 or b > 0)", True)
_set("union", "(a > 0 or b > 0)", True, 25)
_set("sub", "a > 0 and b = 0", True)
_set("exclusive", "(a > 0) <> (b > 0)", True)
_set("inter", "a > 0 and b > 0", False)
_set("xor", "(a > 0) <> (b > 0)", False)


@_query("""select a.name as a_name, b.name as b_name from g_bed_a a join g_bed_b b on a.chrom = b.chrom and a.start_pos < b.end_pos and a.end_pos > b.start_pos""", ("g_bed_a", "g_bed_b"))
def interval_overlap_join(spark, d):
    a = view(spark, d, "g_bed_a").select(F.col("chrom").alias("ac"), F.col("start_pos").alias("s1"), F.col("end_pos").alias("e1"), F.col("name").alias("a_name"))
    b = view(spark, d, "g_bed_b").select(F.col("chrom").alias("bc"), F.col("start_pos").alias("s2"), F.col("end_pos").alias("e2"), F.col("name").alias("b_name"))
    return range_join.overlap_join(a, b, ("ac", "s1", "e1"), ("bc", "s2", "e2"), bin_size=1024).select("a_name", "b_name")


@_query("""select s.rec_id, string_agg(distinct b.name, ',' order by b.name) as regions, count(b.name) as n from g_sites s left join g_bed_b b
    on s.chrom = b.chrom and s.pos - 1 < b.end_pos and s.pos > b.start_pos group by s.rec_id""", ("g_sites", "g_bed_b"))
def annotate_intervals(spark, d):
    s = view(spark, d, "g_sites").select("rec_id", "chrom", (F.col("pos") - 1).alias("p0"), F.col("pos").alias("p1"))
    b = view(spark, d, "g_bed_b").select(F.col("chrom").alias("bc"), "start_pos", "end_pos", "name")
    both = range_join.collapse_overlaps(s, b, ("chrom", "p0", "p1"), ("bc", "start_pos", "end_pos"), {"names": F.array_sort(F.collect_set("name")), "n": F.count("name")}, bin_size=1024)
    return both.select("rec_id", F.when(F.col("n") > 0, F.array_join("names", ",")).alias("regions"), F.coalesce("n", F.lit(0)).alias("n"))


@_query("""select count(*) as regions, cast(sum(end_pos - start_pos) as bigint) as bases, avg(end_pos - start_pos) as mean_size,
    (select case when max((u * 2 = n)::int) = 1 then max(v) else min(v) filter (where u * 2 > n) end from
     (select v, sum(c) over (order by v) as u, sum(c) over () as n from (select cast(end_pos - start_pos as bigint) as v, count(*) as c from g_bed_a group by 1))) as median_size,
    cast(max(end_pos - start_pos) as bigint) as max_size, cast(min(end_pos - start_pos) as bigint) as min_size from g_bed_a""", ("g_bed_a",))
def bed_stats(spark, d):
    return stats.interval_totals(_bed(spark, d, "g_bed_a"))


@_query("""select name, greatest(0, case when strand = '-' then start_pos - 30 else start_pos - 100 end) as start_pos,
    case when strand = '-' then end_pos + 100 else end_pos + 30 end as end_pos from g_bed_a""", ("g_bed_a",))
def bed_resize(spark, d):
    return intervals.resize(_bed(spark, d, "g_bed_a"), five=100, three=30).select("name", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@_query("""select doc_id, case when length(seq) > 0 then round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 6) end as gc, length(seq) as n from g_seq""", ("g_seq",))
def sequence_gc(spark, d):
    return view(spark, d, "g_seq").select("doc_id", F.round(S.gc(F.col("seq")), 6).alias("gc"), F.length("seq").cast("long").alias("n"))


@_query("select doc_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) as revcomp from g_seq", ("g_seq",))
def reverse_complement(spark, d):
    return view(spark, d, "g_seq").select("doc_id", S.reverse_complement(F.col("seq")).alias("revcomp"))


@_query(r"select doc_id, regexp_replace(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10) || '$', '') as wrapped from g_seq", ("g_seq",))
def fasta_wrap(spark, d):
    return view(spark, d, "g_seq").select("doc_id", S.wrap(F.col("seq"), 60).alias("wrapped"))


@_query("""select l_orderkey, l_linenumber, cast(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MX=]', 1), lambda x: x::bigint)) as bigint) as bases,
    cast(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDNX=]', 1), lambda x: x::bigint)) as bigint) as ref_bases from g_reads""", ("g_reads",))
def cigar_lengths(spark, d):
    return view(spark, d, "g_reads").select("l_orderkey", "l_linenumber", S.aligned_bases(F.col("cigar")).alias("bases"), S.reference_length(F.col("cigar")).alias("ref_bases"))


_USE = "((flag & 1) = 0 or (flag & 64) <> 0) and (flag & 3584) = 0"
_FLAG_SQL = ", ".join(f"count(*) filter (where (flag & {bit}) <> 0) as flag_{name}" for name, bit in S.FLAGS.items())


@_query(f"""select count(*) filter (where {_USE}) as reads, count(*) filter (where {_USE} and (flag & 4) = 0) as mapped, count(*) filter (where {_USE} and (flag & 4) <> 0) as unmapped,
    count(*) filter (where {_USE} and (flag & 4) = 0 and nh <> 1) as multiple, count(*) filter (where {_USE} and (flag & 4) = 0 and nh = 1) as unique_reads,
    cast(coalesce(sum(case when {_USE} and (flag & 4) = 0 then list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MIX=]', 1), lambda x: x::bigint)) end), 0) as bigint) as bases, {_FLAG_SQL} from g_reads""", ("g_reads",))
def read_stats(spark, d):
    return stats.reads_profile(view(spark, d, "g_reads").withColumn("ih", F.lit(None).cast("int")))


@_query(f"select ref_name, count(*) as n from g_reads where {_USE} and (flag & 4) = 0 group by ref_name", ("g_reads",))
def reads_per_reference(spark, d):
    return stats.reads_by_reference(view(spark, d, "g_reads"))


@_query("select read_name, flag, mapq from g_reads where (flag & 3) = 3 and (flag & 1024) = 0 and mapq >= 20 and nh < 3", ("g_reads",))
def read_filter(spark, d):
    return reads.select_reads(view(spark, d, "g_reads"), required=3, excluded=1024, min_mapq=20).where("nh < 3").select("read_name", "flag", "mapq")


@_query("""select read_name from g_reads where ref_name = 'chr2' and pos <= 4000 and
    pos + list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDNX=]', 1), lambda x: x::bigint)) - 1 >= 1000""", ("g_reads",))
def read_region(spark, d):
    return reads.in_region(view(spark, d, "g_reads"), "chr2", 1000, 4000).select("read_name")


@_query("""select cast((rn - 1) // 1000 + 1 as bigint) as chunk, count(*) as n, min(rec_id) as first_rec, max(rec_id) as last_rec
    from (select rec_id, row_number() over (order by rec_id) as rn from g_sites) group by 1""", ("g_sites",))
def split_chunks(spark, d):
    chunked = combine.chunks(_records(spark, d), 1000)
    return chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_rec"), F.max("rec_id").alias("last_rec"))


@_query("select rec_id, replace(chrom, 'chr', '') as ensembl, chrom as ucsc, replace(chrom, 'chr', '') as canonical from g_sites", ("g_sites",))
def contig_names(spark, d):
    c = F.col("chrom")
    return view(spark, d, "g_sites").select("rec_id", C.to_ensembl(c).alias("ensembl"), C.to_ucsc(C.to_ensembl(c)).alias("ucsc"), C.canonical(c).alias("canonical"))


QUERIES.update(record_plans.QUERIES)
ORACLES.update(record_plans.ORACLES)
QUERIES.update(from_files.QUERIES)
ORACLES.update(from_files.ORACLES)
