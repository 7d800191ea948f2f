"""Queries through files: the views are written by the sinks, read by the sources, and then asked.

Files go to ``spark.checkpoint.dir`` where that is a local folder, as in a single process, else to a
temporary one; each is written once for a folder of tables, and deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions import sequence as S
from genoloom.functions import variant as V
from genoloom.operators import align, annotate, combine, export, filters, genotypes, headers, interval_sets, intervals, reads
from genoloom.operators.genotypes import Gate
from genoloom.sources import bed, fastx, files, sam, store, tab, targets, vcf
from genoloom.sources.vcf import Header, Vcf
from genoloom.streaming import variants as streaming

from . import records
from .views import sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_folders: dict[str, str] = {}
_written: dict[tuple[str, str, str], str] = {}
#: fixed by rule: what the made contigs repeat, and a contig's length
BASES, CONTIG = "ACGTTGCA", 3_000_000
CONTIGS = [f"chr{i}" for i in range(1, 6)]


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        if not base.startswith("/") and not local:
            raise ValueError("these queries write single files: spark.checkpoint.dir must be a folder that all executors mount")
        _folders[app] = tempfile.mkdtemp(prefix="genoloom-files-", dir=base if base.startswith("/") else None)
    return _folders[app]


@atexit.register
def _clean() -> None:
    for path in _folders.values():
        shutil.rmtree(path, ignore_errors=True)


def _file(spark: SparkSession, d: str, name: str, make: Callable[[str], object]) -> str:
    """The path of a file (or folder) of this name over the tables in ``d``, made once."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _written:
        path = f"{_folder(spark)}/{uuid.uuid4().hex[:8]}-{name}"
        make(path)
        _written[key] = path
    return _written[key]


def _query(oracle: str, *views: str, rec: bool = False):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = records._sql(oracle, *views) if rec else sql(oracle, *views)
        return f

    return keep


def _sorted_at() -> Column:
    """Places in the order of contigs and positions."""
    return F.shiftleft(F.substring("chrom", 4, 9).cast("long"), 40) + F.col("pos")


def _rec(spark: SparkSession, d: str) -> Vcf:
    """The records of ``records``, sorted."""
    v = records._vcf(spark, d)
    lines = [*v.header.lines, *[f"##contig=<ID={c},length={CONTIG}>" for c in CONTIGS]]
    return Vcf(Header(lines, v.header.samples), v.records.withColumn("rec_idx", _sorted_at()))


def _rec_file(spark: SparkSession, d: str) -> str:
    return _file(spark, d, "rec.vcf.gz", lambda path: vcf.write(_rec(spark, d), path, tbi=True))


def _geno(spark: SparkSession, d: str, test: Column | None = None, samples: int | None = None) -> Vcf:
    """All genotypes of the view as lines with one column per supplier, sorted, or for a benchmark the first ``samples``.

    A line is put together from what its site has and the dots between.
    """
    names = [f"S{r[0]}" for r in spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").orderBy("s_suppkey").collect()][:samples]
    nth = spark.createDataFrame(list(enumerate(names)), "nth int, sample_id string")
    entry = F.concat_ws(":", "gt", F.coalesce(F.col("dp").cast("string"), F.lit(".")))
    each = view(spark, d, "g_geno").join(F.broadcast(nth), "sample_id").groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("nth", entry.alias("v")))).alias("by"))
    sites = view(spark, d, "g_sites")
    rows = (sites.where(test) if test is not None else sites).join(each, "rec_id", "left").withColumn("rec_idx", _sorted_at()).orderBy("rec_idx")
    dots = "./.:."
    parts = F.transform("by", lambda e, i: F.concat(F.repeat(F.lit(f"{dots}\t"), e["nth"] - F.coalesce(F.get("by", i - 1)["nth"], F.lit(-1)) - 1), e["v"]))
    after = F.repeat(F.lit(f"\t{dots}"), len(names) - 1 - F.element_at("by", -1)["nth"])
    values = F.coalesce(F.concat(F.array_join(parts, "\t"), after), F.lit("\t".join([dots] * len(names))))
    text = lambda c: F.col(c).cast("string")
    depth = F.concat(F.lit("DP="), text("qual"))
    out = rows.select(
        "rec_idx", F.lit(0).alias("contig_idx"), "chrom", "pos", F.lit(".").alias("id"), "ref", F.array("alt").alias("alts"), F.col("qual").cast("double").alias("qual"), text("qual").alias("qual_raw"), F.split("filt", ",").alias("filters"),
        F.array(F.struct(F.lit("DP").alias("k"), text("qual").alias("v"))).alias("info"), F.array(F.lit("GT"), F.lit("DP")).alias("format_keys"), F.expr("cast(array() as array<array<string>>)").alias("samples"),
        F.concat_ws("\t", "chrom", text("pos"), F.lit("."), "ref", "alt", text("qual"), F.replace("filt", F.lit(","), F.lit(";")), depth, F.lit("GT:DP"), values).alias("raw"),
    )
    lines = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">', *[f"##contig=<ID={c},length={CONTIG}>" for c in CONTIGS]]
    return Vcf(Header(lines, names), out)


def _geno_file(spark: SparkSession, d: str) -> str:
    return _file(spark, d, "geno.vcf.gz", lambda path: vcf.write(_geno(spark, d), path, ordered=False))


def _halves(spark: SparkSession, d: str) -> list[str]:
    """The genotypes in two files, of the first two contigs and of the others."""
    first = F.col("chrom").isin("chr1", "chr2")
    return [_file(spark, d, f"half{n}.vcf.gz", lambda path, t=t: vcf.write(_geno(spark, d, t), path, ordered=False)) for n, t in enumerate((first, ~first))]


def _store(spark: SparkSession, d: str) -> store.Store:
    return store.open(spark, _file(spark, d, "store", lambda path: store.write(spark, [_geno_file(spark, d)], path, info_keys=["DP"], format_keys=["DP"])))


def _value(key: str) -> Column:
    return F.try_element_at(F.filter("info", lambda e: e["k"] == key), F.lit(1))["v"]


def _has(key: str) -> Column:
    return F.exists("info", lambda e: e["k"] == key)


# variant files


@_query("select chrom, pos, ref, alt, qual, filt, case when rec_idx % 2 = 0 then 1 else 0 end as db, concat(t_ad0, ',', t_ad1) as ad from rec", rec=True)
def vcf_scan(spark, d) -> DataFrame:
    v = vcf.read(spark, _rec_file(spark, d))
    return v.records.select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.col("qual").cast("int").alias("qual"), F.array_join("filters", ",").alias("filt"), _has("DB").cast("int").alias("db"), F.get(F.get("samples", F.lit(1)), F.lit(1)).alias("ad"))


@_query("select chrom, pos, ref from rec where chrom = 'chr2' and pos <= 15000 and pos + length(ref) - 1 >= 500", rec=True)
def vcf_region_scan(spark, d) -> DataFrame:
    return vcf.read(spark, _rec_file(spark, d), "chr2:500-15000").records.select("chrom", "pos", "ref")


@_query("select count(*) as variants, true as sorted, true as unsorted_found from rec", rec=True)
def vcf_checked(spark, d) -> DataFrame:
    v = vcf.read(spark, _rec_file(spark, d))

    def is_sorted(r: DataFrame) -> bool:
        try:
            combine.check_sorted(r, span=256)
        except ValueError:
            return False
        return True

    turned = v.records.withColumn("rec_idx", -F.col("rec_idx"))
    return spark.createDataFrame([(vcf.check(v), is_sorted(v.records), not is_sorted(turned))], "variants long, sorted boolean, unsorted_found boolean")


@_query("select chrom, pos, cast((rn - 1) // 700 as integer) as part from (select chrom, pos, row_number() over (order by chrom, pos) as rn from rec)", rec=True)
def vcf_series(spark, d) -> DataFrame:
    """Split into numbered files, found again by the first, and concatenated."""

    def split(base: str) -> None:
        v = vcf.read(spark, _rec_file(spark, d))
        vcf.write_series(Vcf(v.header, combine.chunks(v.records, 700)), base)

    first = f"{_file(spark, d, 'series', split)}.1.vcf.gz"
    series = vcf.read_series(spark, vcf.read_chunks(spark, first))
    return combine.in_order(series.records, series.header.contigs).select("chrom", "pos", "part")


@_query("select concat('S', s_suppkey) as sample, cast(row_number() over (order by s_suppkey) as integer) as nth from supplier")
def vcf_samples(spark, d) -> DataFrame:
    names = targets.read_samples(spark, _geno_file(spark, d))
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "sample string, nth int")


@_query("select 'chr' || i as id, '3000000' as what, 'contig' as kind from range(1, 6) t(i) union all select x, 'Depth', 'info' from (values ('DP')) t(x) union all select * from (values ('GT', 'Genotype', 'format'), ('DP', 'Depth', 'format')) t")
def vcf_header_info(spark, d) -> DataFrame:
    header = vcf.read_header(spark, _geno_file(spark, d))
    return spark.createDataFrame([(*r, kind) for kind in ("contig", "info", "format") for r in headers.header_info(header, kind)], "id string, what string, kind string")


@_query("select chrom, pos, concat(t_ad0, ',', t_ad1) as first_ad, concat(n_ad0, ',', n_ad1) as second_ad, 'TUMOR,N' as names from rec", rec=True)
def samples_reordered(spark, d) -> DataFrame:
    v = headers.rename_samples(headers.reorder(vcf.read(spark, _rec_file(spark, d)), ["T", "1"]), {"T": "TUMOR", "2": "N"})
    again = vcf.read(spark, _file(spark, d, "reordered.vcf", lambda path: vcf.write(v, path)))
    ad = lambda i: F.get(F.get("samples", F.lit(i)), F.lit(1))
    return again.records.select("chrom", "pos", ad(0).alias("first_ad"), ad(1).alias("second_ad"), F.lit(",".join(again.header.samples)).alias("names"))


@_query("""select rec_idx, concat_ws(',', case when filt <> 'PASS' then filt end, 'HET', 'HOM', case when rec_idx % 5 = 0 then 'INS_gt_2' end, case when rec_idx % 5 = 0 then 'INDEL' end,
    case when rec_idx % 2 = 0 then 'DB_present' else 'DB_missing' end, 'GQ_missing', case when qual = 30 then 'DP_eq_30_INFO' else 'DP_neq_30_INFO' end, case when cast(qual as varchar) like '%3%' then 'DP_contain_3_INFO' else 'DP_not_contain_3_INFO' end,
    case when qual in (10, 20) then 'DP_in_10,20_INFO' else 'DP_not_in_10,20_INFO' end) as codes from rec""", rec=True)
def filters_by_text(spark, d) -> DataFrame:
    text = [filters.compare(op, "DP", x, "INFO") for op, x in (("eq", "30"), ("neq", "30"), ("contain", "3"), ("not_contain", "3"), ("in", ["10", "20"]), ("not_in", ["10", "20"]))]
    chain = [filters.het(), filters.hom(), filters.max_insertion(2), filters.max_deletion(1), filters.indel(), filters.flag_present("DB"), filters.flag_missing("DB"), filters.value_missing("GQ"), *text]
    return filters.apply(records._vcf(spark, d).records, chain).select("rec_idx", F.array_join("filters", ",").alias("codes"))


@_query("""select rec_idx, coalesce(nullif(concat_ws(',', case when t_ad0 <= 5 then 'AD_lte_5.0_T_ref' end, case when t_ad1 > 9 then 'AD_gt_9.0_T_alt1' end, case when qual >= 40 then 'DP_gte_40.0_INFO' end), ''), 'PASS') as codes
    from rec where filt = 'PASS'""", rec=True)
def filters_by_number(spark, d) -> DataFrame:
    v = records._vcf(spark, d)
    chain = [filters.compare("lte", "AD", 5, "T", "ref", v.header.samples), filters.compare("gt", "AD", 9, "T", "alt1", v.header.samples), filters.compare("gte", "DP", 40, "INFO")]
    return filters.apply(v.records.where(filters.passes()), chain).select("rec_idx", F.array_join("filters", ",").alias("codes"))


@_query("select chrom, pos, ref, alt, 'indels' as only from rec where rec_idx % 5 = 0 union all select chrom, pos, ref, alt, 'snvs' from rec where rec_idx % 5 <> 0", rec=True)
def export_by_kind(spark, d) -> DataFrame:
    of = lambda only: export.export(records._vcf(spark, d), only=only)[1].toDF("chrom", "pos", "ref", "alt").withColumn("only", F.lit(only))
    return of("indels").unionByName(of("snvs"))


@_query("""select min(rec_idx) as rec_idx, chrom as chrom1, min(pos) as pos from (select *, row_number() over (partition by rec_idx // 2 order by rec_idx) as nth from rec) where nth = 1 group by chrom, rec_idx""", rec=True)
def pairs_of_unique_events(spark, d) -> DataFrame:
    v = records._vcf(spark, d)
    event = F.struct(F.lit("EVENT").alias("k"), F.floor(F.col("rec_idx") / 2).cast("string").alias("v"))
    number = F.struct(F.lit("N").alias("k"), F.col("rec_idx").cast("string").alias("v"))
    out = export.to_bedpe(Vcf(v.header, v.records.withColumn("info", F.concat("info", F.array(event, number)))), name="N", unique_event=True)
    return out.select(F.col("name").cast("long").alias("rec_idx"), "chrom1", F.col("stop1").alias("pos"))


_SEQ = f"(select repeat('{BASES}', {CONTIG // len(BASES)}) as seq)"


def _contig_rows(spark: SparkSession, d: str, beyond: int) -> DataFrame:
    """The made contigs, as long as the sites over the tables in ``d`` need with so many bases after the last."""
    last = view(spark, d, "g_sites").agg(F.max("pos")).first()[0] or 0
    seq = F.repeat(F.lit(BASES), max(CONTIG, last + beyond) // len(BASES) + 1)
    return spark.createDataFrame([(c,) for c in CONTIGS], "contig string").withColumn("seq", seq)


@_query(f"select rec_idx, case when rec_idx % 5 <> 0 then substring(repeat('{BASES}', 3), cast(pos - 3 as integer) % 8 + 1, 5) end as around from rec", rec=True)
def annotate_flanking(spark, d) -> DataFrame:
    path = _file(spark, d, "contigs.fa", lambda p: files.write_lines(p, fastx.fasta_text(_contig_rows(spark, d, 2).select(F.col("contig").alias("name"), "seq"), 60)))
    contigs = fastx.read_fasta(spark, path).select(F.col("name").alias("contig"), "seq")
    v = annotate.flanking(contigs, 2)(records._vcf(spark, d))
    return v.records.select("rec_idx", _value("CG_FLANKING").alias("around"))


_BND = "select rec_id, chrom, pos, 'chr' || cast(1 + (rec_id + 1) % 5 as varchar) as chrom2, pos + 4000 as pos2, rec_id % 4 as how from g_sites"
_ALT = "case how when 0 then 'N[' || chrom2 || ':' || pos2 || '[' when 1 then 'N]' || chrom2 || ':' || pos2 || ']' when 2 then ']' || chrom2 || ':' || pos2 || ']N' else '[' || chrom2 || ':' || pos2 || '[N' end"


def _breakends(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "g_sites").select("rec_id", "chrom", "pos", F.concat(F.lit("chr"), (1 + (F.col("rec_id") + 1) % 5).cast("string")).alias("chrom2"), (F.col("pos") + 4000).alias("pos2"), (F.col("rec_id") % 4).alias("how"))
    mate = F.concat_ws(":", "chrom2", F.col("pos2").cast("string"))
    forms = [("N[", "["), ("N]", "]"), ("]", "]N"), ("[", "[N")]
    alt = F.element_at(F.array(*[F.concat(F.lit(a), mate, F.lit(z)) for a, z in forms]), F.col("how") + 1)
    return b.withColumn("alt", alt)


@_query(f"select rec_id, {_ALT} as alt, chrom2 as mate_chrom, cast(pos2 as integer) as mate_pos, case how when 0 then '3to5' when 1 then '3to3' when 2 then '5to3' else '5to5' end as connection, 'BND' as kind from ({_BND})", "g_sites")
def breakend_mates(spark, d) -> DataFrame:
    alt = F.col("alt")
    return _breakends(spark, d).select("rec_id", "alt", V.breakend_chrom(alt).alias("mate_chrom"), V.breakend_pos(alt).alias("mate_pos"), V.connection(alt).alias("connection"), V.kind(F.lit("N"), alt, F.lit(None).cast("string")).alias("kind"))


_AROUND = "substring(seq, {} % 8 + 1, 20)"
_TURNED = "reverse(translate({}, 'ACGT', 'TGCA'))"
_A0, _A1, _B0, _B1 = (_AROUND.format(x) for x in ("(pos - 20)", "pos", "(pos2 - 20)", "pos2"))


@_query(f"""select 'sv|' || chrom || '|' || pos || '|' || chrom2 || '|' || pos2 || '|b' || rec_id || '|BND|' || case how when 0 then '3to5' when 1 then '3to3' when 2 then '5to3' else '5to5' end as name,
    case how when 0 then {_A0} || {_B1} when 1 then {_A0} || {_TURNED.format(_B0)} when 2 then {_B0} || {_A1} else {_TURNED.format(_B1)} || {_A1} end as seq
    from ({_BND}), (select repeat('{BASES}', 9) as seq)""", "g_sites")
def breakends_to_sequences(spark, d) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    entry = F.array(F.struct(F.lit("SVTYPE").alias("k"), F.lit("BND").alias("v")))
    rows = _breakends(spark, d).select(
        F.col("rec_id").cast("long").alias("rec_idx"), "chrom", "pos", F.concat(F.lit("b"), F.col("rec_id").cast("string")).alias("id"), F.lit("N").alias("ref"), F.array("alt").alias("alts"), F.array(F.lit("PASS")).alias("filters"), entry.alias("info"), none.alias("format_keys"), F.expr("cast(array() as array<array<string>>)").alias("samples")
    )
    return export.sv_to_fasta(Vcf(Header(), rows), _contig_rows(spark, d, 4020), flanking=20)


@_query("""select rec_id, cast(greatest(pos + length(ref) - 1, case when rec_id % 3 = 0 then pos + 50 else 0 end, case when rec_id % 3 = 1 then pos + 30 else 0 end, case when rec_id % 3 = 2 then pos + 9 else 0 end) as integer) as last,
    rec_id % 2 = 0 as is_block from g_sites""", "g_sites")
def reference_ends(spark, d) -> DataFrame:
    """END, SVLEN and a block's LEN, and alleles that stand for a block."""
    s = view(spark, d, "g_sites")
    third = lambda n, v: F.when(F.col("rec_id") % 3 == n, v)
    last = V.ref_end(F.col("pos"), F.col("ref"), third(0, F.col("pos") + 50), third(1, F.lit(-30)), third(2, F.lit(10)))
    alt = F.when(F.col("rec_id") % 2 == 0, F.when(F.col("rec_id") % 4 == 0, "<NON_REF>").otherwise("<*>")).otherwise(F.col("alt"))
    return s.select("rec_id", last.alias("last"), V.is_block_allele(alt).alias("is_block"))


# annotation from files


@_query("select rec_idx, case when filt = 'PASS' then cast(qual as varchar) end as other, filt = 'PASS' as known from rec", rec=True)
def annotate_from_variants(spark, d) -> DataFrame:
    source = vcf.read(spark, _rec_file(spark, d))
    steps = [annotate.from_vcf("OTHER", source, "DP", passing=True), annotate.from_vcf("KNOWN", source, None, passing=True, unique=True)]
    v = annotate.chain(records._vcf(spark, d), steps)
    return v.records.select("rec_idx", _value("OTHER").alias("other"), _has("KNOWN").alias("known"))


@_query("""select r.rec_idx, string_agg(distinct b.name, ',' order by b.name) as ids, string_agg(distinct b.strand, ',' order by b.strand) as strands,
    case when count(b.name) = 0 then null when count(*) filter (where b.start_pos % 3 = 0) > 0 then 'CODING' else 'NONCODING' end as region from rec r
    left join g_bed_b b on b.chrom = r.chrom and r.pos - 1 < b.end_pos and r.pos + length(r.ref) - 1 > b.start_pos group by r.rec_idx""", "g_bed_b", rec=True)
def annotate_genes(spark, d) -> DataFrame:
    def write(path: str) -> None:
        kind = F.when(F.col("start_pos") % 3 == 0, "CDS").otherwise("exon")
        notes = F.format_string('gene_id "%s"; gene_name "G%s"; gene_biotype "x"; tag "basic";', "name", "name")
        line = F.concat_ws("\t", "chrom", F.lit("made"), kind, (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), notes)
        files.write_lines(path, (r["l"] for r in view(spark, d, "g_bed_b").select(line.alias("l")).toLocalIterator()))

    from genoloom.cli import _gtf

    v = annotate.genes(_gtf(spark, _file(spark, d, "genes.gtf", write)), "X_", ("basic",))(records._vcf(spark, d))
    return v.records.select("rec_idx", _value("X_GENEID").alias("ids"), _value("X_STRAND").alias("strands"), _value("X_REGION").alias("region"))


@_query("""select r.rec_idx, string_agg(distinct b.name, ',' order by b.name) as names, count(b.name) > 0 as inside from rec r left join g_bed_b b on b.chrom = r.chrom
    and r.pos + 99 < b.end_pos and r.pos + 100 > b.start_pos group by r.rec_idx""", "g_bed_b", rec=True)
def annotate_at_other_positions(spark, d) -> DataFrame:
    """Regions of a BED file at a position that an INFO value gives."""
    regions = tab.read(spark, _bed_file(spark, d, "g_bed_b"), tab.PRESETS["bed"]).withColumnRenamed("c4", "name")
    v = records._vcf(spark, d)
    moved = v.records.withColumn("info", F.concat("info", F.array(F.struct(F.lit("AT").alias("k"), (F.col("pos") + 100).cast("string").alias("v")))))
    v = annotate.chain(annotate.at_coordinates(Vcf(v.header, moved), pos="AT"), [annotate.bed("NAMES", regions), annotate.bed("INSIDE", regions, flag=True)])
    names = F.array_join(F.array_sort(F.split(_value("NAMES"), ",")), ",")
    return v.records.select("rec_idx", names.alias("names"), _has("INSIDE").alias("inside"))


@_query("select r.rec_idx, r.qual in (select n_nationkey from nation) as listed from rec r", rec=True)
def annotate_listed(spark, d) -> DataFrame:
    def write(path: str) -> None:
        files.write_lines(path, ["# keys of nations", *(str(r[0]) for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect())])

    v = annotate.in_file("LISTED", "DP", targets.values(spark, _file(spark, d, "keys.txt", write)).select("c1"))(records._vcf(spark, d))
    return v.records.select("rec_idx", _has("LISTED").alias("listed"))


# intervals, sequences, reads, tables


def _six(spark: SparkSession, d: str, name: str) -> DataFrame:
    score = F.length("name") + 0.5
    return view(spark, d, name).select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "name", score.alias("score"), "strand")


def _bed_file(spark: SparkSession, d: str, name: str) -> str:
    return _file(spark, d, f"{name}.bed", lambda path: bed.write(_six(spark, d, name), path))


@_query("select chrom, start_pos, end_pos, name, length(name) as score, strand, length(name) + 0.5::double as raw_score from g_bed_a", "g_bed_a")
def bed_scan(spark, d) -> DataFrame:
    b = bed.read(spark, _bed_file(spark, d, "g_bed_a"))
    return intervals.clean(b.withColumn("raw_score", F.col("score"))).select("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "name", F.col("score").cast("long").alias("score"), "strand", "raw_score")


_UNION = """, ends as (select chrom, strand, start_pos as p, 1 as a from g_bed_a union all select chrom, strand, end_pos, -1 from g_bed_a union all select chrom, strand, start_pos, 1 from g_bed_b union all select chrom, strand, end_pos, -1 from g_bed_b),
    steps as (select chrom, strand, p, sum(a) as a from ends group by all), segs as (select chrom, strand, p as s, lead(p) over w as e, sum(a) over w as n from steps window w as (partition by chrom, strand order by p)),
    kept as (select *, case when s > lag(e) over (partition by chrom, strand order by s) then 1 else 0 end as fresh from segs where e is not null and n > 0), isl as (select *, sum(fresh) over (partition by chrom, strand order by s) as i from kept),
    u as (select chrom, strand, cast(min(s) as integer) as start_pos, cast(max(e) as integer) as end_pos from isl group by chrom, strand, i),
    x as (select 0 as n, * from g_bed_a union all select 1, * from g_bed_b)
    select u.chrom, u.start_pos, u.end_pos, u.strand, string_agg(x.name, '|' order by x.n, x.start_pos, x.end_pos, x.name) as name, cast(count(*) as double) as score from u
    join x on x.chrom = u.chrom and x.strand = u.strand and x.start_pos < u.end_pos and x.end_pos > u.start_pos group by all"""


@_query(_UNION, "g_bed_a", "g_bed_b")
def bed_union_named(spark, d) -> DataFrame:
    a, b = (bed.read(spark, _bed_file(spark, d, n)) for n in ("g_bed_a", "g_bed_b"))
    out = interval_sets.decorate(interval_sets.combine(a, b, "union", True), a, b, True, score="count")
    return out.select("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", "name", "score")


@_query("select cast(doc_id as varchar) as name, 'made of ' || length(seq) as comment, md5(seq) as digest, cast(length(seq) as bigint) as n from g_seq", "g_seq")
def fasta_scan(spark, d) -> DataFrame:
    rows = view(spark, d, "g_seq").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("made of "), F.length("seq").cast("string")).alias("comment"), "seq")
    path = _file(spark, d, "seqs.fa", lambda p: files.write_lines(p, fastx.fasta_text(rows, 60)))
    return fastx.read_fasta(spark, path).select("name", "comment", F.md5("seq").alias("digest"), F.length("seq").cast("long").alias("n"))


@_query("select cast(doc_id as varchar) as name, 'x' || chr(9) || 'BC:Z:AC' as comment, md5(seq) as digest, cast(length(seq) as bigint) as n from g_seq", "g_seq")
def fastq_scan(spark, d) -> DataFrame:
    rows = view(spark, d, "g_seq").select(F.col("doc_id").cast("string").alias("name"), F.lit("x").alias("comment"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    path = _file(spark, d, "seqs.fastq", lambda p: files.write_lines(p, fastx.fastq_text(rows)))
    return fastx.tag(fastx.read_fastq(spark, path), "BC:Z:AC").select("name", "comment", F.md5("seq").alias("digest"), F.length("qual").cast("long").alias("n"))


_READ_SEQ = "substring('ACGTTGCAACCGTTAG', cast(1 + pos % 7 as int), 10)"


def _sam_file(spark: SparkSession, d: str) -> str:
    def write(path: str) -> None:
        line = F.concat_ws("\t", "read_name", F.col("flag").cast("string"), "ref_name", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.expr(_READ_SEQ), F.lit("ABCDEFGHIJ"), F.format_string("NH:i:%d", "nh"), F.format_string("RG:Z:g%d", F.col("nh") % 2))
        head = ["@HD\tVN:1.6", *[f"@SQ\tSN:{c}\tLN:{CONTIG}" for c in CONTIGS]]
        files.write_table(view(spark, d, "g_reads").select(line.alias("l")), path, head)

    return _file(spark, d, "reads.sam", write)


_SAM_SQL = f"select read_name, flag, ref_name, pos, mapq, cigar, {_READ_SEQ} as seq, cast(nh as varchar) as nh from g_reads"


@_query(_SAM_SQL, "g_reads")
def sam_scan(spark, d) -> DataFrame:
    _, r = sam.read(spark, _sam_file(spark, d))
    return reads.export(r, ["read_name", "flag", "ref_name", "pos", "mapq", "cigar", "seq"], ["NH"]).withColumnRenamed("NH", "nh")


@_query(_SAM_SQL, "g_reads")
def bam_scan(spark, d) -> DataFrame:
    path = _file(spark, d, "reads.bam", lambda p: sam.write(*sam.read(spark, _sam_file(spark, d)), p, ordered=False))
    return reads.export(sam.read(spark, path)[1], ["read_name", "flag", "ref_name", "pos", "mapq", "cigar", "seq"], ["NH"]).withColumnRenamed("NH", "nh")


@_query("select read_name, nh from g_reads where nh < 3 and nh <> 1 and nh % 2 = 0", "g_reads")
def sam_tag_filter(spark, d) -> DataFrame:
    groups = _file(spark, d, "groups.txt", lambda p: files.write_lines(p, ["g0"]))
    _, r = sam.read(spark, _sam_file(spark, d))
    kept = reads.select_reads(r, tags=[("lt", "NH", "3"), ("not-eq", "NH", "1")])
    return reads.tag_in(kept, "RG", targets.values(spark, groups).select("c1")).select("read_name", reads.tag("NH").cast("int").alias("nh"))


@_query(f"""select read_name as name, 'RG:Z:g' || nh % 2 as comment, case when (flag & 16) <> 0 then reverse(translate({_READ_SEQ}, 'ACGT', 'TGCA')) else {_READ_SEQ} end as seq,
    case when (flag & 16) <> 0 then 'JIHGFEDCBA' else 'ABCDEFGHIJ' end as qual from g_reads""", "g_reads")
def sam_to_sequences(spark, d) -> DataFrame:
    return reads.to_sequences(sam.read(spark, _sam_file(spark, d))[1], ["RG"])


@_query("select name, row_number() over (order by chrom, start_pos, end_pos, cast(substring(name, 2) as bigint)) as nth from g_bed_a", "g_bed_a")
def tab_sort(spark, d) -> DataFrame:
    def write(path: str) -> None:
        rows = view(spark, d, "g_bed_a").orderBy(F.substring("name", 2, 20).cast("long")).select(F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "name").alias("l"))
        plain = f"{path}.in"
        files.write_lines(plain, (r["l"] for r in rows.toLocalIterator()))
        tab.write_sorted(spark, plain, path, tab.PRESETS["bed"])

    rows = tab.read(spark, _file(spark, d, "sorted.bed.gz", write), tab.PRESETS["bed"])
    return rows.select(F.col("c4").alias("name"), (F.col("rec_idx") + 1).alias("nth"))


@_query("select chrom, pos, ref, alt from g_sites where filt <> 'PASS'", "g_sites")
def target_file(spark, d) -> DataFrame:
    return _panel(spark, d).frames(spark)[0]


def _panel(spark: SparkSession, d: str) -> targets.Targets:
    """The loci that a filter marks, from a file of sites."""

    def write(path: str) -> None:
        rows = view(spark, d, "g_sites").where("filt <> 'PASS'").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", "alt").alias("l"))
        files.write_lines(path, (r["l"] for r in rows.toLocalIterator()))

    return targets.read(spark, _file(spark, d, "panel.txt", write))


# the genotype store

_AC = "case when gt in ('0/1', '1|0', '0|1') then 1 when gt = '1/1' then 2 else 0 end"
_CALLED = "gt <> './.' and coalesce(dp >= 10, false)"
_CALLS = f"select chrom, pos, ref, alt, sample_id, gt, dp from g_geno where {_AC} > 0"


def _calls(rows: DataFrame) -> DataFrame:
    return rows.select("chrom", "pos", "ref", "alt", "sample_id", "gt", "dp")


@_query(f"select chrom, pos, ref, alt, sample_id, gt, dp, dp as format_dp from g_geno where {_AC} > 0", "g_geno")
def store_calls(spark, d) -> DataFrame:
    return _store(spark, d).calls.select("chrom", "pos", "ref", "alt", "sample_id", "gt", "dp", "format_dp")


@_query(f"""select s.chrom, s.pos, s.ref, s.alt, cast(coalesce(sum({_AC}), 0) as bigint) as ac, cast(coalesce(sum(case when gt <> './.' then 2 else 0 end), 0) as bigint) as an, count(*) filter (where {_AC} > 0) as n_carriers,
    count(*) filter (where {_CALLED}) as n_called, (select count(*) from supplier) - count(*) filter (where {_CALLED}) as n_lowdp, any_value(s.qual) as info_dp from g_sites s left join g_geno g using (rec_id) group by s.rec_id, s.chrom, s.pos, s.ref, s.alt""", "g_sites", "g_geno")
def store_sites(spark, d) -> DataFrame:
    return _store(spark, d).sites.select("chrom", "pos", "ref", "alt", "ac", "an", "n_carriers", "n_called", "n_lowdp", "info_dp")


@_query(f"""select sample_id, chrom, min(pos) as start_pos, max(pos) as end_pos, cast(count(*) as integer) as n_sites, min(dp) as min_dp from (
    select *, rec_no - row_number() over (partition by sample_id, chrom, band order by rec_no) as island from (
    select g.*, r.rec_no, (dp >= 10)::int + (dp >= 20)::int + (dp >= 50)::int as band from g_geno g
    join (select rec_id, row_number() over (partition by chrom order by pos) as rec_no from g_sites) r using (rec_id) where {_CALLED})) group by sample_id, chrom, band, island""", "g_sites", "g_geno")
def store_runs(spark, d) -> DataFrame:
    return _store(spark, d).regions.select("sample_id", "chrom", "start_pos", "end_pos", "n_sites", "min_dp")


@_query("select chrom, count(*) as sites, min(pos) as first_pos, max(pos) as last_pos, (select count(*) from supplier) as samples from g_sites group by chrom", "g_sites")
def chromosome_census(spark, d) -> DataFrame:
    """From the manifest of the store."""
    _store(spark, d)
    said = store.summary(spark, _written[spark.sparkContext.applicationId, d, "store"])
    return spark.createDataFrame([(c, n, lo, hi, len(said["samples"])) for c, (n, lo, hi) in said["census"].items()], "chrom string, sites long, first_pos int, last_pos int, samples long")


@_query(f"{_CALLS} and ((chrom = 'chr2' and pos between 500 and 15000) or (chrom = 'chr4' and pos = 230) or chrom = 'chr5')", "g_geno")
def store_query_spans(spark, d) -> DataFrame:
    return _calls(_store(spark, d).query(targets.parse(["2:500-15000", "chr4:230", "chr5"])))


@_query(f"{_CALLS} and rec_id in (select rec_id from g_sites where filt <> 'PASS' or (chrom = 'chr3' and pos between 1000 and 9000)) and coalesce(dp >= 20, true)", "g_sites", "g_geno")
def store_query_panel(spark, d) -> DataFrame:
    """More loci than literal predicates hold, a span that holds some of them, and a gate."""
    t = targets.Targets(_panel(spark, d).loci, targets.parse(["chr3:1000-9000"]).spans)
    return _calls(_store(spark, d).query(t, gate=Gate(min_dp=20)))


@_query(f"select chrom, pos, ref, alt, sample_id, gt from g_geno where sample_id in ('S1', 'S3', 'S7') and ({_AC} > 0 or (gt = '0/0' and {_CALLED}))", "g_geno")
def store_hom_ref(spark, d) -> DataFrame:
    return _store(spark, d).query(samples=["S1", "S3", "S7"], hom_ref=True).select("chrom", "pos", "ref", "alt", "sample_id", "gt")


_STATES = f"""select s.chrom, s.pos, s.ref, s.alt, x.sample_id, case when {_AC} > 0 then case when coalesce(dp >= 20, true) then 'carrier' else 'below_gate' end
    when gt = '0/0' and {_CALLED} then 'non_carrier' else 'not_assayed' end as state
    from (select * from g_sites where filt <> 'PASS') s cross join (select concat('S', s_suppkey) as sample_id from supplier) x left join g_geno g on g.rec_id = s.rec_id and g.sample_id = x.sample_id"""


@_query(_STATES, "g_sites", "g_geno")
def store_states(spark, d) -> DataFrame:
    return _store(spark, d).classify(_panel(spark, d), Gate(min_dp=20))


@_query(f"""select chrom, pos, ref, alt, cast(sum({_AC}) as bigint) as ac, cast(sum(case when gt <> './.' and ({_AC} > 0 or dp >= 10) then 2 else 0 end) as bigint) as an,
    coalesce(max(gt) filter (where sample_id = 'S2' and ({_AC} > 0 or ({_CALLED}))), './.') || ',' || coalesce(max(gt) filter (where sample_id = 'S5' and ({_AC} > 0 or ({_CALLED}))), './.') as gts
    from g_geno where sample_id in ('S2', 'S5') and ({_AC} > 0 or ({_CALLED})) group by all""", "g_geno")
def store_matrix(spark, d) -> DataFrame:
    return _store(spark, d).matrix(samples=["S2", "S5"]).select("chrom", "pos", "ref", "alt", "ac", "an", F.array_join("gts", ",").alias("gts"))


@_query(_CALLS, "g_geno")
def store_of_two_inputs(spark, d) -> DataFrame:
    path = _file(spark, d, "store2", lambda p: store.write(spark, _halves(spark, d), p, shard_sites=100))
    return _calls(store.open(spark, path).query())


@_query(_CALLS, "g_geno")
def store_of_two_volumes(spark, d) -> DataFrame:
    def write(path: str) -> None:
        for n, half in enumerate(_halves(spark, d)):
            store.write(spark, [half], f"{path}/v{n}", codec="snappy")
        store.create_volumes(spark, path)

    return _calls(store.open(spark, _file(spark, d, "volumes", write)).query())


@_query(f"{_CALLS} and chrom = 'chr1' and pos <= 20000", "g_geno")
def store_over_a_vcf(spark, d) -> DataFrame:
    return _calls(store.open(spark, _geno_file(spark, d)).query(targets.parse(["chr1:1-20000"])))


@_query("select count(*) as calls, false as overwritten, true as forced from g_geno where gt not in ('0/0', './.') and chrom in ('chr1', 'chr2')", "g_geno")
def store_guarded(spark, d) -> DataFrame:
    """A store is written once; again only by force."""

    def write(path: str) -> None:
        store.write(spark, _halves(spark, d)[:1], path)

    path = _file(spark, d, "guarded", write)
    try:
        write(path)
        overwritten = True
    except ValueError:
        overwritten = False
    store.write(spark, _halves(spark, d)[:1], path, force=True)
    return spark.createDataFrame([(store.open(spark, path).calls.count(), overwritten, True)], "calls long, overwritten boolean, forced boolean")


# streams and alignments


@_query("select chrom, count(*) as records, count(*) filter (where filt = 'PASS') as passing, min(pos) as first_pos, max(pos) as last_pos from rec group by chrom", rec=True)
def streamed_counts(spark, d) -> DataFrame:
    """Two files come into a folder; the running totals after both."""

    def write(folder: str) -> None:
        import os

        os.makedirs(f"{folder}/in")
        v = vcf.read(spark, _rec_file(spark, d))
        for n in range(2):
            vcf.write(Vcf(v.header, v.records.where(F.col("pos") % 20 == 10 * n)), f"{folder}/in/{n}.vcf")
        totals = streaming.counts_by_contig(streaming.read(spark, f"{folder}/in", CONTIGS, files_per_trigger=1))
        query = totals.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
        query.awaitTermination()

    return spark.read.parquet(f"{_file(spark, d, 'stream', write)}/out")


@_query("select doc_id, 30::double as score, substring(seq, 11, 30) as aligned from g_seq where length(seq) >= 60", "g_seq")
def pairwise_alignments(spark, d) -> DataFrame:
    """A part of a sequence is found again in it, whole."""
    pairs = view(spark, d, "g_seq").where(F.length("seq") >= 60).select("doc_id", F.substring("seq", 11, 30).alias("query"), F.substring("seq", 1, 60).alias("target"))
    return align.align_pairs(pairs).select("doc_id", F.col("score").cast("double").alias("score"), F.when(F.col("reverse"), S.reverse_complement(F.col("query_row"))).otherwise(F.col("query_row")).alias("aligned"))
