"""Queries of genotypes: carriers, reference calls, states, counts and matrices.

``calls`` hold one row per sample and alternate allele it carries: sample_id, chrom, pos, ref, alt,
ref_end, gt, dp, ad_ref, ad_alt, gq and, of reference blocks, min_dp. ``sites`` hold one row per
allele; ``runs`` the callable runs of samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import genotype as G

from .range_join import overlap_join

LOCUS = ["chrom", "pos", "ref", "alt"]


@dataclass(frozen=True)
class Gate:
    """Bounds a call must meet; a value that is missing passes."""

    min_dp: int | None = None
    min_ad_alt: int | None = None
    min_ab_het: float | None = None
    max_ref_frac_hom: float | None = None

    def test(self, gt: str = "gt", dp: str = "dp", ad_ref: str = "ad_ref", ad_alt: str = "ad_alt", min_dp: Column | None = None) -> Column:
        """Whether a row passes."""
        tests = [F.lit(True)]
        fails_open = lambda c: F.coalesce(c, F.lit(True))
        total = F.col(ad_ref) + F.col(ad_alt) if None not in (ad_ref, ad_alt) else None
        if self.min_dp is not None:
            tests.append(fails_open((F.coalesce(min_dp, F.col(dp)) if min_dp is not None else F.col(dp)) >= self.min_dp))
        if self.min_ad_alt is not None:
            tests.append(fails_open(F.col(ad_alt) >= self.min_ad_alt))
        if self.min_ab_het is not None:
            tests.append(~G.is_het(F.col(gt)) | fails_open(F.try_divide(F.col(ad_alt), total) >= self.min_ab_het))
        if self.max_ref_frac_hom is not None:
            tests.append(~G.is_hom_alt(F.col(gt)) | fails_open(F.try_divide(F.col(ad_ref), total) <= self.max_ref_frac_hom))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def split_alleles(records: DataFrame) -> DataFrame:
    """One row per record and allele: (…, allele, alt) of records with ``alts``; block alleles go."""
    return records.select("*", F.posexplode("alts").alias("__at", "alt")).withColumn("allele", F.col("__at") + 1).drop("__at").where(~F.col("alt").isin("<NON_REF>", "<*>", ".", "*"))


def site_counts(genotypes: DataFrame, min_dp: int = 10, keys: list[str] | None = None) -> DataFrame:
    """AC, AN, AF and sample counts of each allele of (keys, allele, gt, dp).

    AC and AN come from all called alleles, whatever their depth; called and low depth split the
    samples by ``min_dp``.
    """
    keys = keys or ["chrom", "pos", "ref", "alt"]
    gt, allele = F.col("gt"), F.col("allele")
    seen = G.has_call(gt) & F.coalesce(F.col("dp") >= min_dp, F.lit(False))
    return genotypes.groupBy(*keys).agg(
        F.sum(G.allele_count(gt, allele)).alias("ac"),
        F.sum(F.size(G.called(gt))).alias("an"),
        F.count_if(G.allele_count(gt, allele) > 0).alias("n_carriers"),
        F.count_if(seen).alias("n_called"),
        F.count_if(~seen).alias("n_lowdp"),
    )


def lookup_loci(calls: DataFrame, loci: DataFrame) -> DataFrame:
    """Calls at exact loci, each once; a panel of any size is one join."""
    return calls.join(loci.select(*LOCUS).distinct(), LOCUS, "left_semi")


def lookup_spans(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """Calls that overlap half-open spans (chrom, start, end), each once."""
    wanted = spans.select(F.col("chrom").alias("__c"), F.col("start").alias("__s0"), F.col("end").alias("__e0"))
    held = calls.withColumn("__p0", F.col("pos") - 1)
    return overlap_join(held, wanted, ("chrom", "__p0", "ref_end"), ("__c", "__s0", "__e0"), "left_semi").drop("__p0")


def lookup_samples(calls: DataFrame, samples: list[str] | DataFrame) -> DataFrame:
    """Calls of some samples."""
    if isinstance(samples, DataFrame):
        return calls.join(samples, "sample_id", "left_semi")
    return calls.where(F.col("sample_id").isin(list(samples)))


def hom_ref(sites: DataFrame, runs: DataFrame, calls: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, sample_id, gt) of samples that are observed as reference at a site.

    A sample is, where one of its runs covers the site and it carries no alternate of the same
    record (chrom, pos, ref).
    """
    points = sites.select(*LOCUS, F.col("pos").alias("__s"), (F.col("pos") + 1).alias("__e"))
    spans = runs.select(F.col("chrom").alias("__c"), F.col("start_pos").alias("__rs"), (F.col("end_pos") + 1).alias("__re"), "sample_id")
    covered = overlap_join(points, spans, ("chrom", "__s", "__e"), ("__c", "__rs", "__re")).select(*LOCUS, "sample_id").distinct()
    carried = calls.select("sample_id", "chrom", "pos", "ref").distinct()
    return covered.join(carried, ["sample_id", "chrom", "pos", "ref"], "left_anti").withColumn("gt", F.lit("0/0")).select(*LOCUS, "sample_id", "gt")


def classify(loci: DataFrame, samples: DataFrame, sites: DataFrame, runs: DataFrame, calls: DataFrame, gate: Gate | None = None) -> DataFrame:
    """(locus, sample_id, state): carrier, below_gate, non_carrier or not_assayed.

    Every locus meets every sample of the roster: the answer has that many rows by definition. Off
    the catalogue nothing was assayed.
    """
    wanted = loci.select(*LOCUS).distinct()
    roster = [r[0] for r in samples.select("sample_id").distinct().collect()]
    names = F.split(F.lit("\x1f".join(roster)), "\x1f") if roster else F.expr("cast(array() as array<string>)")
    passes = gate.test() if gate else F.lit(True)
    carried = calls.join(wanted, LOCUS, "left_semi").select(*LOCUS, "sample_id", F.when(passes, 0).otherwise(1).alias("rank"))
    points = sites.join(wanted, LOCUS, "left_semi").select(*LOCUS, F.col("pos").alias("__s"), (F.col("pos") + 1).alias("__e"))
    spans = runs.select(F.col("chrom").alias("__c"), F.col("start_pos").alias("__rs"), (F.col("end_pos") + 1).alias("__re"), "sample_id")
    covered = overlap_join(points, spans, ("chrom", "__s", "__e"), ("__c", "__rs", "__re")).select(*LOCUS, "sample_id", F.lit(2).alias("rank"))
    # what is known of a locus meets it as one list; the rest of the roster is added where the rows are made
    known = carried.unionByName(covered).groupBy(*LOCUS, "sample_id").agg(F.min("rank").alias("rank"))
    listed = known.groupBy(*LOCUS).agg(F.collect_list(F.struct("sample_id", "rank")).alias("known"))
    told = wanted.join(listed, LOCUS, "left").withColumn("known", F.filter(F.coalesce("known", F.array().cast("array<struct<sample_id:string,rank:int>>")), lambda k: F.array_contains(names, k["sample_id"])))
    told = told.select(*LOCUS, F.col("known.rank").alias("ranks"), F.concat("known.sample_id", F.array_except(names, "known.sample_id")).alias("every"))
    rank = F.get("ranks", F.col("__nth"))
    state = F.when(rank == 0, "carrier").when(rank == 1, "below_gate").when(rank == 2, "non_carrier").otherwise("not_assayed")
    return told.select(*LOCUS, "ranks", F.posexplode("every").alias("__nth", "sample_id")).select(*LOCUS, "sample_id", state.alias("state"))


def tally(calls: DataFrame) -> DataFrame:
    """Alternate and reference calls of each locus."""
    alt = F.exists(G.called(F.col("gt")), lambda a: a != 0)
    return calls.groupBy(*LOCUS).agg(F.count_if(alt).alias("alt_calls"), F.count_if(~alt).alias("ref_calls"))


def matrix(calls: DataFrame, samples: list[str]) -> DataFrame:
    """One row per locus: AC, AN, AF, NS and nhomalt over the samples, and ``gts`` in their order."""
    gt = F.col("gt")
    counted = calls.where(F.col("sample_id").isin(samples)).groupBy(*LOCUS).agg(
        F.sum(F.coalesce(G.dosage(gt), F.lit(0))).alias("ac"),
        F.sum(F.size(G.called(gt))).alias("an"),
        F.count_if(G.has_call(gt)).alias("ns"),
        F.count_if(G.is_hom_alt(gt)).alias("nhomalt"),
        F.map_from_entries(F.collect_list(F.struct("sample_id", "gt"))).alias("__gts"),
    )
    columns = F.array(*[F.coalesce(F.try_element_at("__gts", F.lit(s)), F.lit("./.")) for s in samples])
    return counted.select(*LOCUS, "ac", "an", F.try_divide("ac", "an").alias("af"), "ns", "nhomalt", columns.alias("gts"))


def genotype_counts(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(site_idx, chrom, pos, ref, alt, gt, count) for sites in their order, each probed on its position.

    ``sites`` has site_idx, chrom, pos and, or null, ref and alt; ``genotypes`` chrom, pos, ref,
    alts, gt. A site without a record gives one row of ``.`` and count 0.
    """
    g = genotypes.select(F.col("chrom").alias("__c"), F.col("pos").alias("__p"), F.col("ref").alias("__r"), F.col("alts").alias("__a"), G.canonical(F.col("gt")).alias("__gt"))
    on = (F.col("chrom") == F.col("__c")) & (F.col("pos") == F.col("__p")) & (F.col("ref").isNull() | (F.col("ref") == F.col("__r"))) & (F.col("alt").isNull() | F.array_contains("__a", F.col("alt")))
    found = sites.join(g, on, "left")
    shown = {"ref": F.coalesce("ref", "__r", F.lit(".")), "alt": F.coalesce("alt", F.array_join("__a", ","), F.lit("."))}
    return found.select("site_idx", "chrom", "pos", *[v.alias(k) for k, v in shown.items()], F.coalesce("__gt", F.lit(".")).alias("gt"), F.col("__gt").isNotNull().alias("__hit")).groupBy("site_idx", "chrom", "pos", "ref", "alt", "gt").agg(F.count_if("__hit").alias("count"))


def in_class_order(counts: DataFrame) -> DataFrame:
    """Genotype counts in the order of sites and of classes."""
    return counts.orderBy("site_idx", G.class_order(F.col("gt")))


def nearest_variant(records: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(chrom, pos, rec_id, …) with vardist, the distance to the nearest other record; null if alone.

    Records are compared within ranges of positions; what lies beyond a range is known from the
    last position before it and the first after it, so no task orders a whole chromosome.
    """
    ranged = records.withColumn("__range", F.floor(F.col("pos") / span))
    ends = ranged.groupBy("chrom", "__range").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = Window.partitionBy("chrom").orderBy("__range")
    ends = ends.select("chrom", "__range", F.lag("hi").over(w).alias("__before"), F.lead("lo").over(w).alias("__after"))
    order = Window.partitionBy("chrom", "__range").orderBy("pos", "rec_id")
    before, after = F.coalesce(F.lag("pos").over(order), F.col("__before")), F.coalesce(F.lead("pos").over(order), F.col("__after"))
    joined = ranged.join(ends, ["chrom", "__range"])
    return joined.withColumn("vardist", F.least(F.col("pos") - before, after - F.col("pos"))).drop("__range", "__before", "__after")
