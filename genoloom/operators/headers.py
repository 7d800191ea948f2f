"""Steps that change headers and the columns they describe."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import functions as F

from genoloom.functions import contigs as C
from genoloom.sources.vcf import Header, Vcf, changed

from .filters import passes


def glob_match(patterns: Iterable[str], names: Iterable[str]) -> list[str]:
    """Names that any pattern covers: ``*`` any text, ``?`` at most one character."""
    tests = [re.compile("".join(".*" if c == "*" else ".?" if c == "?" else re.escape(c) for c in p) + r"\Z") for p in patterns]
    return [n for n in names if any(t.match(n) for t in tests)]


def rename_samples(vcf: Vcf, pairs: dict[str, str]) -> Vcf:
    """Samples by their new names; the old may be a 1-based number."""
    samples = list(vcf.header.samples)
    for old, new in pairs.items():
        samples[vcf.header.sample_index(old)] = new
    return Vcf(replace(vcf.header, samples=samples), vcf.records)


def reorder(vcf: Vcf, names: list[str]) -> Vcf:
    """The samples named, or numbered, in that order; their columns move as they are."""
    at = [vcf.header.sample_index(n) for n in names]
    parts = F.split("raw", "\t")
    moved = F.array_join(F.concat(F.slice(parts, 1, 9), F.array(*[F.get(parts, F.lit(9 + i)) for i in at])), "\t")
    records = vcf.records.withColumns({"samples": F.array(*[F.get("samples", F.lit(i)) for i in at]), "raw": moved})
    return Vcf(replace(vcf.header, samples=list(names)), records)


def fix_contigs(vcf: Vcf, scheme: str, only: list[str] | None = None, primary_human: bool = False) -> Vcf:
    """Contigs by the names of ucsc or ensembl; ``only`` (new names) or the primary human ones stay."""
    to = C.to_ensembl if scheme == "ensembl" else C.to_ucsc
    keep = set(only or [])
    primary = {*C.PRIMARY, "MT"}
    wanted = lambda n: n in keep if keep else not primary_human or C.name_to("ensembl", n) in primary
    lines = []
    for x in vcf.header.lines:
        d = Header.parse(x)
        if d and d[0] == "contig" and "ID" in d[1]:
            new = C.name_to(scheme, d[1]["ID"])
            if not wanted(new):
                continue
            x = x.replace(f"ID={d[1]['ID']}", f"ID={new}", 1)
        lines.append(x)
    new = to(F.col("chrom"))
    # the rest of the line stays as it was read
    raw = F.concat(new, F.substring("raw", F.length("chrom") + 1, F.length("raw")))
    records = vcf.records.withColumns({"raw": raw, "chrom": new})
    if keep:
        records = records.where(F.col("chrom").isin(sorted(keep)))
    elif primary_human:
        records = records.where(C.is_primary_human(F.col("chrom")))
    return Vcf(replace(vcf.header, lines=lines), records)


def strip(vcf: Vcf, info=(), formats=(), filters=(), samples=(), keep_info=(), keep_formats=(), keep_filters=(), keep_samples=(), dbsnp: bool = False, all_: bool = False, force_end: bool = False, only: str | None = None, passing: bool = False) -> Vcf:
    """Without the INFO and FORMAT keys, filters and samples that globs name and keep-globs do not.

    ``only`` is snvs or indels. The END of a gVCF stays unless forced: its blocks end there.
    """
    if all_:
        info, formats, filters, samples, dbsnp = ("*",), ("*",), ("*",), ("*",), True
    h = vcf.header

    def gone(kind: str, drop, keep) -> list[str]:
        ids = list(h.definitions(kind)) if kind != "sample" else h.samples
        kept = set(glob_match(keep, ids))
        return [x for x in glob_match(drop, ids) if x not in kept]

    no_info, no_format = gone("INFO", info, keep_info), gone("FORMAT", formats, keep_formats)
    no_filter = [x for x in gone("FILTER", filters, keep_filters) if x != "PASS"]
    no_sample = gone("sample", samples, keep_samples)
    if "END" in no_info and h.looks_like_gvcf():
        if force_end:
            warnings.warn("this looks like a gVCF: --force-end removes the END of its blocks", stacklevel=2)
        else:
            warnings.warn("this looks like a gVCF: INFO/END is kept", stacklevel=2)
            no_info.remove("END")
    everything = "*" in info and not keep_info
    records = vcf.records
    if only:
        from genoloom.functions import variant as V

        records = records.where((V.is_snv if only == "snvs" else V.is_indel)(F.col("ref"), F.col("alts")))
    # a star also takes keys that the header does not declare
    spared = [k for k in h.definitions("INFO") if k not in no_info]
    keep_entry = (lambda e: e["k"].isin(spared)) if everything else (lambda e: ~e["k"].isin(no_info))
    left = [i for i, s in enumerate(h.samples) if s not in no_sample]
    keys = F.filter("format_keys", lambda k: ~k.isin(no_format)) if no_format else F.col("format_keys")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("format_keys"), F.lit(1))), lambda i: (i <= F.size("format_keys")) & ~F.try_element_at("format_keys", i).isin(no_format))
    pick = lambda s: F.array_compact(F.transform(at, lambda i: F.try_element_at(s, i))) if no_format else s
    new_samples = F.transform(F.array(*[F.get("samples", F.lit(i)) for i in left]), pick) if left else F.expr("cast(array() as array<array<string>>)")
    codes = F.filter("filters", lambda f: ~f.isin(no_filter)) if no_filter else F.col("filters")
    records = changed(
        records,
        id=F.lit(".") if dbsnp else F.col("id"),
        info=F.filter("info", keep_entry),
        samples=new_samples,
        format_keys=keys,
        filters=F.when((F.size(codes) == 0) & (F.size("filters") > 0), F.array(F.lit("PASS"))).otherwise(codes),
    )
    if passing:
        records = records.where(passes())
    header = h.drop("INFO", no_info).drop("FORMAT", no_format).drop("FILTER", no_filter)
    return Vcf(replace(header, samples=[h.samples[i] for i in left]), records)


def remove_flags(vcf: Vcf, key: str = "FLAGS", always: bool = False) -> Vcf:
    """INFO flags as the values of one key, in the order of the record."""
    flags = [k for k, d in vcf.header.definitions("INFO").items() if d.get("Type") == "Flag"]
    if not flags:
        raise ValueError("the header declares no flags")
    here = F.transform(F.filter("info", lambda e: e["k"].isin(flags)), lambda e: e["k"])
    rest = F.filter("info", lambda e: ~e["k"].isin(flags))
    entry = lambda v: F.array(F.struct(F.lit(key).alias("k"), v.alias("v")))
    none = F.concat(rest, entry(F.lit("."))) if always else rest
    new = F.when(F.size(here) > 0, F.concat(rest, entry(F.array_join(here, ",")))).otherwise(none)
    header = vcf.header.drop("INFO", flags).define("INFO", key, ".", "String", "Flags that were set")
    return Vcf(header, changed(vcf.records, info=new))


def clear_filters(vcf: Vcf, codes: list[str], only: bool = False, passing: bool = False) -> Vcf:
    """Without the named codes, which are noted in INFO; ``only`` where a record has no other code."""
    here = F.filter("filters", lambda f: f.isin(codes))
    rest = F.filter("filters", lambda f: ~f.isin(codes))
    do = (F.size(here) > 0) & ((F.size(rest) == 0) if only else F.lit(True))
    note = F.array(F.struct(F.lit("CG_CLEARED_FILTER").alias("k"), F.array_join(here, ",").alias("v")))
    records = changed(vcf.records, filters=F.when(do, F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit("PASS")))).otherwise(F.col("filters")), info=F.when(do, F.concat("info", note)).otherwise(F.col("info")))
    if passing:
        records = records.where(passes())
    return Vcf(vcf.header.define("INFO", "CG_CLEARED_FILTER", ".", "String", "Filters that were cleared"), records)


def header_info(header: Header, what: str) -> list[tuple[str, ...]]:
    """Rows of one part of a header: info, format, filters, sample or contig."""
    if what == "sample":
        return [(s,) for s in header.samples]
    if what == "contig":
        return [(k, d.get("length", "")) for k, d in header.definitions("contig").items()]
    return [(k, d.get("Description", "")) for k, d in header.definitions({"info": "INFO", "format": "FORMAT", "filters": "FILTER"}[what]).items()]
