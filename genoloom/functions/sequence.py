"""Sequences and alignments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the codes of bases and sets of bases, and their complements
_CODES = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
_COMPLEMENTS = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"

#: fixed values of the file format: the bits of a read's flag
FLAGS = {
    "paired": 0x1, "proper": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "first": 0x40, "second": 0x80, "secondary": 0x100, "qcfail": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _CODES, _COMPLEMENTS))


def gc(seq: Column) -> Column:
    """Share of G and C among all bases; null for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, F.length(F.regexp_replace(seq, "[^GCgc]", "")) / n)


def wrap(seq: Column, width: int) -> Column:
    """Line breaks after every ``width`` bases; below 1 there are none."""
    return seq if width < 1 else F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def cigar_length(cigar: Column, operations: str) -> Column:
    """Bases of the given operations of a CIGAR."""
    sizes = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{operations}]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def aligned_bases(cigar: Column) -> Column:
    return cigar_length(cigar, "MX=")


def read_bases(cigar: Column) -> Column:
    """Bases of the read that are aligned or inserted."""
    return cigar_length(cigar, "MIX=")


def high_bases(cigar: Column, qual: Column) -> Column:
    """Of these, bases of quality 30 or more: all but the clipped ends are read."""
    lead = F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    trail = F.coalesce(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))
    return F.regexp_count(F.substring(qual, lead + 1, F.length(qual) - lead - trail), F.lit(r"[?-~]"))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment spans."""
    return cigar_length(cigar, "MDNX=")


def unique(nh: Column, ih: Column, mapq: Column) -> Column:
    """Mapped to one place: by NH, else by IH, else by mapping quality."""
    return F.coalesce(nh == 1, ih == 1, mapq != 0)


def flanking(context: Column, ref: Column, alt: Column) -> Column:
    """Substitution in its context, written from the pyrimidine of the pair."""
    n = F.length(context)
    mid = F.floor(n / 2).cast("int")
    purine = F.upper(ref).isin("A", "G")
    c = F.when(purine, reverse_complement(context)).otherwise(context)
    r = F.when(purine, reverse_complement(ref)).otherwise(ref)
    a = F.when(purine, reverse_complement(alt)).otherwise(alt)
    return F.concat(F.substring(c, F.lit(1), mid), F.lit("["), r, F.lit(">"), a, F.lit("]"), F.substring(c, mid + 2, mid))
