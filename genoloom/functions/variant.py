"""What an allele is: kinds of variants, spans on the reference and breakends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values of the file format: alleles that stand for a reference block
BLOCK_ALLELES = ("<NON_REF>", "<*>", ".")
_BREAKEND = r"^([^\[\]]*)([\[\]])(.+):(\d+)[\[\]]([^\[\]]*)$"


def is_block_allele(alt: Column) -> Column:
    return alt.isin(*BLOCK_ALLELES)


def real_alts(alts: Column) -> Column:
    """Alternate alleles that are no reference block."""
    return F.filter(alts, lambda a: ~is_block_allele(a))


def is_snv(ref: Column, alts: Column) -> Column:
    """Every allele has one base; symbols and breakends do not."""
    real = real_alts(alts)
    return (F.length(ref) == 1) & (F.size(real) > 0) & F.forall(real, lambda a: F.length(a) == 1)


def is_indel(ref: Column, alts: Column) -> Column:
    """Some allele has another length than one base; symbols and breakends count."""
    real = real_alts(alts)
    return (F.size(real) > 0) & ((F.length(ref) != 1) | F.exists(real, lambda a: F.length(a) != 1))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def is_transversion(ref: Column, alt: Column) -> Column:
    one = F.upper(ref).isin("A", "C", "G", "T") & F.upper(alt).isin("A", "C", "G", "T")
    return one & (F.upper(ref) != F.upper(alt)) & ~is_transition(ref, alt)


def tstv(ref: Column, alt: Column) -> Column:
    """-1 for a transition, 1 for a transversion, else 0."""
    return F.when(is_transition(ref, alt), -1).when(is_transversion(ref, alt), 1).otherwise(0)


def is_breakend(alt: Column) -> Column:
    return alt.rlike(_BREAKEND)


def breakend_chrom(alt: Column) -> Column:
    return F.when(is_breakend(alt), F.regexp_extract(alt, _BREAKEND, 3))


def breakend_pos(alt: Column) -> Column:
    return F.when(is_breakend(alt), F.regexp_extract(alt, _BREAKEND, 4).cast("int"))


def connection(alt: Column) -> Column:
    """How the two flanks of a breakend are joined."""
    lead, mark = F.regexp_extract(alt, _BREAKEND, 1), F.regexp_extract(alt, _BREAKEND, 2)
    right, ahead = mark == "[", lead != ""
    return F.when(is_breakend(alt), F.when(ahead & right, "3to5").when(ahead, "3to3").when(right, "5to5").otherwise("5to3"))


def kind(ref: Column, alt: Column, svtype: Column) -> Column:
    """SNV, INS, DEL, BND or the type of a symbol."""
    symbol = F.coalesce(svtype, F.regexp_extract(alt, r"^<([^:>]+)", 1))
    return (
        F.when(is_breakend(alt), "BND").when(alt.startswith("<"), symbol).when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV")
        .when(F.length(alt) > 1, "INS").otherwise("DEL")
    )


def ref_end(pos: Column, ref: Column, end: Column, svlen: Column, length: Column | None = None) -> Column:
    """The last reference base of a record: the furthest of REF, END, POS + |SVLEN| and a block's LEN."""
    zero = F.lit(0)
    own = pos + F.length(ref) - 1
    return F.greatest(own, F.coalesce(end, zero), F.coalesce(pos + F.abs(svlen), zero), F.coalesce(pos + length - 1, zero) if length is not None else zero).cast("int")
