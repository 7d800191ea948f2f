"""Names of contigs: one chromosome under several naming schemes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMARY = [str(i) for i in range(1, 23)] + ["X", "Y"]


def to_ensembl(chrom: Column) -> Column:
    return F.when(chrom == "chrM", "MT").otherwise(F.regexp_replace(chrom, "^chr", ""))


def to_ucsc(chrom: Column) -> Column:
    return F.when(chrom.isin("MT", "M"), "chrM").when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def canonical(chrom: Column) -> Column:
    """One name for UCSC, Ensembl and RefSeq names of a human chromosome; others stay."""
    number = F.regexp_extract(chrom, r"^NC_0*(\d+)\.\d+$", 1)
    refseq = F.when(number == "23", "X").when(number == "24", "Y").when(number.isin("12920",), "MT").otherwise(number)
    plain = F.regexp_replace(F.lower(chrom), "^chr", "")
    known = F.when(plain.isin("m", "mt"), "MT").when(plain.rlike(r"^(\d+|x|y)$"), F.upper(plain))
    return F.when(number != "", refseq).otherwise(F.coalesce(known, chrom))


def canonical_name(name: str) -> str:
    """The same as ``canonical`` for one name on the driver."""
    if m := re.match(r"^NC_0*(\d+)\.\d+$", name):
        return {"23": "X", "24": "Y", "12920": "MT"}.get(m[1], m[1])
    plain = name.lower().removeprefix("chr")
    return "MT" if plain in ("m", "mt") else plain.upper() if re.match(r"^(\d+|x|y)$", plain) else name


def is_primary_human(chrom: Column) -> Column:
    return canonical(chrom).isin(*PRIMARY, "MT")


def name_to(scheme: str, name: str) -> str:
    """The same for one name on the driver; ``scheme`` is ucsc or ensembl."""
    if scheme == "ensembl":
        return "MT" if name == "chrM" else name.removeprefix("chr")
    return "chrM" if name in ("MT", "M") else name if name.startswith("chr") else f"chr{name}"
