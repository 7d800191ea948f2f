"""Targets of queries: loci, spans and samples, from arguments or files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import files


@dataclass
class Targets:
    """Exact loci (chrom, pos, ref, alt) and spans (chrom, start, end), 0-based and half-open."""

    loci: list[tuple[str, int, str, str]] = field(default_factory=list)
    spans: list[tuple[str, int, int]] = field(default_factory=list)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return (spark.createDataFrame(self.loci, "chrom string, pos int, ref string, alt string"), spark.createDataFrame(self.spans, "chrom string, start int, end int"))


END = 2**31 - 1


def add(out: Targets, selector: str) -> None:
    """``chr``, ``chr:start-end``, ``chr:pos`` or ``chr:pos:ref:alt``; anything else is a contig's name."""
    parts = selector.split(":")
    if len(parts) == 4 and parts[1].isdigit() and not parts[2].isdigit() and not parts[3].isdigit():
        out.loci.append((parts[0], int(parts[1]), parts[2], parts[3]))
    elif len(parts) == 2 and (m := re.match(r"^(\d+)(?:-(\d+))?$", parts[1])):
        start, end = int(m[1]), int(m[2] or m[1])
        if end < start:
            raise ValueError(f"{selector} ends before it starts")
        out.spans.append((parts[0], start - 1, end))
    elif len(parts) == 2:
        raise ValueError(f"{selector} is no position")
    else:
        out.spans.append((selector, 0, END))


def parse(selectors: list[str]) -> Targets:
    out = Targets()
    for s in selectors:
        add(out, s)
    return out


def read(spark: SparkSession, path: str) -> Targets:
    """A VCF, BED or list of sites, told by content; one without targets is an error."""
    out = Targets()
    vcf = False
    for line in files.head(spark, path):
        vcf = vcf or line.startswith("##fileformat=VCF")
        if not line.strip() or line.startswith("#"):
            continue
        p = line.split("\t") if vcf else line.split()
        if vcf:
            out.loci += [(p[0], int(p[1]), p[3], a) for a in p[4].split(",") if a != "."]
        elif len(p) == 1:
            add(out, p[0])
        elif len(p) >= 3 and p[1].isdigit() and p[2].isdigit():
            out.spans.append((p[0], int(p[1]), int(p[2])))
        elif len(p) >= 4:
            out.loci.append((p[0], int(p[1]), p[2], p[3]))
        else:
            out.spans.append((p[0], int(p[1]) - 1, int(p[1])))
    if not out.loci and not out.spans:
        raise ValueError(f"{path} has no targets")
    return out


def read_samples(spark: SparkSession, path: str) -> list[str]:
    """Samples of a VCF's header, or the words of a list; each once."""
    names: list[str] = []
    for line in files.head(spark, path):
        if line.startswith("#CHROM"):
            return line.split("\t")[9:]
        if not line.startswith("#"):
            names += line.split()
    return list(dict.fromkeys(names))


def values(spark: SparkSession, path: str) -> DataFrame:
    """A file of values, one per line, as columns c1, c2, … of its tabs."""
    from pyspark.sql import functions as F

    rows = files.lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    p = F.split("value", "\t")
    return rows.select(*[F.get(p, F.lit(i)).alias(f"c{i + 1}") for i in range(16)])
