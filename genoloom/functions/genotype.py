"""Genotype text as column expressions: alleles, classes, dosage and splitting by allele."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[/|]"


def alleles(gt: Column) -> Column:
    """Allele tokens of a genotype; null and empty text count as one missing allele."""
    return F.split(F.when(gt.isNull() | (gt == ""), ".").otherwise(gt), SEPARATOR)


def called(gt: Column) -> Column:
    """Called alleles, as numbers."""
    return F.transform(F.filter(alleles(gt), lambda a: ~a.isin(".", "")), lambda a: a.cast("int"))


def has_call(gt: Column) -> Column:
    """Whether any allele is called."""
    return F.size(called(gt)) > 0


def dosage(gt: Column) -> Column:
    """How many called alleles differ from the reference; null where none is called."""
    return F.when(has_call(gt), F.size(F.filter(called(gt), lambda a: a != 0)))


def allele_count(gt: Column, allele: Column) -> Column:
    """How often an allele number occurs."""
    return F.size(F.filter(called(gt), lambda a: a == allele))


def canonical(gt: Column) -> Column:
    """The unordered class of a genotype: alleles in order, missing first, joined by a slash."""
    ranked = F.array_sort(F.transform(alleles(gt), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1))))
    return F.array_join(F.transform(ranked, lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))), "/")


def class_order(canonical_gt: Column) -> Column:
    """A sort key of classes: called first, by their largest allele and then the rest, missing last."""
    tokens = F.split(canonical_gt, "/")
    missing = F.size(F.filter(tokens, lambda a: a == "."))
    numbers = F.transform(F.filter(tokens, lambda a: a != "."), lambda a: a.cast("int"))
    return F.struct(missing.alias("missing"), F.reverse(numbers).alias("by"))


def recode(gt: Column, allele: Column) -> Column:
    """The genotype as one allele sees it: itself 1, the reference 0, any other missing; phase stays."""
    tokens = F.transform(alleles(gt), lambda a: F.when(a == allele.cast("string"), "1").when(a == "0", "0").otherwise("."))
    marks = F.concat(F.regexp_extract_all(gt, F.lit(SEPARATOR), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(tokens, marks, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")


def is_het(gt: Column) -> Column:
    """At least two different called alleles."""
    return F.size(F.array_distinct(called(gt))) > 1


def is_hom_alt(gt: Column) -> Column:
    """Two or more alleles, all the same and not the reference."""
    a = alleles(gt)
    return (F.size(a) > 1) & (F.size(F.array_distinct(a)) == 1) & ~F.element_at(a, 1).isin("0", ".")


def is_hom(gt: Column) -> Column:
    """Two or more called alleles, all the same."""
    a = alleles(gt)
    return (F.size(a) > 1) & (F.size(F.array_distinct(a)) == 1) & (F.element_at(a, 1) != ".")


def bases(gt: Column, ref: Column, alts: Column) -> Column:
    """The genotype in bases, its separators kept."""
    every = F.concat(F.array(ref), alts)
    tokens = F.transform(alleles(gt), lambda a: F.when(a == ".", ".").otherwise(F.coalesce(F.try_element_at(every, a.cast("int") + 1), F.lit("."))))
    marks = F.concat(F.regexp_extract_all(gt, F.lit(SEPARATOR), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(tokens, marks, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")


def depth_band(dp: Column, bands: list[int]) -> Column:
    """The class of a depth among ascending bounds."""
    if bands != sorted(set(bands)) or any(b <= 0 for b in bands):
        raise ValueError("depth bands must be positive and ascending")
    return sum((F.when(dp >= b, 1).otherwise(0) for b in bands), F.lit(0))
