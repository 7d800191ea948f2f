"""Filters that stamp codes on records, in order; a record without codes passes.

Records have ref, alts, qual, filters (codes in order; none, or PASS, where it passes), info
(array of key and value), format_keys and samples (arrays of values).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.functions import genotype as G
from genoloom.functions import variant as V


def info(key: str, column: str = "info") -> Column:
    """The value of an INFO key; null where the key is missing or is a flag."""
    return F.try_element_at(F.filter(F.col(column), lambda e: e["k"] == key), F.lit(1))["v"]


def has_info(key: str, column: str = "info") -> Column:
    return F.coalesce(F.exists(F.col(column), lambda e: e["k"] == key), F.lit(False))


def sample_value(values: Column, key: str) -> Column:
    """The value of a FORMAT key among one sample's values."""
    at = F.array_position("format_keys", key).cast("int")
    return F.when(at > 0, F.try_element_at(values, at))


def allele_value(value: Column, allele: str | None, alt: Column | None = None) -> Column:
    """One part of a value: all of it, ref, altN, an index, or the sum, min or max of all parts."""
    if not allele:
        return value
    parts = F.split(value, ",")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    if allele == "sum":
        total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
        return shown(total)
    if allele in ("min", "max"):
        return shown(F.array_min(numbers) if allele == "min" else F.array_max(numbers))
    if allele == "ref":
        return F.try_element_at(parts, F.lit(1))
    if allele.startswith("alt"):
        return F.try_element_at(parts, F.lit(int(allele[3:]) + 1))
    return F.try_element_at(parts, F.lit(int(allele) + 1))


def shown(number: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def passes(filters: Column | None = None) -> Column:
    """No code but PASS."""
    f = F.col("filters") if filters is None else filters
    return F.size(F.filter(f, lambda x: ~x.isin("PASS", ".", ""))) == 0


@dataclass(frozen=True)
class Filter:
    """A code, the test that stamps it, and what the header says of it."""

    code: str | Callable[[], Column]
    test: Column
    description: str

    def stamp(self) -> Column:
        return F.when(F.coalesce(self.test, F.lit(False)), F.lit(self.code) if isinstance(self.code, str) else self.code())


def chrom_pass(names: list[str]) -> Filter:
    return Filter(lambda: F.concat(F.lit("CHROM_FAIL_"), F.col("chrom")), ~F.col("chrom").isin(names), f"Chromosome is not one of {','.join(names)}")


def chrom_fail(names: list[str]) -> Filter:
    return Filter(lambda: F.concat(F.lit("CHROM_FAIL_"), F.col("chrom")), F.col("chrom").isin(names), f"Chromosome is one of {','.join(names)}")


def snv() -> Filter:
    return Filter("SNV", V.is_snv(F.col("ref"), F.col("alts")), "Variant is a SNV")


def indel() -> Filter:
    return Filter("INDEL", V.is_indel(F.col("ref"), F.col("alts")), "Variant is an indel")


def _any_sample(test: Callable[[Column], Column], sample: int | None) -> Column:
    if sample is not None:
        return test(F.try_element_at("samples", F.lit(sample + 1)))
    return F.exists("samples", test)


def het(sample: int | None = None) -> Filter:
    return Filter("HET", _any_sample(lambda s: F.coalesce(G.is_het(sample_value(s, "GT")), F.lit(False)), sample), "Genotype is heterozygous")


def hom(sample: int | None = None) -> Filter:
    return Filter("HOM", _any_sample(lambda s: F.coalesce(G.is_hom(sample_value(s, "GT")), F.lit(False)), sample), "Genotype is homozygous")


def max_insertion(n: int) -> Filter:
    return Filter(f"INS_gt_{n}", F.exists("alts", lambda a: ~a.startswith("<") & (F.length(a) - F.length("ref") > n)), f"Insertion is longer than {n}")


def max_deletion(n: int) -> Filter:
    return Filter(f"DEL_gt_{n}", F.exists("alts", lambda a: ~a.startswith("<") & (F.length("ref") - F.length(a) > n)), f"Deletion is longer than {n}")


def quality(least: float) -> Filter:
    return Filter(f"QUAL_lt_{float(least)}", F.col("qual") < least, f"Quality is below {float(least)}")


def flag_present(key: str) -> Filter:
    return Filter(f"{key}_present", has_info(key), f"{key} is present")


def flag_missing(key: str) -> Filter:
    return Filter(f"{key}_missing", ~has_info(key), f"{key} is missing")


def _value(key: str, sample: str | None, allele: str | None, names: list[str], test: Callable[[Column], Column]) -> Column:
    """A test of an INFO value (sample INFO), of one sample's value, or of any sample's."""
    if sample == "INFO":
        return test(allele_value(info(key), allele))
    of = lambda s: F.coalesce(test(allele_value(sample_value(s, key), allele)), F.lit(False))
    if sample:
        at = names.index(sample) if sample in names else int(sample) - 1
        return of(F.try_element_at("samples", F.lit(at + 1)))
    return F.exists("samples", of)


def value_missing(key: str, sample: str | None = None, names: list[str] | None = None) -> Filter:
    code = "_".join(x for x in (key, "missing", sample) if x)
    return Filter(code, _value(key, sample, None, names or [], lambda v: F.coalesce(v.isin(".", ""), F.lit(True))), f"{key} has no value")


_TEXT = {
    "eq": lambda v, x: v == x, "neq": lambda v, x: v != x, "contain": lambda v, x: v.contains(x), "not_contain": lambda v, x: ~v.contains(x),
    "in": lambda v, x: v.isin(x), "not_in": lambda v, x: ~v.isin(x),
}
_NUMBER = {"lt": lambda v, x: v < x, "lte": lambda v, x: v <= x, "gt": lambda v, x: v > x, "gte": lambda v, x: v >= x}


def compare(op: str, key: str, value, sample: str | None = None, allele: str | None = None, names: list[str] | None = None) -> Filter:
    """A filter of a value by text (eq, neq, contain, not_contain, in, not_in) or number (lt, lte, gt, gte)."""
    if op in _NUMBER:
        text, test = str(float(value)), lambda v: _NUMBER[op](v.try_cast("double"), float(value))
    else:
        text, test = value if isinstance(value, str) else ",".join(value), lambda v: _TEXT[op](v, value)
    code = "_".join(x for x in (key, op, text, sample, allele) if x)
    return Filter(code, _value(key, sample, allele, names or [], test), f"{key} {op} {text}")


def apply(records: DataFrame, filters: list[Filter], keep: str | None = None) -> DataFrame:
    """Records with the codes of all filters; ``keep`` passing or failing drops the others."""
    old = F.filter("filters", lambda x: ~x.isin("PASS", ".", ""))
    stamped = F.concat(old, F.array_compact(F.array(*[f.stamp() for f in filters]))) if filters else old
    out = records.withColumn("__codes", F.array_distinct(stamped))
    out = out.withColumn("filters", F.when(F.size("__codes") > 0, F.col("__codes")).otherwise(F.array(F.lit("PASS")))).drop("__codes")
    if keep:
        out = out.where(passes() if keep == "passing" else ~passes())
    return out


def combination_counts(records: DataFrame) -> DataFrame:
    """(codes, n, first): how often each combination of codes occurs, first seen first; passing rows not."""
    combo = F.array_join(F.array_sort(F.filter("filters", lambda x: ~x.isin("PASS", ".", ""))), ",")
    return records.groupBy(combo.alias("codes")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_idx").alias("first")).where("codes <> ''")
