"""Genomic views derived from the star-schema tables; each is one SELECT for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CHROM = "concat('chr', cast(1 + {} % 5 as string))"
_ACGT = "substring('ACGT', cast({} as int), 1)"

#: name -> (FROM clause, {column: expression}); {G} is where DuckDB asks for a global replacement
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "g_sites": ("part", {
        "rec_id": "cast(p_partkey as int)",
        "chrom": _CHROM.format("p_partkey"),
        "pos": "cast(100 + 10 * p_partkey as int)",
        "ref": _ACGT.format("1 + p_partkey % 4"),
        "alt": _ACGT.format("1 + (p_partkey + 1 + p_size % 3) % 4"),
        "filt": "case when p_partkey % 7 <> 0 then 'PASS' when p_partkey % 2 = 0 then 'lowq,hotspot' else 'lowq' end",
        "qual": "cast(p_size as int)",
    }),
    "g_geno": ("(select distinct l_partkey, l_suppkey as s_suppkey from lineitem) l join g_sites on rec_id = l_partkey", {
        "rec_id": "rec_id", "chrom": "chrom", "pos": "pos", "ref": "ref", "alt": "alt",
        "sample_id": "concat('S', cast(s_suppkey as string))",
        "gt": "case (rec_id * 31 + s_suppkey * 17) % 23 when 0 then './.' when 1 then '0/1' when 2 then '1|0' when 3 then '1/1' when 4 then '0|1' else '0/0' end",
        "dp": "case when (rec_id * 13 + s_suppkey * 7) % 29 = 0 then null else cast(3 + (rec_id * 11 + s_suppkey * 5) % 60 as int) end",
    }),
    "g_bed_a": ("orders", {
        "chrom": _CHROM.format("o_custkey"),
        "start_pos": "cast(o_orderkey % 50000 as int)",
        "end_pos": "cast(o_orderkey % 50000 + 5 + o_custkey % 40 as int)",
        "name": "concat('A', cast(o_orderkey as string))",
        "strand": "case when o_orderkey % 2 = 0 then '+' else '-' end",
    }),
    "g_bed_b": ("customer", {
        "chrom": _CHROM.format("c_custkey"),
        "start_pos": "cast((c_custkey * 37) % 50000 as int)",
        "end_pos": "cast((c_custkey * 37) % 50000 + 20 + c_nationkey as int)",
        "name": "concat('B', cast(c_custkey as string))",
        "strand": "case when c_custkey % 2 = 0 then '+' else '-' end",
    }),
    "g_seq": ("documents", {
        "doc_id": "doc_id",
        "seq": "regexp_replace(upper(text), '[^ACGTN]', ''{G})",
    }),
    "g_reads": ("lineitem", {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber",
        "read_name": "concat('R', cast(l_orderkey as string), '.', cast(l_linenumber as string))",
        "flag": "cast((l_partkey * 37 + l_suppkey) % 4096 as int)",
        "ref_name": _CHROM.format("l_suppkey"),
        "pos": "cast(1 + 10 * l_partkey as int)",
        "mapq": "cast(l_quantity as int)",
        "nh": "cast(1 + l_linenumber % 3 as int)",
        "cigar": "concat(cast(cast(l_quantity as int) as string), case when l_linenumber % 5 = 0 then 'M100N10M' else 'M5S' end)",
    }),
}


def _select(name: str) -> tuple[str, list[str]]:
    source, columns = VIEWS[name]
    return source, [f"{e} as {c}" for c, e in columns.items()]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in ``sf_dir``."""
    source, columns = _select(name)
    columns = [c.replace("{G}", "") for c in columns]
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "g_geno":
        seen = read("lineitem").selectExpr("l_partkey", "l_suppkey as s_suppkey").distinct()
        sites = view(spark, sf_dir, "g_sites")
        return seen.join(sites, sites["rec_id"] == seen["l_partkey"]).selectExpr(*columns)
    return read(source).selectExpr(*columns)


def sql(body: str, *names: str) -> str:
    """DuckDB SQL: the views named (and what they need) as CTEs before ``body``."""
    wanted = (["g_sites"] if "g_geno" in names and "g_sites" not in names else []) + list(names)
    parts = []
    for n in wanted:
        source, columns = _select(n)
        text = ", ".join(c.replace("{G}", ", 'g'").replace("as string)", "as varchar)") for c in columns)
        parts.append(f"{n} as (select {text} from {source})")
    return f"with {', '.join(parts)} {body}" if parts else body
