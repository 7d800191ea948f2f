"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads. Every query is run whole, into a sink
that keeps nothing; the first run of the session is not counted. A VCF of up to 200 samples (and all
sites: 20,000 at sf0.1, the shape of the corpus that published times are of) is converted to a genotype
store, and panels of 1 to 1000 loci, and of 1 to 1000 spans, are asked of it; each panel runs once unmeasured.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "site_allele_counts", "callable_runs", "hom_ref_reconstruction", "observed_states", "sample_matrix", "site_genotype_counts", "variant_distance", "filter_chain", "variant_stats",
    "bed_union_stranded", "bed_inter_stranded", "interval_overlap_join", "annotate_intervals", "bed_stats", "sequence_gc", "reverse_complement", "read_stats", "read_region",
]


SAMPLES = 200


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from genoloom.plans import from_files
    from genoloom.plans.catalog import QUERIES
    from genoloom.sources import store, vcf
    from genoloom.sources.targets import Targets

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(QUERIES["genotype_classes"](spark, sf_dir))
    took = {name: timed(lambda n=name: sink(QUERIES[n](spark, sf_dir))) for name in HEADLINE}

    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        vcf.write(from_files._geno(spark, sf_dir, samples=SAMPLES), f"{folder}/in.vcf.gz")
        took["store_write"] = timed(lambda: store.write(spark, [f"{folder}/in.vcf.gz"], f"{folder}/store"))
        s = store.open(spark, f"{folder}/store")
        loci = [tuple(r) for r in s.sites.select("chrom", "pos", "ref", "alt").orderBy(F.xxhash64("chrom", "pos")).limit(1000).collect()]
        for n in (1, 10, 100, 1000):
            for kind, t in (("loci", Targets(loci[:n])), ("spans", Targets(spans=[(c, p - 1, p + 49) for c, p, _, _ in loci[:n]]))):
                run = lambda t=t: s.query(t).collect()
                run()
                took[f"panel_{n}_{kind}"] = timed(run)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
