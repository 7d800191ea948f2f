import shutil

from genoloom.operators import filters
from genoloom.streaming import variants
from tests.helpers import path


def test_totals_grow_as_files_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = {}

    def keep(batch, number):
        seen.update({r["chrom"]: (r["records"], r["passing"]) for r in batch.collect()})

    shutil.copy(path("sample.vcf"), folder / "a.vcf")
    q = variants.start(variants.counts_by_contig(variants.read(spark, str(folder))), str(tmp_path / "c1"), keep, "complete")
    q.processAllAvailable()
    assert seen == {"chr1": (3, 2), "chr2": (2, 2)}
    shutil.copy(path("annotate.vcf"), folder / "b.vcf")
    q.processAllAvailable()
    q.stop()
    assert seen == {"chr1": (7, 5), "chr2": (3, 3)}


def test_filters_on_a_stream_equal_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(path("annotate.vcf"), folder / "a.vcf")
    got = []
    q = variants.start(variants.passing(variants.read(spark, str(folder)), [filters.snv(), filters.quality(30)]), str(tmp_path / "c2"), lambda b, n: got.extend(r["pos"] for r in b.collect()))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [300, 500]
