"""Every stage of the pipeline against brute force, over rows with nulls, repeats, copies and columns of clashing names."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genoloom.llm import quality

from .test_decontaminate import brute as brute_overlaps
from .test_shapes import targets
from .test_simhash import brute_fingerprint, brute_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, score string, overlap string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["X$$$", "q%%%", "9&&&"]) for _ in range(n))
    passage = prose(12)
    texts = [prose(rng.randint(10, 90)) for _ in range(160)]
    texts += texts[:20] + [t + "  " for t in texts[20:30]] + [junk(40) + f" {i}" for i in range(40)]
    texts += [f"{prose(20)} {passage} {prose(9)}" for _ in range(6)] + ["", None, " "]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), "mine", "mine", "mine", "mine") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose(30), None, "b", None, "mine", None, None, None)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "not there at all " * 4), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    quality_of = [(i, int("$$$" not in (t or "") and "%%%" not in (t or "")), 0) for i, t in enumerate(texts) if t]
    spark.createDataFrame(quality_of, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {i: q for i, q, _ in quality_of}


def key(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in rows), key=str)


def test_every_stage(spark, tables):
    folder, good = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "SimHash", "benchmark", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)

    out = stage[names[0]](spark, docs, folder)
    kept = out.collect()
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores(pa.array([r["text"] for r in rows]))
    assert out.columns == docs.columns and key(kept) == key(r for r, s in zip(rows, scores, strict=True) if s >= 0.3)
    assert all(good.get(r["doc_id"], 1) for r in kept) and sum(good.get(r["doc_id"], 0) for r in kept) >= 0.98 * sum(good.values())

    # each later stage is judged on all rows
    out = stage[names[1]](spark, docs, folder)
    kept = out.collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    groups = brute_groups([brute_fingerprint(r["text"]) for r in order])
    assert out.columns == docs.columns and key(kept) == key(order[g] for g in set(groups))

    out = stage[names[2]](spark, docs, folder)
    hit = brute_overlaps([(n, r["text"]) for n, r in enumerate(rows)], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert out.columns == docs.columns and key(out.collect()) == key(r for n, r in enumerate(rows) if not hit[n][2]) and out.count() == len(rows) - 6

    out = stage[names[3]](spark, docs, folder)
    mixed = out.collect()
    size = lambda r: len((r["text"] or "").split())
    sums = lambda rs: {s: sum(size(r) for r in rs if r["source"] == s) for s in ("a", "b", None)}
    want, got = targets(sums(rows)), sums(mixed)
    assert out.columns == docs.columns and all(abs(got[s] - want[s]) <= 0.02 * want[s] + 3 for s in want)
    times = {k: (key(mixed).count(k), key(rows).count(k)) for k in key(rows) if k[2].strip()}
    assert set(key(mixed)) <= set(key(rows)) and all(0 <= m <= 3 * n for m, n in times.values())

    out = stage[names[4]](spark, docs, folder).toPandas()
    assert len(out) == len(rows) and out.fillna({"text": ""}).groupby("text").shard.nunique().max() == 1
    loads = out.assign(bytes=[len((t or "").encode()) + 1 for t in out.text]).groupby("shard").bytes.sum()
    assert len(loads) == 8 and loads.max() - loads.min() <= 2 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_run_is_its_stages_in_turn(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = docs
    for _, f in corpus_pipeline.STAGES:
        want = spark.createDataFrame((out := f(spark, want, folder)).collect(), out.schema)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in want.columns]
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == want.columns and sorted(got.select(columns).collect()) == sorted(want.select(columns).collect()) and got.count() > 100


def test_empty_documents(spark, tables):
    folder, _ = tables
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert all(f(spark, none, folder).count() == 0 for _, f in corpus_pipeline.STAGES)
