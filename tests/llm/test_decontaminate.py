import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoloom.llm import decontaminate as D

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, bench, window=8):
    wins = {}
    for item, text in bench:
        w = words(text)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add(item if item is None else str(item))
    out = {}
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if found := wins.get(tuple(w[j : j + k])):
                    items |= found
                    hit |= set(range(j, j + k))
        out[i] = (len(w), len(hit), sorted(items - {None}))
    return out


def found(spark, docs, bench, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.find_overlaps(d, b, **options).select("doc_id", "overlap.n_words", D.n_hit().alias("n"), "overlap.items").collect()
    return {r["doc_id"]: (r["n_words"], r["n"], r["items"]) for r in got}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    vocabulary = ["Ab", "c", "dé", "ef9", "g", "hij", "k_l", "ÄÖ", "x" * 30]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 5, 7, 8, 9, 12, 20]))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (None, text(11)), (93, "q r " * 30), (94, "s " * 40), (94, "q r s " * 5)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)]
    docs += [(100 + i, f"{text(5)}, {t} {text(4)}") for i, (_, t) in enumerate(bench) if t]
    return docs + [(900, None), (901, ""), (902, "!!!"), (903, bench[0][1]), (904, "a b " * 3000 + (bench[3][1] or "")), (905, "q r " * 500), (906, "s " * 700), (907, "s s q r s q r q r q r s s s s s s s s s s"), (908, "x, " + bench[-4][1])], bench


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_equals_brute_force(spark, planted, block_words):
    docs, bench = planted
    assert found(spark, docs, bench, block_words=block_words) == brute(docs, bench)


@pytest.mark.parametrize("gram", [1, 4, 8])
def test_any_gram_finds_the_same(spark, planted, gram):
    docs, bench = planted
    assert found(spark, docs, bench, gram=gram) == brute(docs, bench)


@pytest.mark.parametrize("pattern", ["a ", "a b ", "a a b "])
def test_repetition_costs_little(pattern):
    bench = D.Benchmark([(pattern * 2000)[:4000], "other words that are here " * 3], ["x", "y"], D.WINDOW, D.GRAM)
    text = (pattern * 20_000)[:40_000]
    began = time.monotonic()
    (row,) = D._find(pa.array([text]), bench).to_pylist()
    assert time.monotonic() - began < 1
    n = len(text.split())
    assert row == {"n_words": n, "spans": [{"first": 0, "last": n}], "items": ["x"], "unnamed": False}


def test_a_passage_in_all_items_is_expanded_in_parts(monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 7)
    passage = " ".join(f"w{i}" for i in range(30))
    bench = D.Benchmark([f"{passage} own{i} {passage}" for i in range(50)], [str(i) for i in range(50)], D.WINDOW, D.GRAM)
    got = D._find(pa.array([f"before {passage} after", "before after", None, passage[:-5]]), bench).to_pylist()
    assert [len(r["items"]) for r in got] == [50, 0, 0, 50] and got[0]["spans"] == [{"first": 1, "last": 31}]


def test_empty_tables(spark, planted):
    docs, bench = planted
    assert found(spark, [], bench) == {}
    assert all(n == 0 and items == [] for _, n, items in found(spark, docs, []).values())


def test_stage_keeps_columns_and_clean_rows(spark, planted):
    docs, bench = planted
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"overlap": F.lit("mine"), "n_words": F.lit(None).cast("int")})
    d = d.unionByName(d)
    kept = D.decontaminate(d, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == d.columns
    want = sorted(i for i, (_, _, items) in brute(docs, bench).items() if not items)
    want = [i for i in want if i != 908]  # it holds an item without an id
    assert sorted(r["doc_id"] for r in kept.where("overlap = 'mine'").collect()) == sorted(want * 2)
    in_blocks = D.decontaminate(d, spark.createDataFrame(bench, "item_id long, text string"), block_words=40)
    assert in_blocks.columns == d.columns and sorted(r["doc_id"] for r in in_blocks.collect()) == sorted(want * 2)


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        found(spark, [], [], gram=9)
