"""Sums over shared terms of all pairs, block by block: held against brute force, and no shuffle of pairs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import all_pairs, cluster
from triagelake.sources.tables import checkpointed


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    found = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


@pytest.mark.parametrize("binary", [False, True])
def test_blocks_and_tiles_of_any_size_give_the_sums_of_all_pairs(spark, monkeypatch, binary):
    rng = random.Random(3)
    weights = {(f"c{c:03d}", f"t{t}"): rng.random() + 0.1 for c in range(90) for t in {int(rng.paretovariate(0.6)) % 300 for _ in range(rng.choice([1, 5, 40]))}}
    weights |= {("lone", "only"): 1.0}
    scale = {c: rng.random() + 0.5 for c, _ in sorted(weights)}
    rows = [(c, t, w, scale[c]) for (c, t), w in weights.items()] + [(None, "t1", 1.0, 1.0), ("c000", None, 1.0, 1.0)]
    want = {}
    for (a, s), x in weights.items():
        for (b, t), y in weights.items():
            if a < b and s == t:
                want[a, b] = want.get((a, b), 0.0) + (1.0 if binary else x) * y / (scale[a] * scale[b])
    entries = checkpointed(spark.createDataFrame(rows, "case_id string, term string, w double, scale double"))
    for sizes in ({}, {"BLOCK": 7, "TASKS": 3}, {"BLOCKS": 1}):
        for name, value in sizes.items():
            monkeypatch.setattr(all_pairs, name, value)
        got = {(r["a"], r["b"]): r["value"] for r in all_pairs.shared_sums(entries, binary).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
        assert math.isclose(all_pairs.shared_sums(entries, binary, best=True).agg(F.max("value")).first()[0], max(want.values()), rel_tol=1e-9)


@pytest.mark.parametrize("common", [0, 3, 12])
def test_tiles_of_any_size_give_the_matrix_product(monkeypatch, common):
    rng = np.random.default_rng(common)
    x, y = (np.where(rng.random((n, 12)) < 0.4, rng.random((n, 12)), 0.0) for n in (9, 7))
    sides = [(*np.nonzero(v), v[np.nonzero(v)]) for v in (x, y)]
    for cells, products, slab in ((1 << 21, 1 << 22, 512), (1, 1, 1), (20, 5, 2)):
        for name, value in (("CELLS", cells), ("PRODUCTS", products), ("SLAB", slab)):
            monkeypatch.setattr(all_pairs, name, value)
        for binary, want in ((False, x @ y.T), (True, (x > 0) @ y.T)):
            tiles = list(all_pairs._tiles(*sides, 9, 7, common, binary))
            assert np.allclose(np.vstack([t for _, t in tiles]), want) and len(tiles) == -(-9 // max(1, cells // 7))
            assert [top for top, _ in tiles] == np.cumsum([0, *(len(t) for _, t in tiles[:-1])]).tolist()


def test_the_best_score_needs_no_table_of_candidate_pairs(spark, monkeypatch):
    """Cases that share common words and no rare ones: all pairs may be the best."""
    rng = random.Random(1)
    words = spark.createDataFrame([(f"c{c:03d}", f"w{t}") for c in range(100) for t in range(15) for _ in range(rng.randint(1, 3))], "case_id string, term string")
    parts = checkpointed(cluster._term_parts(words))
    want = cluster._scores(parts).agg(F.max("bm25")).first()[0]
    monkeypatch.setattr(cluster, "bm25_candidates", None)
    assert math.isclose(cluster.best_bm25(parts).first()["top"], want, rel_tol=1e-12)


def test_grams_of_a_long_account_take_time_in_proportion(spark):
    """80,000 characters: looked at anew for each gram these are 6 billion steps."""
    long = "Ab  é\n😀x" * 10_000
    began = time.time()
    rows = spark.createDataFrame([(1, long), (2, "aB"), (3, None), (4, ""), (5, "a\t\tbc")], "id int, text string").select("id", T.char_ngrams(F.col("text")).alias("g"))
    got = {r["id"]: r["g"] for r in rows.collect()}
    assert time.time() - began < 20
    flat = "ab é 😀x" * 10_000
    assert got[1] == [flat[i : i + 3] for i in range(len(flat) - 2)] and got[5] == ["a b", " bc"] and not got[2] and not got[3] and not got[4]


@pytest.mark.parametrize("of", ["bm25_pairs", "gram_cosine"])
def test_listing_all_pairs_shuffles_none_of_them(spark, of):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"c{c:03d}", f"w{t}") for c in range(800) for t in range(15) for _ in range(rng.randint(1, 3))], "case_id string, term string")
    before = shuffled(spark)
    out = cluster.bm25_pairs(rows) if of == "bm25_pairs" else cluster.gram_cosine(rows.withColumnRenamed("term", "gram"))
    assert out.count() == 800 * 799 // 2 and shuffled(spark) - before < 200_000
