"""The largest lexical score of all pairs, found without forming most of them."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import cluster
from triagelake.plans import standins as S
from triagelake.sources.tables import checkpointed


def exact(parts):
    return cluster._scores(parts).agg(F.max("bm25")).first()[0] or 0.0


@pytest.mark.parametrize("seed", range(4))
def test_best_score_equals_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        n = rng.choice([1, 3, 20, 60])
        rows += [(f"c{c:02d}", f"t{int(rng.paretovariate(0.7)) % (40 if seed % 2 else 400)}") for _ in range(n)]
    if seed == 2:
        rows += [(f"copy{i}", f"only{j}") for i in range(5) for j in range(30)]
    if seed == 3:
        rows = [(c, f"{c}-{t}") for c, t in rows]  # no two cases share a term
    parts = checkpointed(cluster._term_parts(spark.createDataFrame(rows, "case_id string, term string")))
    assert cluster.best_bm25(parts).first()["top"] == pytest.approx(exact(parts), rel=1e-12)


def test_under_a_tenth_of_all_pairs_is_formed(spark):
    words = S.turns(spark, "/root/testdata/sf0.1").select("case_id", F.explode(T.word_tokens(F.col("text"))).alias("term"))
    parts = checkpointed(cluster._term_parts(words))
    index, n = checkpointed(cluster.term_index(parts)), parts.select("case_id").distinct().count()
    seeds = cluster.bm25_seeds(index)
    found = cluster._scores(parts, seeds).agg(F.max("bm25")).first()[0]
    formed = seeds.union(cluster.bm25_candidates(index, found, formed=True)).distinct().count()
    assert n == 1000 and formed < 0.1 * n * (n - 1) / 2
    assert cluster.best_bm25(parts).first()["top"] == pytest.approx(exact(parts), rel=1e-12)


def test_no_cases_and_one_case_have_no_best(spark):
    words = spark.createDataFrame([("a", "x"), ("a", "y")], "case_id string, term string")
    for rows in (words, words.limit(0)):
        assert cluster.best_bm25(cluster._term_parts(rows)).first()["top"] == 0.0


DAY = datetime.datetime(2026, 1, 1)


def test_a_crowded_slot_is_cut_and_its_links_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    when = {f"c{i:03d}": DAY + datetime.timedelta(days=rng.choice([0, 1, 5, 13.5, 14, 20, 27.9])) for i in range(150)}
    cases = spark.createDataFrame(list(when.items()), "case_id string, started_at timestamp")
    tokens = spark.createDataFrame([(c, "person", "hot") for c in when] + [(c, "place", f"p{i % 40}") for i, c in enumerate(when)], "case_id string, kind string, token string")
    key = lambda rows: sorted((r["a"], r["b"], r["days_apart"], tuple(r["shared_people"]), tuple(r["shared_places"])) for r in rows.collect())
    whole = key(cluster.links(tokens, cases))
    want = {(a, b) for a in when for b in when if a < b and abs((when[a] - when[b]).total_seconds()) <= 14 * 86400}
    assert {(a, b) for a, b, *_ in whole} == want and len(whole) == len(want)
    monkeypatch.setattr(cluster, "CROWD", 16)
    assert key(cluster.links(tokens, cases)) == whole
    counted = {(r["kind"], r["token"]): (r["n_cases"], r["n_links"]) for r in cluster.link_counts(tokens, cases, parts=7).collect()}
    assert counted["person", "hot"] == (150, len(want))
    assert sum(n for (kind, _), (_, n) in counted.items() if kind == "place") == sum(len(p[4]) for p in whole)


def test_links_of_100_000_cases_of_one_token_are_counted_by_part(spark):
    n, width = 100_000, 14 * 86_400_000_000
    cases = spark.range(n).select(F.concat(F.lit("c"), "id").alias("case_id"), F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.pmod(F.xxhash64("id"), F.lit(3 * width))).alias("started_at"), "id")
    tokens = cases.select("case_id", F.lit("person").alias("kind"), F.lit("hot").alias("token"))
    got = cluster.link_counts(tokens, cases).first()
    t = np.sort(np.array([r[0] for r in cases.select(F.unix_micros("started_at")).collect()]))
    assert (got["n_cases"], got["n_links"]) == (n, int((np.searchsorted(t, t + width, side="right") - np.arange(n) - 1).sum()))
    same = cluster.link_counts(tokens, cases.withColumn("started_at", F.lit(DAY).cast("timestamp"))).first()
    assert same["n_links"] == n * (n - 1) // 2
    # Rows of the crowded slots are dealt over parts: none of them holds more than a few times its share.
    parts = cases.groupBy(F.expr(f"pmod(unix_micros(started_at), {width}) * {cluster.PARTS} div {width}").alias("part")).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert parts[1] == cluster.PARTS and parts[0] < 3 * n / cluster.PARTS


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    least = {}
    for x in root:
        least[find(x)] = min(x, least.get(find(x), x))
    return {x: least[find(x)] for x in root}


@pytest.mark.parametrize("shape", ["path", "star", "random", "copies", "none"])
def test_components_by_contraction(spark, shape):
    rng = random.Random(7)
    n = 2000
    name = lambda i: f"n{i * 7919 % n:05d}"
    edges = {
        "path": [(name(i), name(i + 1)) for i in range(n - 1)], "star": [("n01234", f"m{i:05d}") for i in range(n)], "none": [],
        "random": [(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(1200)], "copies": [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("d", "e"), ("e", "f"), ("d", "d")],
    }[shape]
    got = {r["node"]: r["component"] for r in cluster.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == plain_components(edges)
