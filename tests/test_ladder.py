"""Many heads fitted in one job, against Spark ML one at a time and plain cross-validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import head, ladder
from triagelake.sources.tables import checkpointed

NAMES = ("a", "b", "c", "flat")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for i in range(240):
        tier = int(rng.choice(5, p=[0.4, 0.3, 0.15, 0.1, 0.05]))
        x = rng.normal(0, 1, 3) + np.array([tier * 0.6, (tier == 4) * 2, 0])
        out.append((f"case-{i}", f"T{tier}", *map(float, x), 7.0))
    return checkpointed(spark.createDataFrame(out, "case_id string, tier string, a double, b double, c double, flat double"))


@pytest.fixture(scope="module")
def fitted(rows):
    seeds, k, rungs = (0, 3), 3, [("a",), ("a", "b", "c", "flat")]
    data = checkpointed(ladder.dealt(rows, NAMES, seeds, k).repartition(4))
    plan = ladder._plan(data, [np.array([*[NAMES.index(f) for f in names], 4]) for names in rungs], len(seeds), k, 4)
    return seeds, k, rungs, data, plan, ladder.fit_all(data, plan)


def test_folds_are_those_of_one_seed_each(rows, fitted):
    seeds, k, _, data, *_ = fitted
    got = {r["case_id"]: r["folds"] for r in data.collect()}
    for i, seed in enumerate(seeds):
        assert {r["case_id"]: r["fold"] for r in head.folds(rows, "tier", k, seed).collect()} == {c: f[i] for c, f in got.items()}


def test_weights_equal_spark_ml(rows, fitted, monkeypatch):
    """Run to its end: by default it stops at changes of 1e-6 of the loss, which leaves weights some thousandths off."""
    from pyspark.ml.classification import LogisticRegression

    seeds, k, rungs, _, plan, weights = fitted
    plain = LogisticRegression.__init__
    monkeypatch.setattr(LogisticRegression, "__init__", lambda self, **o: plain(self, **{**o, "tol": 1e-14, "maxIter": 2000}))
    for m, rung, seed, fold in plan.models():
        if fold == 0 or (seed, fold) == (1, 2):
            train = head.folds(rows, "tier", k, seeds[seed]).filter(F.col("fold") != fold)
            want = head.fit_head(train, rungs[rung], tiers=True)
            assert want.classes == head.TIERS
            coef, intercept = np.array(want.coef), np.array(want.intercept)
            assert np.abs(weights[m][:, :-1] - coef).max() < 1e-4 and np.abs(weights[m][:, -1] - (intercept - intercept.mean())).max() < 1e-4


def test_ladder_equals_cross_validation_of_each(spark, rows):
    from triagelake.operators.metrics import proper_scores, summary_scores

    got = {(r["rung"], r["seed"]): r for r in ladder.ladder(rows, {"one": ("a",), "all": NAMES}, seeds=(5,), k=3).collect()}
    assert set(got) == {("one", 5), ("all", 5)} and got["all", 5]["macro_f1"] > got["one", 5]["macro_f1"]
    scored = checkpointed(head.out_of_fold(rows, NAMES, k=3, inner=2, seed=5))
    place = lambda c: (F.array_position(F.array(*map(F.lit, head.TIERS)), F.col(c)) - 1).cast("long")
    judged = scored.select(place("tier").alias("y_true"), place("model_tier").alias("y_pred"), "probs", F.array_max("probs").alias("conf"))
    want, both = summary_scores(judged, 5).first(), proper_scores(judged).first()
    assert abs(got["all", 5]["macro_f1"] - want["macro_f1"]) < 0.02 and abs(got["all", 5]["accuracy"] - want["accuracy"]) < 0.01 and abs(got["all", 5]["brier"] - both["brier"]) < 2e-3


def test_a_tier_that_training_lacks_and_a_table_of_one_tier(spark, rows):
    rare = rows.filter("tier <> 'T4'").union(rows.filter("tier = 'T4'").limit(1))
    got = ladder.ladder(rare, {"x": ("a", "b")}, seeds=(0, 1), k=3).collect()
    assert len(got) == 2 and all(0 < r["macro_f1"] < 1 and 0 <= r["brier"] <= 2 for r in got)
    one = ladder.ladder(rows.filter("tier = 'T2'"), {"x": ("a",)}, seeds=(0,), k=2).collect()
    assert [(r["accuracy"], round(r["brier"], 9), r["macro_f1"]) for r in one] == [(1.0, 0.0, 0.2)]
