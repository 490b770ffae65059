"""The seam to a turn classifier: what plugs in, what fails, and what fails stays apart."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import head, scorer


@pytest.fixture
def turns(spark):
    return spark.createDataFrame([(f"c{i % 5}", i // 5, t) for i, t in enumerate(["calm words here", "slow", "wrong", "nan", None, "calm again", "broken", "", "calm", "x" * 5000])], "case_id string, turn int, text string").repartition(1)


def model(count=None):
    def load():
        if count:
            with open(count, "a") as f:
                f.write("x")

        def predict(texts):
            if "slow" in texts:
                time.sleep(20)
            if "broken" in texts:
                raise RuntimeError("lost")
            if "wrong" in texts:
                return np.zeros((len(texts), 2))
            out = np.tile(np.array([float(len(t) % 7) for t in texts])[:, None], (1, 6)) * np.arange(6)
            out[[t == "nan" for t in texts]] = np.nan
            return out

        return predict

    return load


def test_failures_are_null_and_named(turns):
    got = {(r["case_id"], r["turn"]): r for r in scorer.scored(turns, scorer.batched(model(), seconds=2, batch=1), temperature=2.0).collect()}
    assert [got[f"c{i % 5}", i // 5]["outcome"] for i in range(10)] == ["scored", "timeout", "bad_response", "bad_response", "scored", "scored", "unavailable", "scored", "scored", "scored"]
    for (c, t), r in got.items():
        assert (r["probs"] is None) == (r["outcome"] != "scored")
        if r["probs"] is not None:
            z = np.arange(6) * (len(r["text"] or "") % 7) / 2
            assert np.allclose(r["probs"], np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert {r["outcome"]: r["n"] for r in scorer.outcomes(scorer.scored(turns, None)).collect()} == {"not_configured": 10}


def test_a_model_is_loaded_once_and_one_that_is_missing_stops_nothing(spark, turns, tmp_path):
    many = spark.range(500).select(F.lit("c").alias("case_id"), F.col("id").cast("int").alias("turn"), F.lit("calm").alias("text")).repartition(4)
    path = str(tmp_path / "loads")
    assert scorer.outcomes(scorer.scored(many, scorer.batched(model(path), batch=8))).collect()[0]["n"] == 500
    assert os.path.getsize(path) <= 4  # workers, not batches

    def missing():
        raise FileNotFoundError("no checkpoint")

    assert {r["outcome"] for r in scorer.scored(turns, scorer.batched(missing)).collect()} == {"unavailable"}


def test_written_logits_and_the_text_baseline_plug_in(spark, turns):
    written = spark.createDataFrame([("c0", 0, [0.0] * 6), ("c1", 0, [0.0] * 5), ("c2", 0, None), ("c3", 0, [float("inf")] + [0.0] * 5)], "case_id string, turn int, logits array<double>")
    got = {(r["case_id"], r["turn"]): r for r in scorer.scored(turns, scorer.from_logits(written)).collect()}
    assert got["c0", 0]["probs"] == pytest.approx([1 / 6] * 6) and got["c4", 0]["outcome"] == "unavailable"
    assert {got[c, 0]["outcome"] for c in ("c1", "c2", "c3")} == {"bad_response"}
    said = [(i, f"{'good kind words' if i % 2 else 'bad cruel words'} number {i % 4}", "none" if i % 2 else "threat") for i in range(40)]
    fitted = head.fit_text_baseline(spark.createDataFrame(said, "row_id int, text string, label string"))
    labels = ("none", "distress", "harassment", "identity_attack", "threat", "self_harm")
    asked = spark.createDataFrame([("a", 0, "kind good words"), ("a", 1, "cruel bad words"), ("a", 2, None)], "case_id string, turn int, text string")
    out = {r["turn"]: r for r in scorer.scored(asked, scorer.from_baseline(fitted, labels)).collect()}
    assert {r["outcome"] for r in out.values()} == {"scored"}
    assert np.argmax(out[0]["probs"]) == 0 and np.argmax(out[1]["probs"]) == 4 and out[0]["probs"][1] < 1e-20 and sum(out[2]["probs"]) == pytest.approx(1)


def test_weights_by_batch_equal_those_by_row(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    vocabulary = [f"t{i}" for i in range(50)]
    idf = rng.random(50) + 1
    rows = [[f"t{int(v)}" for v in rng.integers(0, 70, rng.integers(0, 40))] for _ in range(60)] + [[], None]
    row, place, value = head.weighted_terms(pa.array(rows, pa.list_(pa.string())), pa.array(vocabulary), idf)
    for i, terms in enumerate(rows):
        counts = {t: (terms or []).count(t) for t in vocabulary if t in (terms or [])}
        want = {vocabulary.index(t): (1 + np.log(n)) * idf[vocabulary.index(t)] for t, n in counts.items()}
        size = np.sqrt(sum(v * v for v in want.values())) or 1
        assert {p: pytest.approx(v / size) for p, v in want.items()} == dict(zip(place[row == i].tolist(), value[row == i].tolist(), strict=True))
