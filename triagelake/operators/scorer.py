"""The seam to a turn classifier: whatever gives logits by turn plugs in, and what it fails to give is null, so that triage goes on by the gate alone.

A scorer maps turns (case_id, turn, text) to (case_id, turn, logits, failed): logits of ``width`` classes, or null and how it failed. ``batched`` runs a model
in Arrow batches, loaded once in each worker process; ``from_logits`` reads what a model wrote elsewhere; ``from_baseline`` is the text baseline. ``scored`` checks
the numbers and scales them by a fitted temperature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import softmax

WIDTH = 6
#: Seconds after which a batch is given up, and how many turns it has.
SECONDS, BATCH = 4.0, 32
#: Fixed values. What may come of a request.
OUTCOMES = ("scored", "timeout", "unavailable", "bad_response", "not_configured")

Scorer = Callable[[DataFrame], DataFrame]
Predict = Callable[[Sequence[str]], np.ndarray]


def batched(load: Callable[[], Predict], width: int = WIDTH, seconds: float = SECONDS, batch: int = BATCH) -> Scorer:
    """A model that ``load`` builds, once in each worker: texts to an array of n x ``width`` logits.

    A batch that takes too long, raises, or has another shape has no logits; a model that cannot be loaded has none for any. The turns of other batches keep theirs.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        from concurrent.futures import ThreadPoolExecutor

        try:
            predict = load()
        except Exception:  # noqa: BLE001  a model that is not there must not stop triage
            predict = None
        pool = [ThreadPoolExecutor(1)]

        def run(texts: np.ndarray) -> np.ndarray:
            out = np.full((len(texts), width + 1), np.nan)
            out[:, width] = OUTCOMES.index("unavailable")
            if predict is None:
                return out
            try:
                found = np.asarray(pool[0].submit(predict, ["" if t is None else str(t) for t in texts]).result(seconds), dtype=np.float64)
            except TimeoutError:
                out[:, width] = OUTCOMES.index("timeout")
                pool[0].shutdown(wait=False)
                pool[0] = ThreadPoolExecutor(1)
                return out
            except Exception:  # noqa: BLE001
                return out
            if found.shape != (len(texts), width):
                out[:, width] = OUTCOMES.index("bad_response")
                return out
            return np.hstack((found, np.zeros((len(texts), 1))))

        return run

    def score(turns: DataFrame) -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, DoubleType

        run = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch)
        asked = turns.select("case_id", "turn", run(F.coalesce("text", F.lit(""))).alias("_out"))
        code = F.get("_out", F.lit(width)).cast("int")
        return asked.select("case_id", "turn", F.when(code == 0, F.slice("_out", 1, width)).alias("logits"), F.when(code > 0, F.get(F.array(*map(F.lit, OUTCOMES)), code)).alias("failed"))

    return score


def from_logits(logits: DataFrame) -> Scorer:
    """What was written before: (case_id, turn, logits). A turn that is not there is unavailable."""

    def score(turns: DataFrame) -> DataFrame:
        found = logits.select("case_id", "turn", "logits", F.lit(True).alias("_had"))
        return turns.select("case_id", "turn").join(found, ["case_id", "turn"], "left").select("case_id", "turn", "logits", F.when(F.col("_had").isNull(), "unavailable").alias("failed"))

    return score


def from_baseline(model, labels: Sequence[str]) -> Scorer:
    """The text baseline (``head.TextBaseline``); a label that it never saw has no chance."""

    def score(turns: DataFrame) -> DataFrame:
        place = {label: i for i, label in enumerate(model.labels)}
        chance = lambda label: F.log(F.greatest(F.get("probs", F.lit(place[label])), F.lit(1e-30))) if label in place else F.lit(-100.0)
        return model.predict(turns.select("case_id", "turn", "text")).select("case_id", "turn", F.array(*map(chance, labels)).alias("logits"), F.lit(None).cast("string").alias("failed"))

    return score


def _sound(logits: Column, width: int) -> Column:
    return (F.size(logits) == width) & F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scored(turns: DataFrame, scorer: Scorer | None, width: int = WIDTH, temperature: float = 1.0) -> DataFrame:
    """``turns`` with ``probs``, null where there are none, and the ``outcome``. Without a scorer nothing is configured, which is no fault."""
    if scorer is None:
        return turns.withColumn("probs", F.lit(None).cast("array<double>")).withColumn("outcome", F.lit("not_configured"))
    answers = scorer(turns).select(F.col("case_id").alias("_case"), F.col("turn").alias("_turn"), "logits", "failed")
    both = turns.join(answers, (F.col("case_id") == F.col("_case")) & (F.col("turn") == F.col("_turn")), "left")
    outcome = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.coalesce(_sound(F.col("logits"), width), F.lit(False)), "scored").when(F.col("_case").isNull(), "unavailable").otherwise("bad_response")
    probs = F.when(F.col("outcome") == "scored", softmax(F.col("logits"), temperature))
    return both.withColumn("outcome", outcome).withColumn("probs", probs).drop("_case", "_turn", "logits", "failed")


def outcomes(rows: DataFrame) -> DataFrame:
    """How many turns came to what."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
