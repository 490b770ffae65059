"""The ablation ladder in one job: many small multinomial heads, one for each rung, seed and fold, fitted side by side.

A step is one pass over the cases. Each task adds up loss, gradient and Hessian of every model over its cases (a case counts for all folds of a seed but its own), the sums
of a model are added in its own group, and the group solves for Newton's step; the driver gets a few hundred numbers for each model and decides whether to take the
step or to halve the last one. So a ladder takes about ten passes, whatever its number of models, instead of some hundred for each.

The objective is that of ``head.fit_head``: balanced weights, standardised features, an L2 penalty on all weights but the intercepts. A tier that a fold's
training cases lack has probability 0. Features that are constant in training are not scaled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ranked
from ..sources.tables import checkpointed
from .head import TIERS

K = len(TIERS)
#: Tasks of a pass: each hands on the sums of all models, some hundred KB a model.
PARTS = 64
#: Holds the intercepts' common shift, which no case decides.
TINY = 1e-6
SUMS = pa.schema([("model", pa.int32()), ("loss", pa.float64()), ("grad", pa.binary()), ("hess", pa.binary())])


def dealt(rows: DataFrame, features: Sequence[str], seeds: Sequence[int], k: int) -> DataFrame:
    """(case_id, y, x, folds): features as one array and the case's fold under each seed, the same that ``head.folds`` deals."""
    each = rows.select("case_id", "tier", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    digest = F.sha1(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("case_id").cast("string")))
    placed = ranked(each.withColumn("_digest", digest), ["seed", "tier"], F.substring("_digest", 1, 3), [F.col("_digest"), F.col("case_id")])
    folds = placed.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seed", ((F.col("_rank") - 1) % k).alias("fold")))).alias("f"))
    by_seed = F.array(*[F.get("f", F.lit(sorted(seeds).index(s)))["fold"] for s in seeds])
    y = (F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) - 1).cast("int")
    return rows.select("case_id", y.alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).join(folds.select("case_id", by_seed.alias("folds")), "case_id")


@dataclass
class Plan:
    """Models in order (rung, seed, fold), what standardises a (seed, fold)'s training cases, and its tiers' weights."""

    columns: list[np.ndarray]
    seeds: int
    k: int
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def models(self) -> Iterator[tuple[int, int, int, int]]:
        n = 0
        for rung in range(len(self.columns)):
            for seed in range(self.seeds):
                for fold in range(self.k):
                    yield n, rung, seed, fold
                    n += 1

    def scaled(self, x: np.ndarray, seed: int, fold: int) -> np.ndarray:
        """Standardised features with a 1 behind them."""
        return np.hstack(((x - self.mean[seed, fold]) / self.scale[seed, fold], np.ones((len(x), 1))))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    flat = lambda c: np.asarray(batch.column(c).flatten()).reshape(n, -1)
    return np.asarray(batch.column("y")), flat("x"), flat("folds")


def _plan(data: DataFrame, columns: list[np.ndarray], seeds: int, k: int, d: int) -> Plan:
    """From one pass of sums by seed and fold: a table of seeds x folds rows, as wide as the features."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((seeds, k, K + 2 * d))
        for batch in batches:
            if batch.num_rows:
                y, x, folds = _arrays(batch)
                row = np.hstack((np.eye(K)[y], x, x * x))
                for s in range(seeds):
                    np.add.at(total[s], folds[:, s], row)
        s, f = np.divmod(np.arange(seeds * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(f, pa.int32()), pa.array(list(total.reshape(seeds * k, -1)), pa.list_(pa.float64()))], names=["seed", "fold", "v"])

    each = data.mapInArrow(sums, "seed int, fold int, v array<double>").select("seed", "fold", F.posexplode("v").alias("i", "v"))
    found = each.groupBy("seed", "fold", "i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((seeds, k, K + 2 * d))
    total[np.asarray(found["seed"]), np.asarray(found["fold"]), np.asarray(found["i"])] = np.asarray(found["v"])
    train = total.sum(axis=1, keepdims=True) - total
    counts, n = train[..., :K], train[..., :K].sum(axis=-1, keepdims=True)
    mean = train[..., K : K + d] / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(train[..., K + d :] / np.maximum(n, 1) - mean * mean, 0))
    # What a sum of squares leaves of a constant is no spread.
    scale = np.where(spread > 1e-9 * np.maximum(1, np.abs(mean)), spread, 1.0)
    present = np.maximum((counts > 0).sum(axis=-1, keepdims=True), 1)
    return Plan(columns, seeds, k, mean, scale, np.where(counts > 0, n / (present * np.maximum(counts, 1)), 0.0))


def _chances(x: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    logits = np.where(weight > 0, x @ w.T, -np.inf)
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _step(data: DataFrame, plan: Plan, weights: list[np.ndarray], penalty: float) -> list[tuple[float, np.ndarray]]:
    """Loss at the weights and Newton's step from there, of each model."""
    shared = data.sparkSession.sparkContext.broadcast((plan, weights))
    classes_in_all = plan.weight.shape[-1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        out = [(np.zeros(1), np.zeros(w.shape), np.zeros((w.size, w.size))) for w in weights]
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x, folds = _arrays(batch)
            held = {}
            for m, rung, seed, fold in plan.models():
                if (seed, fold) not in held:
                    mine = folds[:, seed] != fold
                    held[seed, fold] = mine, plan.scaled(x[mine], seed, fold)
                mine, full = held[seed, fold]
                own, w, classes = full[:, plan.columns[rung]], weights[m], plan.weight[seed, fold]
                p, t, cost = _chances(own, w, classes), y[mine], classes[y[mine]]
                loss, grad, hess = out[m]
                loss -= (cost * np.log(np.maximum(p[np.arange(len(t)), t], 1e-300))).sum()
                grad += (cost[:, None] * (p - np.eye(classes_in_all)[t])).T @ own
                wide = w.shape[1]
                for a in range(classes_in_all):
                    for b in range(a, classes_in_all):
                        part = own.T @ ((cost * p[:, a] * ((a == b) - p[:, b]))[:, None] * own)
                        hess[a * wide : (a + 1) * wide, b * wide : (b + 1) * wide] += part
                        if a != b:
                            hess[b * wide : (b + 1) * wide, a * wide : (a + 1) * wide] += part
        for m, (loss, grad, hess) in enumerate(out):
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array(loss), pa.array([grad.tobytes()], pa.binary()), pa.array([hess.tobytes()], pa.binary())], schema=SUMS)

    def solve(table: pa.Table) -> pa.Table:
        m = table["model"][0].as_py()
        w = shared.value[1][m]
        added = lambda c: np.sum([np.frombuffer(v, np.float64) for v in table[c].to_pylist()], axis=0)
        ridge = np.full(w.shape, penalty)
        ridge[:, -1] = TINY
        grad = added("grad") + (ridge * w).ravel()
        step = np.linalg.solve(added("hess").reshape(w.size, w.size) + np.diag(ridge.ravel()), grad)
        loss = sum(table["loss"].to_pylist()) + 0.5 * (ridge * w * w).sum()
        return pa.Table.from_arrays([pa.array([m], pa.int32()), pa.array([float(loss)]), pa.array([(-step).tobytes()], pa.binary())], names=["model", "loss", "step"])

    rows = data.mapInArrow(sums, "model int, loss double, grad binary, hess binary").groupBy("model").applyInArrow(solve, "model int, loss double, step binary").toArrow().to_pylist()
    return [(r["loss"], np.frombuffer(r["step"], np.float64).reshape(weights[r["model"]].shape)) for r in sorted(rows, key=lambda r: r["model"])]


def fit_all(data: DataFrame, plan: Plan, c: float = 0.5, close: float = 1e-7, rounds: int = 50) -> list[np.ndarray]:
    """Weights of all models, one row for each tier, the intercept last. A step that made a model worse is halved."""
    weights = [np.zeros((plan.weight.shape[-1], len(plan.columns[rung]))) for _, rung, _, _ in plan.models()]
    base, best = list(weights), [np.inf] * len(weights)
    for _ in range(rounds):
        moved = 0.0
        for m, (loss, step) in enumerate(_step(data, plan, weights, 1 / c)):
            if loss <= best[m] + 1e-9 * max(1.0, abs(loss)):
                base[m], best[m], weights[m] = weights[m], loss, weights[m] + step
            else:
                weights[m] = (weights[m] + base[m]) / 2
            moved = max(moved, float(np.abs(weights[m] - base[m]).max()))
        if moved < close:
            break
    # Only differences between intercepts count: they add up to 0.
    return [np.hstack((w[:, :-1], w[:, -1:] - w[:, -1].mean())) for w in weights]


def scores(data: DataFrame, plan: Plan, weights: list[np.ndarray]) -> DataFrame:
    """(rung, seed, y_true, y_pred, n, brier): cells of each ladder entry's confusion, every case judged by the model that never saw it."""
    shared = data.sparkSession.sparkContext.broadcast((plan, weights))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        cells = np.zeros((len(plan.columns), plan.seeds, K, K, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x, folds = _arrays(batch)
            for m, rung, seed, fold in plan.models():
                mine = folds[:, seed] == fold
                p, t = _chances(plan.scaled(x[mine], seed, fold)[:, plan.columns[rung]], weights[m], plan.weight[seed, fold]), y[mine]
                apart = ((p - np.eye(K)[t]) ** 2).sum(axis=1)
                np.add.at(cells[rung, seed], (t, p.argmax(axis=1)), np.stack((np.ones(len(t)), apart), axis=1))
        at = np.argwhere(cells[..., 0] > 0)
        found = cells[tuple(at.T)]
        yield pa.RecordBatch.from_arrays([*(pa.array(at[:, i], pa.int32()) for i in range(4)), pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 1])], names=["rung", "seed", "y_true", "y_pred", "n", "brier"])

    each = data.mapInArrow(judge, "rung int, seed int, y_true int, y_pred int, n long, brier double")
    return each.groupBy("rung", "seed", "y_true", "y_pred").agg(F.sum("n").alias("n"), F.sum("brier").alias("brier"))


def ladder(rows: DataFrame, rungs: dict[str, tuple[str, ...]], seeds: tuple[int, ...] = tuple(range(10)), k: int = 5, c: float = 0.5) -> DataFrame:
    """(rung, seed, macro_f1, accuracy, brier) of ``rows`` (case_id, tier, features): each set of features cross-validated under each seed."""
    features = sorted({f for names in rungs.values() for f in names})
    data = checkpointed(dealt(rows, features, seeds, k).coalesce(PARTS))
    columns = [np.array([*[features.index(f) for f in names], len(features)]) for names in rungs.values()]
    plan = _plan(data, columns, len(seeds), k, len(features))
    cells = checkpointed(scores(data, plan, fit_all(data, plan, c)))
    by = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    each = cells.withColumn("label", F.explode(F.array_distinct(F.array("y_true", "y_pred"))))
    per = each.groupBy("rung", "seed", "label").agg(by(F.col("y_true") == F.col("y_pred")).alias("hit"), by(F.col("y_true") == F.col("label")).alias("support"), by(F.col("y_pred") == F.col("label")).alias("predicted"))
    # 2 x hit over both sizes is the harmonic mean of precision and recall; a tier that nothing has or gets counts as 0.
    f1 = per.groupBy("rung", "seed").agg((F.sum(2 * F.col("hit") / (F.col("support") + F.col("predicted"))) / K).alias("macro_f1"))
    whole = cells.groupBy("rung", "seed").agg((by(F.col("y_true") == F.col("y_pred")) / F.sum("n")).alias("accuracy"), (F.sum("brier") / F.sum("n")).alias("brier"))
    named = F.get(F.array(*map(F.lit, rungs)), F.col("rung")).alias("rung")
    return f1.join(whole, ["rung", "seed"]).select(named, F.get(F.array(*map(F.lit, seeds)), F.col("seed")).alias("seed"), "macro_f1", "accuracy", "brier")
