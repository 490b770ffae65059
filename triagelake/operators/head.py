"""The conversation head: fits, plain parameters, and their application as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import hash_ranked
from ..functions.text import interpolate, softmax, word_list, word_runs
from ..sources.tables import checkpointed

TIERS = ("T0", "T1", "T2", "T3", "T4")
RISKY = ("T3", "T4")
OVERRIDE_AT = 0.70
#: Bytes of words whose terms are listed at once; tasks of a pass of the text model's fit, each of which hands on a sum for each weight.
SLICE, PARTS = 1 << 20, 64


@dataclass(frozen=True)
class HeadParams:
    """What scoring needs: as plain as JSON. Rows of ``coef`` follow ``classes``."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    classes: tuple[str, ...]
    coef: tuple[tuple[float, ...], ...]
    intercept: tuple[float, ...]
    ranker: tuple[float, ...]
    ranker_intercept: float
    knots: tuple[float, ...] = (0.0, 1.0)
    levels: tuple[float, ...] = (0.0, 1.0)


def _dot(scaled: list[Column], weights: tuple[float, ...], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for x, w in zip(scaled, weights, strict=True):
        if w:
            total = total + x * float(w)
    return total


def apply_head(features: DataFrame, p: HeadParams) -> DataFrame:
    """probs by class, the model's tier (the lower one on ties), raw and calibrated escalation: column expressions only."""
    scaled = [(F.col(f) - float(m)) / float(s or 1.0) for f, m, s in zip(p.features, p.mean, p.scale, strict=True)]
    logits = F.array(*[_dot(scaled, w, b) for w, b in zip(p.coef, p.intercept, strict=True)])
    raw = 1 / (1 + F.exp(-_dot(scaled, p.ranker, p.ranker_intercept)))
    out = features.withColumn("probs", softmax(logits)).withColumn("raw_escalation", raw)
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    clipped = F.least(F.greatest(F.col("raw_escalation"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("model_tier", F.element_at(F.array(*map(F.lit, p.classes)), best)).withColumn("confidence", F.array_max("probs")).withColumn("escalation", interpolate(clipped, list(p.knots), list(p.levels)))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(counts.crossJoin(totals)), label).withColumn("weight", F.col("_total") / (F.col("_k") * F.col("_n"))).drop("_n", "_total", "_k")


def fit_head(rows: DataFrame, features: tuple[str, ...], c_tier: float = 0.5, c_ranker: float = 1.0, tiers: bool = True) -> HeadParams:
    """Standardise by population moments, then a balanced multinomial tier model (unless ``tiers`` is false) and a balanced binary T3+T4 ranker.

    Both by Newton's steps (``ladder.fit_all``), each one pass over the cases: some ten passes instead of hundreds.
    """
    from . import ladder

    k = len(features)
    held = checkpointed(rows.select("tier", F.array(*[F.col(f).cast("double") for f in features]).alias("x")).coalesce(ladder.PARTS))
    counts = {r["tier"]: r["n"] for r in held.groupBy("tier").agg(F.count("*").alias("n")).orderBy("tier").collect()}
    if not counts or None in counts:
        raise ValueError("there are no cases, or some without a tier")
    each = held.select(F.posexplode("x").alias("i", "v"))
    bad = F.count_if(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf")))
    facts = each.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"), bad.alias("bad")).orderBy("i").collect()
    if broken := [f for f, r in zip(features, facts, strict=True) if r["bad"]]:
        raise ValueError(f"features that are not finite: {', '.join(broken)}")
    mean, scale = np.array([r["mean"] for r in facts]), np.array([r["spread"] for r in facts])
    scale = np.where(scale > 1e-9 * np.maximum(1, np.abs(mean)), scale, 1.0)

    def fitted(y: Column, sizes: list[int], c: float) -> np.ndarray:
        """Weights of each class, the intercept last; balanced, and no fold held out."""
        n = np.array(sizes, dtype=float)
        plan = ladder.Plan([np.arange(k + 1)], 1, 1, mean.reshape(1, 1, k), scale.reshape(1, 1, k), (n.sum() / (len(n) * n)).reshape(1, 1, -1))
        return ladder.fit_all(held.select(y.cast("int").alias("y"), "x", F.array(F.lit(1)).alias("folds")), plan, c)[0]

    classes, kinds = tuple(counts), [sum(n for t, n in counts.items() if (t in RISKY) == risky) for risky in (False, True)]
    if tiers:
        tier = fitted(F.array_position(F.array(*map(F.lit, classes)), F.col("tier")) - 1, list(counts.values()), c_tier)
    else:
        tier = np.zeros((len(classes), k + 1))
    if all(kinds):
        # Of two classes with opposite weights, each has half of the difference: at twice the penalty the difference is the one model's.
        none, some = fitted(F.col("tier").isin(*RISKY), kinds, c_ranker / 2)
        rank = some - none
    else:
        rank = np.append(np.zeros(k), np.inf if kinds[1] else -np.inf)
    plain = lambda v: tuple(float(x) for x in v)
    return HeadParams(tuple(features), plain(mean), plain(scale), classes, tuple(map(plain, tier[:, :-1])), plain(tier[:, -1]), plain(rank[:-1]), float(rank[-1]))


def out_of_fold(rows: DataFrame, features: tuple[str, ...], k: int = 5, inner: int = 4, seed: int = 0) -> DataFrame:
    """(case_id, tier, fold, probs, model_tier, raw_escalation, escalation): every case scored by a head that never saw it.

    ``probs`` follow the tier axis T0 to T4, a tier absent from a fold's training cases at 0. Escalation is calibrated by an isotonic map
    fitted on inner out-of-fold scores of the training cases alone; where these are of one kind only, it stays raw. Folds are fitted side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    dealt = checkpointed(folds(rows.select("case_id", "tier", *features), "tier", k, seed))

    def one(fold: int) -> DataFrame:
        train, test = dealt.filter(F.col("fold") != fold), dealt.filter(F.col("fold") == fold)
        params = fit_head(train, features)
        within = checkpointed(folds(train.drop("fold").withColumn("risky", F.col("tier").isin(*RISKY)), "risky", inner, seed))
        kinds = within.select("risky").distinct().count()
        if kinds == 2:
            parts = [apply_head(within.filter(F.col("fold") == i), fit_head(within.filter(F.col("fold") != i), features, tiers=False)) for i in range(inner)]
            scores = reduce(DataFrame.unionByName, parts)
            knots, levels = fit_isotonic(scores.select(F.col("raw_escalation").alias("score"), F.col("risky").cast("double").alias("label")))
            params = replace(params, knots=tuple(knots), levels=tuple(levels))
        scored = apply_head(test, params)
        aligned = F.array(*[F.get("probs", F.lit(params.classes.index(t))) if t in params.classes else F.lit(0.0) for t in TIERS])
        raw = F.col("raw_escalation")
        return scored.select("case_id", "tier", "fold", aligned.alias("probs"), "model_tier", raw, (F.col("escalation") if kinds == 2 else raw).alias("escalation"))

    with ThreadPoolExecutor(k) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(k)))


def fit_isotonic(rows: DataFrame, score: str = "score", label: str = "label", bins: int = 1000) -> tuple[list[float], list[float]]:
    """Knots and levels of the isotonic map from score (0 to 1) to rate.

    Scores are first pooled in ``bins`` equal parts (mean score, mean label, weight), so neither the fit nor its knots grow with the rows.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    own = rows.select(F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0)).alias("_score"), F.col(label).cast("double").alias("label"))
    pooled = own.groupBy(F.least(F.floor(F.col("_score") * bins), F.lit(bins - 1)).alias("_bin")).agg(F.avg("_score").alias("_score"), F.avg("label").alias("label"), F.count("*").cast("double").alias("_weight"))
    model = IsotonicRegression(featuresCol="_features", labelCol="label", weightCol="_weight").fit(VectorAssembler(inputCols=["_score"], outputCol="_features").transform(pooled))
    return [float(b) for b in model.boundaries], [float(v) for v in model.predictions]


def folds(rows: DataFrame, label: str, k: int = 5, seed: int = 0, row_id: str = "case_id") -> DataFrame:
    """Stratified folds: place in hash order within the class, modulo k."""
    return hash_ranked(rows, [label], row_id, f"{seed}:").withColumn("fold", (F.col("_rank") - 1) % k).drop("_rank", "_size")


def decide_case(scored: DataFrame) -> DataFrame:
    """Final tier of scored cases joined with their verdicts: the model's, ceiling unless P(T4) allows, then floor; and the queue rank."""
    from .gate import apply_verdict

    rank = lambda c: F.substring(c, 2, 1).cast("int")
    override = (F.col("model_tier") == "T4") & (F.element_at("probs", -1) >= OVERRIDE_AT)
    names = F.coalesce(F.col("names"), F.lit("")) if "names" in scored.columns else F.lit("")
    tier, reason = apply_verdict(rank("model_tier"), rank("floor"), rank("ceiling"), override, names)
    out = scored.withColumn("tier", F.concat(F.lit("T"), tier.cast("string"))).withColumn("floor_reason", reason)
    return out.withColumn("queue_rank", F.coalesce(rank("floor"), F.lit(0)) + F.least(F.greatest(F.col("escalation"), F.lit(0.0)), F.lit(1.0)))


def rank_features(p: HeadParams) -> list[tuple[str, float]]:
    """Features by mean absolute weight over classes: as many as the model has, on the driver."""
    weight = [sum(abs(row[i]) for row in p.coef) / len(p.coef) for i in range(len(p.features))]
    return sorted(zip(p.features, weight, strict=True), key=lambda x: (-x[1], x[0]))


def majority(rows: DataFrame, label: str) -> DataFrame:
    """The most frequent class, first in order on ties."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


@dataclass
class Vocabulary:
    """Terms by their place."""

    vocabulary: list[str]


@dataclass
class TextBaseline:
    """A fitted text model: both vocabularies, their idf, and the classifier, whose classes are ``labels`` in order."""

    words: Vocabulary
    chars: Vocabulary
    idf: tuple
    model: object
    labels: tuple[str, ...]

    def vectors(self, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``rows`` (text) with ``x``: 1 + ln(count) times idf, words and characters each of unit length; ``keep``: only these columns beside it.

        Words are the JVM's; each slice of them is counted, looked up and weighed at once, as a matrix in rows of (place, value).
        """
        from pyspark.ml.linalg import VectorUDT
        from pyspark.sql.types import StructField, StructType

        shared = rows.sparkSession.sparkContext.broadcast((pa.array(self.words.vocabulary, pa.string()), pa.array(self.chars.vocabulary, pa.string()), self.idf))
        kept = list(rows.columns) if keep is None else keep

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *vocabularies, idf = shared.value
            for batch in _slices(batches):
                parts = []
                for (row, term, count, names), vocabulary, own in zip(counted_terms(batch), vocabularies, idf, strict=True):
                    place = pc.index_in(names, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[term]
                    order = np.argsort((row * max(1, len(vocabulary)) + place)[known := place >= 0], kind="stable")
                    parts.append(_weighed(*(v[known][order] for v in (row, place, count)), own, batch.num_rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _rows_of_matrices(parts, batch.num_rows, [len(i) for i in idf])], names=[*kept, "x"])

        return with_words(rows).select(*kept, "_words", "_runs").mapInArrow(weigh, StructType([*(rows.schema[c] for c in kept), StructField("x", VectorUDT())]))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the predicted label and the probabilities of all labels."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self.vectors(rows))
        return out.withColumn("predicted", F.element_at(F.array(*map(F.lit, self.labels)), F.col("prediction").cast("int") + 1)).withColumn("probs", vector_to_array("probability")).drop("x", "rawPrediction", "probability", "prediction")


def with_words(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return rows.withColumn("_words", word_list(text)).withColumn("_runs", word_runs(text))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut after every ``SLICE`` bytes of words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("_runs")
        bytes_to = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(runs.flatten()), dtype=np.int64))))
        upto = bytes_to[np.cumsum(np.asarray(pc.list_value_length(runs), dtype=np.int64))]
        begin = 0
        for end in np.flatnonzero(np.diff(upto // SLICE, append=-1)) + 1:
            yield batch.slice(begin, end - begin)
            begin = end


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each string, and the strings by code."""
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    coded = lists.flatten().dictionary_encode()
    return row, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def _counted(row: np.ndarray, term: np.ndarray, names: pa.Array, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, count, names) of different terms of each row, in order."""
    width = max(1, len(names))
    if weight is None:
        keys, count = np.unique(row * width + term, return_counts=True)
    else:
        keys, at = np.unique(row * width + term, return_inverse=True)
        count = np.bincount(at, weight, len(keys)).astype(np.int64)
    return *np.divmod(keys, width), count, names


def counted_terms(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """What ``word_terms`` and ``char_terms`` list, counted: (row, term, count, names) of each; grams are cut from different words only."""
    row, word, names = _coded(batch.column("_words"))
    near = row[1:] == row[:-1]
    pairs, pair = np.unique((word[:-1] * max(1, len(names)) + word[1:])[near], return_inverse=True)
    both = pc.binary_join_element_wise(*(names.take(pa.array(p)) for p in np.divmod(pairs, max(1, len(names)))), " ")
    words = _counted(np.concatenate((row, row[:-1][near])), np.concatenate((word, pair + len(names))), pa.concat_arrays([names, both]))

    row, run, count, names = _counted(*_coded(batch.column("_runs")))
    grams: list[str] = []
    ends = [0]
    for name in names.to_pylist():
        spaced = f" {name} "
        grams += [spaced[i : i + n] for n in (3, 4, 5) for i in range(len(spaced) - n + 1)]
        ends.append(len(grams))
    coded = pa.array(grams, pa.string()).dictionary_encode()
    begin = np.array(ends)
    many = np.diff(begin)[run]
    at = np.arange(many.sum()) + np.repeat(begin[run] - (np.cumsum(many) - many), many)
    return [words, _counted(np.repeat(row, many), np.asarray(coded.indices, dtype=np.int64)[at], coded.dictionary, np.repeat(count, many))]


def _weighed(row: np.ndarray, place: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = (1 + np.log(count)) * idf[place]
    size = np.sqrt(np.bincount(row, value * value, minlength=rows))
    return row, place, value / np.where(size > 0, size, 1.0)[row]


def weighted_terms(terms: pa.Array, vocabulary: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the terms of the vocabulary in each row: (1 + ln(count)) idf, of unit length by row, in order."""
    lengths = np.asarray(pc.list_value_length(terms).fill_null(0), dtype=np.int64)
    found = pc.index_in(terms.flatten(), value_set=vocabulary)
    known = np.asarray(pc.is_valid(found))
    row, place, count, _ = _counted(np.repeat(np.arange(len(lengths)), lengths)[known], np.asarray(found.drop_null(), dtype=np.int64), vocabulary)
    return _weighed(row, place, count, idf, len(lengths))


def _rows_of_matrices(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int, widths: list[int]) -> pa.StructArray:
    """Matrices beside each other as Spark ML's sparse vectors, one for each row."""
    behind = np.concatenate(([0], np.cumsum(widths)))
    row = np.concatenate([r for r, _, _ in parts])
    order = np.argsort(row, kind="stable")
    place = np.concatenate([p + b for (_, p, _), b in zip(parts, behind, strict=False)])[order]
    value = np.concatenate([v for _, _, v in parts])[order]
    bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32))
    fields = [pa.array(np.zeros(rows, dtype=np.int8)), pa.array(np.full(rows, behind[-1], dtype=np.int32)), pa.ListArray.from_arrays(bounds, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value))]
    return pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])


def term_totals(rows: DataFrame) -> DataFrame:
    """(kind, term, n, df): how often words and pairs (kind 0) and characters (1) are there, and in how many of ``rows`` (text); one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for kind, (_, term, n, names) in enumerate(counted_terms(batch)):
                total, df = (np.bincount(term, w, len(names)).astype(np.int64) for w in (n, None))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), kind, np.int32)), names, pa.array(total), pa.array(df)], names=["kind", "term", "n", "df"])

    each = with_words(rows.select("text")).select("_words", "_runs").mapInArrow(count, "kind int, term string, n long, df long")
    return each.groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def fit_text_baseline(rows: DataFrame, label: str = "label", size: int = 200_000, c: float = 4.0) -> TextBaseline:
    """Words and pairs of two texts at least, characters of three, the most frequent ``size`` of each; smoothed idf; balanced logistic regression.

    Terms are counted in one pass and weighed in another; the regression's passes go over the vectors in ``PARTS`` tasks at most.
    """
    from pyspark.ml.classification import LogisticRegression

    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()}
    labels, n = tuple(sizes), sum(sizes.values())
    named = rows.select("text", (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("double").alias("label"))
    totals = checkpointed(term_totals(rows).filter(F.col("df") >= F.when(F.col("kind") == 0, 2).otherwise(3)))
    found = [totals.filter(F.col("kind") == kind).orderBy(F.desc("n"), "term").limit(size).select("term", "df").toArrow() for kind in (0, 1)]
    idf = tuple(np.log((1 + n) / (1 + np.asarray(t["df"], dtype=np.float64))) + 1 for t in found)
    baseline = TextBaseline(*(Vocabulary(t["term"].to_pylist()) for t in found), idf, None, labels)
    data = checkpointed(baseline.vectors(named, ["label"]))
    baseline.model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1 / (c * max(1, n)), standardization=False, family="multinomial", maxIter=200).fit(balanced(data, "label").coalesce(PARTS))
    return baseline
