"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Every whole text becomes ``STATISTICS``: sizes, word shapes, repetition, lines. Words are looked at once for each slice.
2. The statistics, standardised over the labelled rows, go through random Fourier features, cos(Wx + b), whose inner products
   approximate a Gaussian kernel.
3. Each partition of labelled rows adds up its normal equations; the sums are added up in a tree of tasks, ``FAN`` to one, and the last ``FAN`` by
   the driver, whose share does not depend on the data's size. Ridge scores follow from one linear solve.
4. A fifth of the labelled rows, chosen by a hash of the id, is kept out of the solve: their scores, counted in ``BINS`` bins, fit the
   isotonic (pool-adjacent-violators) map from score to probability.

Cases: a null text is the empty text, whose statistics are all zero; it is scored like any other. Rows without label, or with a null
id, are never trained on; several labels of one id are averaged. Without any label every score is 0.5. Repeated rows are trained
on and scored as often as they occur. Empty tables give no rows. Only id, text and the labels' id and quality columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, WordArrays, buffers, checkpointed, filled, hash_slot, segment_sums, slices

FEATURES = 384
BANDWIDTH = 4.0
RIDGE = 1e-3
BINS = 4000
ACCEPT = 0.5
FAN = 16
STATISTICS = (
    "log_words log_letters mean_length deviation_length log_longest distinct_share distinct_excess adjacent_share pair_share top_share upper_share title_share "
    "mark_run_share bang_share bar_share digit_share mark_share non_ascii_share short_share sentence_share log_lines words_per_line repeated_lines"
).split()

_CLASS = np.zeros((256, 5), dtype=np.int32)  # upper, digit, mark, non-ASCII, any (the first bytes of characters only count once)
for _b in range(256):
    _CLASS[_b] = (65 <= _b <= 90, 48 <= _b <= 57, 33 <= _b < 127 and not chr(_b).isalnum(), 0xC0 <= _b, not 0x80 <= _b < 0xC0)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    words = WordArrays(texts)
    count = words.counts.astype(np.float64)
    safe = np.maximum(count, 1)
    out = np.zeros((len(count), len(STATISTICS)))
    if not len(words.codes):
        return out
    raw, bounds = buffers(words.distinct)
    kinds = segment_sums(_CLASS[raw], bounds)  # of each distinct word
    length = kinds[:, 4]
    alone = words.distinct
    shape = np.column_stack(
        [
            length,
            length**2,
            np.asarray(pc.utf8_is_upper(alone)) & (length > 1),
            np.asarray(pc.utf8_is_title(alone)),
            np.asarray(pc.match_substring_regex(alone, r"[#$%&*@^~=<>|\\/_+-]{2,}")),
            np.asarray(pc.ends_with(alone, "!!")),
            np.asarray(pc.equal(alone, "|")),
            kinds[:, 1],
            kinds[:, 2],
            kinds[:, 3],
            length <= 3,
            np.asarray(pc.match_substring_regex(alone, r"[.!?]$")),
        ]
    ).astype(np.float64)
    sums = segment_sums(shape[words.codes], words.offsets)
    letters = np.maximum(sums[:, 0], 1)
    mean = sums[:, 0] / safe
    longest = np.zeros(len(count))
    full = words.counts > 0
    longest[full] = np.maximum.reduceat(length[words.codes], words.offsets[:-1][full])
    owner = words.text_of_word()
    ranked = np.sort(owner << 32 | words.codes)
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(new)
    of = ranked[starts] >> 32
    distinct = np.bincount(of, minlength=len(count)).astype(np.float64)
    top = np.zeros(len(count))
    np.maximum.at(top, of, np.diff(np.concatenate((starts, [len(ranked)]))))
    inside = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][inside & (words.codes[1:] == words.codes[:-1])], minlength=len(count))
    # pairs by a 40-bit hash beside the text's number in the slice
    codes = words.codes.astype(np.int64)
    pairs = ((codes[:-1] * 0x9E3779B1 + codes[1:] * 0x85EBCA77) & ((1 << 40) - 1))[inside]
    ranked = np.sort(owner[:-1][inside] << 40 | pairs)
    kept = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    distinct_pairs = np.bincount(ranked[kept] >> 40, minlength=len(count))
    lines = pc.split_pattern(texts, "\n")
    line_bounds = np.asarray(lines.offsets, dtype=np.int64) - lines.offsets[0].as_py()
    line_codes = np.asarray(lines.flatten().dictionary_encode().indices, dtype=np.int64)
    n_lines = np.diff(line_bounds).astype(np.float64)
    ranked = np.sort(np.repeat(np.arange(len(count)), np.diff(line_bounds)) << 32 | line_codes)
    distinct_lines = np.bincount(ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))] >> 32, minlength=len(count))
    values = [
        np.log1p(count), np.log1p(sums[:, 0]), mean, np.sqrt(np.maximum(sums[:, 1] / safe - mean**2, 0)), np.log1p(longest), distinct / safe, np.log1p(distinct) - 0.75 * np.log1p(count),
        same / safe, distinct_pairs / np.maximum(count - 1, 1), top / safe, sums[:, 2] / safe, sums[:, 3] / safe, sums[:, 4] / safe, sums[:, 5] / safe, sums[:, 6] / safe,
        sums[:, 7] / letters, sums[:, 8] / letters, sums[:, 9] / letters, sums[:, 10] / safe, sums[:, 11] / safe, np.log1p(n_lines), np.log1p(count / n_lines), 1 - distinct_lines / n_lines,
    ]
    out[:] = np.column_stack(values)
    out[~full] = 0
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # ridge scores
    levels: np.ndarray  # calibrated probabilities at the knots


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int = 3) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / BANDWIDTH, (x.shape[1], FEATURES))
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.cos(np.clip((x - mean) / scale, -6, 6) @ directions + phases) * np.sqrt(2 / FEATURES)
    return np.column_stack((z, np.ones(len(x))))


def _pools(sums: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: rows (sum of scores, hits, count) of pools whose rates rise."""
    pools: list[list[float]] = []
    for row in zip(sums, hits, counts, strict=True):
        pools.append(list(row))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array(pools)


def isotonic(scores: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean score and level of each pool of bins in order of score. Each pool is shrunk by one row at the share of all, then pooled again."""
    first = _pools(scores * counts, hits, counts)
    knots = first[:, 0] / first[:, 2]
    weight = first[:, 2] + 1
    again = _pools(knots * weight, first[:, 1] + hits.sum() / counts.sum(), weight)
    return again[:, 0] / again[:, 2], again[:, 1] / again[:, 2]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                x = statistics(filled(part.column("text"))).astype(np.float32)
                offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(describe, "doc_id long, x array<float>")


def train(rows: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Fit on the labelled rows of ``described``; None if there are none."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    labelled = checkpointed(rows.filter(hash_slot("doc_id", 3) != 1).join(known, "doc_id").withColumn("judge", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(5)) == 0))
    each = [F.get("x", F.lit(i)).cast("double") for i in range(len(STATISTICS))]
    facts = labelled.agg(F.count("*"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not facts[0]:
        return None
    n = len(STATISTICS)
    mean, scale = np.array(facts[1 : n + 1], dtype=np.float64), np.maximum(np.array(facts[n + 1 :], dtype=np.float64), 1e-6)
    size = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x, y = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, n)), np.asarray(batch.column("y"))
            for at in range(0, len(x), 4096):
                z = fourier(x[at : at + 4096], mean, scale)
                total += z.T @ np.column_stack((z, y[at : at + 4096]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for data in batch.column("sums").to_pylist():
                total += np.frombuffer(data).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    fitted = labelled.filter(~F.col("judge"))
    if not fitted.take(1):
        fitted = labelled
    sums = fitted.select("x", "y").mapInArrow(equations, "sums binary")
    left = sums.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        sums = sums.repartition(left).mapInArrow(added, "sums binary")
    parts = sums.collect()
    total = sum(np.frombuffer(r["sums"]).reshape(size, size + 1) for r in parts)
    weights = np.linalg.solve(total[:, :size] + RIDGE * total[-1, size - 1] * np.eye(size) / size, total[:, size])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = fourier(_matrix(batch.column("x")), mean, scale) @ weights
                bins = np.clip((score + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], names=["bin", "y"])

    judged = labelled.filter("judge")
    if not judged.take(1):
        judged = labelled
    counted = sorted(judged.select("x", "y").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).collect())
    bins, hits, counts = (np.array(c, dtype=np.float64) for c in zip(*counted, strict=True))
    knots, levels = isotonic((bins + 0.5) / (BINS / 2) - 0.5, hits, counts)
    return QualityModel(mean, scale, weights, knots, levels)


def apply(x: np.ndarray, model: QualityModel | None) -> np.ndarray:
    """Calibrated scores; between the isotonic levels they run straight, so that nearby texts stay in order."""
    if model is None:
        return np.full(len(x), 0.5)
    return np.clip(np.interp(fourier(x.astype(np.float64), model.mean, model.scale) @ model.weights, model.knots, model.levels), 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = checkpointed(described(docs))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = apply(_matrix(batch.column("x")), model.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", F.coalesce(hash_slot("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "x").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(described(docs), labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                scores = apply(statistics(filled(part.column("text"))).astype(np.float32), shared.value)
                yield part.filter(pa.array(scores >= accept))

    return docs.mapInArrow(keep, docs.schema)
