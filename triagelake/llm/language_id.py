"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its words' byte n-grams (``<word>``, lower-cased, n in ``GRAMS``, hashed into ``BUCKETS``
rows); a linear layer and softmax follow. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows. A held-back share of that sample fits a softmax temperature and the confidence under which a prediction is rejected.

At prediction embedding and linear layer collapse into one table of BUCKETS x languages where that is the smaller; else the embeddings
of words are averaged first. Either way the table is BUCKETS x DIMENSIONS at most, which is what is broadcast, with one linear row for each language. Each
distinct word of a slice is scored once.

Cases: null or letterless text gives ``und``, score 0, rejected. Null ids and null langs are never trained on; rows with a null id
are predicted with ``held_out`` false. No labelled row at all: every text is ``und``, and only letterless
ones are rejected. Repeated rows are scored alike. Only id, text
and lang are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, WordArrays, checkpointed, filled, hash_slot, segment_sums, slices

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
DIMENSIONS = 16
#: Labelled rows used for each language, about, and for all of them; the sample is chosen by a hash of the id. Every language is learnt: of more
#: than ``SAMPLE_ROWS / ROWS_PER_LANGUAGE`` languages each has fewer rows, but ``LEAST_ROWS`` at least (or all it has).
ROWS_PER_LANGUAGE = 300
SAMPLE_ROWS = 24_000
LEAST_ROWS = 8
#: N-grams of all sampled rows together, about (256 MB at the driver): where a row has more than its share, words of it are drawn, spread over the whole text.
SAMPLE_GRAMS = 1 << 25
MOST_BROADCAST = 100_000
EPOCHS = 8
#: Share of right predictions that rejection may cost on the calibration rows.
REJECT_SHARE = 0.002
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, embeddings times the linear layer; or the embeddings alone
    linear: np.ndarray | None  # the linear layer, where it is not in the table
    bias: np.ndarray
    temperature: float
    threshold: float


def gram_buckets(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the buckets of the byte n-grams of the distinct words, and each word's bounds in them."""
    marked = pc.binary_join_element_wise(pa.scalar("<"), words, pa.scalar(">"), "")
    raw = np.frombuffer(marked.buffers()[2], dtype=np.uint8)
    offsets = np.frombuffer(marked.buffers()[1], dtype=np.int32)[: len(marked) + 1].astype(np.int64)
    raw = raw[: offsets[-1]]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))
    rolling = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        rolling *= np.uint32(16777619)
        rolling[: max(0, len(raw) - n + 1)] += raw[n - 1 :]
        rolling += np.uint32(n)
        if n in GRAMS:
            mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(2246822519)
            valid = left >= n
            yield (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))[valid], np.concatenate(([0], np.cumsum(valid)))[offsets]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled row the gram counts of the whole text, or of words drawn from it up to ``most`` grams, and of one window of up to 8 words, so that short
    texts are learnt too."""
    for batch in batches:
        for part in slices(batch, limit=STAGE_BYTES):
            texts = pc.utf8_lower(filled(part.column("text")))
            words = WordArrays(texts)
            if not len(words.distinct):
                continue
            every = list(gram_buckets(words.distinct))
            weights = sum(np.diff(bounds) for _, bounds in every)
            out = {"lang": [], "place": [], "buckets": [], "counts": []}
            for i, (row, lang) in enumerate(zip(part.column("place").to_pylist(), part.column("lang").to_pylist(), strict=True)):
                most = part.column("most")[i].as_py()
                own = words.codes[words.offsets[i] : words.offsets[i + 1]]
                if not len(own):
                    continue
                start = row % max(1, len(own) - 7)
                for codes in (own, own[start : start + 8]):
                    if weights[codes].sum() > most:
                        codes = np.random.default_rng(row).permutation(codes)
                        codes = codes[np.cumsum(weights[codes]) <= most]
                        if not len(codes):
                            continue
                    used, times = np.unique(codes, return_counts=True)
                    total = np.zeros(BUCKETS)
                    for grams, bounds in every:
                        lengths = bounds[used + 1] - bounds[used]
                        index = np.repeat(bounds[used] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
                        total += np.bincount(grams[index], weights=np.repeat(times, lengths), minlength=BUCKETS)
                    kept = np.flatnonzero(total)
                    out["lang"].append(lang)
                    out["place"].append(row)
                    out["buckets"].append(kept.astype(np.int32))
                    out["counts"].append(total[kept].astype(np.float32))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("place", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))]))


def labelled_sample(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """About ``rows_per_language`` labelled rows of each language, fewer of very many languages, chosen by a hash of the id: no sort and no hot group."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (hash_slot("doc_id", 4) != 2))
    counts = checkpointed(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    wanted = max(LEAST_ROWS, min(rows_per_language, SAMPLE_ROWS // max(1, languages)))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 30))
    below = counts.select("lang", (F.least(F.lit(1.0), F.lit(float(wanted)) / F.col("n")) * (1 << 30)).cast("long").alias("below"))
    # Few rows, so no text is shuffled for them.
    below = F.broadcast(below) if languages <= MOST_BROADCAST else below
    return labelled.select("lang", "text", place.alias("place")).join(below, "lang").filter("place < below").select("lang", "text", "place", F.lit(SAMPLE_GRAMS // (2 * wanted * max(1, languages))).alias("most"))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = EPOCHS, seed: int = 11) -> LanguageModel | None:
    """Fit on a bounded sample; None if nothing is labelled."""
    sample = labelled_sample(docs, rows_per_language)
    rows = sample.mapInArrow(_examples, "lang string, place long, buckets array<int>, counts array<float>").toArrow()
    if not rows.num_rows:
        return None
    order = np.lexsort((np.asarray(pc.list_value_length(rows["buckets"])), np.asarray(rows["place"]), np.asarray(rows["lang"])))
    rows = rows.take(order)
    names = rows["lang"].to_pylist()
    languages = sorted(set(names))
    codes = {x: i for i, x in enumerate(languages)}
    target = np.array([codes[x] for x in names])
    features = []
    for buckets, counts in zip(rows["buckets"].combine_chunks(), rows["counts"].combine_chunks(), strict=True):
        b, c = buckets.values.to_numpy(), counts.values.to_numpy()
        features.append((b, c / c.sum()))
    held = np.asarray(rows["place"]) % 4 == 3
    if held.all() or not held.any():
        held = np.zeros(len(target), dtype=bool)
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    weight = 1 / np.maximum(np.bincount(target[~held], minlength=len(languages)), 1)
    weight = weight / weight[target[~held]].mean()
    fitted = np.flatnonzero(~held)
    steps, step = epochs * len(fitted), 0
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            rate = np.float32((1 - step / steps) * min(weight[target[i]], 3.0))
            step += 1
            buckets, share = features[i]
            rows_used = embeddings[buckets]
            mean = share @ rows_used
            error = _softmax(mean @ linear + bias)
            error[target[i]] -= 1
            back = linear @ error
            linear -= rate * 2 * np.outer(mean, error)
            bias -= rate * np.float32(0.1) * error
            embeddings[buckets] = rows_used - (rate * 20) * share[:, None] * back
    table = embeddings @ linear
    inside = len(languages) <= DIMENSIONS
    judged = np.flatnonzero(held) if held.any() else fitted
    logits = np.stack([share @ table[buckets] + bias for buckets, share in (features[i] for i in judged)]).astype(np.float64)
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(judged)), target[judged]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    chances = _softmax(logits / temperature)
    right = chances.max(axis=1)[chances.argmax(axis=1) == target[judged]]
    threshold = min(0.5, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return LanguageModel(languages, (table if inside else embeddings).astype(np.float32), None if inside else linear.astype(np.float64), bias.astype(np.float64), temperature, threshold)


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def predict_slice(texts: pa.Array, model: LanguageModel | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Language, confidence and rejection of each text."""
    known = np.asarray(pc.match_substring_regex(texts, r"\p{L}")).astype(bool)
    if model is None or not known.any():
        return pa.array([UNKNOWN] * len(texts), pa.string()), np.zeros(len(texts)), ~known
    words = WordArrays(pc.utf8_lower(texts))
    by_word, sizes = np.zeros((len(words.distinct), model.table.shape[1])), np.zeros(len(words.distinct))
    for grams, bounds in gram_buckets(words.distinct):
        by_word += segment_sums(model.table[grams], bounds)
        sizes += np.diff(bounds)
    total = segment_sums(sizes[words.codes], words.offsets)
    mean = segment_sums(by_word[words.codes], words.offsets) / np.maximum(total, 1)[:, None]
    logits = (mean if model.linear is None else mean @ model.linear) + model.bias
    chances = _softmax(logits / model.temperature)
    best = chances.argmax(axis=1)
    score = np.where(known, chances[np.arange(len(best)), best], 0.0)
    names = pc.if_else(pa.array(known), pa.array(model.languages, pa.string()).take(pa.array(best)), pa.scalar(UNKNOWN))
    return names, score, ~known | (score < model.threshold)


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                names, score, rejected = predict_slice(filled(part.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), names, pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held_out = F.coalesce(hash_slot("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("string").alias("text")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                yield part.filter(pa.array(~predict_slice(filled(part.column("text")), shared.value)[2]))

    return docs.select(*names).mapInArrow(keep, docs.schema)
