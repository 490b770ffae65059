"""Phrase collocations: word-id suffix arrays by prefix doubling for each shard, n-grams from LCP intervals, counts merged by key.

A shard is a slice of texts of some megabytes. Its words become ids, different for each language, and its pieces end in a sign that no phrase holds. Numpy
sorts the suffixes by prefix doubling (by one word, then two, four, eight) as deep as the longest phrase; neighbours' common prefixes (LCP) give
intervals: a run of neighbours that share n words is one n-gram, its length the count. So each shard hands on a different n-gram once, and
Spark adds them up by key.

An n-gram of ``LEAST`` occurrences is often rare in each shard, so shards cannot drop any by their own counts. They go over their texts twice: the first pass sums
pairs of words, keyed by 64-bit hashes; those that occur ``LEAST`` times mark a bitmap of ``MARKS`` bits, which all tasks get (16 MB, whatever the corpus). In
the second pass n-grams of words and of marked pairs alone are handed on, with their words as the key: two hashes that meet only add rows to be dropped by their exact
counts. The larger the share of marked pairs, the less the bitmap saves; results do not depend on it.

The parts of a candidate's cuts are counted phrases themselves, found by joins on (lang, phrase, slot): a word that begins very many candidates is
dealt over ``SLOTS`` slots. A candidate goes if a candidate longer by one word holds it and occurs as often; for longer ones that follows,
as no phrase between the two occurs more often than the shorter or less often than the longer.

Cases: null text is empty, null lang is ``und``; the two are one group if a lang is called so. A language without words, or without candidates, has no rows. Repeated
rows count each time. Texts are looked at whole. Empty tables give no rows. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, filled, slices, written

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bits of the map of frequent pairs, kept as up to 4,096 rows of 4 KB.
MARKS = 1 << 27
SLOTS = 8
#: Bytes of text in a shard: a larger one counts more of its n-grams itself, and its arrays take some eighty times as much.
SHARD_BYTES = 2 << 20
SEED = 42

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK


class Shard:
    """Ids of the words of some texts, with 0 at the end of each piece, and the distinct (lang, word) behind the ids."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = buffers(pc.ascii_lower(texts))
        kind = _KIND[data]
        first = np.zeros(len(data), dtype=bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        word = kind == 0
        starts = word.copy()
        starts[1:] &= ~word[:-1] | first[1:]
        at = np.flatnonzero(starts)
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:]
        size = np.flatnonzero(ends) - at + 1
        bytes_ = data[word].tobytes()
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32).tobytes()), pa.py_buffer(bytes_)).dictionary_encode()
        spoken = langs.dictionary_encode()
        text = np.searchsorted(offsets, at, side="right") - 1
        codes = np.asarray(words.indices, dtype=np.int64) + np.asarray(spoken.indices, dtype=np.int64)[text] * len(words.dictionary)
        distinct, ids = np.unique(codes, return_inverse=True)
        self.words = words.dictionary.take(pa.array(distinct % max(1, len(words.dictionary))))
        self.langs = spoken.dictionary.take(pa.array(distinct // max(1, len(words.dictionary))))
        # A piece ends before a word if there is a break, or a text's start, between it and the word before.
        breaks = np.cumsum((kind == _BREAK) | first)
        ended = np.diff(breaks[at]) > 0 if len(at) else np.zeros(0, dtype=bool)
        place = np.arange(len(at)) + np.concatenate((np.zeros(min(1, len(at)), dtype=np.int64), np.cumsum(ended)))
        self.ids = np.zeros(int(place[-1]) + 2 if len(at) else 1, dtype=np.int64)
        self.ids[place] = ids + 1


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` ids at least, by prefix doubling."""
    rank, known = ids, 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[: max(0, len(rank) - known)] = rank[known:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key)
        known *= 2
        if known >= depth:
            return order
        ranked = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many ids, up to ``depth``, each suffix shares with the one before it in order; 0 for the first."""
    lcp, same = np.zeros(len(order), dtype=np.int64), np.ones(max(0, len(order) - 1), dtype=bool)
    padded = np.concatenate((ids, np.zeros(depth, dtype=ids.dtype)))
    for ahead in range(depth):
        there = padded[order + ahead]
        same &= there[1:] == there[:-1]
        lcp[1:] += same
    return lcp


def intervals(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``size`` ids: where each first stands in the order's intervals, and how often it occurs. Those over a piece's end are left out."""
    padded = np.concatenate((ids, np.zeros(size, dtype=ids.dtype)))
    starts = np.flatnonzero(lcp < size)
    counts = np.diff(np.concatenate((starts, [len(order)])))
    places = order[starts]
    inside = np.ones(len(places), dtype=bool)
    for ahead in range(size):
        inside &= padded[places + ahead] > 0
    return places[inside], counts[inside]


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(shard: Shard) -> np.ndarray:
    """A hash for each id, of the language and the word; 0 for the end of a piece."""
    seeds = {lang: xxhash.xxh64_intdigest(lang, SEED) for lang in pc.unique(shard.langs).to_pylist()}
    pairs = zip(shard.words.to_pylist(), shard.langs.to_pylist(), strict=True)
    return np.fromiter((0, *(xxhash.xxh64_intdigest(w, seeds[g]) for w, g in pairs)), np.uint64, len(shard.words) + 1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for part in slices(batch, limit=SHARD_BYTES):
            yield Shard(filled(part.column("text")), part.column("lang").cast(pa.string()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): occurrences of each pair of neighbouring words of a piece, by a hash of language and words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            order = suffix_array(shard.ids, 2)
            places, n = intervals(shard.ids, order, common_prefixes(shard.ids, order, 2), 2)
            hashes = _word_hashes(shard)
            keys = pair_hashes(hashes[shard.ids[places]], hashes[shard.ids[places + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], names=["pair", "n"])

    return rows.mapInArrow(count, "pair long, n int").groupBy("pair").agg(F.sum("n").alias("n"))


def marked_pairs(pairs: DataFrame, least: int = LEAST, marks: int = MARKS) -> np.ndarray:
    """A bitmap of ``marks`` bits, set where a pair that occurs ``least`` times has its hash."""
    place = F.pmod("pair", F.lit(marks)) + 1
    rows = pairs.filter(F.col("n") >= least).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros(max(1, marks // 32768) * 4096, dtype=np.uint8)
    for bucket, bits in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def phrase_counts(rows: DataFrame, least: int = LEAST, longest: int = LONGEST, marks: int = MARKS) -> DataFrame:
    """(lang, words, phrase, n) of all phrases up to ``longest`` words that may occur ``least`` times, and the count of all words (words 0, phrase '')."""
    marked = rows.sparkSession.sparkContext.broadcast(marked_pairs(pair_counts(rows), least, marks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = marked.value
        for shard in _shards(batches):
            ids, hashes = shard.ids, _word_hashes(shard)
            place = (pair_hashes(hashes[ids[:-1]], hashes[ids[1:]]).view(np.int64) % marks).astype(np.int64)
            likely = np.zeros(len(ids) + longest, dtype=bool)
            likely[: len(ids) - 1] = (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            order = suffix_array(ids, longest)
            lcp = common_prefixes(ids, order, longest)
            for size in range(1, longest + 1):
                places, n = intervals(ids, order, lcp, size)
                for ahead in range(size - 1):
                    keep = likely[places + ahead]
                    places, n = places[keep], n[keep]
                parts = [shard.words.take(pa.array(ids[places + ahead] - 1)) for ahead in range(size)]
                phrase = pc.binary_join_element_wise(*parts, " ")
                yield pa.RecordBatch.from_arrays([shard.langs.take(pa.array(ids[places] - 1)), pa.array(np.full(len(n), size, dtype=np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "n"])
            total = np.bincount(ids[ids > 0] - 1, minlength=len(shard.words))
            spoken = shard.langs.dictionary_encode()
            sums = np.bincount(np.asarray(spoken.indices), total, len(spoken.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([spoken.dictionary, pa.array(np.zeros(len(sums), dtype=np.int32)), pa.array([""] * len(sums), pa.string()), pa.array(sums)], names=["lang", "words", "phrase", "n"])

    each = rows.mapInArrow(count, "lang string, words int, phrase string, n long")
    return each.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, marks: int = MARKS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` collocations."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = written(phrase_counts(rows, least, longest, marks).filter((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    totals = counted.filter("words = 0").select("lang", F.col("n").alias("total"))
    phrases = counted.filter("words > 0").select("lang", "words", "phrase", "n")
    candidates = phrases.filter("words > 1").withColumnRenamed("n", "a")
    parts = F.split("phrase", " ")
    piece = lambda start, length: F.array_join(F.slice(F.col("parts"), start, length), " ")
    split = candidates.withColumn("parts", parts)
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"), F.pmod(F.hash("phrase"), F.lit(SLOTS)).alias("slot"))
    copied = phrases.filter(F.col("words") < longest).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    known = lambda part, n: copied.select("lang", F.col("phrase").alias(part), "slot", F.col("n").alias(n))
    met = cuts.join(known("first", "l"), ["lang", "first", "slot"]).join(known("rest", "r"), ["lang", "rest", "slot"]).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("total") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    lowest = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("m"))
    longer = split.filter("words > 2").select("lang", F.explode(F.array(piece(F.lit(1), F.col("words") - 1), piece(F.lit(2), F.col("words") - 1))).alias("phrase"), "a").distinct()
    kept = lowest.select("lang", "phrase", "m.a", "m.l", "m.r", F.col("m.total").alias("n"), "m.score").join(longer, ["lang", "phrase", "a"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
 total AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
 sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS size),
 grams AS (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size),
 f AS (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
 cuts AS (SELECT f.lang, f.phrase, f.a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) f),
 scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, t.n, (1000 * c.a * t.n) // (x.a * y.a) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail JOIN total t ON t.lang = c.lang),
 lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
 kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.size > 1 AND f.a * 100 >= s.a * 100 AND f.phrase <> s.phrase AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' '))),
 ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, * EXCLUDE (lang) FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
