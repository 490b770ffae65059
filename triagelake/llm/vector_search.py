"""Approximate nearest neighbours: an inverted multi-index over two halves of the vectors.

Each half is quantised on its own (k-means on a bounded sample), so a vector lies in the cell of a pair of centroids. A query walks
the pairs in order of summed distance, by a heap over both sorted lists, until the cells passed hold the wanted share of all
entries; these entries are reranked by their true distance. The share is fitted on the sample: the least at which it finds ``RECALL``
of the true neighbours, so that structureless vectors are probed widely and clustered ones narrowly.

Copies of one vector are one entry, so a vector that a third of all rows carry costs no more than another. Entries are dealt by first
centroid and block of about ``BLOCK`` rows (blocks split a centroid that holds too much); a query goes to the blocks of the
centroids it walks, and each block returns its best few.

What goes to the driver: the sample, and counts by cell (at most ``CENTROIDS`` squared). Every valid row is indexed.

Cases: null and zero vectors, and those with null or non-finite components, take no part, neither do vectors of another length than
the table's most frequent one, nor null ids. Repeated ids count once for each vector. Ties go to the smaller id. Fewer candidates
than ``k``: all of them. An empty table has no result rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SAMPLE = 8192
CENTROIDS = 256
RECALL = 0.96
BLOCK = 2048
LEAST_ENTRIES = 256


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cast = cast.filter(finite & F.exists("embedding", lambda x: x != 0.0))
    sizes = cast.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    # -0.0 and 0.0 are one value, so that copies meet
    return cast.filter(F.size("embedding") == (sizes[0]["size"] if sizes else 0)).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    if not points.shape[1]:
        return np.zeros((1, 0))
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(points, centroids).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, not below 0."""
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)[None], 0)


class MultiIndex:
    """The two codebooks, and the walk over their cells."""

    def __init__(self, sample: np.ndarray, entries: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.half = (sample.shape[1] + 1) // 2
        k = int(min(CENTROIDS, max(2, entries**0.5 / 4), max(2, len(sample) // 8)))
        self.books = kmeans(sample[:, : self.half], k, rng), kmeans(sample[:, self.half :], k, rng)
        self.share = self._share(sample, rng)

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(points[:, : self.half], self.books[0]), distances(points[:, self.half :], self.books[1])

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.halves(points)
        return first.argmin(axis=1), second.argmin(axis=1)

    def _share(self, sample: np.ndarray, rng: np.random.Generator) -> float:
        """The least share of entries, nearest cells first, that holds ``RECALL`` of the ten true neighbours within the sample."""
        if len(sample) < 64:
            return 1.0
        asked = rng.choice(len(sample), min(200, len(sample)), replace=False)
        true = distances(sample[asked], sample)
        true[np.arange(len(asked)), asked] = np.inf
        nearest = np.argpartition(true, 10, axis=1)[:, :10]
        first, second = self.halves(sample[asked])
        own = self.cells(sample)
        walked = first[:, own[0]] + second[:, own[1]]
        needed = np.stack([(w[None] < w[n][:, None]).sum(axis=1) for w, n in zip(walked, nearest, strict=True)]) / len(sample)
        return float(min(1.0, np.quantile(needed, RECALL) + 1 / len(sample)))

    def walk(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Cells by summed distance until they hold ``wanted`` entries; equal sums by centroid numbers."""
        by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        a, b = first[by_first].tolist(), second[by_second].tolist()
        heap, found, held = [(a[0] + b[0], 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(by_first[i]), int(by_second[j])
            if counts[cell]:
                found.append(cell)
                held += int(counts[cell])
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return found


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int, k: int = 10) -> DataFrame:
    """The ``k`` nearest other rows found for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = valid_vectors(vectors)
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    # The k + 1 smallest ids of a vector are all that a result can need of its copies.
    copies = rows.distinct().withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= k + 1)
    lists = copies.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = checkpointed(lists.select(F.element_at("ids", 1).alias("entry"), "embedding", "ids"))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    asked = checkpointed(queries.join(entries.select("embedding", "entry"), "embedding").select(F.col("vec_id").alias("query_id"), "entry"))
    total = entries.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    sample = entries.select("embedding").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).toArrow()
    index = spark.sparkContext.broadcast(MultiIndex(_matrix(sample["embedding"]), total))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c1, c2 = index.value.cells(_matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("embedding"), pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], names=["entry", "embedding", "c1", "c2"])

    cells = checkpointed(entries.select("entry", "embedding").mapInArrow(placed, "entry long, embedding array<double>, c1 int, c2 int"))
    counts = np.zeros((len(index.value.books[0]), len(index.value.books[1])), dtype=np.int64)
    for r in cells.groupBy("c1", "c2").agg(F.count("*").alias("n")).collect():
        counts[r["c1"], r["c2"]] = r["n"]
    blocks = np.maximum(1, -(-counts.sum(axis=1) // BLOCK))
    wanted = max(LEAST_ENTRIES, index.value.share * total)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("embedding")) if batch.num_rows else np.zeros((0, 1))
            for start in range(0, len(points), 64):
                first, second = index.value.halves(points[start : start + 64])
                rows_, c1s, places, c2s = [], [], [], []
                for i in range(len(first)):
                    by_first: dict[int, list[int]] = {}
                    for a, b in index.value.walk(first[i], second[i], counts, wanted):
                        by_first.setdefault(a, []).append(b)
                    for a, bs in by_first.items():
                        for block in range(blocks[a]):
                            rows_.append(start + i)
                            c1s.append(a)
                            places.append(block)
                            c2s.append(bs)
                used = batch.take(pa.array(rows_, pa.int64()))
                yield pa.RecordBatch.from_arrays([used.column("entry"), used.column("embedding"), pa.array(c1s, pa.int32()), pa.array(places, pa.int32()), pa.array(c2s, pa.list_(pa.int32()))], names=["query", "embedding", "c1", "block", "c2s"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "entry": [], "distance": []}
        if left.num_rows and right.num_rows:
            points, ids, own = _matrix(left["embedding"]), np.asarray(left["entry"]), np.asarray(left["c2"])
            for query, point, c2s in zip(right["query"].to_pylist(), _matrix(right["embedding"]), right["c2s"].to_pylist(), strict=True):
                taken = np.flatnonzero(np.isin(own, c2s))
                away = np.sqrt(((points[taken] - point) ** 2).sum(axis=1))
                best = np.lexsort((ids[taken], away))[: k + 1]
                out["query"] += [query] * len(best)
                out["entry"] += ids[taken][best].tolist()
                out["distance"] += away[best].tolist()
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("distance", pa.float64())]))

    sizes = F.array(*[F.lit(int(b)) for b in blocks])
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("entry"), F.element_at(sizes, F.col("c1") + 1).cast("long")).cast("int"))
    wants = asked.select("entry").distinct().join(entries.select("entry", "embedding"), "entry").mapInArrow(probes, "query long, embedding array<double>, c1 int, block int, c2s array<int>")
    near = dealt.groupBy("c1", "block").cogroup(wants.groupBy("c1", "block")).applyInArrow(rerank, "query long, entry long, distance double")
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "entry"))).filter(F.col("place") <= k + 1)
    found = best.join(entries.select("entry", "ids"), "entry").select("query", "distance", F.explode("ids").alias("vec_id"))
    # Of a query's vector, too, only the k + 1 first rows count: one of them may be the query itself.
    few = checkpointed(found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))).filter(F.col("place") <= k + 1).drop("place"))
    pairs = asked.withColumnRenamed("entry", "query").join(few, "query").filter(F.col("query_id") != F.col("vec_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").alias("score"))
