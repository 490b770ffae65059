"""Sums over the terms that two cases share, for every two cases: blocks of cases meet, and a task holds two blocks and a tile of their sums.

Nothing is shuffled but the cases, one copy for each other block; products of single terms never leave a task. Pairs go on as they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered

#: Cases of a block at most, and blocks at least where there are cases enough; tasks of all pairs of blocks at most.
BLOCK, BLOCKS, TASKS = 8192, 8, 4096
#: Sums of a tile, and pairs that go on at once; products of rare terms that are listed at once; common terms that are multiplied as one matrix.
CELLS, PAIRS, PRODUCTS, SLAB = 1 << 21, 1 << 18, 1 << 22, 512
#: A term that more than one in so many cases have is common.
COMMON = 10


def _side(table: pa.Table, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the cases in these places of a table."""
    lists = table["entries"].combine_chunks().slice(first, last - first)
    bounds = np.asarray(lists.offsets)
    entries = lists.flatten()
    return np.repeat(np.arange(last - first), np.diff(bounds)), np.asarray(entries.field("t")), np.asarray(entries.field("w"))


def _tiles(left: tuple, right: tuple, n: int, m: int, common: int, binary: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of n cases with m others, tile by tile: the place of a tile's first row, and its rows."""
    row, term, weight = left
    weight = np.ones(len(weight)) if binary else weight
    order = np.argsort(right[1], kind="stable")
    to, with_term, by = (x[order] for x in right)
    height = max(1, CELLS // m)
    for top in range(0, n, height):
        rows = min(height, n - top)
        own = slice(*np.searchsorted(row, [top, top + rows]))
        r, t, w = row[own] - top, term[own], weight[own]
        out = np.zeros((rows, m))
        for low in range(0, common, SLAB):
            high = min(common, low + SLAB)
            a, b = np.zeros((rows, high - low)), np.zeros((high - low, m))
            mine, theirs = (t >= low) & (t < high), slice(*np.searchsorted(with_term, [low, high]))
            a[r[mine], t[mine] - low] = w[mine]
            b[with_term[theirs] - low, to[theirs]] = by[theirs]
            out += a @ b
        rare = t >= common
        r, t, w = r[rare], t[rare], w[rare]
        begin = np.searchsorted(with_term, t)
        count = np.searchsorted(with_term, t, side="right") - begin
        upto = np.cumsum(count)
        # A term of one case meets a block's cases at most, so a list is as long as PRODUCTS and a block.
        cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(PRODUCTS, upto[-1] if len(upto) else 0, PRODUCTS)) + 1, [len(t)])))
        for some in map(slice, cuts[:-1], cuts[1:]):
            c = count[some]
            if total := int(c.sum()):
                at = np.arange(total) + np.repeat(begin[some] - (np.cumsum(c) - c), c)
                out += np.bincount(np.repeat(r[some] * m, c) + to[at], np.repeat(w[some], c) * by[at], rows * m).reshape(rows, m)
        yield top, out


def _meeting(low, high):
    """Number of two blocks."""
    return high * (high + 1) / 2 + low


def _of_blocks(table: pa.Table, common: int, binary: bool, best: bool) -> Iterator[pa.RecordBatch]:
    """Of two blocks' cases in order, or of one block's with each other: all pairs that share a term, or their largest value."""
    block = np.asarray(table["block"])
    ids, scale = table["case_id"].combine_chunks(), np.asarray(table["scale"])
    high = int(block[-1])
    same = table["meeting"][0].as_py() == _meeting(high, high)
    first = len(block) if same else int(np.searchsorted(block, high))
    start = 0 if same else first
    m = len(block) - start
    left, right, most = _side(table, 0, first), _side(table, start, len(block)), 0.0
    for top, sums in _tiles(left, right, first, m, common, binary):
        if same:
            sums *= np.arange(m) > np.arange(top, top + len(sums))[:, None]
        step = max(1, PAIRS // m)
        for low in range(0, len(sums), step):
            a, b = np.nonzero(sums[low : low + step])
            value = sums[low : low + step][a, b] / (scale[top + low + a] * scale[start + b])
            if best:
                most = max(most, value.max(initial=0.0))
            elif len(a):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(top + low + a)), ids.take(pa.array(start + b)), pa.array(value)], names=["a", "b", "value"])
    if best:
        yield pa.RecordBatch.from_arrays([pa.array([float(most)])], names=["value"])


def shared_sums(entries: DataFrame, binary: bool = False, best: bool = False) -> DataFrame:
    """(a, b, value) of all pairs a < b of cases with a common term, from ``entries`` (case_id, term, w, scale), one for each case and term.

    The value is the sum over common terms of a's weight (with ``binary``: 1) times b's, over both cases' scales; weights are above 0. With ``best`` only (value), the largest of each
    two blocks. ``entries`` are read several times: hand in a checkpoint.
    """
    known = entries.filter("case_id is not null and term is not null")
    cases = numbered(known.select("case_id").distinct(), [F.col("case_id")], "place")
    n, of = cases.count(), dict(entries.dtypes)["case_id"]
    schema = "value double" if best else f"a {of}, b {of}, value double"
    if n < 2:
        return entries.sparkSession.createDataFrame([], schema)
    terms = numbered(known.groupBy("term").agg(F.count("*").alias("df")).filter("df > 1"), [F.desc("df"), F.col("term")], "t")
    common = terms.filter(F.col("df") > n / COMMON).count()
    size = min(BLOCK, -(-n // BLOCKS))
    blocks = -(-n // size)
    placed = known.join(terms.select("term", F.col("t").cast("int").alias("t")), "term").groupBy("case_id").agg(F.first("scale").alias("scale"), F.collect_list(F.struct("t", "w")).alias("entries"))
    rows = placed.join(cases, "case_id").withColumn("block", F.floor(F.col("place") / size).cast("int"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Blocks follow the order of ids, so the earlier one of a pair has all of its first cases.
    low, high = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
    dealt = other.withColumn("meeting", _meeting(low, high).cast("long"))
    tasks = min(TASKS, blocks * (blocks + 1) // 2)
    met = dealt.select("meeting", "block", "place", "case_id", "scale", "entries").repartitionById(tasks, (F.col("meeting") % tasks).cast("int")).sortWithinPartitions("meeting", "place")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            meeting = np.asarray(batch.column("meeting"))
            for begin, end in zip(cuts := np.flatnonzero(np.diff(meeting, prepend=-1)), [*cuts[1:], len(meeting)], strict=True):
                if held and held[-1].column("meeting")[0].as_py() != meeting[begin]:
                    yield from _of_blocks(pa.Table.from_batches(held), common, binary, best)
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from _of_blocks(pa.Table.from_batches(held), common, binary, best)

    return met.mapInArrow(meet, schema)
