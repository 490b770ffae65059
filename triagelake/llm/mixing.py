"""Mixing sources to target weights by hash-threshold histograms: no document is sorted.

Sources in order of their names (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words by weight. A target stops at ``MOST_COPIES`` times its
source's words; the excess is shared again by weight among the others, until none is above. A source then takes all documents as many times as its whole
budget has room for, and once more those with a hash below its threshold.

The threshold is found from histograms: words are summed by source and by the hash's first ``BITS`` bits, the bucket in which a running sum passes the budget is
the boundary, and only its documents are counted again by their next bits, until it holds one hash. Rows with that very hash (one row, or repeats of it)
share what is left of the budget, each its first words, so a source takes its target to fewer words than it has such repeats. A filter by hash then gives
each document its words. The hash is of the id and the whole text, so it is the same in every run and its order says nothing of either.

Of documents only (id, source, size, hash) are written and read again. Sources and their thresholds are a table of one row a source; it is broadcast where it
has at most ``MOST_BROADCAST`` rows, else documents meet it on (source, slot), dealt over ``SLOTS`` slots as one source may hold most of them.

Cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; null ids hash as empty ones. Repeated rows have the
same hash and take the same. Where all sizes are 0 so are all targets. Empty tables give no rows. Only doc_id, text and source are read.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

#: What stands between words, which are runs of [^\x20\x09-\x0D].
NO_WORD = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST_COPIES = 2
#: Bits of the hash, and how many of them one histogram resolves.
HASH_BITS, BITS = 60, 12
SLOTS = 64
MOST_BROADCAST = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(F.array_remove(F.split(text, NO_WORD), "")).cast("long").alias("size"), F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"))


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with the weight of their place by name. Ranges of names are numbered each by itself, after those before."""
    parts = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return parts.join(before, "part").withColumn("weight", weight.cast("long")).drop("part", "before")


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def targets(sources: DataFrame, share: Fraction = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight) with ``target`` and ``budget``, its whole words. Each round is one sum over the sources that are not at their limit."""
    rows, free = sources, F.lit(True)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # A free source's target is weight x level, level = left / (below x weights), in whole numbers.
    left, below, bound = share.numerator * total, share.denominator, None
    while True:
        weights = rows.filter(free).agg(F.sum("weight")).first()[0]
        if not weights:
            break
        bound = (left, below * weights)
        above = F.col("weight").cast("decimal(38,0)") * _whole(left) > F.col("source_size").cast("decimal(38,0)") * _whole(most * bound[1])
        stopped = rows.filter(free & above).agg(F.sum("source_size"), F.count("*")).first()
        if not stopped[1]:
            break
        left -= share.denominator * most * stopped[0]
        free = free & ~above
    limit = F.col("source_size") * most
    if bound is None:
        return sources.withColumn("target", limit.cast("double")).withColumn("budget", limit)
    shared = F.col("weight").cast("decimal(38,0)") * _whole(left)
    target = F.when(free, shared.cast("double") / F.lit(float(bound[1]))).otherwise(limit.cast("double"))
    return sources.withColumn("target", target).withColumn("budget", F.when(free, F.call_function("div", shared, _whole(bound[1]))).otherwise(limit))


def _meet(rows: DataFrame, facts: DataFrame, how: str, most_broadcast: int) -> DataFrame:
    """``rows`` (source, h) with the one row of their source in ``facts``, which is in a checkpoint."""
    keyed = facts.withColumnRenamed("source", "_source")
    if facts.count() <= most_broadcast:
        return rows.join(F.broadcast(keyed), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")
    copied = keyed.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    dealt = rows.withColumn("_dealt", F.pmod("h", F.lit(SLOTS)).cast("int"))
    return dealt.join(copied.hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_dealt") == F.col("_slot")), how).drop("_source", "_slot", "_dealt")


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = BITS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(source, bound, before, same): the hash at which the running words of a source pass its budget (source, rest), the words below it and the rows
    that have it. Sources that pass it nowhere are left out."""
    known, done = HASH_BITS, None
    open_ = checkpointed(budgets.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")))
    for shift in range(HASH_BITS - bits, -bits, -bits):
        shift = max(shift, 0)
        inside = _meet(rows.filter("size > 0"), open_, "inner", most_broadcast).filter(F.shiftright("h", known) == F.col("prefix"))
        bucket = F.shiftright("h", shift).alias("bucket")
        sums = inside.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.count("*").alias("same"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        order = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("after", F.col("start") + F.sum("words").over(order)).withColumn("before", F.col("after") - F.col("words"))
        at = checkpointed(running.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("after"))))
        settled = at.filter("low = high").select("source", F.col("low").alias("bound"), "before", "same")
        done = settled if done is None else done.unionByName(settled)
        open_ = checkpointed(at.filter("low < high").select("source", "rest", F.col("bucket").alias("prefix"), "before"))
        if open_.isEmpty():
            break
        known = shift
    return checkpointed(done)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_COPIES, bits: int = BITS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows = written(sized(docs), "sizes")
    sources = checkpointed(weighted(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    budgets = checkpointed(targets(sources, share, most).withColumn("rest", F.when(F.col("source_size") > 0, F.col("budget") % F.col("source_size")).otherwise(0)))
    bounds = thresholds(rows, budgets, bits, most_broadcast)
    facts = checkpointed(budgets.join(bounds.withColumnRenamed("source", "_bounded"), F.col("source").eqNullSafe(F.col("_bounded")), "left").drop("_bounded"))
    whole = F.when(F.col("source_size") > 0, F.call_function("div", F.col("budget"), F.col("source_size"))).otherwise(0)
    more = F.when(F.col("h") < F.col("bound"), F.col("size")).when(F.col("h") == F.col("bound"), F.least("size", F.call_function("div", F.col("rest") - F.col("before"), F.col("same")))).otherwise(0)
    return _meet(rows, facts, "inner", most_broadcast).select("doc_id", "size", "source_size", "target", (whole * F.col("size") + more).cast("long").alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS size,
   CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, sum(size)::HUGEINT AS size, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS weight FROM d GROUP BY source),
 tried AS (SELECT *, sum(size) OVER (ORDER BY size / weight, source NULLS LAST) - size AS stopped, sum(weight) OVER (ORDER BY size / weight DESC, source DESC NULLS FIRST) AS free, sum(size) OVER () AS total FROM s),
 level AS (SELECT 3 * total - 4 * stopped AS top, 2 * free AS bottom FROM tried WHERE weight * (3 * total - 4 * stopped) <= 4 * size * free ORDER BY size / weight, source NULLS LAST LIMIT 1),
 t AS (SELECT s.*, CASE WHEN weight * top <= 2 * size * bottom THEN (weight * top)::DOUBLE / bottom::DOUBLE ELSE (2 * size)::DOUBLE END AS target,
   CASE WHEN weight * top <= 2 * size * bottom THEN weight * top // bottom ELSE 2 * size END AS budget FROM s, level),
 g AS (SELECT source, h, sum(size) AS words, count(*) AS same FROM d WHERE size > 0 GROUP BY ALL),
 r AS (SELECT source, h, same, words, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before FROM g)
SELECT d.doc_id, d.size::BIGINT AS size, t.size::BIGINT AS source_size, t.target, CASE WHEN d.size = 0 THEN 0 ELSE (d.size * (t.budget // t.size)
   + greatest(0, least(d.size, (t.budget % t.size - r.before) // r.same)))::BIGINT END AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""
