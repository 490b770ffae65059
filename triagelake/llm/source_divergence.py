"""Source divergence audit: how far the sources of a language differ in the terms that they use. DataFrame functions only.

Terms are runs of letters (all signs but ASCII's other ones), with A-Z lower-cased. A language keeps the terms that at least ``LEAST_DOCS`` of its
documents have. Each group (lang, source) and each language as a whole gives every kept term a smoothed share
``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``; two shares diverge by ``floor((p - q)^2 / (p + q))``, a symmetric chi-square in whole numbers.
Part ``pair`` sums that over all kept terms for each other source of the language; part ``term`` names the terms that a group uses most beyond its
language's share.

Plan: matches are exploded once, group after group within a task, and combined before the shuffle, so a hot source or word costs one row for each task. Groups are crossed
with kept terms through an equi-join on (lang, slot): terms are dealt over ``SLOTS`` slots by their hash and the few groups of a language are copied to each,
so no language is one key. The dense rows meet themselves on lang and term, each pair of sources once, and are summed before they are shuffled.
Shares are at most 10^9 + 1, so squares fit in 64 bits; where the product before a share's division does not, it is a decimal of 38 digits.

Cases: null text, lang and source are empty strings. Groups without terms, and languages that keep none, still have their pairs, with value 0. Repeated
rows are documents of their own. A language of one source has no pairs. Empty tables give no rows. Only text, lang and source are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

#: What stands between terms, which are runs of [^\x00-\x40\x5B-\x60\x7B-\x7F].
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
TOP_TERMS = 10
#: Tasks that the kept terms of one language are dealt over.
SLOTS = 64
UNIT = 1_000_000_000
#: The largest count whose product with ``UNIT`` fits in 64 bits.
NARROW = (2**63 - 1) // UNIT


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Of ASCII texts lower() does the same by bytes; translate() looks up each sign as a string."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and how many of its documents have it."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    # A task counts group after group, so the keys that it meets at a time are those of one group and not of all.
    rows = docs.select(filled("text"), filled("lang"), filled("source")).sortWithinPartitions("lang", "source")
    # Matches are the runs between what is no match. Splitting finds them in one pass; regexp_extract_all copies the text for each.
    terms = rows.select("lang", "source", F.split(lower_ascii(F.col("text")), NO_TERM).alias("terms"))
    # Sorted, the occurrences of a term in a document stand together: the first of them counts the document.
    sorted_terms = terms.select("lang", "source", F.sort_array("terms").alias("terms"))
    # The outer form has no filter on the array's size put before it, which would split and sort each text a second time; no array is empty.
    each = sorted_terms.select("lang", "source", "terms", F.posexplode_outer("terms").alias("at", "term")).filter("term <> ''")
    marked = each.select("lang", "source", F.col("term").cast("binary").alias("key"), F.expr("CASE WHEN at = 0 THEN true ELSE terms[at - 1] <> term END").alias("fresh"))
    # Keys of strings alone are first looked up in a map of 65,536 keys, which a task's terms fill at once; those of bytes go to the large map directly.
    counts = marked.groupBy("lang", "source", "key").agg(F.count("*").alias("n"), F.count_if("fresh").alias("docs"))
    return counts.select("lang", "source", F.col("key").cast("string").alias("term"), "n", "docs")


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 size)), exactly: in 64 bits where the product fits them, else in decimals, which are slow."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = count + 2, total + 2 * size
    narrow = F.call_function("div", F.lit(UNIT).cast("long") * top, bottom)
    exact = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(top), wide(bottom))
    return F.when(top <= NARROW, narrow).otherwise(exact) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_shares(counts: DataFrame, groups: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, p, q) for every group and every kept term of its language; q is the language's own share."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term", "of_lang")
    kept = written(kept, "kept_terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("n_lang"))
    own = written(counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "own_terms")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    facts = groups.join(sizes, "lang").join(totals, ["lang", "source"], "left").withColumn("n_group", F.coalesce("n_group", F.lit(0)))
    copied = facts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    dealt = kept.withColumn("slot", F.pmod(F.hash("term"), F.lit(SLOTS)))
    dense = dealt.join(copied, ["lang", "slot"]).join(own, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.select("lang", "source", "term", "n", _share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), _share(F.col("of_lang"), F.col("n_lang"), F.col("v")).alias("q"))


def audit_sources(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: see the module."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = checkpointed(docs.select(filled("lang"), filled("source")).distinct())
    shares = written(group_shares(written(term_counts(docs), "term_counts"), groups, least), "shares")
    one = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"))
    other = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"))
    half = one.join(other, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(_apart(F.col("p_a"), F.col("p_b"))).alias("value"))
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    all_pairs = groups.toDF("lang", "a").join(groups.toDF("lang", "b"), "lang").filter("a <> b")
    pairs = all_pairs.join(both, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    terms = shares.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row FROM documents),
 w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10),
 sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
 groups AS (SELECT DISTINCT lang, source FROM d),
 own AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
 dense AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.n AS of_lang FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
 shares AS (SELECT x.lang, x.source, x.term, x.n, 1 + (1000000000 * (x.n + 2)) // (sum(x.n) OVER (PARTITION BY x.lang, x.source)::HUGEINT + 2 * s.v) AS p,
   1 + (1000000000 * (x.of_lang + 2)) // (s.total + 2 * s.v) AS q FROM dense x JOIN sizes s USING (lang)),
 met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
   UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
