"""The safety gate: graded patterns over turns, suppression, overlap resolution, and verdicts with floors and ceilings.

Regular expressions are matched by a small helper in Arrow batches (their classes are Unicode's, which the JVM's differ from); all
that follows is columns and aggregations. Hits are few, so they are aggregated by (case, category) before anything is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PATTERNS, SUPPRESSORS
from ..functions.text import leet_normalize, tier_name

#: Fixed values. Categories in order with the tier that a strong hit floors at; a category without one only modifies.
CATEGORIES = {"self_harm_intent": 4, "suicidal_ideation": 4, "abuse_disclosure": 4, "threat_of_violence": 3, "weapon_mention": 3, "imminent_time_marker": None}
#: Fixed values. Weight of a severity, strongest first; scores from which a verdict is high or grey; the ceiling without a T4 floor.
WEIGHTS = {"strong": 1.0, "moderate": 0.6, "weak": 0.3}
HIGH, GREY, CEILING = 0.70, 0.35, 3
FLOOR_REASON_WEIGHT = 0.6

MODIFIERS = [c for c, floor in CATEGORIES.items() if floor is None]
HIT = "struct<category:string,severity:string,weight:double,name:string,a:int,b:int>"


def bank_sizes(spark, patterns: Sequence = PATTERNS) -> DataFrame:
    """How many patterns each category has."""
    return spark.createDataFrame([(p[0],) for p in patterns], "category string").groupBy("category").agg(F.count("*").alias("n_patterns"))


def prefilter(patterns: Sequence) -> str | None:
    """One RE2 expression that matches wherever any pattern does; null if a pattern uses what it cannot say.

    RE2 finds it in one pass for a whole batch. Word boundaries are left out and word characters widened to all beyond ASCII, as
    Python's classes are Unicode's: more may match, never less.
    """
    wider = {r"\w": r"\w\x{80}-\x{10ffff}", r"\s": r"\s\x0b\x1c-\x1f\x{80}-\x{10ffff}"}

    def widened(rx: str) -> str:
        inside = lambda m: re.sub(r"\\[ws]", lambda x: wider[x.group()], m.group())
        parts = re.split(r"(\[[^\]]*\])", rx.replace(r"\b", ""))
        return "".join(inside(re.match(r"(?s).*", x)) if i % 2 else re.sub(r"\\[ws]", lambda m: f"[{wider[m.group()]}]", x) for i, x in enumerate(parts))

    if any(re.search(r"\(\?[=!<]|\\[BDWSdAZ1-9]|\[\^[^\]]*\\[ws]", rx) for *_, rx in patterns):
        return None
    union = "(?is)" + "|".join(f"(?:{widened(rx)})" for *_, rx in patterns)
    try:
        pc.match_substring_regex(pa.array([""]), union)
    except pa.ArrowInvalid:
        return None
    return union


def raw_matches(turns: DataFrame, patterns: Sequence = PATTERNS, suppressors: Sequence = SUPPRESSORS) -> DataFrame:
    """``turns`` with ``found`` (pattern matches, in the order in which they claim text) and ``cancelled`` (suppressor spans).

    Needs columns ``text``, ``low`` and ``norm``; blank texts match nothing.
    """
    names = turns.columns
    flags = re.IGNORECASE | re.DOTALL
    ordered = [p for c in CATEGORIES for s in WEIGHTS for p in patterns if p[0] == c and p[1] == s]
    rules = [(c, s, n, re.compile(rx, flags)) for c, s, n, rx in ordered]
    cancels = [(c, re.compile(rx, flags)) for c, _, rx in suppressors]
    likely = prefilter(ordered)
    each = [prefilter([p]) for p in ordered]
    hit = pa.struct([("category", pa.string()), ("severity", pa.string()), ("weight", pa.float64()), ("name", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
    span = pa.struct([("category", pa.string()), ("a", pa.int32()), ("b", pa.int32())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cancelled = [], []
            maybe = np.asarray(pc.or_(*(pc.fill_null(pc.match_substring_regex(batch.column(c), likely), False) for c in ("low", "norm")))) if likely else np.ones(batch.num_rows, dtype=bool)
            # Of the few turns that any pattern is in, each pattern is asked for in one go; only where it is there its places are looked for.
            few = np.flatnonzero(maybe)
            hays = [batch.column(c).take(pa.array(few)) for c in ("low", "norm")]
            present = np.ones((len(few), len(rules)), dtype=bool)
            for i, one in enumerate(each if len(few) else ()):
                if one:
                    present[:, i] = np.asarray(pc.or_(*(pc.fill_null(pc.match_substring_regex(h, one), False) for h in hays)))
            asked = dict(zip(few.tolist(), present, strict=True))
            for row, (text, low, norm) in enumerate(zip(batch.column("text").to_pylist(), batch.column("low").to_pylist(), batch.column("norm").to_pylist(), strict=True)):
                # Offsets are the raw text's only if lower-casing kept its length.
                hay = () if row not in asked or not (text or "").strip() else (low,) if low == norm else (low, norm)
                mine = [rules[i] for i in np.flatnonzero(asked[row]).tolist()] if hay else ()
                hits = [{"category": c, "severity": s, "weight": WEIGHTS[s], "name": n, "a": m.start(), "b": m.end()} for c, s, n, rx in mine for h in hay for m in rx.finditer(h)]
                fired = {h["category"] for h in hits}
                found.append(hits)
                cancelled.append([{"category": c, "a": m.start(), "b": m.end()} for c, rx in cancels if c in fired for h in hay for m in rx.finditer(h)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(hit)), pa.array(cancelled, pa.list_(span))], names=[*names, "found", "cancelled"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    return turns.mapInArrow(match, f"{schema}, found array<{HIT}>, cancelled array<struct<category:string,a:int,b:int>>")


def suppress(found: Column, cancelled: Column) -> Column:
    """Hits not contained in a suppressor's span of their category."""
    return F.filter(found, lambda h: ~F.exists(cancelled, lambda s: (s["category"] == h["category"]) & (s["a"] <= h["a"]) & (h["b"] <= s["b"])))


def resolve_overlaps(hits: Column) -> Column:
    """In order, a hit that overlaps one already kept in its category goes."""
    keep = lambda kept, h: F.when(F.exists(kept, lambda k: (k["category"] == h["category"]) & (h["a"] < k["b"]) & (k["a"] < h["b"])), kept).otherwise(F.concat(kept, F.array(h)))
    return F.aggregate(hits, F.array().cast(f"array<{HIT}>"), keep)


def turn_hits(turns: DataFrame, patterns: Sequence = PATTERNS, suppressors: Sequence = SUPPRESSORS) -> DataFrame:
    """One row for each hit of each turn (case_id, turn, text): what was said, where, and under which pattern."""
    prepared = turns.select("case_id", "turn", "text", F.lower("text").alias("low"), leet_normalize(F.col("text")).alias("norm"))
    hits = raw_matches(prepared, patterns, suppressors).filter(F.size("found") > 0).withColumn("hits", resolve_overlaps(suppress(F.col("found"), F.col("cancelled"))))
    each = hits.select("case_id", "turn", "text", F.posexplode("hits").alias("place", "h"))
    return each.select("case_id", "turn", "place", "h.*", F.substr("text", F.col("h.a") + 1, F.col("h.b") - F.col("h.a")).alias("said"))


def _level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= GREY, "grey").otherwise("clear")


def verdicts(hits: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One verdict for each row of ``scope``, from the union of its hits: score, level, floor, ceiling and categories in order."""
    order = F.create_map(*[x for i, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(i))])
    floors = F.create_map(*[x for c, floor in CATEGORIES.items() for x in (F.lit(c), F.lit(floor).cast("int"))])
    modifies = F.col("category").isin(MODIFIERS)
    by_category = hits.groupBy(*keys, "category").agg(F.max("weight").alias("w"), F.max(F.when(F.col("severity") == "strong", floors[F.col("category")])).alias("hard"), F.max(F.when(F.col("severity") == "moderate", floors[F.col("category")])).alias("soft"), F.count("*").alias("n"))
    # At most one row for each category is collected.
    by_key = by_category.groupBy(*keys).agg(
        F.collect_list("w").alias("ws"), F.max("hard").alias("hard"), F.max("soft").alias("soft"), F.bool_or(modifies).alias("marked"), F.bool_or(~modifies).alias("real"), F.sum("n").alias("n"), F.max("w").alias("max_w"),
        F.transform(F.array_sort(F.collect_list(F.struct(order[F.col("category")].alias("i"), "category"))), lambda x: x["category"]).alias("fired"),
    )
    raised = lambda c: F.when(F.col("marked") & (c == 3), 4).otherwise(c)
    score = F.when(F.col("real"), F.aggregate(F.array_sort("ws"), F.lit(1.0), lambda p, w: p * (1 - w), lambda p: 1 - p)).otherwise(0.0)
    floor = F.greatest(raised(F.col("hard")), raised(F.col("soft")) - 1)
    out = scope.select(*keys).join(by_key, list(keys), "left").withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("floor_rank", F.when(F.col("real"), floor))
    return out.select(
        *keys, "score", _level(F.col("score")).alias("level"), tier_name(F.col("floor_rank")).alias("floor"), F.when(F.col("floor_rank") == 4, F.lit(None).cast("string")).otherwise(F.lit(f"T{CEILING}")).alias("ceiling"),
        F.when(F.col("real"), F.array_join("fired", ",")).otherwise("").alias("categories"), F.coalesce(F.when(F.col("real"), F.col("n")), F.lit(0)).cast("long").alias("n_hits"), F.coalesce(F.when(F.col("real"), F.col("max_w")), F.lit(0.0)).alias("max_weight"), F.coalesce(F.col("floor_rank") == 4, F.lit(False)).alias("requires_crisis"),
    )


def verdict_json(verdicts: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, verdict): what the gate emits as a document; ``hits`` are those that count (real_hits), in order of turn and place."""
    listed = hits.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("turn", "place", "category", "name", "severity", "said"))).alias("h"))
    told = F.transform("h", lambda h: F.struct(h["category"].alias("category"), h["name"].alias("pattern"), h["severity"].alias("severity"), h["turn"].alias("turn_index"), h["said"].alias("text")))
    none = F.array().cast("array<struct<category:string,pattern:string,severity:string,turn_index:bigint,text:string>>")
    fields = F.struct(
        F.round("score", 4).alias("score"), "level", (F.col("level") == "high").alias("is_high"), (F.col("level") == "grey").alias("is_grey"), F.filter(F.split("categories", ","), lambda c: c != "").alias("indicators"), "floor", "ceiling", F.coalesce(told, none).alias("hits"),
    )
    return verdicts.join(listed, "case_id", "left").select("case_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("verdict"))


def real_hits(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits without those of modifiers that have nothing to modify in their scope."""
    real = hits.filter(~F.col("category").isin(MODIFIERS)).select(*keys).distinct()
    return hits.join(real, list(keys), "left_semi")


def top_hits(hits: DataFrame, limit: int = 3) -> DataFrame:
    """Of each case the hits of most weight, then earliest."""
    from pyspark.sql import Window

    order = Window.partitionBy("case_id").orderBy(F.desc("weight"), "turn", "a", "b", "name")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def apply_verdict(predicted: Column, floor: Column, ceiling: Column, override: Column, names: Column) -> tuple[Column, Column]:
    """(tier rank, reason): first the ceiling, unless overridden, then the floor, which has the last word. All ranks are ints."""
    above = ceiling.isNotNull() & (predicted > ceiling)
    capped = F.when(above & ~override, ceiling).otherwise(predicted)
    raised = floor.isNotNull() & (floor > capped)
    tier = F.when(raised, floor).otherwise(capped)
    # The sentences.
    allowed = F.concat(F.lit("model proposed "), tier_name(predicted), F.lit(" above the gate ceiling "), tier_name(ceiling), F.lit("; allowed on strong calibrated self-harm evidence"))
    cut = F.concat(F.lit("capped at "), tier_name(ceiling), F.lit(": no self-harm, abuse disclosure or imminent danger evidence in the transcript"))
    reason = F.when(raised, F.concat(F.lit("floored to "), tier_name(floor), F.lit(" by the safety gate: "), names)).when(above & override, allowed).when(above, cut)
    return tier, reason


def floor_names(hits: DataFrame) -> DataFrame:
    """Of each case the distinct names of hits heavy enough to give a floor its reason, sorted."""
    described = F.concat(F.col("category"), F.lit(" / "), F.col("name"))
    return hits.filter(F.col("weight") >= FLOOR_REASON_WEIGHT).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set(described)), ", ").alias("names"))


def audit_verdicts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Cases whose floor or category set differs from the expected one (case_id, expected_floor, expected_categories)."""
    both = actual.join(expected, "case_id", "full_outer")
    same_floor = F.col("floor").eqNullSafe(F.col("expected_floor"))
    same_set = F.array_sort(F.split("categories", ",")).eqNullSafe(F.array_sort(F.split("expected_categories", ",")))
    return both.filter(~(same_floor & same_set)).select("case_id", "floor", "expected_floor", "categories", "expected_categories")
