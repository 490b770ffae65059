"""Report markers and conversation features: one aggregation by case, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import DURATIONS, MARKERS
from .gate import CATEGORIES

HARMS = ("none", "distress", "harassment", "identity_attack", "threat", "self_harm")
CONCERNING, MOST_WEEKS, TOP_K, LEAST_FOR_SLOPE = 0.5, 100.0, 3, 4

#: Fixed values. Feature groups, each a rung of the ablation ladder; 38 in all, in the order of the design matrix.
GROUPS = {
    "gate": ["gate_score", "gate_has_floor", "gate_floor_rank", "gate_is_high", "gate_is_grey", "gate_hit_count", "gate_max_weight", *[f"gate_{c}" for c in CATEGORIES]],
    "turn": ["max_risk", "mean_risk", "topk_mean_risk", "frac_above_tau", "count_above_tau", *[f"max_p_{h}" for h in HARMS]],
    "trend": ["trend_slope", "last_risk", "second_half_delta", "peak_position", "n_turns"],
    "report": ["duration_score", "frequency_count", "has_frequency", "avoidance_count", "has_avoidance", "barrier_count", "has_identity_target"],
    "history": ["prior_sessions", "prior_max_tier_rank"],
}
FEATURES = [name for names in GROUPS.values() for name in names]
ABLATIONS = {"gate-only": ("gate",), "turn-only": ("turn",), "gate+turn": ("gate", "turn"), "+trend": ("gate", "turn", "trend"), "+report": ("gate", "turn", "trend", "report"), "full": tuple(GROUPS)}


def markers(accounts: DataFrame) -> DataFrame:
    """Per case (case_id, account: turns joined by line breaks): duration, counts of matching patterns by family, and flags."""
    text = F.col("account")
    found = lambda pattern: text.rlike(f"(?i){pattern}")
    weeks = F.greatest(F.lit(0.0), *[F.when(found(p), F.lit(w)).otherwise(0.0) for w, p in DURATIONS])
    names = {family: F.filter(F.array(*[F.when(found(p), F.lit(n)) for f, n, p in MARKERS if f == family]), lambda x: x.isNotNull()) for family in ("frequency", "avoidance", "barrier", "identity")}
    out = accounts.select("case_id", weeks.alias("duration_weeks"), *[names[f].alias(f"{f}_hits") for f in names])
    count = lambda f: F.size(f"{f}_hits").cast("double")
    flag = lambda f: (F.size(f"{f}_hits") > 0).cast("double")
    return out.select(
        "*", (F.log1p("duration_weeks") / F.log1p(F.lit(MOST_WEEKS))).alias("duration_score"), count("frequency").alias("frequency_count"), flag("frequency").alias("has_frequency"), count("avoidance").alias("avoidance_count"),
        flag("avoidance").alias("has_avoidance"), count("barrier").alias("barrier_count"), flag("identity").alias("has_identity_target"),
    )


def describe_markers() -> Column:
    """Sentences that a case's markers give its card."""
    # The sentences.
    parts = [
        F.when(F.col("duration_weeks") >= 4, F.concat(F.lit("ongoing for roughly "), F.col("duration_weeks").cast("int").cast("string"), F.lit("+ weeks"))),
        F.when(F.size("avoidance_hits") > 0, F.lit("student has changed their behaviour to avoid it")),
        F.when(F.size("frequency_hits") >= 2, F.lit("described as recurring")),
        F.when(F.size("identity_hits") > 0, F.concat(F.lit("targets a protected characteristic: "), F.array_join(F.transform("identity_hits", lambda h: F.replace(h, F.lit("_"), F.lit(" "))), ", "))),
        F.when(F.size("barrier_hits") > 0, F.lit("barrier to disclosure reported")),
    ]
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def turn_features(turns: DataFrame) -> DataFrame:
    """Per case (case_id, turn, probs): levels and peaks of the risk of its turns.

    The riskiest few are ranked apart: each task hands on that many of a case at most, as it does one row of its sums."""
    risk = turns.withColumn("risk", 1 - F.get("probs", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("risk")))
    top = risk.select("case_id", "risk").withColumn("place", place).filter(F.col("place") <= TOP_K).groupBy("case_id").agg(F.avg("risk").alias("topk_mean_risk"))
    own = [F.max(F.get("probs", F.lit(i))).alias(f"max_p_{h}") for i, h in enumerate(HARMS)]
    concerning = F.count_if(F.col("risk") > CONCERNING)
    out = risk.groupBy("case_id").agg(F.max("risk").alias("max_risk"), F.avg("risk").alias("mean_risk"), (concerning / F.count("*")).alias("frac_above_tau"), concerning.cast("double").alias("count_above_tau"), *own)
    return out.join(top, "case_id")


def trend_features(turns: DataFrame) -> DataFrame:
    """Per case: slope (0 under four turns), second half less first, last risk, place of the peak, turns."""
    risk = turns.withColumn("risk", 1 - F.get("probs", F.lit(0)))
    n = F.count("*").over(Window.partitionBy("case_id"))
    sized = risk.withColumn("n", n).withColumn("half", F.floor(F.col("n") / 2))
    late, early = F.when(F.col("turn") >= F.col("half"), F.col("risk")), F.when(F.col("turn") < F.greatest("half", F.lit(1)), F.col("risk"))
    out = sized.groupBy("case_id").agg(
        F.max("n").alias("n"), F.regr_slope(F.col("risk"), F.col("turn").cast("double")).alias("slope"), (F.avg(late) - F.avg(early)).alias("second_half_delta"), F.max_by("risk", "turn").alias("last_risk"), F.min_by("turn", F.struct(-F.col("risk"), F.col("turn"))).alias("peak")
    )
    return out.select("case_id", F.when(F.col("n") >= LEAST_FOR_SLOPE, F.col("slope")).otherwise(0.0).alias("trend_slope"), "second_half_delta", "last_risk", F.when(F.col("n") > 1, F.col("peak") / (F.col("n") - 1)).otherwise(0.0).alias("peak_position"), F.col("n").cast("double").alias("n_turns"))


def featurise(verdicts: DataFrame, turns: DataFrame, accounts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The 38 features of each case that has turns, joined on its id alone.

    ``history`` may give prior_sessions and prior_max_tier_rank by case_id; both are 0 without it.
    """
    fired = F.split("categories", ",")
    gate = verdicts.select(
        "case_id", F.col("score").alias("gate_score"), F.col("floor").isNotNull().cast("double").alias("gate_has_floor"), F.coalesce(F.substring("floor", 2, 1).cast("double"), F.lit(0.0)).alias("gate_floor_rank"),
        (F.col("level") == "high").cast("double").alias("gate_is_high"), (F.col("level") == "grey").cast("double").alias("gate_is_grey"), F.col("n_hits").cast("double").alias("gate_hit_count"), F.col("max_weight").alias("gate_max_weight"),
        *[F.array_contains(fired, c).cast("double").alias(f"gate_{c}") for c in CATEGORIES],
    )
    report = markers(accounts).select("case_id", *GROUPS["report"])
    out = turn_features(turns).join(trend_features(turns), "case_id").join(report, "case_id", "left").join(gate, "case_id", "left")
    if history is None:
        out = out.withColumn("prior_sessions", F.lit(0.0)).withColumn("prior_max_tier_rank", F.lit(0.0))
    else:
        out = out.join(history.select("case_id", *[F.col(c).cast("double").alias(c) for c in GROUPS["history"]]), "case_id", "left")
    return out.fillna(0.0).select("case_id", *FEATURES)


def checked(rows: DataFrame) -> DataFrame:
    """Features as they are; a missing or non-finite one fails the read."""
    fine = lambda f: F.when(F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf")), F.raise_error(F.concat(F.lit(f"{f} is not finite: "), F.col("case_id")))).otherwise(F.col(f)).alias(f)
    return rows.select("case_id", *map(fine, FEATURES))


#: Fixed values. Why a turn is quoted, where no pattern is the reason.
RISKIEST, NO_SIGNAL = "highest-scoring turn", "no explicit signal; highest-scoring turn"


def quotes(turns: DataFrame, hits: DataFrame, queued: DataFrame | None = None, limit: int = 3, least: int = 15) -> DataFrame:
    """(case_id, rank, turn, band, quote, score, reason): up to ``limit`` quotes of a case, one for each turn.

    First turns with gate hits (their strongest, then earliest one), by weight, turn and place; then risky turns of some length, by risk. A case
    of ``queued`` (case_id) that has none of these gets its riskiest turn of some length, and the reason says that nothing in it was a signal.
    """
    from ..functions.text import strip, widen_quote

    hit = F.min_by(F.struct("weight", "a", "said", "category", "name"), F.struct((-F.col("weight")).alias("w"), "a", "place")).alias("h")
    cited = hits.groupBy("case_id", "turn").agg(hit).select("case_id", "turn", "h.*")
    described = F.concat("category", F.lit(" / "), "name")
    first = cited.join(turns.select("case_id", "turn", "text"), ["case_id", "turn"]).select("case_id", "turn", F.lit(0).alias("band"), (-F.col("weight")).alias("key"), "a", widen_quote(F.col("said"), F.col("text"), least).alias("quote"), F.col("weight").alias("score"), described.alias("reason"))
    long = turns.select("case_id", "turn", strip(F.col("text")).alias("quote"), (1 - F.get("probs", F.lit(0))).alias("score")).filter(F.length("quote") >= least)

    def by_risk(rows: DataFrame, band: int, reason: str) -> DataFrame:
        return rows.select("case_id", "turn", F.lit(band).alias("band"), (-F.col("score")).alias("key"), F.lit(0).alias("a"), "quote", "score", F.lit(reason).alias("reason"))

    risky = long.filter(F.col("score") >= CONCERNING).join(cited.select("case_id", "turn"), ["case_id", "turn"], "left_anti")
    found = first.unionByName(by_risk(risky, 1, RISKIEST))
    if queued is not None:
        without = queued.select("case_id").distinct().join(found.select("case_id").distinct(), "case_id", "left_anti")
        best = long.join(without, "case_id", "left_semi").groupBy("case_id").agg(F.max_by(F.struct("turn", "quote", "score"), F.struct("score", -F.col("turn"))).alias("b")).select("case_id", "b.*")
        found = found.unionByName(by_risk(best, 2, NO_SIGNAL))
    order = Window.partitionBy("case_id").orderBy("band", "key", "turn", "a")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("case_id", F.col("rank").cast("long").alias("rank"), "turn", "band", "quote", "score", "reason")
