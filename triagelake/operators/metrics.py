"""Classification, calibration and budget metrics as aggregations. Predictions have y_true and y_pred as positions in ``labels``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import hash_ranked, ranked


def confusion(predictions: DataFrame, n_labels: int) -> DataFrame:
    """Counts for every pair of labels, absent ones too: one row for each, whatever the data's size."""
    counts = predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    side = predictions.sparkSession.range(n_labels)
    grid = side.select(F.col("id").alias("y_true"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_labels - 1).cast("long"))).alias("y_pred"))
    return grid.join(F.broadcast(counts), ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(predictions: DataFrame, n_labels: int) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where undefined."""
    cells = confusion(predictions, n_labels)
    by = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    each = cells.select(F.explode(F.array_distinct(F.array(F.col("y_true"), F.col("y_pred")))).alias("label"), "*")
    sums = each.groupBy("label").agg(by(F.col("y_true") == F.col("y_pred")).alias("hit"), by(F.col("y_true") == F.col("label")).alias("support"), by(F.col("y_pred") == F.col("label")).alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.withColumn("precision", ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return out.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.col("support").cast("long").alias("support"))


def summary_scores(predictions: DataFrame, n_labels: int) -> DataFrame:
    """Macro and weighted F1 and accuracy: one row."""
    per = class_scores(predictions, n_labels)
    return per.agg(F.avg("f1").alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"), F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("accuracy"))


def top_class(predictions: DataFrame) -> DataFrame:
    """y_true and probs with the first largest probability: y_pred and conf."""
    best = F.array_max("probs")
    return predictions.withColumn("conf", best).withColumn("y_pred", F.array_position("probs", best) - 1)


def reliability_bins(scored: DataFrame, n_bins: int = 15) -> DataFrame:
    """Equal-width bins of confidence, (lo, hi] with 0 in the first, empty ones kept."""
    place = F.greatest(F.ceil(F.col("conf") * n_bins).cast("long") - 1, F.lit(0).cast("long"))
    # an edge that the product rounds over belongs to the bin below
    place = F.when((place > 0) & (F.col("conf") <= place / F.lit(float(n_bins))), place - 1).otherwise(place)
    sums = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    every = scored.sparkSession.range(n_bins).withColumnRenamed("id", "bin")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    out = every.join(F.broadcast(sums), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), zero("mean_conf"), zero("accuracy"))
    return out.withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_conf")))


def calibration_error(scored: DataFrame, n_bins: int = 15) -> DataFrame:
    """Expected error over all bins; the largest among bins with at least 1 % of rows (and one)."""
    bins = reliability_bins(scored, n_bins).withColumn("total", F.sum("n").over(Window.partitionBy()))
    enough = F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("total") * 0.01))
    return bins.agg(F.sum(F.col("gap") * F.col("n") / F.col("total")).alias("ece"), F.max(F.when(enough, F.col("gap"))).alias("mce"))


def proper_scores(scored: DataFrame) -> DataFrame:
    """Brier score, negative log-likelihood (clipped), mean confidence and accuracy."""
    brier = F.aggregate(F.transform("probs", lambda p, i: F.pow(p - (i == F.col("y_true")).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    loss = -F.log(F.greatest(F.get("probs", F.col("y_true").cast("int")), F.lit(1e-12)))
    return scored.agg(F.avg(brier).alias("brier"), F.avg(loss).alias("nll"), F.avg("conf").alias("mean_confidence"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def safety_view(predictions: DataFrame, none: int = 0) -> DataFrame:
    """Of risky rows: the share predicted risky at all, and the share missed as ``none``."""
    risky = F.count_if(F.col("y_true") != none)
    ratio = lambda c: F.coalesce(F.try_divide(F.count_if((F.col("y_true") != none) & c).cast("double"), risky), F.lit(0.0))
    return predictions.agg(risky.alias("n_risky"), ratio(F.col("y_pred") != none).alias("risky_recall"), ratio(F.col("y_pred") == none).alias("missed_as_none"))


def confusion_pair(predictions: DataFrame, a: int, b: int) -> DataFrame:
    """How often ``a`` is taken for ``b`` and the reverse, as shares of each."""
    share = lambda t, p: F.coalesce(F.try_divide(F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p)).cast("double"), F.count_if(F.col("y_true") == t)), F.lit(0.0))
    return predictions.agg(share(a, b).alias("a_as_b"), share(b, a).alias("b_as_a"))


def class_gaps(scored: DataFrame) -> DataFrame:
    """Mean predicted probability of each class less its base rate."""
    each = scored.select("y_true", F.posexplode("probs").alias("label", "p"))
    return each.groupBy(F.col("label").cast("long").alias("label")).agg(F.avg("p").alias("mean_prob"), F.avg((F.col("y_true") == F.col("label")).cast("double")).alias("base_rate")).withColumn("gap", F.col("mean_prob") - F.col("base_rate"))


def recall_curve(rows: DataFrame, ks: tuple[int, ...] = (10, 20, 30, 40)) -> DataFrame:
    """Recall of positives (0 or 1) among the k highest (score from 0 to 1 desc, id asc), for each k and for k = all positives."""
    total = rows.agg(F.coalesce(F.sum("positive"), F.lit(0)).cast("long").alias("total"))
    part = F.floor((1 - F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))) * 4096)
    placed = ranked(rows, [], part, [F.desc("score"), F.col("id")], "r").crossJoin(F.broadcast(total))
    limits = [*[F.lit(k).cast("long") for k in ks], F.col("total")]
    hits = placed.groupBy("total").agg(*[F.sum(F.when(F.col("r") <= k, F.col("positive"))).alias(f"hit{i}") for i, k in enumerate(limits)])
    points = F.array(*[F.struct(k.alias("k"), F.col(f"hit{i}").alias("hit")) for i, k in enumerate(limits)])
    return hits.select(F.explode(points).alias("p"), "total").select("p.k", F.coalesce(F.try_divide(F.col("p.hit"), F.col("total")), F.lit(0.0)).alias("recall"))


def temperature_grid(rows: DataFrame, grid: list[float]) -> DataFrame:
    """Mean loss of logits at each temperature of a fixed grid: all temperatures in one pass."""
    from ..functions.text import softmax

    losses = [F.avg(-F.log(F.greatest(F.get(softmax(F.col("logits"), t), F.col("y_true").cast("int")), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)]
    stacked = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)])).alias("x")
    return rows.agg(*losses).select(stacked).select("x.*")


def fit_temperature(rows: DataFrame, rounds: int = 4, steps: int = 16) -> float:
    """The temperature of least mean loss: a grid over its logarithm, refined around the best; a pass over the rows for each round."""
    low, high = math.log(0.05), math.log(20.0)
    for _ in range(rounds):
        grid = [math.exp(low + (high - low) * i / steps) for i in range(steps + 1)]
        losses = {r["temperature"]: r["nll"] for r in temperature_grid(rows, grid).collect()}
        best = min(range(steps + 1), key=lambda i: (losses[grid[i]], i))
        low, high = math.log(grid[max(0, best - 1)]), math.log(grid[min(steps, best + 1)])
    return grid[best]


def calibration_report(rows: DataFrame, temperature: float) -> DataFrame:
    """Errors and scores of logits as they are and at a temperature: two rows."""
    from ..functions.text import softmax

    def report(name: str, t: float) -> DataFrame:
        scored = top_class(rows.select("y_true", softmax(F.col("logits"), t).alias("probs")))
        return calibration_error(scored).crossJoin(proper_scores(scored)).select(F.lit(name).alias("stage"), F.lit(float(t)).alias("temperature"), "ece", "mce", "brier", "nll", "accuracy")

    return report("raw", 1.0).unionByName(report("scaled", temperature))


def label_counts(scored: DataFrame, group: str) -> DataFrame:
    """How often each label is the likeliest, by group, with its place (most frequent first, then by label)."""
    counts = scored.groupBy(group, F.col("y_pred").cast("long").alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "label")).cast("long"))


def stratified_draw(rows: DataFrame, label: str, row_id: str) -> DataFrame:
    """The baseline that draws a class by its share: classes in order along 0 to 1, and a point for each row from its id's SHA-1."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    upper = F.sum("n").over(Window.partitionBy().orderBy(label)) / F.sum("n").over(Window.partitionBy())
    edges = counts.select(label, upper.alias("upper")).agg(F.array_sort(F.collect_list(F.struct("upper", F.col(label).alias("drawn")))).alias("edges"))
    point = F.conv(F.substring(F.sha1(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.crossJoin(F.broadcast(edges)).withColumn("drawn", F.get(F.filter("edges", lambda e: point < e["upper"]), F.lit(0))["drawn"]).drop("edges")


def class_weights(rows: DataFrame, label: str = "harm") -> DataFrame:
    """n / (classes x count) of each class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(totals)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def risk_by_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean_risk"), F.min(value).alias("min_risk"))


def simulated_recall(cases: DataFrame, prior: dict[str, float], weeks: int = 500, intake: int = 100, budget: int = 20, seed: int = 7) -> DataFrame:
    """Recall of T3 and T4 within a weekly budget over simulated weeks that follow ``prior``: one row.

    Each slot of each week draws a case of its tier by hash; slots join cases on (tier, place), so nothing is multiplied out.
    """
    spark = cases.sparkSession
    numbered = hash_ranked(cases, ["tier"], "case_id").withColumn("place", F.col("_rank") - 1)
    sizes = cases.groupBy("tier").agg(F.count("*").alias("size"))
    quota = [(t, round(p * intake)) for t, p in prior.items()]
    slots = spark.range(weeks).withColumnRenamed("id", "week").crossJoin(F.broadcast(spark.createDataFrame(quota, "tier string, quota int"))).select("week", "tier", F.explode(F.expr("sequence(1, quota)")).alias("slot"))
    number = lambda n: F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(n)), "week", "tier", "slot")), 1, 15), 16, 10).cast("long")
    drawn = slots.join(F.broadcast(sizes), "tier").withColumn("place", F.pmod(number(seed), F.col("size")))
    jitter = F.pmod(number(seed + 1), F.lit(1000)) * 1e-12
    filled = drawn.join(numbered.select("tier", "place", "score"), ["tier", "place"]).withColumn("r", F.row_number().over(Window.partitionBy("week").orderBy(F.desc(F.col("score") + jitter), "tier", "slot")))
    risky = F.col("tier").isin("T3", "T4")
    weekly = filled.groupBy("week").agg(F.try_divide(F.count_if(risky & (F.col("r") <= budget)).cast("double"), F.count_if(risky)).alias("recall"))
    return weekly.agg(F.avg("recall").alias("mean_recall"), F.stddev_pop("recall").alias("sd_recall"), F.count("*").alias("weeks"))
