"""The head's fit in few passes, against Spark ML's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import head
from triagelake.sources.tables import checkpointed

NAMES = ("x", "z", "flat")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    tiers = [rng.choice("0012334") for _ in range(400)]
    return checkpointed(spark.createDataFrame([(f"c{i}", f"T{t}", int(t) + rng.gauss(0, 2), rng.gauss(5, 9), 3.0) for i, t in enumerate(tiers)], "case_id string, tier string, x double, z double, flat double"))


def test_head_equals_spark_ml_run_to_its_end(rows):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    p = head.fit_head(rows, NAMES)
    assert p.classes == head.TIERS and p.scale[2] == 1.0
    scaled = rows.select("tier", *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(NAMES, p.mean, p.scale)], F.substring("tier", 2, 1).cast("double").alias("label"), F.col("tier").isin(*head.RISKY).cast("double").alias("risky"))
    data = checkpointed(VectorAssembler(inputCols=list(NAMES), outputCol="v").transform(scaled))
    fit = lambda label, c, family: LogisticRegression(featuresCol="v", labelCol=label, weightCol="weight", regParam=1 / (c * 400), standardization=False, family=family, tol=1e-14, maxIter=2000).fit(head.balanced(data, label))
    tier, rank = fit("label", 0.5, "multinomial"), fit("risky", 1.0, "binomial")
    assert np.abs(np.array(p.coef) - tier.coefficientMatrix.toArray()).max() < 1e-5
    assert np.abs(np.array(p.intercept) - (tier.interceptVector.toArray() - tier.interceptVector.toArray().mean())).max() < 1e-5
    assert np.abs(np.array(p.ranker) - rank.coefficients.toArray()).max() < 1e-5 and abs(p.ranker_intercept - rank.intercept) < 1e-5


def test_a_fit_takes_few_jobs(spark, rows):
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        head.fit_head(rows, NAMES)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) < 60


def test_one_kind_of_cases_and_features_that_are_missing(rows):
    low = head.fit_head(rows.filter("tier < 'T2'"), NAMES)
    assert low.classes == ("T0", "T1") and low.ranker == (0.0,) * 3 and low.ranker_intercept == float("-inf")
    assert head.apply_head(rows, low).agg(F.max("raw_escalation")).first()[0] == 0.0
    for bad in (None, float("nan")):
        with pytest.raises(ValueError, match="not finite: x"):
            head.fit_head(rows.withColumn("x", F.when(F.col("case_id") == "c7", F.lit(bad)).otherwise(F.col("x"))), NAMES)


def test_terms_are_counted_in_slices_as_they_are_listed(spark, monkeypatch):
    from triagelake.functions.text import char_terms, word_terms

    rng = random.Random(9)
    said = [" ".join(rng.choices(["a", "Dögs", "big", "x_1", "😀ab", "\n\tlong-word", "İs", "run run", "'"], k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "  "]
    texts = checkpointed(spark.createDataFrame([(t,) for t in said], "text string"))
    text = F.coalesce("text", F.lit(""))
    want = {}
    for kind, terms in enumerate((word_terms(text), char_terms(text))):
        for r in texts.withColumn("i", F.monotonically_increasing_id()).select("i", F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("i").alias("df")).collect():
            want[kind, r["term"]] = (r["n"], r["df"])
    assert {(r["kind"], r["term"]): (r["n"], r["df"]) for r in head.term_totals(texts).collect()} == want
    monkeypatch.setattr(head, "SLICE", 40)
    batch = head.with_words(texts).select("_words", "_runs").toArrow().combine_chunks().to_batches()[0]
    cut = list(head._slices([batch]))
    found = {}
    for part in cut:
        for kind, (_, term, count, names) in enumerate(head.counted_terms(part)):
            for t, n in zip(term, count):
                old = found.get((kind, names[t].as_py()), (0, 0))
                found[kind, names[t].as_py()] = old[0] + n, old[1] + 1
    assert len(cut) > 10 and sum(part.num_rows for part in cut) == 63 and found == want


def test_the_text_model_reads_its_rows_few_times(spark):
    """The texts are read once to count terms and once to weigh them, not for each vocabulary and idf."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [(f"{'good kind' if i % 2 else 'bad cruel'} words number {i % 4}", "ab"[i % 2]) for i in range(40)]
    rows = checkpointed(spark.createDataFrame(texts, "text string, label string")).mapInArrow(through, "text string, label string")
    model = head.fit_text_baseline(rows)
    assert read.value <= 3 * 40 and model.predict(rows).filter("predicted = label").count() == 40
