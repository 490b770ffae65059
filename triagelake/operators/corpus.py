"""Corpus building: label mapping, exact-key dedupe, caps and stratified splits, all decided by hashes instead of row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import hash_ranked
from ..functions.text import clean_text, norm_key, strip

CAP, LEAST_CHARS, SCARCE = 12_000, 3, 1000
SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}
#: Fixed values. Source order for keeping the first of equal keys.
SOURCES = ("jigsaw", "reddit", "cyberbullying")


def flag_label(threat: Column, identity: Column, insult: Column, toxic: Column, severe: Column, obscene: Column) -> Column:
    """One label from overlapping flags: the gravest wins; obscenity alone has none and is dropped."""
    on = lambda c: F.coalesce(c, F.lit(0)) > 0
    return F.when(on(threat), "threat").when(on(identity), "identity_attack").when(on(insult) | on(toxic) | on(severe), "harassment").when(on(obscene), F.lit(None).cast("string")).otherwise("none")


#: Fixed values. Classes of two labelled sources and the labels they stand for; any other class has none and is dropped.
SUBREDDITS = {"suicidewatch": "self_harm", "depression": "distress", "teenagers": "none"}
BULLYING = {"not_cyberbullying": "none", "religion": "identity_attack", "ethnicity": "identity_attack", "gender": "identity_attack", "age": "identity_attack", "other_cyberbullying": "harassment"}


def class_label(value: Column, labels: dict[str, str]) -> Column:
    """The label of a class name, whatever its case and the blanks around it."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.lower(strip(value))]


def cleaned(rows: DataFrame, text: str = "text") -> DataFrame:
    """Labelled rows with clean text of some length."""
    return rows.withColumn(text, clean_text(F.col(text))).filter((F.length(text) >= LEAST_CHARS) & F.col("harm").isNotNull())


def first_of_key(rows: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """The first row of each normalised key.

    ``min_by`` combines before the shuffle, so a key that a third of all rows share costs one row for each task.
    """
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(norm_key(F.col(text)).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def cap_groups(rows: DataFrame, keys: list[str], cap: int = CAP, row_id: str = "row_id") -> DataFrame:
    """At most ``cap`` rows of each group, chosen by a hash of the id."""
    return hash_ranked(rows, keys, row_id).filter(F.col("_rank") <= cap).drop("_rank", "_size")


def stratified_split(rows: DataFrame, label: str = "harm", row_id: str = "row_id") -> DataFrame:
    """``split`` by rank within the class in hash order, 70/15/15."""
    share = (F.col("_rank") - 1) / F.col("_size")
    return hash_ranked(rows, [label], row_id).withColumn("split", F.when(share < SPLITS["train"], "train").when(share < SPLITS["train"] + SPLITS["val"], "val").otherwise("test")).drop("_rank", "_size")


def class_distribution(rows: DataFrame, label: str = "harm") -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(label, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), (F.col("n") < SCARCE).alias("scarce"))
