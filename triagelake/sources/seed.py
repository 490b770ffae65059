"""The seed load: fixtures redacted, cases upserted, turns and sealed spans rewritten; dry unless a folder is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.casework import retention_expiry
from ..operators.privacy import redact, seal
from .stores import BucketStore
from .tables import checkpointed, replace_children, upsert


def seeded(turns: DataFrame, cards: DataFrame, entities: DataFrame, key: Column, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables conversations, turns and pii after the load.

    ``turns`` (case_id, turn, role, text) of cases with a card (case_id, handle, tier, confidence, started_at) are redacted, each by itself, with
    what ``entities`` (case_id, people, places) knows of the case. ``before`` has the same tables as they were: cases are upserted, and all turns and spans
    of a loaded case come from this load, so that a second one changes nothing but nonces.
    """
    none = F.array().cast("array<string>")
    known = turns.join(cards.select("case_id"), "case_id", "left_semi").join(entities.select("case_id", "people", "places"), "case_id", "left")
    clean = redact(known.select(F.struct("case_id", "turn", "role").alias("id"), "text", F.coalesce("people", none).alias("people"), F.coalesce("places", none).alias("places")))
    told = clean.select("id.case_id", "id.turn", "id.role", F.col("redacted").alias("text"), F.size("spans").cast("long").alias("n_spans"))
    spans = clean.select("id.case_id", "id.turn", F.explode("spans").alias("s")).select("case_id", "turn", "s.type", "s.placeholder", seal(F.col("s.value"), key).alias("ciphertext"))
    loaded = {"conversations": cards.withColumn("retention_expires_at", retention_expiry(F.col("started_at"), F.col("tier"))), "turns": told, "pii": spans}
    if before is None:
        return loaded
    # A case without spans has had its old ones replaced by none.
    kept = before["pii"].join(cards.select("case_id"), "case_id", "left_anti")
    return {"conversations": upsert(before["conversations"], loaded["conversations"], "case_id"), "turns": replace_children(before["turns"], told, "case_id"), "pii": kept.unionByName(spans)}


def report(loaded: dict[str, DataFrame], written: bool) -> DataFrame:
    """One row of counts; a load in which nothing was redacted fails, as then the entities were not there."""
    turns = loaded["turns"].agg(F.count_distinct("case_id").alias("cases"), F.count("*").alias("turns"), F.count_if(F.col("n_spans") > 0).alias("turns_redacted"), F.coalesce(F.sum("n_spans"), F.lit(0)).alias("spans_found"))
    checked = F.when(F.col("turns_redacted") == 0, F.raise_error(F.lit("nothing was redacted")).cast("long")).otherwise(F.col("turns_redacted"))
    return turns.withColumn("turns_redacted", checked).withColumn("spans_sealed", F.col("spans_found") if written else F.lit(0).cast("long"))


def load(turns: DataFrame, cards: DataFrame, entities: DataFrame, key: Column, folder: str | None = None, before: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run the load, into ``folder`` if one is given (not the one that ``before`` is read from), and report it."""
    loaded = seeded(turns, cards, entities, key, before)
    counts = report(seeded(turns, cards, entities, key), folder is not None)
    if folder is not None:
        counts.collect()
        for name, rows in loaded.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    return counts


CONVERSATION = "case_id string, handle string, tier string, confidence double, started_at timestamp, retention_expires_at timestamp"
TURN, PII = "case_id string, turn long, role string, text string, n_spans long", "case_id string, turn long, type string, placeholder string, ciphertext string"


def seed_stores(spark: SparkSession, folder: str, buckets: int = 64) -> dict[str, BucketStore]:
    """The stores that a load goes into: cases, their turns, and what was sealed of those."""
    return {name: BucketStore(spark, f"{folder}/{name}", schema, "case_id", buckets) for name, schema in (("conversations", CONVERSATION), ("turns", TURN), ("pii", PII))}


def load_into(stores: dict[str, BucketStore], turns: DataFrame, cards: DataFrame, entities: DataFrame, key: Column) -> DataFrame:
    """Load into stores and report: only the buckets of the cases that are loaded are rewritten.

    What is sealed is written once before it goes anywhere, as each sealing has a nonce of its own.
    """
    loaded = {name: checkpointed(rows) for name, rows in seeded(turns, cards, entities, key).items()}
    counts = checkpointed(report(loaded, True))
    stores["conversations"].upsert(loaded["conversations"])
    for name in ("turns", "pii"):
        stores[name].replace_children(loaded[name], cards)
    return counts
