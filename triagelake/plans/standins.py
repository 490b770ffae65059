"""Inputs for the queries from the driver's tables.

They stand in for what those tables lack and are no model's output: probabilities are hash digits, start times follow from ids, entities
are long words, and the vocabulary bank grades everyday words, since the shipped bank matches none of the invented text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import student_turns, table

#: (category, severity, name, pattern): one everyday word for each category.
VOCABULARY = (
    ("self_harm_intent", "weak", "w_was", r"\bwas\b"),
    ("suicidal_ideation", "moderate", "w_from", r"\bfrom\b"),
    ("abuse_disclosure", "weak", "w_with", r"\bwith\b"),
    ("threat_of_violence", "strong", "w_are", r"\bare\b"),
    ("weapon_mention", "moderate", "w_by", r"\bby\b"),
    ("imminent_time_marker", "strong", "w_or", r"\bor\b"),
)
#: A bank whose patterns overlap, and a suppressor: for text in which look-alike signs stand for letters in every other turn.
OVERLAPPING = (("weapon_mention", "strong", "w_of_the", r"\bof the\b"), ("weapon_mention", "moderate", "w_the", r"\bthe\b"), ("threat_of_violence", "strong", "w_in", r"\bin\b"), ("abuse_disclosure", "weak", "w_a", r"\ba\b"))
SUPPRESSING = (("threat_of_violence", "in_the", r"\bin the\b"),)
#: What a student may write, one to a case, for the shipped bank.
SAID = (
    "we walked 5 kms for charity", "im gonna kill myself", "i'm going to end it all tonight", "he said he'd stab me after school", "i've been cutting my arms", "i have been cutting my legs", "this homework is killing me", "he told me to kill myself, and honestly i do want to die",
    "i would never kill myself", "self harm", "there was a knife", "someone brought a knife to school", "see you tomorrow", "i w4nt t0 d!e", "k1ll my5elf", "", "   ", "kai says he'll batter me", "i stopped cutting last year", "we had pizza and a quiz",
)
KEY = b"a key for tests, not a secret"


def hash_probs(text: Column, n: int) -> Column:
    """n positive numbers that add up to 1, from the hex digits of a text's SHA-1."""
    digest = F.sha1(F.coalesce(text, F.lit("")))
    raw = F.array(*[F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("double") + 1 for i in range(n)])
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def started_at(conv_id: Column) -> Column:
    """Four hours earlier for each id."""
    return F.timestamp_micros(F.lit(1_772_323_200_000_000) - conv_id * F.lit(4 * 3_600_000_000))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, turn, text, conv_id, probs) of all student turns."""
    return student_turns(table(spark, folder, "conversations")).withColumn("probs", hash_probs(F.col("text"), 6))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, conv_id, started_at, handle)."""
    ids = table(spark, folder, "conversations").filter("role = 'user'").select("conv_id").distinct()
    return ids.select(F.concat(F.lit("case-"), F.col("conv_id").cast("string")).alias("case_id"), "conv_id", started_at(F.col("conv_id")).alias("started_at"), F.concat(F.lit("Handle"), F.col("conv_id").cast("string")).alias("handle"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, seq, first, turns, at): each student turn as a delta; each first turn twice; and a stale one that says other things, numbered below them."""
    own = turns(spark, folder).join(cases(spark, folder).select("case_id", "started_at"), "case_id")
    sent = lambda rows, seq, text, at: rows.select("case_id", seq.cast("long").alias("seq"), F.col("turn").alias("first"), F.array(text).alias("turns"), at.alias("at"))
    minutes = F.timestamp_micros(F.unix_micros("started_at") + F.col("turn") * 60_000_000)
    begun = own.filter("turn = 0")
    return sent(own, F.col("turn") + 2, F.col("text"), minutes).unionByName(sent(begun, F.lit(2), F.col("text"), F.col("started_at"))).unionByName(sent(begun, F.lit(1), F.lit("the of in or by and"), F.col("started_at")))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, account): all student turns of a case, in order, by line."""
    said = turns(spark, folder).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return said.select("case_id", F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("account"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(id, y_true, probs) over three classes: quality plus toxicity of labelled documents, and hash digits of their text."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).cast("long").alias("y_true"), hash_probs(F.col("text"), 3).alias("probs"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, source, text, harm): flags of labelled documents mapped to one label."""
    from ..operators.corpus import flag_label

    zero = F.lit(0)
    rows = table(spark, folder, "documents").select("doc_id", "source", "text").join(table(spark, folder, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("row_id"), "source", "text", flag_label(zero, zero, F.col("toxic"), zero, zero, 1 - F.col("quality")).alias("harm"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, people, places): long capitalised and long lower-case words of the student's turns."""
    own = accounts(spark, folder)
    words = lambda p: F.array_distinct(F.filter(F.split("account", "[^A-Za-z]+"), lambda w: w.rlike(p)))
    return own.select("case_id", words("^[A-Z][a-z]{5,}$").alias("people"), words("^[a-z]{10,}$").alias("places"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Cases as stored records: tier, holds, expiry and tombstones follow from the id."""
    c = F.col("conv_id")
    return cases(spark, folder).select(
        "case_id", "conv_id", "started_at", F.when(c % 7 == 6, F.lit(None).cast("string")).otherwise(F.concat(F.lit("T"), (c % 5).cast("string"))).alias("tier"),
        F.when(c % 11 == 0, F.col("started_at") + F.expr("INTERVAL 2 DAYS")).alias("retention_expires_at"), F.when(c % 13 == 0, "under review").alias("retention_hold_reason"), F.when(c % 17 == 0, F.col("started_at")).alias("content_deleted_at"),
        F.when(c % 17 != 0, F.concat(F.lit("card of "), "case_id")).alias("card"),
    )


def reason(n: Column) -> Column:
    """Of any length up to 29, every third with tabs, line breaks and wide blanks around it, every eleventh of nothing else."""
    written = F.repeat(F.lit("x"), (n % 30).cast("int"))
    return F.when(n % 11 == 5, F.repeat(F.lit("\t\r\n\u3000"), 8)).when(n % 3 == 1, F.concat(F.lit("\n\t \u00a0"), written, F.lit("\r\n\u2003\ufeff"))).otherwise(written)


def access(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as an access log: (seq, case_id, counsellor_id, action, reason, at)."""
    e = table(spark, folder, "events")
    actions = ("viewed_card", "viewed_transcript", "unsealed_pii", "overrode_tier")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("case-"), (F.col("user_id") % 50).cast("string")).alias("case_id"), F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("counsellor_id"),
        F.element_at(F.array(*map(F.lit, actions)), (F.col("event_id") % 4 + 1).cast("int")).alias("action"), reason(F.col("event_id")).alias("reason"), F.col("ts").alias("at"),
    )
