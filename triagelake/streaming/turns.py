"""Structured Streaming over turns and events: the gate's verdicts as a store on disk, windows and sessions.

The state of a case lives in ``cases``; here its rows go into a store of hash buckets, of which a batch rewrites those that hold a case it changed. A batch that runs
twice writes the same rows: a row with a lower number never replaces a higher one, and the crisis flag latches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed_values import PATTERNS, SUPPRESSORS
from ..sources.stores import BucketStore
from .cases import KEEP_DAYS, LATE, OUT, case_states

EVENT = "case_id string, seq long, first long, turns array<string>, at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict_store(spark: SparkSession, folder: str, buckets: int = 64) -> BucketStore:
    return BucketStore(spark, folder, OUT, "case_id", buckets)


def run_gate(events: DataFrame, folder: str, checkpoint: str, patterns=PATTERNS, suppressors=SUPPRESSORS, keep_days: float = KEEP_DAYS, late: str = LATE, buckets: int = 64) -> StreamingQuery:
    """Keep one verdict for each case in the store under ``folder``."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("case_id").agg(F.max_by(F.struct(*batch.columns), F.struct("seq", "closed")).alias("r")).select("r.*")
        verdict_store(batch.sparkSession, folder, buckets).upsert(last, latch=("crisis",), newest="seq")

    spark, key = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    # The only provider that keeps maps and timers; a query takes the setting over as it starts.
    spark.conf.set(key, PROVIDER)
    try:
        out = case_states(events, patterns, suppressors, keep_days, late)
        return out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def read_events(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Messages as JSON lines, so many files a batch at most; one that does not say when it was sent was sent now."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(folder).withColumn("at", F.coalesce("at", F.current_timestamp()))


def windowed_counts(events: DataFrame, watermark: str = "1 hour", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events by window and type, late ones within the watermark: an extension for streams, batch or live."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap: an extension for streams, batch or live."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
