"""Stores on disk that a batch changes in part: hash buckets that are rewritten only where a batch touches them, and logs that take a batch once.

A store is ``rows/bucket=N`` under its folder, N from the hash of the key. A batch's change is computed from the touched buckets alone and written beside
them first (``redo``); then those buckets are overwritten by dynamic partition overwrite, and the copy goes. A run that is lost while it overwrites leaves a whole
copy, which the next change plays again before its own: no state between two is ever read. One writer at a time, as for any such table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from . import tables


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _there(spark: SparkSession, path: str) -> bool:
    files, where = _store(spark, path)
    return files.exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _store(spark, path)
    files.delete(where, True)


class BucketStore:
    """Rows of ``schema`` in ``buckets`` hash buckets by ``key``. Rows without a key are not stored."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "case_id", buckets: int = 64):
        self.spark, self.key, self.buckets, self.schema = spark, key, buckets, schema
        self.data, self.redo = f"{folder}/rows", f"{folder}/redo"

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        self._finish()
        whole = f"{self.schema}, bucket int"
        return self.spark.read.schema(whole).parquet(self.data) if _there(self.spark, self.data) else self.spark.createDataFrame([], whole)

    def rows(self, **equals) -> DataFrame:
        """Rows whose columns equal the given values (null: is null). One of a given key is looked for in its bucket alone; other conditions reach the scan."""
        found = self._all().filter(F.col(self.key).isNotNull())
        if self.key in equals:
            found = found.filter(F.col("bucket") == self.bucket_number(equals[self.key]))
        return tables.stored(found.drop("bucket"), **equals)

    def bucket_number(self, key) -> int:
        return self.spark.range(1).select(self.bucket_of(F.lit(key))).first()[0]

    def upsert(self, new: DataFrame, latch: tuple[str, ...] = (), newest: str | None = None) -> None:
        """See ``tables.upsert``. Only the buckets of the new keys are read and rewritten."""
        given = tables.checkpointed(new.filter(F.col(self.key).isNotNull()))
        self._change(given.select(self.key), lambda old: tables.upsert(old, given.select(*old.columns), self.key, latch, newest))

    def replace_children(self, new: DataFrame, parents: DataFrame | None = None) -> None:
        """All rows of the parents (by default those that ``new`` has rows of) come from ``new``; a parent of no new row has none left."""
        given = tables.checkpointed(new.filter(F.col(self.key).isNotNull()))
        named = tables.checkpointed((given if parents is None else parents).select(self.key).distinct())
        self._change(named, lambda old: old.join(named, self.key, "left_anti").select(*old.columns).unionByName(given.join(named, self.key, "left_semi").select(*old.columns)))

    def put_scored(self, scored: DataFrame, columns: tuple[str, ...] = tables.SCORED) -> None:
        """See ``tables.put_scored``: cases that are not stored stay so."""
        given = tables.checkpointed(scored)
        self._change(given.select(self.key), lambda old: tables.put_scored(old, given, columns))

    def update_where(self, condition: Column, **values: Column) -> None:
        """A guarded update: the buckets without a row that meets the condition are left alone."""
        self._change(self.rows().filter(condition).select(self.key), lambda old: tables.update_where(old, condition, **values))

    def erase(self, keys: DataFrame) -> None:
        """Rows of the keys go."""
        gone = tables.checkpointed(keys.select(self.key).distinct())
        self._change(gone, lambda old: old.join(gone, self.key, "left_anti").select(*old.columns))

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        # As many numbers as there are buckets, at most.
        touched = sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.key)).alias("b")).distinct().collect())
        if not touched:
            return
        old = self._all().filter(F.col("bucket").isin(touched) & F.col(self.key).isNotNull()).drop("bucket")
        after = change(old).withColumn("bucket", self.bucket_of(F.col(self.key)))
        # An overwrite touches the partitions it writes rows to: each bucket has one row without a key, so that one that lost all its rows is rewritten too.
        marks = self.spark.range(1).select(F.explode(F.array(*map(F.lit, touched))).alias("bucket"))
        after.unionByName(marks, allowMissingColumns=True).repartition(len(touched), "bucket").write.mode("overwrite").parquet(self.redo)
        self._finish()

    def _finish(self) -> None:
        """Play a whole copy that is left; one that was not written to its end is none."""
        if not _there(self.spark, self.redo):
            return
        if _there(self.spark, f"{self.redo}/_SUCCESS"):
            copy = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.redo)
            copy.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.data)
        _remove(self.spark, self.redo)


class AppendLog:
    """A log that is only added to: each batch once, with numbers (``seq``) that go on without gaps, in the order of ``order`` within a batch.

    A batch's rows are ``rows/batch=N``; what makes them part of the log is their entry in ``ledger`` (batch, first, n). A run that is lost before the entry leaves rows that
    nobody reads and that the next run of the batch writes over; a batch that has its entry is not taken again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, order: tuple[str, ...] = ("at",)):
        self.spark, self.schema, self.order = spark, schema, order
        self.data, self.entries = f"{folder}/rows", f"{folder}/ledger"

    def ledger(self) -> DataFrame:
        schema = "batch long, first long, n long"
        return self.spark.read.schema(schema).parquet(f"{self.entries}/*") if _there(self.spark, self.entries) else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Whether the batch was new."""
        known = self.ledger().agg(F.max(F.col("first") + F.col("n")).alias("next"), F.count_if(F.col("batch") == batch).alias("had")).first()
        if known["had"]:
            return False
        first, names = known["next"] or 0, [c for c in rows.columns if c != "seq"]
        # Rows that agree in the order are told apart by all their columns, so that a second run numbers them alike.
        total = [F.col(c) for c in (*self.order, *[c for c in names if c not in self.order])]
        path = f"{self.data}/batch={batch}"
        numbered(rows.select(*names), total, "seq", first).write.mode("overwrite").parquet(path)
        n = self.spark.read.parquet(path).count()
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(first).cast("long").alias("first"), F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.entries}/{batch}")
        return True

    def rows(self) -> DataFrame:
        """The log, without what has no entry."""
        if not _there(self.spark, self.data):
            return self.spark.createDataFrame([], f"{self.schema}, seq long")
        whole = self.spark.read.schema(f"{self.schema}, seq long, batch long").parquet(self.data)
        return whole.join(F.broadcast(self.ledger().select("batch")), "batch", "left_semi").drop("batch")

    def newest(self, key: str, most: int = 100) -> DataFrame:
        """The newest entries of each key, by order and number, with their place."""
        last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in (*self.order, "seq")])
        return self.rows().withColumn("place", F.row_number().over(last)).filter(F.col("place") <= most)
