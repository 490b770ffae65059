"""Reading and writing: declared schemas, failing on malformed lines, deterministic order, and writes that keep their rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
CONVERSATION = f"id string, tier string, handle string, scenario string, notes string, expected_gate array<string>, expected_floor string, days_ago double, turns array<{TURN}>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Without one only a local session may go on, in its warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@dataclass(frozen=True)
class Source:
    """A registered corpus: where it is, which column is text, and how a row gets its label (null: dropped)."""

    key: str
    path: str
    text: str
    label: Callable[[], Column]


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """(text, harm, source) of the rows that map to a label."""
    rows = spark.read.parquet(source.path).select(F.col(source.text).alias("text"), source.label().alias("harm"))
    return rows.filter("harm is not null").withColumn("source", F.lit(source.key))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines by a declared schema; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(CONVERSATION).option("mode", "FAILFAST").json(path)


def read_probabilities(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """(case_id, turn, probs) from one JSON document; the label order must be ours."""
    whole = spark.read.option("multiLine", True).schema("label_order array<string>, probs map<string,array<array<double>>>").json(path)
    checked = whole.select(F.when(F.col("label_order") == F.array(*map(F.lit, labels)), F.col("probs")).otherwise(F.raise_error(F.lit("label order differs"))).alias("probs"))
    return checked.select(F.explode("probs").alias("case_id", "rows")).select("case_id", F.posexplode("rows").alias("turn", "probs"))


def stale_probabilities(probabilities: DataFrame, turns: DataFrame) -> DataFrame:
    """Cases whose number of rows differs from their number of turns."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    return count(probabilities, "n_probs").join(count(turns, "n_turns"), "case_id", "full_outer").filter("not (n_probs <=> n_turns)")


def read_logits(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(row_id, y_true, logits) from Parquet; a row whose logits are not ``width`` finite numbers, or whose label is none of them, fails the read."""
    rows = spark.read.schema("row_id long, y_true long, logits array<double>").parquet(path)
    fine = (F.size("logits") == width) & F.forall("logits", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("y_true").between(0, width - 1)
    return rows.withColumn("logits", F.when(fine, F.col("logits")).otherwise(F.raise_error(F.concat(F.lit("bad logits of row "), F.col("row_id").cast("string")))))


def stored(rows: DataFrame, order: tuple[Column, ...] = (), limit: int | None = None, **equals) -> DataFrame:
    """A store's read: rows whose columns equal the given values (null: is null), in order, the first ``limit`` of them."""
    for name, value in equals.items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    rows = rows.orderBy(*order) if order else rows
    return rows.limit(limit) if limit is not None else rows


def append(rows: DataFrame, folder: str) -> None:
    """Audit rows are only ever added."""
    rows.write.mode("append").parquet(folder)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    each = spark.read.option("multiLine", True).schema("conversations array<struct<caseId:string,people:array<string>,places:array<string>,platforms:array<string>>>").json(path)
    return each.select(F.explode("conversations").alias("c")).select(F.col("c.caseId").alias("case_id"), "c.people", "c.places", "c.platforms")


def student_turns(conversations: DataFrame, role: str = "user") -> DataFrame:
    """(case_id, turn, text): only the student's turns, numbered from 0 among themselves."""
    from pyspark.sql import Window

    own = conversations.filter(F.col("role") == role)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return own.select(F.concat(F.lit("case-"), F.col("conv_id").cast("string")).alias("case_id"), place.cast("long").alias("turn"), "text", "conv_id")


def valid_requests(requests: DataFrame, most: int = 40, chars: int = 1000) -> DataFrame:
    """Requests (id, messages) of 1 to ``most`` messages that end with the student; texts are cut to ``chars``."""
    ok = F.size("messages").between(1, most) & (F.element_at("messages", -1)["role"] == "student")
    return requests.filter(ok).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.substring(m["text"], 1, chars).alias("text"))))


def write_splits(rows: DataFrame, folder: str) -> None:
    """Parquet by split, in one pass."""
    rows.write.mode("overwrite").partitionBy("split").parquet(folder)


def write_sorted_json(rows: DataFrame, folder: str, *order: str) -> None:
    """JSON in a total order; for fixtures and reports, which are small by nature."""
    rows.orderBy(*order).write.mode("overwrite").json(folder)


def upsert(old: DataFrame, new: DataFrame, key: str, latch: tuple[str, ...] = (), newest: str | None = None) -> DataFrame:
    """New rows replace old ones of their key, unless ``newest`` says that the old one is newer; a latched flag that was ever true stays true."""
    names = [c for c in old.columns if c != key]
    o, n = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in names], F.lit(True).alias("_had")), new.select(key, *[F.col(c).alias(f"_n_{c}") for c in names], F.lit(True).alias("_has"))
    takes = F.col("_has") if newest is None else F.col("_has") & (F.col("_had").isNull() | F.coalesce(F.col(f"_n_{newest}") >= F.col(f"_o_{newest}"), F.col(f"_o_{newest}").isNull()))
    pick = lambda c: (F.coalesce(F.col(f"_o_{c}"), F.lit(False)) | F.coalesce(F.col(f"_n_{c}"), F.lit(False)) if c in latch else F.when(takes, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))).alias(c)
    return o.join(n, key, "full_outer").select(key, *map(pick, names))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a rewritten parent come from ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


#: Columns of a stored card that a scored one replaces; all else of the stored case, its identity above all, stays.
SCORED = ("tier", "confidence", "escalation", "queue_rank", "model_tier")


def put_scored(old: DataFrame, scored: DataFrame, columns: tuple[str, ...] = SCORED) -> DataFrame:
    """Stored cases (case_id, awaiting, ...) with the card columns of ``scored`` where there are any; these no longer await a score."""
    new = scored.select("case_id", *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_scored"))
    both = old.join(new, "case_id", "left")
    kept = [F.when(F.col("_scored"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.when(F.col("_scored"), F.lit(False)).otherwise(F.col(c)).alias(c) if c == "awaiting" else F.col(c) for c in old.columns]
    return both.select(*kept)


def update_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Point update: columns of the rows that meet the condition."""
    return rows.withColumns({name: F.when(condition, value).otherwise(F.col(name)) for name, value in values.items()})
