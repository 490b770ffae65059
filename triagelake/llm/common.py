"""What the training-data operators share: checkpoints, bounded text slices and word arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step holds at once (a longer text is a step of its own).
SLICE_BYTES = 4 << 20
#: The same for the pipeline's stages, of which one executor runs all: its workers stay from stage to stage.
STAGE_BYTES = 1 << 20
#: Narrow rows that one file of a checkpoint holds, where it is known how many there are.
FILE_ROWS = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is set only a local session may go on, in a folder of its warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder. Of about ``rows`` rows, where that is known, few go to few files: each partition is a
    file, even an empty one, for which a local file system starts a process that sets its mode."""
    shared_folder(df.sparkSession)
    return (df if rows is None else df.repartition(1 + rows // FILE_ROWS)).checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder: for rows with whole texts, which it compresses. It goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_slot(column, modulus: int):
    """The contracts' crc32 of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")) % modulus


def filled(texts: pa.Array) -> pa.Array:
    """A plain string array in which null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    return pc.fill_null(texts, "")


@lru_cache(1)
def _trim():
    """The C library's call that gives free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def released() -> None:
    """Give memory that is free back to the system. A worker serves task after task, and what it once took would stay with it beside the JVM's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of which the texts have about ``limit`` bytes at most, so that memory does not follow Arrow's row count. After the last the
    memory that they took is released."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    released()


class WordArrays:
    """Words between ASCII white space of many texts: the code of each word, the texts' bounds in them and the distinct words."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten()
        offsets = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
        keep = np.asarray(pc.binary_length(words), dtype=np.int64) > 0
        kept = np.concatenate(([0], np.cumsum(keep)))
        self.offsets = kept[offsets]
        coded = words.filter(pa.array(keep)).dictionary_encode()
        self.codes = np.asarray(coded.indices)
        self.distinct = coded.dictionary
        self.counts = np.diff(self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows) between neighbouring offsets; 0 for an empty segment."""
    shape = (len(offsets) - 1, *values.shape[1:])
    out = np.zeros(shape, dtype=np.float64)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets in them, without a copy."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
