"""Helpers that the training-data operators share."""
from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy kernel call works on; a longer single text is one call of its own.
KERNEL_BYTES = 1 << 20


#: Bytes of a batch that goes to Python at most; Spark's own default is sixteen times that.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Has the session cut batches for Python at BATCH_BYTES, unless it cuts them smaller already.

    Texts differ in length by thousands, so a batch of so many rows may be any size.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader, with only the named columns."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a folder of its own under /tmp.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = chosen.get() if chosen.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "/tmp/clinograph-shared"
    return path.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, deleted when the driver ends at the latest."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def durable(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table under the shared folder and reads it back.

    The lineage ends there, and the loss of an executor after the write costs nothing.  The table goes
    with forget(), at the latest when the driver ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = work_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of durable() that no later step reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of steps whose results are written."""
    gc.collect()
    spark._jvm.System.gc()


def utf8(text: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text column; none for null."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def slices(batch: pa.RecordBatch, column: str | int, most: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose strings in `column` hold about `most` bytes together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the row offsets in it; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = pc.fill_null(column.cast(kind), b"")
    width = np.int64 if kind == pa.large_binary() else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def to_arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the schema from arrays or lists by name."""
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
