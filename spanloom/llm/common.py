"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that parts words in every operator that counts or joins words.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step works on; bounds the Python workers' memory.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or where none is named a
    folder of the warehouse, which they share as well. A machine's own temporary folder is never taken."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps").rstrip("/")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or one like it that is no column of the frames: steps add columns without touching any."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def durable(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: lineage ends
    there, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*written: DataFrame) -> None:
    """Deletes tables that ``durable`` wrote, once nothing that isn't written yet depends on them."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts an object of this package, code included. Callers have checked its size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shipped: Broadcast) -> object:
    return pickle.loads(shipped.value)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the binary or string ``column`` holds about ``most`` bytes each time.
    One longer value makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and their bounds (one more than the values);
    null counts as empty."""
    if values.null_count:
        values = pa.compute.fill_null(values, b"")
    if pa.types.is_large_binary(values.type):
        values = values.cast(pa.binary())
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]
