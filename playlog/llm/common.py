"""What the operators of this subpackage share: the shared work folder, id ranges and size-checked joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times this many bytes stay under BROADCAST_BYTES.
BROADCAST_BYTES = 24 << 20


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing and the master is local (tests on one machine) is a local folder chosen and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def free_name(columns: list[str], base: str) -> str:
    """base, or that with as many underscores behind it as no column's name has."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def id_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ascending split points that deal the doc_ids into about ``parts`` ranges of like size (at most parts - 1 values)."""
    if parts <= 1:
        return []
    shares = ", ".join(str(i / parts) for i in range(1, parts))
    row = docs.agg(F.expr(f"approx_percentile(doc_id, array({shares}), 10000)").alias("b")).first()
    return sorted(set(row["b"] or []))


def id_range(column, bounds: list[int]):
    """Number of the range a doc_id falls in; nulls come before every id."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    return F.coalesce(F.size(F.filter(steps, lambda b: b <= column)), F.lit(0))


def parts_for(spark: SparkSession, size: float, per_part: float, least: int | None = None) -> int:
    """Partitions so that each holds about per_part of size, and no fewer than the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    return max(1, least, int(size / per_part) + 1)


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives freed memory back when its task ends: Python workers outlive their tasks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(stream)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that maps a batch."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run


def small_pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about limit bytes of the column, or one row."""
    lengths = batch.column(column).cast(pa.large_binary()).buffers()
    import numpy as np

    base = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(lengths[1], dtype=np.int64)[base.offset : base.offset + batch.num_rows + 1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
