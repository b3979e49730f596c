"""Flat token-id files with 64-bit document offsets.

A shard is one flat file of little-endian unsigned integers (16 or 32 bits, by the vocabulary)
that holds the ids of a range of documents in ascending doc_id order, each document closed by
the end id, beside a file of 64-bit offsets, one for each document's start within the shard.
Shards are numbered in id order, so a shard's base is the prefix sum of the sizes before it.
Both files are plain arrays that ``numpy.memmap`` opens as they are.

The files go through Spark's text writer, so they can lie in any file system Spark knows: a row
is a document's ids, and the row separator is the end id itself in binary.  Offsets are written
the same way, with the highest byte of a 64-bit number, which is always zero, as separator.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlog.llm.common import id_bounds, saved, small_pieces, trimmed, work_folder
from playlog.llm.wordbpe import codec, tokenizer_path

END_ID = 2
SHARD_BYTES = 16 << 20
#: Files are read in blocks of so many bytes.
BLOCK_BYTES = 1 << 20
#: Bytes of text for a byte of ids, about; it sets the number of shards only.
TEXT_PER_ID_BYTE = 2.5


def tokenize(docs: DataFrame, width: int, path: str, bounds: list[int]) -> DataFrame:
    """doc_id, shard, n and the n ids of each document without the end id, as little-endian unsigned integers of width bytes under zstd.

    The shard is the number of the split points (ascending doc_ids) up to the doc_id; a null doc_id is in the first.
    """
    cuts = np.array(bounds, dtype=np.int64)

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, packer = codec(path), zstandard.ZstdCompressor(level=3)
        for whole in stream:
            for batch in small_pieces(whole, "text"):
                ids = [np.frombuffer(c.encode(t.as_py() or ""), dtype="<u4").astype(f"<u{width}").tobytes() for t in batch.column("text")]
                n = pa.array([len(x) // width for x in ids], pa.int64())
                doc = batch.column("doc_id")
                shard = np.where(np.asarray(doc.is_null()), 0, np.searchsorted(cuts, doc.fill_null(0).to_numpy(), "right"))
                yield pa.RecordBatch.from_arrays([doc, pa.array(shard.astype(np.int32)), n, pa.array(map(packer.compress, ids), pa.binary())], names=["doc_id", "shard", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, shard int, n long, ids binary")


def _unpacked(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdDecompressor()
    for whole in stream:
        for batch in small_pieces(whole, "ids"):
            ids = pa.array([packer.decompress(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("tie"), ids], names=["doc_id", "shard", "tie", "ids"])


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> dict:
    """Write docs(doc_id, text) and return the description that read() takes.

    A null or empty text is a document of the end id alone.  Null doc_ids come first, rows with
    equal doc_ids stay side by side, ordered by a hash of their ids.
    """
    path = path or tokenizer_path()
    width = 2 if len(codec(path).pieces) <= 1 << 16 else 4
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if not rows:  # no documents, no files
        return {"folder": folder, "width": width, "shards": 0}
    bounds = id_bounds(docs, int((size or 0) * width / 2 / TEXT_PER_ID_BYTE / shard_bytes) + 1)
    parts = len(bounds) + 1
    tokens = saved(tokenize(docs, width, path, bounds), folder, "tokens")
    placed = tokens.withColumns({"tie": F.xxhash64("ids"), "n": F.col("n") + 1})
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    (placed.repartition(parts, "shard").mapInArrow(trimmed(_unpacked), "doc_id long, shard int, tie long, ids binary").sortWithinPartitions("shard", *order)
        .select("shard", F.col("ids").cast("string").alias("value"))
        .write.partitionBy("shard").option("maxRecordsPerFile", 0).option("lineSep", end_id.to_bytes(width, "little").decode()).text(f"{folder}/ids"))
    at = Window.partitionBy("shard").orderBy(*order)
    narrow = placed.select("shard", "doc_id", "tie", "n")  # the ids themselves are shuffled once, for their file
    index = narrow.select("shard", "doc_id", F.row_number().over(at).cast("long").alias("at"), F.sum("n").over(at.rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    index = saved(index.select("shard", "doc_id", F.col("at") - 1, F.coalesce("start", F.lit(0)).cast("long").alias("start")).toDF("shard", "doc_id", "at", "start"), folder, "index")
    low = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright("start", 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0")) for k in range(7)])
    (index.repartition(parts, "shard").sortWithinPartitions("shard", "at")
        .select("shard", low.cast("string").alias("value"))
        .write.partitionBy("shard").option("maxRecordsPerFile", 0).option("lineSep", "\0").text(f"{folder}/offsets"))
    return {"folder": folder, "width": width, "shards": parts}


def bases(spark: SparkSession, files: dict) -> DataFrame:
    """(shard, base): ids in the shards before, by a prefix sum over one row a shard. A shard is one file; a query over one of several fails."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{files['folder']}/ids").groupBy("shard").agg(F.sum("length").alias("length"), F.count("*").alias("files"))
    split = F.raise_error(F.concat(F.lit("shard "), F.col("shard").cast("string"), F.lit(" has several files")))
    sizes = found.select("shard", F.when(F.col("files") == 1, F.col("length")).otherwise(split.cast("long")).alias("length"))
    before = F.sum("length").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("shard", (F.coalesce(before, F.lit(0)) / files["width"]).cast("long").alias("base"))


def read(spark: SparkSession, files: dict) -> DataFrame:
    """doc_id, start (ids before it in all documents), n_tokens and ids_crc32, from the files alone.

    A task gets a shard's offsets and then its ids in blocks in their order, so it holds one block and the offsets;
    documents that lie in several blocks carry their checksum over.
    """
    width, folder = files["width"], files["folder"]
    if not files["shards"]:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def pack(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in stream:
            data = pa.array([packer.compress(x.as_buffer()) for x in batch.column("data")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], data], names=["shard", "kind", "block", "data"])

    def blocks(kind: str, number: int) -> DataFrame:
        """(shard, kind, block, data) of every file, cut where it is read."""
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{kind}")
        cut = rows.select("shard", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(BLOCK_BYTES).cast("long"))).alias("block"))
        data = F.expr(f"substring(content, cast(block + 1 as int), {BLOCK_BYTES})")
        return cut.select("shard", F.lit(number).alias("kind"), "block", data.alias("data")).mapInArrow(trimmed(pack), "shard int, kind int, block long, data binary")

    def out(shard: int, starts: np.ndarray, total: int, crc: list[int]) -> pa.RecordBatch:
        n = np.diff(np.append(starts, total))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), shard, np.int32)), *(pa.array(np.asarray(x), pa.int64()) for x in (np.arange(len(starts)), starts, n, crc))], names=["shard", "at", "start", "n_tokens", "ids_crc32"])

    def cut(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, offsets, starts, seen, doc, crc, packer = None, [], None, 0, 0, [], zstandard.ZstdDecompressor()
        for batch in stream:
            for number, kind, data in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                if number != shard:
                    if shard is not None:
                        yield out(shard, starts, seen, crc)
                    shard, offsets, starts, seen = number, [], None, 0
                data = packer.decompress(data.as_buffer())
                if kind == 0:
                    offsets.append(data)
                    continue
                if starts is None:
                    starts, doc = np.frombuffer(b"".join(offsets), dtype="<i8"), 0
                    ends, crc = np.append(starts[1:], np.iinfo(np.int64).max).tolist(), [0] * len(starts)
                ids = memoryview(np.frombuffer(data, dtype=f"<u{width}").astype("<u4")).cast("B")
                here, size = 0, len(ids) // 4
                while here < size:
                    upto = min(size, ends[doc] - seen)
                    crc[doc] = zlib.crc32(ids[4 * here : 4 * upto], crc[doc])
                    here = upto
                    doc += upto + seen == ends[doc]
                seen += size
        if shard is not None:
            yield out(shard, starts, seen, crc)

    rows = blocks("offsets", 0).unionByName(blocks("ids", 1))
    dealt = rows.repartition(files["shards"], "shard").sortWithinPartitions("shard", "kind", "block")
    found = dealt.mapInArrow(trimmed(cut), "shard int, at long, start long, n_tokens long, ids_crc32 long").join(bases(spark, files), "shard")
    index = spark.read.parquet(f"{folder}/index").select("shard", "at", "doc_id")
    return found.join(index, ["shard", "at"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def open_shard(folder: str | Path, shard: int, width: int) -> tuple[np.memmap, np.memmap]:
    """The memory-mapped ids and offsets of a shard in a local folder."""
    found = [next(Path(folder, kind, f"shard={shard}").glob("part-*")) for kind in ("ids", "offsets")]
    return np.memmap(found[0], dtype=f"<u{width}", mode="r"), np.memmap(found[1], dtype="<i8", mode="r")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents to the shared folder and read them back."""
    return read(docs.sparkSession, write(docs, work_folder(docs.sparkSession), path))
