"""SpotSigs document fingerprints.

A spot is a common word (the anchor) with the chain of the next CHAIN content words behind it, anchors
left out.  A document's signature is the set of its spots; likeness is the Jaccard coefficient of two
signatures.  Near pairs are sought with the signatures partitioned by their size: sizes that
differ by more than the threshold allows never meet, and within a partition only the rarest part of a
signature is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.common import id_bounds, id_range, parts_for
from playlog.llm.wordhash import Words, mix, slices

CHAIN = 2
THRESHOLD = 0.75
# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au de des du elle en est et il la le les pour que qui un une "
    "auf das den der die ein eine ist mit nicht und von zu "
    "el los las por se su y"
).split()


def _anchor_hashes() -> np.ndarray:
    return np.unique(np.concatenate([w.hashes for _, w in slices(pa.array(ANCHORS), normal=True)]))


def signature(words: Words, i: int, is_anchor: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit spots of text i; a text with words and without a spot has its word sequence as the one spot."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    if a == b:
        return np.zeros(0, dtype=np.uint32)
    h, anchor = words.hashes[a:b], is_anchor[a:b]
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    after = np.searchsorted(content, spots)
    ok = after + CHAIN <= len(content)
    spots, after = spots[ok], after[ok]
    if not len(spots):
        return (np.array([words.text_hash(i)]) >> np.uint64(32)).astype(np.uint32)
    value = h[spots]
    for k in range(CHAIN):
        value = mix(value * np.uint64(3) + h[content[after + k]])
    return np.unique((value >> np.uint64(32)).astype(np.uint32))


def signatures(texts: pa.Array) -> list[np.ndarray]:
    anchors, out = _anchor_hashes(), []
    for _, words in slices(texts, normal=True):
        at = np.minimum(np.searchsorted(anchors, words.hashes), len(anchors) - 1)
        is_anchor = anchors[at] == words.hashes
        out += [signature(words, i, is_anchor) for i in range(len(words))]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two signatures; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex of the sorted spots) of each row; a null text is an empty one."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_of(s) for s in signatures(batch.column("text"))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The next document is that with the next smaller doc_id (after the last, the first); null ids come
    last, equal ids are ordered by text.  The edited text has the last floor(n_chars / 2)
    code points replaced by as many from the start of the next document.  Columns: doc_id, n_chars,
    edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, into ranges of doc_id; the first document of the range below is also sent to the
    range above it, so that every document meets its next one inside its range.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    bounds = id_bounds(source, parts_for(spark, size, 16e6))
    placed = source.withColumn("part", id_range(F.col("doc_id"), bounds))
    # the first row of each range, in descending order: one id a range reaches the driver
    heads = {r["part"]: r["top"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(heads, reverse=True)
    pairs = [(below, heads[below], part) for part, below in zip(order, [*order[1:], *order[:1]], strict=True)]
    sent = spark.createDataFrame(pairs or [(0, 0, 0)], "part int, top long, target int")
    helper = placed.join(F.broadcast(sent), "part").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("target").agg(F.min(F.struct("doc_id", "text")).alias("h"))
    rows = placed.withColumn("helper", F.lit(0)).unionByName(helper.select(F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"), F.col("target").alias("part"), F.lit(1).alias("helper")))
    dealt = rows.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "helper", F.col("doc_id").desc_nulls_last(), "text")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row seen, which waits for its next
        for batch in stream:
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "helper")), strict=True))
            held = []
            done, edited = [], []
            for k, (doc_id, text, part, helper) in enumerate(rows):
                if helper:
                    continue
                if k + 1 == len(rows):
                    held = [rows[k]]
                    break
                after = rows[k + 1][1]
                half = len(text) // 2
                done.append(k)
                edited.append(text[: len(text) - half] + after[:half])
            if not done:
                continue
            own = signatures(pa.array([r[1] for r in rows], pa.string()))
            other = signatures(pa.array(edited, pa.string()))
            values = [
                pa.array([rows[k][0] for k in done], pa.int64()),
                pa.array([len(rows[k][1]) for k in done], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array([text_of(own[k]) for k in done], pa.string()),
                pa.array([text_of(s) for s in other], pa.string()),
                pa.array([likeness(own[k], s) for k, s in zip(done, other, strict=True)], pa.float64()),
                pa.array([likeness(own[k], own[k + 1]) for k in done], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) of representatives of different fingerprints, a < b, with likeness >= threshold.

    Documents of equal fingerprints are one class, represented by the smallest doc_id; empty ones and null
    ids take no part.  Sizes fall into partitions whose bounds grow by 1 / threshold, so a signature meets
    only its own partition and the next one; each indexes its rarest spots only, and a pair is counted in
    full from the two signatures.
    """
    classes = fingerprints(docs).where("fingerprint <> '' and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    sets = classes.select("doc_id", F.transform(F.sequence(F.lit(0), (F.length("fingerprint") / 8 - 1).cast("int")), lambda i: F.substring("fingerprint", i * 8 + 1, F.lit(8))).alias("spots"))
    sized = sets.withColumns({"n": F.size("spots"), "bin": F.floor(F.log(F.size("spots")) / math.log(1 / threshold) + 1e-9)})
    # rare spots first: the order is the corpus frequency, then the spot
    count = sized.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("df"))
    ranked = sized.select("doc_id", "n", "bin", F.explode("spots").alias("spot")).join(count, "spot")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "spot"))
    prefix = ranked.where("df > 1 or n = 1").withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = prefix.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), "spot", F.col("bin").alias("meets"))
    right = prefix.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), "spot", F.explode(F.array("bin", F.col("bin") - 1)).alias("meets"))
    pairs = left.join(right, ["spot", "meets"]).where("nx <= ny and (nx < ny or x < y)").where(F.col("nx") >= F.col("ny") * threshold - 1e-9).select("x", "y").distinct()
    full = pairs.join(sets.withColumnsRenamed({"doc_id": "x", "spots": "sx"}), "x").join(sets.withColumnsRenamed({"doc_id": "y", "spots": "sy"}), "y")
    both = F.size(F.array_intersect("sx", "sy"))
    scored = full.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (both / (F.size("sx") + F.size("sy") - both)).alias("likeness"))
    return scored.where(F.col("likeness") >= threshold - 1e-12)
