"""Near-duplicate groups by one-permutation hashing.

A document is its set of distinct 5-word shingles.  One hash of every shingle names a bin and a value in it; a bin keeps its
least value, and an empty bin takes the value of another bin that a fixed random walk of its own finds (optimal densification), so that
two sets agree in a bin as often as they overlap.  Bins go in bands; sets that agree in a band share a bucket.

In a bucket a star is drawn, not all pairs: its centre is the set that shares most buckets with others, which in a group of
copies is the likeliest original.  A star edge is a link if the whole sets say so.  Links make components.  Buckets that still hold several
components are not done: sets outside a bucket's largest component are compared with those of other components, in blocks of a fixed size dealt
over tasks, by parity maps, which bound an overlap from above; pairs that the bound leaves open are compared in full.  So no link of two sets that
share a bucket is lost to the star.  Two sets at the threshold share none with a probability of about (1 - 0.85 ** ROWS) ** BANDS, 6e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.llm.common import saved, trimmed, work_folder
from playlog.llm.ngramjoin import N, _key, _parity, bounded, components, verified
from playlog.llm.wordhash import mix, shingles, slices

SHARE, BANDS, ROWS = 85, 32, 4
BINS = BANDS * ROWS
#: Sets outside the largest component of a bucket are compared in blocks of about so many.
OUTSIDE = 1000
_STEPS = 64


def _walk(t: int) -> np.ndarray:
    """The bins that each bin tries at its steps t .. t + _STEPS."""
    step = np.arange(t, t + _STEPS, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    return (mix(step * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


_FIRST = _walk(0)


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each bin of a non-empty ascending array of hashes, empty bins filled."""
    bins, first = np.unique((s >> np.uint64(32)) % np.uint64(BINS), return_index=True)
    full = np.zeros(BINS, dtype=bool)
    full[bins] = True
    value = np.zeros(BINS, dtype=np.uint64)
    value[bins] = s[first]
    empty, t, walk = np.flatnonzero(~full), 0, _FIRST
    while len(empty):
        tried = walk[:, empty]
        hit = full[tried]
        found = hit.any(axis=0)
        value[empty[found]] = value[tried[hit.argmax(axis=0)[found], np.flatnonzero(found)]]
        empty, t = empty[~found], t + _STEPS
        if len(empty):
            walk = _walk(t)
    return value


def band_keys(value: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of a signature."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in value.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, n, k1, k2, bits, bands): set size, a 128-bit key and the parity map of the set, the keys of its bands."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for base, words in slices(batch.column("text"), lower=True):
                sets = shingles(words, N)
                keys = [_key(s) if len(s) else (0, 0) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(base, len(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([_parity(s) if len(s) else None for s in sets], pa.binary()), pa.array([band_keys(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=["doc_id", "n", "k1", "k2", "bits", "bands"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(trimmed(run), "doc_id long, n int, k1 long, k2 long, bits binary, bands array<long>")


def stars(members: DataFrame) -> DataFrame:
    """(a, b): star edges of the buckets of members(bucket, rep), each pair once; a is a centre."""
    size = members.groupBy("bucket").agg(F.count("*").alias("size"))
    shared = members.join(size, "bucket").groupBy("rep").agg(F.sum("size").alias("shared"))
    centre = members.join(shared, "rep").groupBy("bucket").agg(F.max(F.struct("shared", (-F.col("rep")).alias("first"))).alias("c"))
    edges = members.join(centre.select("bucket", (-F.col("c.first")).alias("a")), "bucket").where("a <> rep").select("a", F.col("rep").alias("b"))
    return edges.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def _linked(both: str = "both") -> str:
    return f"100 * {both} >= {SHARE} * (na + nb - {both})"


def _open(n: int, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements that differ in apart elements at least can link."""
    most = (n + m - apart) // 2
    return (100 * most >= SHARE * (n + m - most)) & (100 * np.minimum(n, m) >= SHARE * np.maximum(n, m))


def _maps(bits: list[bytes]) -> dict[int, np.ndarray]:
    """Parity maps as rows of 64-bit words, per number of words that all can be folded to; a shorter map has no row in it (zeros)."""
    sizes = np.array([len(b) // 8 for b in bits])
    out = {}
    for w in np.unique(sizes).tolist():
        rows = np.zeros((len(bits), w), dtype="<u8")
        for i in np.flatnonzero((sizes == w) | (sizes == 2 * w)).tolist():
            row = np.frombuffer(bits[i], dtype="<u8")
            rows[i] = row if len(row) == w else row[:w] ^ row[w:]
        out[w] = rows
    return out


def open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of sets of different labels that share a bucket and that sizes and parity maps let link, each pair once."""
    rows = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
    count = rows.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    mixed = count.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("size")).where("main.c < size")
    blocks = mixed.select("bucket", F.col("main.label").alias("main"), F.ceil((F.col("size") - F.col("main.c")) / OUTSIDE).cast("int").alias("blocks"))
    rows = rows.join(blocks, "bucket").withColumn("outside", F.col("label") != F.col("main"))
    some = rows.where("outside").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = some.withColumn("asks", F.lit(1)).unionByName(every.withColumn("asks", F.lit(0)))
    both = both.join(sets.select("rep", "n", "bits"), "rep").select("bucket", "block", "asks", "rep", "label", "outside", "n", "bits")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, []

        def answers(theirs: list[tuple]) -> pa.RecordBatch | None:
            rep, label, outside, n = (np.array([r[i] for r in theirs]) for i in range(4))
            maps, a, b = _maps([r[4] for r in theirs] + [r[4] for r in asked]), [], []
            sizes = np.array([len(r[4]) // 8 for r in theirs])
            for j, (o, lab, _, m, bits) in enumerate(asked, len(theirs)):
                w = len(bits) // 8
                ok = (label != lab) & (~outside | (rep > o)) & (100 * np.minimum(n, m) >= SHARE * np.maximum(n, m))
                for size in (w, 2 * w, w // 2):  # the shorter map of the two
                    at = np.flatnonzero(ok & (sizes == size)) if size else np.zeros(0, np.int64)
                    if len(at):
                        x = maps[min(w, size)]
                        apart = np.bitwise_count(x[at] ^ x[j]).sum(axis=1).astype(np.int64)
                        at = at[_open(m, n[at], apart)]
                        a += [o] * len(at)
                        b += rep[at].tolist()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        for batch in stream:
            theirs = []
            for bucket, block, asks, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, block) != key:
                    if theirs and (found := answers(theirs)):
                        yield found
                    key, asked, theirs = (bucket, block), [], []
                (asked if asks else theirs).append(row)
            if theirs and (found := answers(theirs)):
                yield found

    dealt = both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("asks"))
    return dealt.mapInArrow(trimmed(run), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known of docs: its rows (described), its classes of equal sets (k1, k2, n, rep, bits) and the links (a, b, both, na, nb) found between their rep's.

    Every two classes that share a bucket and link are in one component of the links; links within a component are not all among them.
    """
    folder = work_folder(docs.sparkSession)
    own = saved(described(docs), folder, "sets")
    some = own.where("n > 0 and doc_id is not null")
    classes = some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    sets = saved(classes, folder, "classes")
    members = sets.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = saved(members.join(shared, "bucket"), folder, "members")

    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"))
    fits = f"100 * least(na, nb) >= {SHARE} * greatest(na, nb)"
    pairs = saved(stars(members), folder, "stars")
    first = saved(bounded(pairs.join(side("a"), "a").join(side("b"), "b").where(fits)).where(_linked("most")).select("a", "b"), folder, "pairs_one")
    links = verified(docs, first, sets, folder, "one").where(_linked()).select("a", "b", "both", "na", "nb")
    labels = saved(components(links, folder, "labels_one"), folder, "labels_one")
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = saved(open_pairs(members, labels, sets).join(done, ["a", "b"], "left_anti"), folder, "pairs_two")
    if not left.isEmpty():
        links = links.unionByName(verified(docs, left, sets, folder, "two").where(_linked()).select("a", "b", "both", "na", "nb"))
    return own, sets, saved(links, folder, "links")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; kept is one document of each group, that with the smallest doc_id.

    A null or empty text, or one without words, has the empty set: n_shingles 0, a group of its own.  A text of fewer than five
    words has its whole word sequence as its one shingle.  Rows with equal sets are one class and linked.  A null doc_id takes no part, has a null
    component_id and is kept.  Rows with equal doc_ids are judged by their texts, one by one.  Other columns are not read.
    """
    own, sets, links = linked(docs)
    folder = work_folder(docs.sparkSession)
    labels = saved(components(links, folder, "labels"), folder, "labels")
    placed = sets.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component_id"))
    whole = own.drop("bits", "bands").join(placed, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    found = whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
