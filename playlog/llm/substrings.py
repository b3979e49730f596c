"""Substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words.  From the hashes of the ANCHOR-word windows that a WINDOW
contains, the smallest is selected, so two equal WINDOWs select the same one: the index keeps about
one fingerprint in twenty words and misses no repeat.  Documents arrive in batches of ascending doc_id.  Each
batch adds one immutable run: its distinct fingerprints, sorted and bucketed by hash, beside the
batch's texts and the fingerprints' places, which stay by document.  The new run is merge-joined
with every older one, bucket by bucket and without a shuffle; the fingerprints that two documents share
name the few places whose whole WINDOWs are then verified: a 128-bit BLAKE2b digest of the
window's bytes decides what goes.  Runs are compacted into one when there are many.  An index lies in
a folder and can be opened again to add the next batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm.common import id_bounds, parts_for, saved, work_folder
from playlog.llm.wordhash import Words, slices

WINDOW, ANCHOR = 50, 16
BATCHES = 2
MAX_RUNS = 8
PLACES = "doc_id long, th long, fps array<long>, pos array<int>"
#: The tables of a run that are bucketed, with their columns and keys.
BUCKETED = {"texts": ("doc_id long, th long, text string", ["doc_id", "th"]), "fps": ("fp long, lo long, hi long", ["fp"])}


def anchors(words: Words, i: int) -> np.ndarray:
    """Places (words from the text's start) of the selected fingerprints of text i."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    if b - a < WINDOW:
        return np.zeros(0, dtype=np.int64)
    run = words.anchor_runs[a : b - ANCHOR + 1]
    span = WINDOW - ANCHOR + 1
    views = np.lib.stride_tricks.sliding_window_view(run, span)
    return np.unique(np.arange(len(views)) + views.argmin(axis=1))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def places(texts: DataFrame) -> DataFrame:
    """Per document (doc_id, th, fps, pos): its selected fingerprints and where they lie; documents without any are left out."""

    def lists(values: np.ndarray, n: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for base, words in slices(batch.column("text")):
                words.anchor_runs = words.runs(ANCHOR)
                found = [anchors(words, i) for i in range(len(words))]
                some = [i for i, x in enumerate(found) if len(x)]
                if not some:
                    continue
                n = [len(found[i]) for i in some]
                pos = np.concatenate([found[i] for i in some])
                fps = words.anchor_runs[np.repeat(words.first[some], n) + pos].view(np.int64)
                rows = pa.array([base + i for i in some])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), lists(fps, n), lists(pos.astype(np.int32), n)], names=["doc_id", "th", "fps", "pos"])

    return texts.where("text is not null").select("doc_id", "th", "text").mapInArrow(run, PLACES)


class FingerprintIndex:
    """The runs of an index in a folder, for one session.

    A folder holds, for each batch, the tables texts, places and fps, and one small manifest for each state of the
    index; the newest manifest names the tables in use.  Nothing that is written is changed later.  Bucketed
    tables are known to the session's catalog under random names until close().
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, runs: list[tuple[str, str]], version: int, last: int | None):
        self.spark, self.folder, self.buckets, self.version, self.last = spark, folder, buckets, version, last
        self.runs, self.names = runs, {}  # runs: (kind, path)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int) -> FingerprintIndex:
        index = cls(spark, folder, buckets, [], 0, None)
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index of a folder as its last batch left it."""
        rows = spark.read.schema("kind string, path string, buckets int, last long, version int").parquet(f"{folder}/manifest")
        newest = rows.join(rows.agg(F.max("version").alias("version")), "version").collect()  # a few rows a run
        own = [(r["kind"], r["path"]) for r in newest if r["kind"] != "index"]
        return cls(spark, folder, newest[0]["buckets"], own, newest[0]["version"], newest[0]["last"])

    def _commit(self) -> None:
        self.version += 1
        rows = [(kind, path, self.buckets, self.last) for kind, path in [*self.runs, ("index", "")]]
        self.spark.createDataFrame(rows, "kind string, path string, buckets int, last long").coalesce(1).write.parquet(f"{self.folder}/manifest/version={self.version}")

    def paths(self, kind: str) -> list[str]:
        return [path for k, path in self.runs if k == kind]

    def _write(self, kind: str, rows: DataFrame) -> str:
        """A new immutable table; bucketed ones have one sorted file a bucket."""
        path = f"{self.folder}/{kind}_{uuid.uuid4().hex}"
        if kind in BUCKETED:
            keys = BUCKETED[kind][1]
            name = self.names[path] = f"run_{uuid.uuid4().hex}"
            rows.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
        else:
            rows.write.parquet(path)
        return path

    def table(self, kind: str, path: str) -> DataFrame:
        if kind not in BUCKETED:
            return self.spark.read.schema(PLACES).parquet(path)
        if path not in self.names:  # written by an earlier session
            columns, keys = BUCKETED[kind]
            name = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {name} ({columns}) using parquet clustered by ({', '.join(keys)}) sorted by ({', '.join(keys)}) into {self.buckets} buckets location '{path}'")
            self.names[path] = name
        return self.spark.table(self.names[path])

    def close(self) -> None:
        """Forget the session's names for the tables; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")
        self.names = {}

    def compact(self) -> None:
        """Merge the fingerprints of all runs into one run, two runs at a time, bucket by bucket."""
        old = self.paths("fps")
        merged = old[0]
        for path in old[1:]:
            a, b = self.table("fps", merged).toDF("fa", "la", "ha"), self.table("fps", path).toDF("fb", "lb", "hb")
            both = a.hint("merge").join(b, F.col("fa") == F.col("fb"), "full")
            merged = self._write("fps", both.select(F.coalesce("fa", "fb").alias("fp"), F.least("la", "lb").alias("lo"), F.greatest("ha", "hb").alias("hi")))
        self.runs = [r for r in self.runs if r[0] != "fps"] + [("fps", merged)]
        self._commit()

    def common(self, new: str) -> DataFrame:
        """Fingerprints of the new run that another document has, in that run or an older one."""
        own = self.table("fps", new)
        out = own.where("lo < hi").select("fp")
        for path in self.paths("fps"):
            if path != new:
                out = out.unionByName(own.select("fp").hint("merge").join(self.table("fps", path).select("fp"), "fp"))
        return out.distinct()

    def add(self, docs: DataFrame) -> DataFrame:
        """Take docs(doc_id, th, text) in as a new batch and return (doc_id, th, text, starts) of its documents.

        starts are the places of WINDOWs that a document with a smaller doc_id has, of this batch or an earlier one;
        null if there are none.  doc_ids are not null and above those of all earlier batches.
        """
        row = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        if self.last is not None and row["lo"] is not None and row["lo"] <= self.last:
            raise ValueError(f"doc_id {row['lo']} is not above those of earlier batches ({self.last})")
        texts = self._write("texts", docs.select("doc_id", "th", "text").repartition(self.buckets, "doc_id", "th"))
        found = self._write("places", places(self.table("texts", texts)))
        each = self.table("places", found).select(F.explode("fps").alias("fp"), "doc_id").groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        fps = self._write("fps", each.repartition(self.buckets, "fp"))
        self.runs += [("texts", texts), ("places", found), ("fps", fps)]
        self.last = self.last if row["hi"] is None else row["hi"]
        self._commit()
        work = f"{self.folder}/batch_{uuid.uuid4().hex}"
        common = saved(self.common(fps), work, "common")
        if len(self.paths("fps")) > MAX_RUNS:
            self.compact()
        every = None
        for path in self.paths("places"):
            rows = self.table("places", path).select("doc_id", "th", F.explode(F.arrays_zip("fps", "pos")).alias("p"))
            every = rows if every is None else every.unionByName(rows)
        # a fingerprint of very many documents makes a skewed partition, which adaptive execution splits
        hit = every.select("doc_id", "th", F.col("p.fps").alias("fp"), F.col("p.pos").alias("pos")).join(common, "fp")
        shared = saved(hit.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("places")), work, "shared")
        windows = None
        for path in self.paths("texts"):
            rows = _windows(self._marked(path, shared))
            windows = rows if windows is None else windows.unionByName(rows)
        first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
        first = saved(first, work, "first")
        again = _windows(self._marked(texts, shared)).join(first, ["h1", "h2"]).where("lo < doc_id")
        cover = saved(again.groupBy("doc_id", "th").agg(F.collect_set("start").alias("starts")), work, "cover")
        return self.table("texts", texts).join(cover.hint("merge"), ["doc_id", "th"], "left").select("doc_id", "th", "text", "starts")

    def _marked(self, texts: str, shared: DataFrame) -> DataFrame:
        """The texts of one run that have shared places, with those; the texts stay where they are."""
        return self.table("texts", texts).join(shared.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "places")


def _windows(spans: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, th, start): digest of each WINDOW that covers a shared place."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            marks = batch.column("places")
            for base, words in slices(batch.column("text")):
                found = [_starts(marks[base + i].values.to_numpy(), int(words.first[i + 1] - words.first[i])) for i in range(len(words))]
                n = [len(x) for x in found]
                if not sum(n):
                    continue
                start = np.concatenate(found)
                at = start + np.repeat(words.first[:-1], n)
                data, offsets = words.joined()
                digest = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[at].tolist(), offsets[at + WINDOW].tolist(), strict=True)])
                h = np.frombuffer(digest, dtype="<i8").reshape(-1, 2)
                own = pa.array(np.repeat(np.arange(base, base + len(words)), n))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc_id").take(own), batch.column("th").take(own), pa.array(start.astype(np.int32))], names=["h1", "h2", "doc_id", "th", "start"])

    return spans.mapInArrow(run, "h1 long, h2 long, doc_id long, th long, start int")


def _starts(places: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that cover one of the fingerprints at places."""
    flag = np.zeros(n_words + 2, dtype=np.int64)
    lo, hi = np.maximum(places + ANCHOR - WINDOW, 0), np.minimum(places, n_words - WINDOW)
    np.add.at(flag, lo, 1)
    np.add.at(flag, hi + 1, -1)
    return np.flatnonzero(np.cumsum(flag)[: n_words + 1] > 0)


def removed_words(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, th, n_words, n_removed, kept (the remaining words joined by one space) of every row of docs.

    A word goes if a window over it has words that also start in a document with a smaller doc_id.
    A null or empty text has no words; a row with a null doc_id loses nothing and takes nothing from
    others; rows with equal doc_ids are one document with several texts, which take nothing from one
    another; repeated rows get equal results.  Other columns are not read.  With an index, docs are
    compared with what it holds as well and are added to it.
    """
    spark, source = docs.sparkSession, _source(docs)
    bounds = id_bounds(docs, batches)
    if index is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        index = FingerprintIndex.create(spark, work_folder(spark), parts_for(spark, size, 64e6))
    out = _kept(source.where("doc_id is null").withColumn("starts", F.lit(None).cast("array<int>")))
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        new = source.where("doc_id is not null")
        new = new if lo is None else new.where(F.col("doc_id") >= lo)
        new = new if hi is None else new.where(F.col("doc_id") < hi)
        out = out.unionByName(_kept(index.add(new)))
    return out


def _kept(rows: DataFrame) -> DataFrame:
    """doc_id, th, n_words, n_removed, kept of rows(doc_id, th, text, starts)."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            starts = batch.column("starts")
            totals, gone, kept = [], [], []
            for base, words in slices(batch.column("text")):
                for i in range(len(words)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    stay = np.ones(b - a, dtype=bool)
                    own = starts[base + i]
                    if own.is_valid:
                        flag = np.zeros(b - a + 1, dtype=np.int64)
                        s = own.values.to_numpy()
                        np.add.at(flag, s, 1)
                        np.add.at(flag, s + WINDOW, -1)
                        stay = np.cumsum(flag)[:-1] == 0
                    where = np.flatnonzero(stay) + a
                    data = words.data
                    kept.append(b" ".join([data[x:y].tobytes() for x, y in zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)]))
                    totals.append(b - a)
                    gone.append(b - a - len(where))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "th", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "th", "text", "starts").mapInArrow(run, "doc_id long, th long, n_words long, n_removed long, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int, str]]:
    """The same rows by comparing every window with every other, for small tables."""
    import re

    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least: dict[tuple[str, ...], int] = {}
    for d, w in split:
        for i in range(len(w) - WINDOW + 1 if d is not None else 0):
            key = tuple(w[i : i + WINDOW])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - WINDOW + 1 if d is not None else 0):
            if least[tuple(w[i : i + WINDOW])] < d:
                gone.update(range(i, i + WINDOW))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
