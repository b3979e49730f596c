"""The stored tables of a play log: what is derived once and every query reads, kept by the version of the data below it.

A table lies in ``<name>/<version>.<number>`` below the library's folder.  The version is a digest of the files that the table is made
of (names, sizes, times of change), so changed input gives another table, and a change of tags leaves tables alone that are made of plays only.
Tables are never changed in place: a rebuild writes the next number, readers take the highest that is complete (it has ``_SUCCESS``),
and what a failed write leaves is never read.  Another application finds the tables of an earlier one.
"""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines share; a folder of this machine only where a local master has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _files(spark: SparkSession, folder: str) -> list:
    """(file system, status) of what lies in a folder, or of a file; nothing if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(fs, s) for s in fs.listStatus(path)] if fs.exists(path) else []


def snapshot(spark: SparkSession, paths: Iterable[str]) -> str:
    """A digest of the names, sizes and times of change of all files at or below the paths."""
    seen, left = [], list(paths)
    while left:
        for _, s in _files(spark, left.pop()):
            name = s.getPath().toString()
            if s.isDirectory():
                left.append(name)
            else:
                seen.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def size_of(table: DataFrame) -> int:
    """Bytes of the files that a stored table is read from."""
    folders = {unquote(f.rsplit("/", 1)[0]) for f in table.inputFiles()}
    return sum(s.getLen() for f in folders for _, s in _files(table.sparkSession, f))


class Store:
    """Tables of one library in one folder."""

    def __init__(self, spark: SparkSession, *key: str):
        self.spark = spark
        self.folder = f"{base_folder(spark)}/playlog/{hashlib.sha256('|'.join(key).encode()).hexdigest()[:16]}"
        self.schemas: dict[str, object] = {}
        self.seconds: dict[str, float] = {}

    def numbers(self, name: str, version: str) -> tuple[str | None, int]:
        """The newest complete folder of a version of a table, and the next free number."""
        found = [(int(p.rsplit(".", 1)[1]), p, fs, s) for fs, s in _files(self.spark, f"{self.folder}/{name}") if (p := s.getPath().toString()).rsplit("/", 1)[1].startswith(version + ".")]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        done = max((n, p) for n, p, fs, _ in found if fs.exists(path(f"{p}/_SUCCESS")))[1] if any(fs.exists(path(f"{p}/_SUCCESS")) for _, p, fs, _ in found) else None
        return done, 1 + max((n for n, *_ in found), default=0)

    def kept(self, name: str, version: str, make: Callable[[], DataFrame], by_year: bool = False, anew: bool = False) -> DataFrame:
        """The table of this name and version, written from make() where there is none yet, or anew."""
        done, number = self.numbers(name, version)
        if done is None or anew:
            began, df = time.time(), make()
            done = f"{self.folder}/{name}/{version}.{number}"
            if by_year:
                df.write.partitionBy("lyear").parquet(done)
            else:
                df.write.parquet(done)
            self.schemas[done] = df.schema
            self.seconds[name] = time.time() - began
        if done not in self.schemas:
            self.schemas[done] = self.spark.read.parquet(done).schema
        return self.spark.read.schema(self.schemas[done]).parquet(done)

    def vacuum(self) -> int:
        """Delete all but the newest complete folder of each version of each table; how many went. Nothing may be reading them."""
        gone = 0
        for _, table in _files(self.spark, self.folder):
            name = table.getPath().getName()
            for version in {s.getPath().getName().rsplit(".", 1)[0] for _, s in _files(self.spark, f"{self.folder}/{name}")}:
                best = self.numbers(name, version)[0]
                for fs, s in _files(self.spark, f"{self.folder}/{name}"):
                    if s.getPath().getName().startswith(version + ".") and s.getPath().toString() != best:
                        gone += fs.delete(s.getPath(), True)
        return gone


_stores: dict[tuple[str, ...], Store] = {}


def store_of(spark: SparkSession, *key: str) -> Store:
    """The store of a library."""
    own = (spark.sparkContext.applicationId, base_folder(spark), *key)
    if own not in _stores:
        _stores[own] = Store(spark, *key)
    return _stores[own]


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to a new table in the shared folder, partitioned by a column, and read again, which cuts its lineage."""
    path = f"{base_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
