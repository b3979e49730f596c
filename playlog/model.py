"""The play-log model and the adapters that read it from the relational test tables.

A play is (ts, artist_id, track_id, album_id, lday, lhour, lwday); ts is in unix seconds, floored to the
minute, and (ts, artist_id, track_id) is its identity and its order.  "Now" is the newest play, never the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.store import Store, size_of, snapshot, store_of

ORDER = ["ts", "artist_id", "track_id"]
TASK_BYTES = 4 << 20


def local_parts(ts: Column, zone: str = "UTC") -> tuple[Column, Column, Column]:
    """Local day, hour and weekday (Monday is 0) of unix seconds."""
    local = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))  # seconds alone: the session's zone has no say
    day = F.floor(local / 86400).cast("int")
    return F.date_from_unix_date(day), F.floor(F.pmod(local, F.lit(86400)) / 3600).cast("int"), F.pmod(day + 3, F.lit(7)).cast("int")


def with_calendar(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    day, hour, weekday = local_parts(F.col("ts"), zone)
    return rows.withColumns({"lday": day, "lhour": hour, "lwday": weekday})


def ingest(raw: DataFrame, zone: str = "UTC") -> DataFrame:
    """Raw plays to identified ones: minute floor, one row per identity, the smallest album id kept.

    The aggregate combines on the map side, so a re-import of the same rows shuffles one row per key and task.
    """
    rows = raw.withColumn("ts", F.col("ts") - F.pmod("ts", F.lit(60)))
    return with_calendar(rows.groupBy(*ORDER).agg(F.min("album_id").alias("album_id")), zone)


def left_by(rows: DataFrame, facts: DataFrame, key: str, theirs: str | None = None) -> DataFrame:
    """rows left-joined with facts by a key that many rows lack: those with null match nothing, and are not sent to the one task that null hashes to."""
    own = rows.where(F.col(key).isNotNull())
    found = own.join(facts, key, "left") if theirs is None else own.join(facts, F.col(key) == F.col(theirs), "left")
    return found.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def derive():
    """The module of derivations, which itself needs this one."""
    from playlog.operators import derive as module

    return module


def rhythms():
    """The module of genres and cycles, which itself needs this one."""
    from playlog.operators import genres as module

    return module


def _raw(spark: SparkSession, sf_dir: str, a: str, b: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    day = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400
    first, second = F.col(a), F.col(b)
    return items.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (day + (F.col("o_orderkey") * 7919) % 79200 + F.col("l_linenumber") * 210).alias("ts"),
        first.alias("artist_id"),
        (first * 100 + (second % 7) * (second % 2)).alias("track_id"),
        F.when(F.col("l_returnflag") != "N", first * 100 + second % 3).alias("album_id"),
    )


@dataclass(frozen=True)
class PlayLog:
    """The tables of one library: plays and what is known about artists, albums and loved tracks.

    What is derived from the raw tables is read from the library's store, by the version of the data it is made of.
    """

    spark: SparkSession
    sf_dir: str
    profile: str = "part"
    #: Derive every table anew that is asked for.
    anew: bool = False

    @property
    def store(self) -> Store:
        return store_of(self.spark, self.sf_dir, self.profile)

    @cached_property
    def version(self) -> str:
        """Of the data that plays are made of."""
        return snapshot(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in ("orders", "lineitem")])

    @cached_property
    def tag_version(self) -> str:
        """Of plays and tags together."""
        return f"{self.version}-{snapshot(self.spark, [f'{self.sf_dir}/part.parquet'])}"

    def _kept(self, name: str, make: Callable[[], DataFrame], by_year: bool = False, tags: bool = False) -> DataFrame:
        return self.store.kept(name, self.tag_version if tags else self.version, make, by_year, self.anew)

    @cached_property
    def marked(self) -> DataFrame:
        """Plays with the breaks before them on their day: the one large table."""
        pair = ("l_partkey", "l_suppkey") if self.profile == "part" else ("l_suppkey", "l_partkey")
        return self._kept("plays", lambda: derive().marked_once(_raw(self.spark, self.sf_dir, *pair)), by_year=True)

    @property
    def tasks(self) -> int:
        """Tasks for what is some times as large as the plays: one for TASK_BYTES of their files."""
        return 1 + size_of(self.marked) // TASK_BYTES

    @cached_property
    def days(self) -> DataFrame:
        return self._kept("days", lambda: derive().listening_days(self.marked))

    @cached_property
    def plays(self) -> DataFrame:
        return self.marked.drop("in_day")

    @cached_property
    def sessions(self) -> DataFrame:
        """Plays with session_id, numbered when they are read: days are few."""
        return derive().numbered(self.marked, self.days)

    @cached_property
    def stats(self) -> DataFrame:
        return self._kept("stats", lambda: derive().artist_stats(self.sessions))

    @cached_property
    def gateway(self) -> DataFrame:
        return self._kept("gateway", lambda: derive().gateway(self.sessions))

    @cached_property
    def links(self) -> DataFrame:
        return self.weak_links.where(F.col("shared") >= derive().MIN_SHARED)

    @cached_property
    def weak_links(self) -> DataFrame:
        """Links down to two shared sessions."""
        return self._kept("links", lambda: derive().co_links(self.sessions, min_shared=2))

    @cached_property
    def counts(self) -> DataFrame:
        """Plays by artist, year and bucket of every dimension of the calendar, from one pass over the log."""
        return self._kept("counts", lambda: rhythms().calendar_counts(self.marked, self.tasks))

    @cached_property
    def observed(self) -> DataFrame:
        """The same by genre. A change of tags makes this table anew and none of the others."""
        return self._kept("observed", lambda: rhythms().observed(self.counts, rhythms().genre_shares(self.tags)), tags=True)

    def rebuild(self) -> DataFrame:
        """Derive every table anew from the raw data; one row a table with its rows, and nothing volatile. Who reads the old tables is not disturbed."""
        log = replace(self, anew=True)
        tables = [("plays", log.plays), ("sessions", log.sessions), ("stats", log.stats), ("gateway", log.gateway), ("links", log.links), ("albums", log.albums), ("span", log.span), ("counts", log.counts)]
        if self.profile == "part":
            tables.append(("observed", log.observed))
        out = None
        for name, table in tables:
            row = table.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
            out = row if out is None else out.unionByName(row)
        return out

    @cached_property
    def artists(self) -> DataFrame:
        """id and name of every artist that has a name."""
        table, key, name = ("part", "p_partkey", "p_name") if self.profile == "part" else ("supplier", "s_suppkey", "s_name")
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").select(F.col(key).alias("artist_id"), F.col(name).alias("name"))

    @cached_property
    def albums(self) -> DataFrame:
        """Albums with a release date of mixed precision: a year, a month or a day, as text."""
        day = F.date_add(F.lit("1965-01-01").cast("date"), ((F.col("album_id") * 37) % 13000).cast("int"))
        length = F.element_at(F.array(F.lit(4), F.lit(7), F.lit(10)), (F.col("album_id") % 3 + 1).cast("int"))
        known = lambda: self.plays.where("album_id is not null").select("album_id", "artist_id").distinct()
        return self._kept("albums", known).withColumn("release_date", F.substring(day.cast("string"), F.lit(1), length))

    @cached_property
    def tags(self) -> DataFrame:
        """(artist_id, tag, weight): genre tags of artists."""
        part = self.spark.read.parquet(f"{self.sf_dir}/part.parquet").select("p_partkey", "p_type", "p_brand", "p_name")
        pairs = F.array(*[F.struct(tag.alias("tag"), F.lit(weight).alias("weight")) for tag, weight in ((F.col("p_type"), 100), (F.col("p_brand"), 60), (F.split("p_name", " ")[0], 40))])
        return part.select(F.col("p_partkey").alias("artist_id"), F.explode(pairs).alias("t")).select("artist_id", "t.tag", "t.weight")

    @cached_property
    def loved(self) -> DataFrame:
        """(track_id, artist_id, loved_at) of loved tracks."""
        first = self.plays.groupBy("track_id", "artist_id").agg(F.min("ts").alias("first_ts")).where("track_id % 17 = 0")
        return first.select("track_id", "artist_id", (F.col("first_ts") + (F.col("track_id") % 40) * 864000).alias("loved_at"))

    @cached_property
    def span(self) -> DataFrame:
        """One row: lo and hi, the oldest and newest play."""
        return self._kept("span", lambda: self.days.agg(F.min("first").alias("lo"), F.max("last").alias("hi")))
