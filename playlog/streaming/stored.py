"""A play log that takes new rows: batches are merged into stored plays, and only what they touch is derived again.

Plays are partitioned by local month; a batch rewrites the months that it has plays of.  Breaks are counted within a day, so
sessions of other months stay as they are; session numbers are given when the log is read.  New plays join sessions and never part
them, so what changes are the artists of the sessions that hold a new play.  The tables of artists and links are kept by the
version of the plays they were made of: a batch that comes twice finds nothing to do, and tables that a run left behind are made whole by the next.
After a log's first batch, and after one that changes a tenth of its plays, a table is made of all plays when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlog.model import ORDER, local_parts
from playlog.operators import derive
from playlog.store import Store, saved, snapshot

OVERLAP_S = 24 * 3600
#: A batch that changes this part of the plays or more has tables made of all plays.
MOST = 0.1
_PLAYS = "ts long, artist_id long, track_id long, album_id long, lday date, lhour int, lwday int, in_day long, lmonth string"
_IMPORTS = "at long, label string, rows_read long, rows_added long, duplicates long, first_ts long, last_ts long"
_DERIVED = ("totals", "entrances", "pairs", "sizes")


class StoredLog:
    """One writer at a time; readers of tables that are replaced meanwhile keep the old ones, readers of plays take them anew."""

    def __init__(self, spark: SparkSession, folder: str, min_shared: int = derive.MIN_SHARED):
        self.spark, self.folder, self.min_shared = spark, folder.rstrip("/"), min_shared
        self.store = Store(spark, self.folder)

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @property
    def marked(self) -> DataFrame:
        if not self._there("plays"):
            return self.spark.createDataFrame([], _PLAYS)
        return self.spark.read.schema(_PLAYS).parquet(f"{self.folder}/plays")

    @property
    def plays(self) -> DataFrame:
        return self.marked.drop("in_day", "lmonth")

    @property
    def sessions(self) -> DataFrame:
        marked = self.marked.drop("lmonth")
        return derive.numbered(marked, derive.listening_days(marked))

    @property
    def span(self) -> DataFrame:
        return self.marked.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))

    def since(self, now: int | None = None) -> int | None:
        """From when on a source is asked: a day before the newest play, so that late ones are found; a play from the future does not stop that."""
        newest = self.span.first()["hi"]
        return None if newest is None else max(0, (newest if now is None else min(newest, now)) - OVERLAP_S)

    # ---------------------------------------------------------------- writing

    def merge(self, raw: DataFrame, label: str = "", at: int = 0) -> dict[str, int]:
        """Merge raw plays(ts, artist_id, track_id, album_id) and bring the tables up to date; what came of it, which is logged too.

        Rows without a time, artist or track are read and not taken.  Of equal plays one is kept, with the smallest album_id.
        """
        raw = saved(raw.select(*[F.col(c).cast("long").alias(c) for c in (*ORDER, "album_id")]))
        read, came = raw.count(), raw.dropna(subset=ORDER)
        day = local_parts(F.col("ts") - F.pmod("ts", F.lit(60)))[0]
        months = [r[0] for r in came.select(F.date_format(day, "yyyy-MM").alias("lmonth")).distinct().collect()]  # of the calendar, so few
        old = self.marked.where(F.col("lmonth").isin(months)) if months else self.marked.limit(0)
        both = old.select(*ORDER, "album_id", F.lit(True).alias("known")).unionByName(came.withColumn("known", F.lit(False)))
        # of equal plays the one that stays is an old one where it can be; who had none is added: all in the shuffle and order that the breaks need
        there = F.max("known").over(Window.partitionBy("lyear", "lday", *ORDER))
        whole = derive.marked_once(both, keep=("known",), seen={"there": there}).withColumn("lmonth", F.date_format("lday", "yyyy-MM"))
        whole = saved(whole.select(*[c.split(" ")[0] for c in _PLAYS.split(", ")], "known", "there"), by="lmonth")
        new = whole.where("not known")
        size = new.agg(F.count("*").alias("changed"), F.count_if(~F.col("there")).alias("added")).first()
        if size["changed"]:
            before, first = self.version, not self._there("plays")
            if not first and size["changed"] < self.marked.count() * MOST:
                self._whole()  # what the tables below are brought up from
            whole.drop("known", "there").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lmonth").parquet(f"{self.folder}/plays")
            if not first:
                self._refresh(before, new)
        span = raw.agg(F.min("ts"), F.max("ts")).first()
        done = {"rows_read": read, "rows_added": size["added"], "duplicates": read - size["added"]}
        self.spark.createDataFrame([(at, label, *done.values(), *span)], _IMPORTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/imports")
        return done

    def imports(self) -> DataFrame:
        """What was merged when."""
        return self.spark.read.schema(_IMPORTS).parquet(f"{self.folder}/imports") if self._there("imports") else self.spark.createDataFrame([], _IMPORTS)

    def into(self, label: str = "stream") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that is run again after a failure changes nothing."""
        return lambda batch, number: self.merge(batch, f"{label} {number}") and None

    @property
    def version(self) -> str:
        return snapshot(self.spark, [f"{self.folder}/plays"])

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.store.kept(name, self.version, make)

    def _refresh(self, before: str, new: DataFrame) -> None:
        """Derived tables for the plays as they are: rows of touched artists made again, all others taken over."""
        if any(self.store.numbers(n, before)[0] is None for n in _DERIVED):
            return  # a first or large batch: most rows would be made again, so each table is made of all plays when it is read
        marked = self.marked.drop("lmonth")
        days = saved(derive.listening_days(marked))
        sessions = derive.numbered(marked, days)  # read anew where it is used: days are few
        changed = saved(derive.numbered(new.select("lday", "in_day"), days).select("session_id").distinct())
        touched = saved(sessions.join(changed, "session_id", "left_semi").select("artist_id").distinct())
        theirs = sessions.join(touched, "artist_id", "left_semi").select("session_id").distinct()
        around = saved(sessions.join(theirs, "session_id", "left_semi"))  # whole sessions: ranks and predecessors need all that is in them
        own = around.join(touched, "artist_id", "left_semi")
        seen = saved(derive.visits(around).join(touched, "artist_id", "left_semi"))
        pair = [F.col(x) == F.col("t") for x in ("a", "b")]
        mark = touched.select(F.col("artist_id").alias("t"))

        def kept_pairs() -> DataFrame:  # a pair changes only where both change
            old = self.store.kept("pairs", before, lambda: self._all()["pairs"])
            both = old.join(mark, pair[0], "left_semi").join(mark, pair[1], "left_semi").select("a", "b")
            return old.join(both, ["a", "b"], "left_anti").unionByName(derive.pair_counts(seen))

        made = {"totals": lambda: derive.artist_totals(own), "entrances": lambda: derive.entrances(around).join(touched, "artist_id", "left_semi"),
                "sizes": lambda: seen.groupBy("artist_id").agg(F.count("*").alias("n"))}
        for name, make in made.items():
            old = lambda n=name: self.store.kept(n, before, lambda: self._all()[n])
            self._table(name, lambda m=make, o=old: o().join(touched, "artist_id", "left_anti").unionByName(m()))
        self._table("pairs", kept_pairs)

    def _all(self) -> dict[str, DataFrame]:
        """Every derived table from all plays."""
        sessions = self.sessions
        seen = derive.visits(sessions)
        return {"totals": derive.artist_totals(sessions), "entrances": derive.entrances(sessions), "pairs": derive.pair_counts(seen), "sizes": seen.groupBy("artist_id").agg(F.count("*").alias("n"))}

    def _whole(self) -> None:
        for name in _DERIVED:
            self._table(name, lambda n=name: self._all()[n])

    def repair(self) -> list[str]:
        """Make the tables that a run which died left behind; their names."""
        missing = [n for n in _DERIVED if self.store.numbers(n, self.version)[0] is None]
        self._whole()
        return missing

    # ---------------------------------------------------------------- reading

    @property
    def stats(self) -> DataFrame:
        return derive.with_prehistory(self._table("totals", lambda: self._all()["totals"]), self.span)

    @property
    def gateway(self) -> DataFrame:
        return derive.discovered(self._table("entrances", lambda: self._all()["entrances"]), self.span)

    @property
    def links(self) -> DataFrame:
        return derive.scored_links(self._table("pairs", lambda: self._all()["pairs"]), self._table("sizes", lambda: self._all()["sizes"]), self.min_shared)


class Snapshots:
    """A list that a source always sends whole: what it sent last, replaced only when something in it differs."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], first: str):
        self.spark, self.folder, self.keys, self.first = spark, folder.rstrip("/"), keys, first
        self.store = Store(spark, self.folder)

    def current(self) -> DataFrame | None:
        done = self.store.numbers("list", "all")[0]
        return None if done is None else self.spark.read.parquet(done)

    def replace(self, rows: DataFrame, expected: int | None = None) -> dict[str, object]:
        """Rows of equal keys are one, with the earliest first; a row without a key or time is not taken.  A list of which more than a few
        of the expected rows are missing is a bad answer and raises, so that nothing is taken away."""
        taken = saved(rows.dropna(subset=[*self.keys, self.first]))
        size = rows.count()
        if expected is not None and size < expected - max(5, expected // 50):
            raise ValueError(f"{size} of {expected} rows came; the old list is kept")
        one = saved(taken.groupBy(*self.keys).agg(F.min_by(F.struct(*[c for c in taken.columns if c not in self.keys]), self.first).alias("r")).select(*self.keys, "r.*"))
        old = self.current()
        changed = old is None or not (old.exceptAll(one).isEmpty() and one.exceptAll(old).isEmpty())
        if changed:
            self.store.kept("list", "all", lambda: one, anew=True)
        return {"rows": one.count(), "changed": changed}

    def into(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch is a whole list; an empty one is no answer."""
        return lambda batch, _: None if batch.isEmpty() else self.replace(batch) and None
