"""A user's rules that outlive a session, and merges of artists with their titles.

Rules lie in an append-only table: what is said later about the same thing holds, and a removal is a rule too.  Plays are never
updated; rules are applied when tables are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlog.model import ingest, left_by

KINDS = ("alias", "hide", "dismiss", "loved", "track_edition", "album_edition", "merge")
_SCHEMA = "seq long, at long, kind string, key string, value long, removed boolean"


class RuleLog:
    """Rules in a folder: (kind, key) says about what, value what. Whoever appends next gets the next number; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def history(self) -> DataFrame:
        """All that was ever said; nothing where nothing was."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(_SCHEMA).parquet(self.folder) if there else self.spark.createDataFrame([], _SCHEMA)

    def say(self, kind: str, rules: DataFrame, at: int, removed: bool = False) -> int:
        """Append rules(key, value), all under the next number, which is returned. A null key says nothing and is left out."""
        if kind not in KINDS:
            raise ValueError(f"no such kind of rule: {kind}")
        number = (self.history().agg(F.max("seq")).first()[0] or 0) + 1
        value = F.col("value").cast("long") if "value" in rules.columns else F.lit(None).cast("long")
        rows = rules.where("key is not null").select(F.lit(number).cast("long").alias("seq"), F.lit(at).cast("long").alias("at"), F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), value.alias("value"), F.lit(removed).alias("removed"))
        rows.write.mode("append").parquet(self.folder)
        return number

    def current(self, kind: str) -> DataFrame:
        """(key, value, at) of the rules of a kind that hold; of several said at once for a key the smallest value."""
        last = F.max_by(F.struct("value", "at", "removed"), F.struct("seq", -F.coalesce("value", F.lit(0))))
        return self.history().where(F.col("kind") == kind).groupBy("key").agg(last.alias("r")).where("not r.removed").select("key", "r.value", "r.at")

    def listed(self, kind: str) -> DataFrame:
        """The rules of a kind that hold, newest first."""
        return self.current(kind).orderBy(F.desc("at"), "key")


def pair_key(a: Column, b: Column) -> Column:
    """One key for two texts."""
    return F.concat_ws("\n", a, b)


def asked_aliases(asked: DataFrame, artists: DataFrame) -> DataFrame:
    """asked(name_key, target_id) with what comes of it: alias, merge (from_id is the artist of that name), or why nothing does.

    A name that an artist of the library (artist_id, name_key) has is no alias: that artist is merged instead.
    """
    own = artists.groupBy("name_key").agg(F.min("artist_id").alias("from_id"))
    known = artists.select(F.col("artist_id").alias("target_id"), F.lit(True).alias("found")).distinct()
    rows = asked.join(own, "name_key", "left").join(known, "target_id", "left")
    said = (F.when(F.coalesce("name_key", F.lit("")) == "", "empty name").when(F.col("from_id") == F.col("target_id"), "own name").when(F.col("found").isNull(), "artist not found")
            .when(F.col("from_id").isNotNull(), "merge").otherwise("alias"))
    return rows.select("name_key", "target_id", said.alias("outcome"), F.when(said == "merge", F.col("from_id")).alias("from_id"))


def asked_loved(asked: DataFrame, entries: DataFrame, resolved: DataFrame, tracks: DataFrame, held: DataFrame) -> DataFrame:
    """asked(artist_key, title_key, track_id) with ok, or why the loved entry cannot be linked to that track.

    resolved is loved_resolve() without rules, held the rules that hold (key as pair_key).
    """
    entry = ["artist_key", "title_key"]
    rows = asked.join(entries.select(*entry).distinct().withColumn("loved", F.lit(True)), entry, "left")
    rows = rows.join(tracks.select("track_id", F.col("artist_id").alias("track_artist")), "track_id", "left")
    rows = rows.join(resolved.groupBy(*entry).agg(F.max("artist_id").alias("artist_id"), F.max("track_id").alias("direct")), entry, "left")
    rows = rows.join(held.select("key", F.lit(True).alias("held")), pair_key(F.col("artist_key"), F.col("title_key")) == F.col("key"), "left")
    said = (F.when(F.col("loved").isNull(), "not loved").when(F.col("track_artist").isNull(), "track not found").when(F.col("artist_id").isNull(), "artist unknown")
            .when(F.col("track_artist") != F.col("artist_id"), "another artist").when(F.col("direct").isNotNull(), "already matches").when(F.col("held"), "already linked").otherwise("ok"))
    return rows.select(*entry, "track_id", said.alias("outcome"))


def without_hidden(rows: DataFrame, log: RuleLog) -> DataFrame:
    """rows without the artists that are hidden from suggestions."""
    hidden = log.current("hide").select(F.col("key").cast("long").alias("artist_id"))
    return rows.join(hidden, "artist_id", "left_anti")


# ------------------------------------------------------------------ merges


def titles_after(items: DataFrame, rules: DataFrame, item: str) -> DataFrame:
    """(item, artist_id, into_id) of items(item, artist_id, title_key) after artists are merged by resolved rules(from_id, to_id).

    Items of one title meet in that of the artist who stays, else in the smallest; a null title meets none.
    """
    moved = items.join(rules, F.col("artist_id") == F.col("from_id"), "left").select(item, F.coalesce("to_id", "artist_id").alias("artist_id"), "title_key", F.col("to_id").isNotNull().alias("came"))
    first = F.min(F.struct("came", F.col(item).alias("id")))
    into = moved.where("title_key is not null").groupBy("artist_id", "title_key").agg(first.alias("f")).select("artist_id", "title_key", F.col("f.id").alias("into_id"))
    return moved.join(into, ["artist_id", "title_key"], "left").select(item, "artist_id", F.coalesce("into_id", item).alias("into_id"))


def merged_plays(plays: DataFrame, rules: DataFrame, tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """plays(ts, artist_id, track_id, album_id) after artists are merged, their tracks and albums of one title combined.

    Plays that then have one minute and one track are one play.  tracks and albums are titles_after().
    """
    to = lambda rows, item: rows.select(item, F.col("into_id").alias(f"{item}_into"))
    rows = plays.join(rules, F.col("artist_id") == F.col("from_id"), "left").join(to(tracks, "track_id"), "track_id", "left")
    rows = left_by(rows, to(albums, "album_id"), "album_id")
    return ingest(rows.select("ts", F.coalesce("to_id", "artist_id").alias("artist_id"), F.coalesce("track_id_into", "track_id").alias("track_id"), F.coalesce("album_id_into", "album_id").alias("album_id")))


def merge_outcome(plays: DataFrame, after: DataFrame, rules: DataFrame, tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """One row: plays of merged artists, plays that fell together, tracks and albums combined."""
    gone = lambda rows, item: rows.agg(F.count_if(F.col(item) != F.col("into_id")).alias(item))
    moved = plays.join(rules, F.col("artist_id") == F.col("from_id"), "left_semi").agg(F.count("*").alias("moved"))
    before, left = plays.agg(F.count("*").alias("b")), after.agg(F.count("*").alias("a"))
    row = moved.crossJoin(before).crossJoin(left).crossJoin(gone(tracks, "track_id")).crossJoin(gone(albums, "album_id"))  # one row each
    return row.select("moved", (F.col("b") - F.col("a")).alias("duplicates"), F.col("track_id").alias("tracks_combined"), F.col("album_id").alias("albums_combined"))


def aliases_after(aliases: DataFrame, artists: DataFrame, rules: DataFrame) -> DataFrame:
    """(name_key, artist_id) after a merge: rules for a merged artist point at where it went, its own name does too, and no rule has the name of an artist who stays."""
    moved = aliases.join(rules, F.col("artist_id") == F.col("from_id"), "left").select("name_key", F.coalesce("to_id", "artist_id").alias("artist_id"), F.lit(1).alias("old"))
    own = artists.join(rules, F.col("artist_id") == F.col("from_id")).select("name_key", F.col("to_id").alias("artist_id"), F.lit(0).alias("old"))
    stay = artists.join(rules, F.col("artist_id") == F.col("from_id"), "left_anti").select("name_key").distinct()
    best = F.min(F.struct("old", "artist_id"))
    return moved.unionByName(own).join(stay, "name_key", "left_anti").groupBy("name_key").agg(best.alias("b")).select("name_key", F.col("b.artist_id").alias("artist_id"))


def repointed(rules: DataFrame, into: DataFrame, item: str) -> DataFrame:
    """rules with a column item after its items met in others (titles_after)."""
    return rules.join(into.select(item, "into_id"), item, "left").withColumn(item, F.coalesce("into_id", item)).drop("into_id").select(*rules.columns)


def title_rules_after(aliases: DataFrame, items: DataFrame, after: DataFrame, rules: DataFrame, item: str) -> DataFrame:
    """(artist_id, title_key, item) rules of titles merged earlier, after artists are merged: they follow the artist and the item.

    A rule of the artist who stays goes before one that came; one for a title that an item of the artist has is dropped.
    """
    moved = repointed(aliases.select("artist_id", "title_key", item), after, item).join(rules, F.col("artist_id") == F.col("from_id"), "left")
    moved = moved.select(F.coalesce("to_id", "artist_id").alias("artist_id"), "title_key", item, F.col("to_id").isNotNull().alias("came"))
    one = moved.groupBy("artist_id", "title_key").agg(F.min(F.struct("came", F.col(item).alias("id"))).alias("b")).select("artist_id", "title_key", F.col("b.id").alias(item))
    held = items.select(item, "title_key").join(after.select(item, "artist_id"), item).select("artist_id", "title_key").distinct()
    return one.join(held, ["artist_id", "title_key"], "left_anti")


def hidden_after(hidden: DataFrame, rules: DataFrame) -> DataFrame:
    """(artist_id, at): a hidden artist stays hidden under the one it went to; that one's own rule goes first, then the earliest."""
    moved = hidden.join(rules, F.col("artist_id") == F.col("from_id"), "left").select(F.coalesce("to_id", "artist_id").alias("artist_id"), F.col("to_id").isNotNull().alias("came"), "at")
    return moved.groupBy("artist_id").agg(F.min(F.struct("came", "at")).alias("b")).select("artist_id", "b.at")


def because(links: DataFrame, core: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """(artist_id, because) of found artists: the core(core_id) artists that they link to most strongly."""
    both = links.select(F.col("a").alias("artist_id"), F.col("b").alias("core_id"), "score").unionByName(links.select(F.col("b").alias("artist_id"), F.col("a").alias("core_id"), "score"))
    near = both.join(F.broadcast(core.select("core_id")), "core_id").join(found.select("artist_id"), "artist_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("artist_id").orderBy(F.desc(F.round("score", 9)), "core_id"))
    first = F.sort_array(F.collect_list(F.struct("r", "core_id")))  # so many at most
    return near.withColumn("r", rank).where(F.col("r") <= most).groupBy("artist_id").agg(F.transform(first, lambda x: x.core_id).alias("because"))
