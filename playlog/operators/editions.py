"""Editions of one recording: titles that differ by a note such as "(Remastered 2011)" alone, found as groups and merged by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.functions.text import norm_key
from playlog.functions.titles import strip_edition
from playlog.model import ingest, left_by

# Names that speak for another recording or a compilation, and titles that say nothing.
OTHER_RECORDING = (
    r"(?i)live|demo|session|unplugged|acoustic|bootleg|rehears|outtake|alternat|instrumental|remix|karaoke|tribute|concert|\bmtv\b|\bbbc\b|\bpeel\b"
    r"|b-side|rarit|unreleased|konsert|akustinen|en vivo|directo|concierto|reimagin|re-?record|stripped|orchestra|symphon|piano|soundtrack|\bost\b|mixtape|medley|\bdub\b")
COMPILATION = r"(?i)greatest|best of|collection|anthology|essential|hits|compilation|very best|singles|rarities|archive|box|complete|selected|ultimate|definitive"
GENERIC = ["intro", "outro", "interlude", "untitled", "prelude", "overture", "finale", "theme", "prologue", "epilogue", "reprise", "skit", "title track",
           "introduction", "end credits", "main title"]
MAX_SAFE, LEAST_OVERLAP = 3, 0.5


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with title_key and edition_key of their title; each distinct title is worked on once."""
    names = rows.select("title").distinct().where("title is not null")
    names = names.withColumns({"title_key": norm_key("title"), "edition_key": norm_key(strip_edition("title"))})
    return rows.join(names, "title", "left")


def _colliding(rows: DataFrame) -> DataFrame:
    """rows of groups (artist_id, edition_key) that hold more than one title, without a user's dismissed groups."""
    keyed = with_keys(rows)
    groups = keyed.groupBy("artist_id", "edition_key").agg(F.countDistinct("title_key").alias("titles")).where("titles > 1")
    return keyed.join(groups.select("artist_id", "edition_key"), ["artist_id", "edition_key"], "left_semi")


GROUP = ["artist_id", "edition_key"]


def _target(members: DataFrame, item: str) -> DataFrame:
    """target_id of each group: the title without a note, then the most plays, then the smallest id."""
    best = F.min(F.struct((F.col("title_key") != F.col("edition_key")).alias("noted"), (-F.col("plays")).alias("less"), F.col(item).alias("id")))
    return members.groupBy(*GROUP).agg(best.alias("best"), F.count("*").alias("versions"), F.sum("plays").alias("plays")).select(*GROUP, F.col("best.id").alias("target_id"), "versions", "plays")


def track_edition_groups(plays: DataFrame, tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """One row per group of an artist's tracks that differ by edition notes.

    same_album says that two were played from one album, notes ignored.  The flags tell why a group is not safe to merge;
    they look at the tracks that share no album with another: many (over three versions), other_recording (an album's name
    speaks for one), generic (a title that says nothing), no_album.
    """
    own = _colliding(tracks)
    by = plays.join(own.select("track_id"), "track_id", "left_semi").groupBy("track_id", "album_id").agg(F.count("*").alias("n"))
    named = with_keys(albums.select("album_id", "title")).select("album_id", F.col("title").alias("album"), F.col("edition_key").alias("album_key"))
    seen = own.join(by, "track_id").join(named, "album_id")
    shared = seen.where("album_key <> ''").groupBy(*GROUP, "album_key").agg(F.countDistinct("track_id").alias("t")).where("t > 1").select(*GROUP, "album_key")
    anchored = seen.join(shared, [*GROUP, "album_key"], "left_semi").select("track_id").distinct().withColumn("anchored", F.lit(True))
    albums_of = seen.groupBy("track_id").agg(F.max(F.col("album").rlike(OTHER_RECORDING)).alias("other"))
    counts = by.groupBy("track_id").agg(F.sum("n").alias("plays"))
    members = own.join(counts, "track_id", "left").join(anchored, "track_id", "left").join(albums_of, "track_id", "left").fillna(0, ["plays"])
    outside = F.col("anchored").isNull()
    flags = members.groupBy(*GROUP).agg(
        F.max(~outside).alias("same_album"), F.max(outside).alias("outside"), F.coalesce(F.max(outside & F.col("other")), F.lit(False)).alias("other_recording"),
        F.max(outside & F.col("other").isNull()).alias("no_album"))
    out = _target(members, "track_id").join(flags, GROUP)
    return out.select(*GROUP, "target_id", "versions", "plays", "same_album", (F.col("outside") & (F.col("versions") > MAX_SAFE)).alias("many"), "other_recording",
                      (F.col("outside") & F.col("edition_key").isin(GENERIC)).alias("generic"), "no_album")


def album_edition_groups(plays: DataFrame, albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per group of an artist's albums that differ by edition notes, with the least overlap of their tracks.

    An album's overlap is its best with another of the group: common titles (notes ignored) over those of the smaller one.
    A group below one half has flags: many, compilation (by a title), nothing_shared (with three titles each).
    """
    own = _colliding(albums)
    by = plays.join(own.select("album_id"), "album_id", "left_semi").groupBy("album_id", "track_id").agg(F.count("*").alias("n"))
    counts = by.groupBy("album_id").agg(F.sum("n").alias("plays"))
    songs = by.join(with_keys(tracks.select("track_id", "title")).select("track_id", F.col("edition_key").alias("song")), "track_id").select("album_id", "song").distinct()
    size = songs.groupBy("album_id").agg(F.count("*").alias("songs"))
    owned = own.select(*GROUP, "album_id").join(songs, "album_id").join(size, "album_id")
    left, right = owned.withColumnsRenamed({"album_id": "a", "songs": "na"}), owned.withColumnsRenamed({"album_id": "b", "songs": "nb"})
    pairs = left.join(right, [*GROUP, "song"]).where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    best = pairs.groupBy(F.col("a").alias("album_id")).agg(F.max(F.col("shared") / F.least("na", "nb")).alias("best"))
    members = own.join(counts, "album_id", "left").join(size, "album_id", "left").join(best, "album_id", "left").fillna(0, ["plays", "songs", "best"])
    flags = members.groupBy(*GROUP).agg(F.min("best").alias("least"), F.max(F.col("title").rlike(COMPILATION)).alias("named"), F.min("songs").alias("songs"))
    few = F.col("least") < LEAST_OVERLAP
    return _target(members, "album_id").join(flags, GROUP).select(
        *GROUP, "target_id", "versions", "plays", F.round("least", 2).alias("overlap"), (~few).alias("same_tracks"), (few & (F.col("versions") > MAX_SAFE)).alias("many"),
        (few & F.col("named")).alias("compilation"), ((F.col("least") == 0) & (F.col("songs") >= 3)).alias("nothing_shared"))


def edition_rules(groups: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """(from_id, to_id) of the groups: every other version goes to the target."""
    rows = with_keys(items).join(groups.select(*GROUP, "target_id"), GROUP).where(F.col(item) != F.col("target_id"))
    return rows.select(F.col(item).alias("from_id"), F.col("target_id").alias("to_id"))


def merge_items(plays: DataFrame, rules: DataFrame, item: str) -> DataFrame:
    """plays with track or album rules applied and identities made unique again; nothing is updated in place."""
    mapped = left_by(plays, rules, item, "from_id").withColumn(item, F.coalesce("to_id", item))
    return ingest(mapped.select("ts", "artist_id", "track_id", "album_id"))


def merged_facts(facts: DataFrame, rules: DataFrame, item: str) -> DataFrame:
    """facts by id after a merge: a target keeps its own row, else it takes that of its smallest version that has one."""
    rows = facts.join(rules, F.col(item) == F.col("from_id"), "left").withColumn("at", F.coalesce("to_id", item))
    first = F.row_number().over(Window.partitionBy("at").orderBy(F.col("to_id").isNotNull(), item))
    return rows.withColumn("r", first).where("r = 1").drop(item, "from_id", "to_id", "r").withColumnRenamed("at", item)
