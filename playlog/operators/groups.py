"""Albums and the release groups of an encyclopedia: an exact title first, then the title without edition notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.functions.text import keyed
from playlog.functions.titles import clean_title, edition_free_title

LEAST_SCORE = 90
# How titles of compilations begin, after "the", "very" and "ultimate".
BEST_OF = ["best of", "greatest hits", "hits", "collection", "essential", "anthology"]


def _key(rows: DataFrame, column: str, name: str) -> DataFrame:
    return keyed(rows, column).withColumnRenamed("key", name)


def _is_best_of(title: Column) -> Column:
    begins = F.regexp_replace(F.lower(title), "^(the )?((very|ultimate) )?", "")
    return begins.rlike(rf"^({'|'.join(BEST_OF)})\b")


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("album_id").orderBy(*order, F.desc("score"), "group_id"))
    return rows.withColumn("r", rank).where("r = 1").select("album_id", "group_id")


def matched(albums: DataFrame, groups: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """(album_id, group_id, outcome) of albums(album_id, artist, title): the release group that each is, or none.

    groups is (group_id, title, credit, kind, others, score), others being its secondary types.  A group needs a score of least, the title, and a
    credit that has the artist in it.  An album without one is tried again by its title without edition notes: one that ended in EP or Single needs that
    type; any other needs an album or an EP, albums first, whose secondary types are named in the title (a compilation may begin like one instead).
    Outcome is exact, edition-free or none.  A null title or artist matches nothing.
    """
    wanted = _key(_key(albums, "artist", "artist_key"), "title", "title_key").where("title is not null and artist_key <> ''")
    known = _key(_key(groups.where(F.col("score") >= least).withColumnRenamed("title", "group_title"), "credit", "credit_key"), "group_title", "group_key")
    known = known.select("group_id", "credit_key", "group_key", "kind", "others", "score")
    theirs = F.col("credit_key").contains(F.col("artist_key"))
    exact = _first(wanted.join(known, F.col("title_key") == F.col("group_key")).where(theirs)).withColumn("outcome", F.lit("exact"))
    left = wanted.join(exact.select("album_id"), "album_id", "left_anti")
    plain = keyed(left, "title", edition_free_title).withColumnRenamed("key", "plain").where("plain <> title")
    plain = keyed(_key(plain, "plain", "plain_key"), "title", clean_title).withColumn("wanted", F.col("key.kind")).drop("key")
    tried = plain.withColumn("try", F.explode(F.array_distinct(F.array("plain_key", "title_key")))).join(known, F.col("try") == F.col("group_key")).where(theirs)
    rows = tried.withColumn("unnamed", F.expr(r"filter(coalesce(others, array()), o -> not (title rlike concat('(?iu)(?<!\\w)\\Q', o, '\\E(?!\\w)')))"))
    rows = rows.withColumn("unnamed", F.when(_is_best_of(F.col("plain")), F.array_remove("unnamed", "Compilation")).otherwise(F.col("unnamed")))
    fits = F.when(F.col("wanted").isNotNull(), F.col("kind") == F.col("wanted")).otherwise(F.col("kind").isin("Album", "EP") & (F.size("unnamed") == 0))
    again = _first(rows.where(fits), F.col("wanted").isNull() & (F.col("kind") != "Album")).withColumn("outcome", F.lit("edition-free"))
    found = exact.unionByName(again)
    return albums.select("album_id").join(found, "album_id", "left").select("album_id", "group_id", F.coalesce("outcome", F.lit("none")).alias("outcome"))
