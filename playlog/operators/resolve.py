"""Entity resolution as rule tables: duplicates are found by keys, merges are rules applied to the plays."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from playlog.functions.text import held, keyed, loose_key
from playlog.functions.titles import loose_title
from playlog.model import ingest
from playlog.store import saved


def loose_dups(names: DataFrame) -> DataFrame:
    """(key, artists) of names(artist_id, name) that share a non-empty loose key."""
    rows = keyed(names, "name", loose_key).where("key <> ''")
    return rows.groupBy("key").agg(F.count("*").alias("artists"), F.min("artist_id").alias("first_id")).where("artists > 1")


def resolved_rules(rules: DataFrame) -> DataFrame:
    """rules(from_id, to_id) followed to their ends; a chain of merges doubles its reach each round.

    As many rounds as it takes: a chain is no longer than the rules are many. Rules that go round in a circle have no end
    and raise a ValueError.
    """
    from_count, rounds = rules.count(), 0
    while True:
        step = rules.toDF("via", "end")
        moved = rules.join(step, F.col("to_id") == F.col("via"), "left").select("from_id", F.coalesce("end", "to_id").alias("to_id"))
        if not moved.where("from_id = to_id").isEmpty() or 1 << rounds > 2 * from_count + 1:
            raise ValueError("the merge rules go round in a circle")
        if moved.exceptAll(rules).isEmpty():
            return rules
        rules, rounds = saved(moved), rounds + 1


def merge_artists(plays: DataFrame, rules: DataFrame) -> DataFrame:
    """plays with the rules applied and identities made unique again; nothing is updated in place."""
    mapped = plays.join(rules, plays["artist_id"] == F.col("from_id"), "left").select("ts", F.coalesce("to_id", "artist_id").alias("artist_id"), "track_id", "album_id")
    return ingest(mapped)


def merge_preview(plays: DataFrame, rules: DataFrame) -> DataFrame:
    """Plays that the rules move, and how many of all plays collide and go."""
    moved = plays.join(rules, F.col("artist_id") == F.col("from_id"), "left_semi").agg(F.count("*").alias("moved"))
    before, after = plays.agg(F.count("*").alias("b")), merge_artists(plays, rules).agg(F.count("*").alias("a"))
    return moved.crossJoin(before).crossJoin(after).select("moved", (F.col("b") - F.col("a")).alias("duplicates"))


def check_library(candidates: DataFrame, artists: DataFrame, stats: DataFrame) -> DataFrame:
    """Which candidate names are known, by folded name, with plays and first and last play of the best match."""
    known = artists.join(stats, "artist_id").groupBy(F.lower("name").alias("k")).agg(F.max(F.struct("plays", "artist_id", "first_ts", "last_ts")).alias("m"))
    rows = candidates.join(known, F.lower("candidate") == F.col("k"), "left")
    return rows.select("candidate", F.col("m").isNotNull().alias("known"), F.col("m.plays").alias("plays"), F.col("m.first_ts").alias("first_ts"), F.col("m.last_ts").alias("last_ts"))


def loved_resolve(entries: DataFrame, artists: DataFrame, tracks: DataFrame, artist_aliases: DataFrame, title_rules: DataFrame, track_aliases: DataFrame) -> DataFrame:
    """entries(artist_key, title_key, loved_at) with the artist and track that they mean, null where nothing does.

    A rule for the entry goes first, then the artist's track of that title, then a title merged into another track.
    The artist is found by another name of theirs before their own. Keys of artists, tracks, aliases and rules are unique; of
    rows that share one the smallest id counts.
    """
    one = lambda rows, key, value, name: rows.groupBy(*key).agg(F.min(value).alias(name))
    entry = ["artist_key", "title_key"]
    ruled = one(title_rules, entry, "track_id", "ruled").join(tracks.select(F.col("track_id").alias("ruled"), F.col("artist_id").alias("ruled_artist")), "ruled")
    names = one(artists, ["name_key"], "artist_id", "own").join(one(artist_aliases, ["name_key"], "artist_id", "alias"), "name_key", "full")
    found = names.select(F.col("name_key").alias("artist_key"), F.coalesce("alias", "own").alias("found_artist"))
    titles = lambda rows, name: one(rows, ["artist_id", "title_key"], "track_id", name).withColumnRenamed("artist_id", "found_artist")
    rows = entries.join(ruled, entry, "left").join(found, "artist_key", "left")
    rows = rows.join(titles(tracks, "named"), ["found_artist", "title_key"], "left").join(titles(track_aliases, "merged"), ["found_artist", "title_key"], "left")
    return rows.select(*entry, "loved_at", F.coalesce("ruled_artist", "found_artist").alias("artist_id"), F.coalesce("ruled", "named", "merged").alias("track_id"))


def unmatched_loved(resolved: DataFrame) -> DataFrame:
    """Loved entries without a track, and why."""
    reason = F.when(F.col("artist_id").isNull(), "artist unknown").otherwise("title unknown")
    return resolved.where("track_id is null").select("artist_key", "title_key", "loved_at", "artist_id", reason.alias("reason"))


def duplicate_candidates(names: DataFrame, stats: DataFrame, corrected: DataFrame, dismissed: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """Groups of names(artist_id, name) that share a loose key or a corrected name(artist_id, corrected), most played first.

    group_id is the smallest artist_id. The target is the most played artist whose own name is its corrected name, else the most
    played. Groups are components over distinct keys, so an artist with many namesakes is one row there. dismissed has name
    keys, sorted and joined by line ends, as in group_key.
    """
    keys = keyed(names, "name", loose_key).withColumnRenamed("key", "loose")
    keys = keyed(keys, "name").withColumnRenamed("key", "name_key")
    fixed = keyed(corrected.where("corrected is not null"), "corrected").select("artist_id", F.col("key").alias("fixed"))
    rows = saved(keys.join(fixed, "artist_id", "left").join(stats.select("artist_id", "plays"), "artist_id", "left").fillna(0, ["plays"]))
    nodes = rows.select("artist_id", "name_key", "plays", F.nullif("loose", F.lit("")).alias("a"), F.nullif("fixed", F.lit("")).alias("b"), (F.col("fixed") == F.col("name_key")).alias("own"))
    nodes = nodes.withColumns({"a": F.concat(F.lit("l:"), "a"), "b": F.concat(F.lit("f:"), "b")})
    edges = saved(nodes.where("a is not null and b is not null").select("a", "b").distinct())
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    every = nodes.select(F.explode(F.array("a", "b")).alias("key")).where("key is not null").distinct()
    labels = saved(every.select("key", F.col("key").alias("label")))
    while True:  # the smallest key wanders along the edges, and then to where its own label points
        near = ends.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("label").alias("n"))
        step = labels.join(near, F.col("key") == F.col("a"), "left").select("key", "label", F.least("label", "n").alias("next"))
        jump = step.join(labels.toDF("via", "end"), F.col("next") == F.col("via"), "left")
        moved = saved(jump.select("key", F.col("label").alias("was"), F.least("next", "end").alias("label")))
        labels = moved.select("key", "label")
        if moved.where("was <> label").isEmpty():
            break
    grouped = nodes.join(labels, F.coalesce("a", "b") == F.col("key"))
    best = F.min(F.struct((~F.coalesce("own", F.lit(False))).alias("other"), (-F.col("plays")).alias("less"), F.col("artist_id").alias("id")))
    out = grouped.groupBy("label").agg(F.min("artist_id").alias("group_id"), F.count("*").alias("artists"), F.sum("plays").alias("plays"), best.alias("best")).where("artists > 1")
    if dismissed is not None:
        spelled = grouped.select("label", "name_key").distinct().groupBy("label").agg(F.array_join(F.sort_array(F.collect_set("name_key")), "\n").alias("group_key"))
        out = out.join(spelled, "label").join(dismissed, "group_key", "left_anti")
    return out.select("group_id", "artists", F.col("best.id").alias("target_id"), "plays").orderBy(F.desc("plays"), "group_id").limit(limit)


@held
@F.pandas_udf(DoubleType())
def block_ratio(wanted: pd.Series, have: pd.Series) -> pd.Series:
    """Letters in matching blocks of two texts, as a part of all letters."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(wanted, have, strict=True)], dtype="float64")


def likeness(wanted: Column | str, have: Column | str) -> Column:
    """2 for equal loose titles, 0 for those that differ in digits alone, else the ratio of their matching blocks. Only the last leaves the JVM."""
    wanted, have = (F.col(x) if isinstance(x, str) else x for x in (wanted, have))
    letters = lambda x: F.regexp_replace(x, r"(?U)\d", "")
    other = (wanted != have) & (letters(wanted) != letters(have))
    ratio = block_ratio(F.when(other, wanted).otherwise(""), F.when(other, have).otherwise(""))
    return F.when(wanted == have, 2.0).when(other, ratio).otherwise(0.0)


def title_suggestions(unmatched: DataFrame, tracks: DataFrame, plays: DataFrame, least: float = 0.8, top: int = 3) -> DataFrame:
    """Up to top tracks of the artist for each entry(artist_key, title_key, artist_id) whose title is unknown, with their rank.

    The same loose title first, then the most alike, then more plays, then the smaller id. Each distinct pair of titles is compared once.
    """
    wanted = keyed(unmatched.where("artist_id is not null").select("artist_key", "title_key", "artist_id").distinct(), "title_key", loose_title).withColumnRenamed("key", "wanted")
    have = keyed(tracks, "title", loose_title).withColumnRenamed("key", "have")
    pairs = wanted.where("wanted <> ''").join(have.where("have <> ''").select("artist_id", "track_id", "have"), "artist_id")
    alike = pairs.select("wanted", "have").distinct().withColumn("score", likeness("wanted", "have")).where(F.col("score") >= least)
    counts = plays.groupBy("track_id").agg(F.count("*").alias("plays"))
    rows = pairs.join(alike, ["wanted", "have"]).join(counts, "track_id", "left").fillna(0, ["plays"])
    rank = F.row_number().over(Window.partitionBy("artist_key", "title_key").orderBy(F.desc("score"), F.desc("plays"), "track_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("artist_key", "title_key", "rank", "track_id", "plays")
