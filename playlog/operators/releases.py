"""Upcoming releases: whose they are, and how much those artists are listened to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.operators.library import release_friday


def release_match(releases: DataFrame, names: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """(release_id, artist_id) of releases(release_id, credit_key, ids array, part_keys array): the library's artists that a credit means.

    By an id first; else by the whole name, where another name of an artist goes before an artist's own; else by the names of the
    parts. A credit with ids does not mean an artist whose own id is known, as that is another of the same name.
    names and aliases are (name_key, artist_id), ids is (mbid, artist_id); of rows that share a key the smallest artist counts.
    """
    one = lambda rows, key: rows.groupBy(key).agg(F.min("artist_id").alias("artist_id"))
    known = one(ids.where("mbid <> ''"), "mbid")
    by_id = releases.select("release_id", F.explode("ids").alias("mbid")).join(known, "mbid").select("release_id", "artist_id").distinct()
    called = one(names, "name_key").withColumnRenamed("artist_id", "own").join(one(aliases, "name_key").withColumnRenamed("artist_id", "alias"), "name_key", "full")
    called = called.select("name_key", F.coalesce("alias", "own").alias("artist_id"))
    rest = releases.select("release_id", "credit_key", "ids", "part_keys").join(by_id, "release_id", "left_anti").withColumn("given", F.coalesce(F.size("ids"), F.lit(0)) > 0)
    whole = rest.join(called, F.col("credit_key") == F.col("name_key")).select("release_id", "given", "artist_id")
    parts = rest.join(whole.select("release_id"), "release_id", "left_anti").select("release_id", "given", F.explode("part_keys").alias("name_key")).join(called, "name_key")
    found = whole.unionByName(parts.select("release_id", "given", "artist_id"))
    namesakes = known.select("artist_id").distinct().withColumn("has_id", F.lit(True))
    allowed = found.join(namesakes, "artist_id", "left").where(~F.col("given") | F.col("has_id").isNull())
    return by_id.unionByName(allowed.select("release_id", "artist_id").distinct())


def artist_facts(plays: DataFrame, stats: DataFrame, loved: DataFrame, span: DataFrame, least: int = 3, days: int = 365) -> DataFrame:
    """(artist_id, plays, recent_plays, loved, fit) of artists of some plays.

    fit grows with the logarithms of all plays and, weighted more, of those of the last days, and with up to six loved tracks.
    """
    recent = plays.crossJoin(F.broadcast(span.select("hi"))).where(F.col("ts") > F.col("hi") - days * 86400).groupBy("artist_id").agg(F.count("*").alias("recent_plays"))
    hearts = loved.groupBy("artist_id").agg(F.countDistinct("track_id").alias("loved"))
    rows = stats.where(F.col("plays") >= least).select("artist_id", "plays").join(recent, "artist_id", "left").join(hearts, "artist_id", "left").fillna(0, ["recent_plays", "loved"])
    fit = F.log1p("plays") + 1.5 * F.log1p("recent_plays") + 0.5 * F.least("loved", F.lit(6))
    return rows.withColumn("fit", F.round(fit, 6))


def release_fit(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """(release_id, artist_id, fit): the best fitting artist of each matched release."""
    best = F.max(F.struct("fit", (-F.col("artist_id")).alias("less")))
    return matches.join(facts, "artist_id").groupBy("release_id").agg(best.alias("b")).select("release_id", (-F.col("b.less")).alias("artist_id"), "b.fit")


KINDS = ["Album", "EP", "Single"]


def release_merge(releases: DataFrame, matches: DataFrame) -> DataFrame:
    """(release_id, into_id) of the wikipedia rows of releases(release_id, source, credit_key, title_key, kind, day): the listenbrainz release that each tells of.

    One of the same credit and title, else of the same artists (of the credit, where none are known) and title; an album before
    an EP, then the earlier, and never a single. A credit of which only a single has the title ends the search. Null: it stands alone.
    """
    # a credit has few artists, so the list of one release is short
    whose = matches.groupBy("release_id").agg(F.array_join(F.sort_array(F.collect_set("artist_id")).cast("array<string>"), " ").alias("artists"))
    rows = releases.join(whose, "release_id", "left").withColumn("who", F.coalesce(F.concat(F.lit("ids "), "artists"), F.concat(F.lit("name "), "credit_key")))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = F.min(F.when(F.col("kind") != "Single", F.struct(place.alias("p"), "day", F.col("release_id").alias("id"))))
    listed, told = rows.where("source = 'listenbrainz'"), rows.where("source = 'wikipedia'")
    by_credit = listed.groupBy("credit_key", "title_key").agg(best.alias("c"), F.lit(True).alias("credited"))
    by_artist = listed.groupBy("who", "title_key").agg(best.alias("a"))
    found = told.join(by_credit, ["credit_key", "title_key"], "left").join(by_artist, ["who", "title_key"], "left")
    return found.select("release_id", F.when(F.col("credited"), F.col("c.id")).otherwise(F.col("a.id")).alias("into_id"))


def upcoming_lists(releases: DataFrame, merges: DataFrame, matches: DataFrame, facts: DataFrame, start: Column, end: Column) -> DataFrame:
    """(friday, list, release_id, fit) of the releases from start to end, merged ones left out.

    mine: an artist of theirs has facts, with the best fit; also: told of by wikipedia; more: other albums and EPs. Other singles are in none.
    """
    folded = merges.where("into_id is not null")
    told = folded.select(F.col("into_id").alias("release_id")).distinct().withColumn("told", F.lit(True))
    rows = releases.where(F.col("day").between(start, end)).join(folded.select("release_id"), "release_id", "left_anti")
    rows = rows.join(told, "release_id", "left").join(release_fit(matches, facts).select("release_id", "fit"), "release_id", "left")
    also = F.col("told") | (F.col("source") == "wikipedia")
    kind = F.when(F.col("fit").isNotNull(), "mine").when(also, "also").when(F.col("kind").isin("Album", "EP"), "more")
    return rows.select(release_friday(F.col("day")).alias("friday"), kind.alias("list"), "release_id", "fit").where("list is not null")


def upcoming_weeks(lists: DataFrame) -> DataFrame:
    """(friday, mine, also, more, best_id): the size of each list of a week, and the release that fits best."""
    size = lambda name: F.count_if(F.col("list") == name).alias(name)
    best = F.max(F.when(F.col("list") == "mine", F.struct("fit", (-F.col("release_id")).alias("less"))))
    return lists.groupBy("friday").agg(size("mine"), size("also"), size("more"), (-best["less"]).alias("best_id"))
