"""Releases by artists that are new to the library: how like its artists they are, and how well their genres fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.functions.text import keyed, tag_fold
from playlog.functions.titles import edition_free_title
from playlog.operators.library import release_friday
from playlog.operators.releases import KINDS
from playlog.store import saved

MIN_GENRE_FIT, SIMILARITY_WEIGHT, NEW_PER_WEEK, LIKE = 0.4, 0.5, 15, 3


def _folded(rows: DataFrame) -> DataFrame:
    """rows with fold, one key for all spellings of their tag."""
    return keyed(rows, "tag").withColumn("fold", tag_fold(F.col("key"))).drop("key")


def genre_vector(weighted: DataFrame, shares: DataFrame) -> DataFrame:
    """(fold, now, idf): the part of each genre in what is heard now, among artists with genres, and how rare it is among those artists.

    Spellings of one genre count together.  An artist counts once for a genre however it is spelled.
    """
    own = _folded(shares)
    heard = weighted.join(own, "artist_id").groupBy("fold").agg(F.sum(F.col("now") * F.col("share")).alias("n"))
    total = heard.agg(F.sum("n").alias("t"))
    artists = shares.agg(F.countDistinct("artist_id").alias("artists"))  # one row each
    rare = own.groupBy("fold").agg(F.countDistinct("artist_id").alias("df"))
    rows = rare.join(heard, "fold", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(artists))
    return rows.select("fold", F.coalesce(F.try_divide("n", "t"), F.lit(0.0)).alias("now"), F.log1p(F.col("artists") / F.col("df")).alias("idf"))


def likeness(candidates: DataFrame, seeds: DataFrame, similar: DataFrame) -> DataFrame:
    """(release_id, similarity, like) of candidates(release_id, name_key, part_keys, ids) that a seed(seed_key, weight) is like.

    similar is (seed_key, name_key, mbid, match).  A seed counts once a release, with its best match by name, part or id; like names the
    seeds that count most.
    """
    links = similar.join(seeds, "seed_key").select("seed_key", "name_key", "mbid", (F.col("weight") * F.col("match")).alias("value")).where("value > 0")
    by_key = links.select("seed_key", F.col("name_key").alias("key"), "value")
    by_id = links.where("mbid <> ''").select("seed_key", F.concat(F.lit("mbid:"), "mbid").alias("key"), "value")
    ids = F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda i: F.concat(F.lit("mbid:"), i))
    names = F.concat(F.array("name_key"), F.coalesce("part_keys", F.array().cast("array<string>")))
    asked = candidates.select("release_id", F.explode(F.array_distinct(F.concat(names, ids))).alias("key"))
    best = asked.join(by_key.unionByName(by_id), "key").groupBy("release_id", "seed_key").agg(F.max("value").alias("value"))
    order = F.row_number().over(Window.partitionBy("release_id").orderBy(F.desc(F.round("value", 12)), "seed_key"))
    ranked = best.withColumn("r", order)
    first = F.sort_array(F.collect_list(F.when(F.col("r") <= LIKE, F.struct("r", "seed_key"))))  # so many at most
    return ranked.groupBy("release_id").agg(F.sum("value").alias("similarity"), F.transform(first, lambda x: x.seed_key).alias("like"))


def genre_fit(candidates: DataFrame, tags: DataFrame, vector: DataFrame) -> DataFrame:
    """(release_id, genre_fit, genres): the cosine between the tags(name_key, tag, weight) of a release's artist and the genre_vector.

    A tag that no artist of the library has counts as the rarest.  Artists come from the tags that they share with the vector: no pairs are tried.
    """
    rarest = vector.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("rarest"))
    you = vector.select("fold", (F.col("now") * F.col("idf")).alias("you"))
    norm = you.agg(F.sqrt(F.sum(F.col("you") * F.col("you"))).alias("mine"))
    theirs = _folded(tags.join(candidates.select("name_key").distinct(), "name_key", "left_semi"))
    theirs = theirs.join(vector.select("fold", "idf"), "fold", "left").crossJoin(F.broadcast(rarest)).withColumn("w", F.col("weight") * F.coalesce("idf", "rarest"))
    theirs = theirs.groupBy("name_key", "fold").agg(F.max("w").alias("w"), F.min("tag").alias("tag"))
    met = theirs.join(you.where("you > 0"), "fold", "left").withColumn("both", F.col("w") * F.col("you"))
    rank = F.row_number().over(Window.partitionBy("name_key").orderBy(F.desc_nulls_last(F.round("both", 12)), "fold"))
    shared = F.sort_array(F.collect_list(F.when((F.col("r") <= LIKE) & F.col("both").isNotNull(), F.struct("r", "tag"))))
    by = met.withColumn("r", rank).groupBy("name_key").agg(F.sum("both").alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), shared.alias("s"))
    found = by.where("dot is not null").crossJoin(F.broadcast(norm))
    fit = F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("mine")), F.lit(0.0))
    return candidates.select("release_id", "name_key").join(found.select("name_key", fit.alias("genre_fit"), F.transform("s", lambda x: x.tag).alias("genres")), "name_key").drop("name_key")


def new_to_you(candidates: DataFrame, seeds: DataFrame, similar: DataFrame, tags: DataFrame, vector: DataFrame) -> DataFrame:
    """candidates with similarity, genre_fit, score, like and genres: those like an artist heard now, or whose genres fit well enough.

    similarity is scaled so that the best release has 1; the score is half of each.
    """
    candidates, vector = saved(candidates), saved(vector)  # each is read several times
    near = candidates.join(likeness(candidates, seeds, similar), "release_id", "left").join(genre_fit(candidates, tags, vector), "release_id", "left")
    near = near.withColumns({"similarity": F.coalesce("similarity", F.lit(0.0)), "genre_fit": F.coalesce("genre_fit", F.lit(0.0))})
    near = saved(near).where((F.col("similarity") > 0) | (F.round("genre_fit", 9) >= MIN_GENRE_FIT))
    top = near.agg(F.max("similarity").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("top"))
    part = F.col("similarity") / F.col("top")
    fit = F.round("genre_fit", 3)
    score = F.round(SIMILARITY_WEIGHT * part + (1 - SIMILARITY_WEIGHT) * fit, 4)
    rows = near.crossJoin(F.broadcast(top)).withColumns({"score": score, "genre_fit": fit, "similarity": F.round(part, 4)})
    return rows.drop("top")


def new_weeks(found: DataFrame, per_week: int = NEW_PER_WEEK) -> DataFrame:
    """(friday, place, release_id, score): the best of new_to_you() releases each week; an album goes before an EP of the same name.

    Equal scores go by day, artist and kind, then release_id.
    """
    found = found.select("release_id", "name_key", "title", "kind", "day", "score")
    titles = keyed(found, "title", edition_free_title).withColumnRenamed("key", "plain")
    titles = keyed(titles, "plain").withColumnRenamed("key", "title_key").withColumn("friday", release_friday(F.col("day")))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = [F.desc("score"), "day", "name_key", place, "release_id"]
    once = titles.withColumn("r", F.row_number().over(Window.partitionBy("friday", "name_key", "title_key").orderBy(*order))).where("r = 1")
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("friday").orderBy(*order))).where(F.col("place") <= per_week)
    return ranked.select("friday", "place", "release_id", "score")


def not_yours(releases: DataFrame, merges: DataFrame, matches: DataFrame, facts: DataFrame) -> DataFrame:
    """releases of artists without facts: albums and EPs, and whatever is told of by wikipedia; a merged row is not one of its own."""
    mine = matches.join(facts.select("artist_id"), "artist_id", "left_semi").select("release_id").distinct()
    folded = merges.where("into_id is not null")
    told = folded.select(F.col("into_id").alias("release_id")).distinct().withColumn("told", F.lit(True))
    rows = releases.join(folded.select("release_id"), "release_id", "left_anti").join(mine, "release_id", "left_anti").join(told, "release_id", "left")
    return rows.where(F.col("kind").isin("Album", "EP") | F.col("told") | (F.col("source") == "wikipedia")).drop("told")


def places(weighted: DataFrame, tags: DataFrame, names: dict[str, str], top: int = 4, least: float = 0.05) -> DataFrame:
    """(place, share) of what is heard now: an artist with a tag of a place counts whole for it, and once however many name it. names gives the place of a tag."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    own = keyed(tags.where("weight > 0"), "tag").select("artist_id", F.coalesce(known[F.col("key")], F.col("key")).alias("place")).distinct()
    total = weighted.agg(F.sum("now").alias("t"))
    by = weighted.join(own, "artist_id").groupBy("place").agg(F.sum("now").alias("n")).crossJoin(F.broadcast(total))
    return by.select("place", F.round(F.col("n") / F.col("t"), 6).alias("share")).where(F.col("share") >= least).orderBy(F.desc("share"), "place").limit(top)
