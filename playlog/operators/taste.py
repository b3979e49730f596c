"""Current taste: recent listening against all listening, by genre and artist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.operators.cohorts import dated_plays, decade_of

SMOOTH, RISING, FADING = 0.005, 1.5, 0.5
MIN_SHARE, MIN_TOP_SHARE, MIN_COVERAGE, MIN_TREND_PLAYS = 0.02, 0.005, 0.5, 10


def weights(plays: DataFrame, span: DataFrame, half_life: int = 90) -> DataFrame:
    """Per artist: its plays (ever), and the same halved for every half_life days of age (now)."""
    age = F.floor((F.col("hi") - F.col("ts")) / 86400)
    by = plays.crossJoin(F.broadcast(span.select("hi"))).groupBy("artist_id", age.alias("age")).agg(F.count("*").alias("n"))
    return by.groupBy("artist_id").agg(F.sum(F.col("n") * F.pow(F.lit(0.5), F.col("age") / half_life)).alias("now"), F.sum("n").alias("ever"))


def genre_trends(weighted: DataFrame, shares: DataFrame) -> DataFrame:
    """Per genre: its share of recent listening (shown), among artists with genres now and ever, their smoothed ratio, and weights."""
    cells = weighted.join(shares, "artist_id").groupBy("tag").agg(F.sum(F.col("now") * F.col("share")).alias("n"), F.sum(F.col("ever") * F.col("share")).alias("e"))
    total = weighted.agg(F.sum("now").alias("total"))
    covered = cells.agg(F.sum("n").alias("cn"), F.sum("e").alias("ce"))
    rows = cells.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(covered))
    now, ever = F.col("n") / F.col("cn"), F.col("e") / F.col("ce")
    return rows.select("tag", F.round(F.col("n") / F.col("total"), 6).alias("shown"), F.round(now, 6).alias("now"), F.round(ever, 6).alias("ever"), F.round((now + SMOOTH) / (ever + SMOOTH), 6).alias("ratio"), F.round("n", 6).alias("weight"), F.round("e", 6).alias("plays"), F.round(F.col("cn") / F.col("total"), 6).alias("coverage"))


def now(trends: DataFrame) -> DataFrame:
    return trends.where(F.col("shown") >= MIN_TOP_SHARE).orderBy(F.desc("shown"), "tag").limit(15).select("tag", "shown")


def rising(trends: DataFrame, ratio: float = RISING) -> DataFrame:
    some = trends.where((F.col("coverage") >= MIN_COVERAGE) & (F.col("shown") >= MIN_SHARE) & (F.col("weight") >= MIN_TREND_PLAYS) & (F.col("ratio") >= ratio))
    return some.orderBy(F.desc("ratio"), "tag").limit(6).select("tag", "ratio")


def core(trends: DataFrame) -> DataFrame:
    return trends.orderBy(F.desc("ever"), "tag").limit(8).select("tag", "ever")


def fading(trends: DataFrame, ratio: float = FADING) -> DataFrame:
    some = trends.where((F.col("coverage") >= MIN_COVERAGE) & (F.col("ever") >= MIN_SHARE) & (F.col("plays") >= MIN_TREND_PLAYS) & (F.col("ratio") <= ratio))
    return some.orderBy("ratio", "tag").limit(5).select("tag", "ratio")


def discoveries(stats: DataFrame, span: DataFrame, days: int = 180, least: int = 5) -> DataFrame:
    """The most played artists first heard in the last days."""
    new = stats.crossJoin(F.broadcast(span)).where((F.col("first_ts") > F.col("hi") - days * 86400) & (F.col("prehistory") == 0) & (F.col("plays") >= least))
    return new.orderBy(F.desc("plays"), "artist_id").limit(8).select("artist_id", "plays")


def staples(weighted: DataFrame) -> DataFrame:
    return weighted.orderBy(F.desc("ever"), "artist_id").limit(8).select("artist_id", F.col("ever").alias("plays"))


def seeds(weighted: DataFrame, limit: int = 150) -> DataFrame:
    """The most played artists now with their part of all recent listening."""
    rows = weighted.select("artist_id", F.round("now", 6).alias("now"))
    total = weighted.agg(F.sum("now").alias("total"))
    return rows.orderBy(F.desc("now"), "artist_id").limit(limit).crossJoin(F.broadcast(total)).select("artist_id", F.round(F.col("now") / F.col("total"), 6).alias("weight"))


def gap_decades(plays: DataFrame, albums: DataFrame, loved: DataFrame, least: int = 10, share: float = 0.02, prior: float = 5) -> DataFrame:
    """Per release decade its share of loved tracks against its share of plays; nothing under least dated loved tracks.

    A loved track is dated by its most played dated album, of equals the earlier release, then the lower id.
    """
    dated = dated_plays(plays, albums)
    known = albums.select("album_id", F.substring("release_date", 1, 4).cast("int").alias("release_year")).where("release_year between 1900 and 2100")
    by = plays.where("album_id is not null").join(loved.select("track_id").distinct(), "track_id", "left_semi").groupBy("track_id", "album_id").agg(F.count("*").alias("n")).join(known, "album_id")
    best = by.withColumn("r", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("n"), "release_year", "album_id"))).where("r = 1")
    a = best.groupBy(decade_of("release_year").alias("decade")).agg(F.count("*").alias("loved"))
    b = dated.groupBy(decade_of("release_year").alias("decade")).agg(F.sum("n").alias("plays"))
    rows = b.join(a, "decade", "full").select("decade", F.coalesce("loved", F.lit(0)).alias("loved"), F.coalesce("plays", F.lit(0)).alias("plays"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("loved").alias("tl"), F.sum("plays").alias("tp")))).where((F.col("tl") >= least) & (F.col("tp") > 0))
    e = F.col("tl") * F.col("plays") / F.col("tp")
    kept = rows.where((F.round(F.col("loved") / F.col("tl"), 9) >= share) | (F.round(F.col("plays") / F.col("tp"), 9) >= share))
    return kept.select("decade", "loved", F.round(e, 6).alias("expected"), F.round((F.col("loved") + prior) / (e + prior), 6).alias("ratio"))


def sparse_cosine(shares: DataFrame, artist_id: int) -> DataFrame:
    """(artist_id, cosine) of one artist's genre vector with every other that shares a genre."""
    one = shares.where(F.col("artist_id") == artist_id).select("tag", F.col("share").alias("w"))
    norms = shares.groupBy("artist_id").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    own = one.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own"))
    dot = shares.where(F.col("artist_id") != artist_id).join(F.broadcast(one), "tag").groupBy("artist_id").agg(F.sum(F.col("share") * F.col("w")).alias("dot"))
    return dot.join(norms, "artist_id").crossJoin(F.broadcast(own)).select("artist_id", F.round(F.try_divide(F.col("dot"), F.col("norm") * F.col("own")), 6).alias("cosine"))


def overlap(tracks: DataFrame) -> DataFrame:
    """(a, b, shared, overlap) of the albums of one artist: common tracks over those of the smaller, of tracks(artist_id, album_id, track_id).

    The pairs of an artist's albums are bounded by its albums, not by plays.
    """
    own = tracks.distinct()
    size = own.groupBy("album_id").agg(F.count("*").alias("n"))
    pairs = own.select("artist_id", "track_id", F.col("album_id").alias("a")).join(own.select("artist_id", "track_id", F.col("album_id").alias("b")), ["artist_id", "track_id"]).where("a < b")
    by = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    return by.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", "shared", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap"))
