"""Work lists and coverage of what was looked up about artists and albums, and views that need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.operators.periods import in_range

KEPT_DAYS = 120
ALBUM_PLAYS = 3


def _due(status: str, fetched: str, span: DataFrame, rows: DataFrame, days: int) -> DataFrame:
    """The rows whose lookup is missing, failed, or older than so many days before the newest play."""
    old = F.col(fetched) < F.col("hi") - days * 86400
    return rows.crossJoin(F.broadcast(span.select("hi"))).where(F.col(fetched).isNull() | (F.col(status) == "error") | old)


def pending_artists(stats: DataFrame, info: DataFrame, span: DataFrame, days: int = KEPT_DAYS) -> DataFrame:
    """(artist_id, plays) of artists to look up, most played first."""
    rows = stats.select("artist_id", "plays").join(info, "artist_id", "left")
    return _due("status", "fetched_at", span, rows, days).select("artist_id", "plays").orderBy(F.desc("plays"), "artist_id")


def album_plays(plays: DataFrame) -> DataFrame:
    return plays.where("album_id is not null").groupBy("album_id").agg(F.count("*").alias("plays"))


def pending_albums(plays: DataFrame, info: DataFrame, span: DataFrame, least: int = ALBUM_PLAYS, days: int = KEPT_DAYS) -> DataFrame:
    """(album_id, plays) of albums of some plays to look up, most played first."""
    rows = album_plays(plays).where(F.col("plays") >= least).join(info, "album_id", "left")
    return _due("status", "fetched_at", span, rows, days).select("album_id", "plays").orderBy(F.desc("plays"), "album_id")


def pending_releases(plays: DataFrame, info: DataFrame, span: DataFrame, days: int = KEPT_DAYS) -> DataFrame:
    """(album_id, plays) of albums found whose release is still to be looked up, most played first."""
    rows = info.where("status = 'ok'").join(album_plays(plays), "album_id", "left")
    return _due("mb_status", "mb_fetched_at", span, rows, days).select("album_id", "plays").orderBy(F.desc("plays"), "album_id")


def enrich_status(plays: DataFrame, stats: DataFrame, tags: DataFrame, artists: DataFrame, albums: DataFrame, least: int = ALBUM_PLAYS) -> DataFrame:
    """One row: how many artists, albums and plays the lookups cover."""
    done = F.count_if(F.col("status").isin("ok", "not_found"))
    tagged = tags.select("artist_id").distinct()
    parts = [
        stats.agg(F.count("*").alias("artists"), F.sum("plays").alias("plays")),
        artists.agg(done.alias("artists_done"), F.max("fetched_at").alias("last_fetch")),
        tagged.agg(F.count("*").alias("artists_tagged")),
        stats.join(tagged, "artist_id", "left_semi").agg(F.coalesce(F.sum("plays"), F.lit(0)).alias("plays_covered")),
        album_plays(plays).agg(F.count_if(F.col("plays") >= least).alias("albums_eligible")),
        albums.agg(done.alias("albums_done"), F.count("release_date").alias("albums_dated"), F.count_if("has_cover").alias("albums_with_cover")),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.crossJoin(part)
    return out


def place_shares(tags: DataFrame, info: DataFrame) -> DataFrame:
    """(artist_id, tag, share) of places; artists that were looked up and have none are elsewhere, a null tag of share one."""
    total = tags.groupBy("artist_id").agg(F.sum("weight").alias("total"))
    some = tags.join(total, "artist_id").select("artist_id", "tag", (F.col("weight") / F.col("total")).alias("share"))
    none = info.where("status in ('ok', 'not_found')").join(total, "artist_id", "left_anti")
    return some.unionByName(none.select("artist_id", F.lit(None).cast("string").alias("tag"), F.lit(1.0).alias("share")))


def two_digits(number: Column) -> Column:
    """A whole number rounded to its first two digits, halves to the even one."""
    unit = F.pow(F.lit(10.0), F.greatest(F.length(number.cast("string")) - 2, F.lit(0)))
    return (F.rint(number / unit) * unit).cast("long")


def obscure(plays: DataFrame, info: DataFrame, names: DataFrame, start: str, end: str, low: int = 100, high: int = 20_000, least: int = 3) -> DataFrame:
    """The artist of a range with the fewest listeners in the world, about."""
    known = info.where((F.col("status") == "ok") & F.col("listeners").between(low, high)).select("artist_id", "listeners")
    own = in_range(plays, start, end).groupBy("artist_id").agg(F.count("*").alias("plays")).where(F.col("plays") >= least)
    first = own.join(known, "artist_id").join(names, "artist_id").orderBy("listeners", "name", "artist_id").limit(1)
    return first.select("artist_id", two_digits(F.col("listeners")).alias("listeners"), "plays")


def rolling(plays: DataFrame, span: DataFrame, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """(days, plays, artists, tracks) of the last days before the newest play; a play counts in each window that it lies in."""
    widest = plays.crossJoin(F.broadcast(span.select("hi"))).where(F.col("ts") > F.col("hi") - max(days) * 86400)
    each = widest.withColumn("days", F.explode(F.array(*[F.lit(d) for d in days]))).where(F.col("ts") > F.col("hi") - F.col("days") * 86400)
    tracks = each.groupBy("days", "artist_id", "track_id").agg(F.count("*").alias("n"))
    artists = tracks.groupBy("days", "artist_id").agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    return artists.groupBy("days").agg(F.sum("n").alias("plays"), F.count("*").alias("artists"), F.sum("t").alias("tracks"))


def snapshot_changes(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(state, rows): what a new snapshot adds to, removes from and keeps of the old one."""
    a, b = old.select(*keys).distinct().withColumn("was", F.lit(True)), new.select(*keys).distinct().withColumn("is", F.lit(True))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept")
    return a.join(b, list(keys), "full").groupBy(state.alias("state")).agg(F.count("*").alias("rows"))
