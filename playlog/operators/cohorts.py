"""Release cohorts: partial dates, decades, album age and discovery lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.operators.genres import drift


def release_mid(text: Column) -> Column:
    """Middle of a partial date: a year is 1 July, a month its 15th; other lengths give null."""
    n = F.length(text)
    return F.when(n == 4, F.concat(text, F.lit("-07-01"))).when(n == 7, F.concat(text, F.lit("-15"))).when(n == 10, text).try_cast("date")


def release_span(text: Column) -> tuple[Column, Column]:
    """First and last day that a partial date may mean."""
    n = F.length(text)
    lo = F.when(n == 4, F.concat(text, F.lit("-01-01"))).when(n == 7, F.concat(text, F.lit("-01"))).when(n == 10, text).try_cast("date")
    return lo, F.when(n == 4, F.concat(text, F.lit("-12-31")).try_cast("date")).when(n == 7, F.last_day(lo)).otherwise(lo)


def dated_plays(plays: DataFrame, albums: DataFrame) -> DataFrame:
    """Plays per album and listening day, with the album's release year."""
    known = albums.select("album_id", "release_date", F.substring("release_date", 1, 4).cast("int").alias("release_year")).where("release_year between 1900 and 2100")
    return plays.where("album_id is not null").groupBy("album_id", "artist_id", "lday").agg(F.count("*").alias("n")).join(known, "album_id")


def decade_of(year: str) -> Column:
    return (F.floor(F.col(year) / 10) * 10).cast("int")


def decade_overview(plays: DataFrame, albums: DataFrame) -> DataFrame:
    rows = dated_plays(plays, albums).withColumn("decade", (F.floor(F.col("release_year") / 10) * 10).cast("int"))
    by = rows.groupBy("decade").agg(F.sum("n").alias("plays"), F.countDistinct("album_id").alias("albums"))
    total = rows.agg(F.sum("n").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("decade", "plays", "albums", F.round(F.col("plays") / F.col("t"), 6).alias("share"))


def release_year_hist(plays: DataFrame, albums: DataFrame) -> DataFrame:
    by = dated_plays(plays, albums).groupBy("release_year").agg(F.sum("n").alias("n"))
    axis = by.agg(F.min("release_year").alias("a"), F.max("release_year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("release_year"))
    return axis.join(by, "release_year", "left").select("release_year", F.coalesce("n", F.lit(0)).alias("plays"))


def decade_drift(plays: DataFrame, albums: DataFrame, top: int = 5) -> DataFrame:
    """Per listening year the shares of the release decades that are biggest overall, and of all the others together (decade null)."""
    rows = dated_plays(plays, albums).groupBy(F.year("lday").alias("year"), decade_of("release_year").alias("key")).agg(F.sum("n").alias("o"))
    return drift(rows, top).withColumnRenamed("key", "decade")


def vogue(plays: DataFrame, albums: DataFrame, span: DataFrame) -> DataFrame:
    """Per decade, plays of the last 365 days against what its share before leads to expect."""
    newest = span.select(F.to_date(F.timestamp_seconds("hi")).alias("today"))
    rows = dated_plays(plays, albums).crossJoin(F.broadcast(newest)).withColumn("recent", F.datediff("today", "lday") < 365)
    by = rows.groupBy((F.floor(F.col("release_year") / 10) * 10).cast("int").alias("decade")).agg(F.sum(F.when(F.col("recent"), F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(F.col("recent"), 0).otherwise(F.col("n"))).alias("before"))
    total = by.agg(F.sum("o").alias("r_total"), F.sum("before").alias("b_total"))
    e = F.col("r_total") * F.col("before") / F.col("b_total")
    kept = by.crossJoin(F.broadcast(total)).withColumn("e", e).where((F.col("r_total") >= 50) & (F.round(F.col("e") + F.col("o"), 6) >= 10))
    return kept.select("decade", F.col("o").alias("plays"), F.round("e", 6).alias("expected"), F.round((F.col("o") + 20) / (F.col("e") + 20), 6).alias("lift"))


def album_age(plays: DataFrame, albums: DataFrame) -> DataFrame:
    """Per year, plays by age of the album when played."""
    age = F.greatest(F.lit(0), F.datediff("lday", release_mid(F.col("release_date"))))
    part = F.when(age < 365, 0).when(age < 1826, 1).when(age < 7305, 2).otherwise(3)
    by = dated_plays(plays, albums).groupBy(F.year("lday").alias("year"), part.alias("age")).agg(F.sum("n").alias("plays"))
    return by.withColumn("share", F.round(F.col("plays") / F.sum("plays").over(Window.partitionBy("year")), 6))


def album_age_median(plays: DataFrame, albums: DataFrame, least: int = 100) -> DataFrame:
    """Per year the weighted lower median age in days, from (age, count) rows and not from single plays."""
    age = F.greatest(F.lit(0), F.datediff("lday", release_mid(F.col("release_date"))))
    by = dated_plays(plays, albums).groupBy(F.year("lday").alias("year"), age.alias("age")).agg(F.sum("n").alias("n"))
    year = Window.partitionBy("year")
    rows = by.withColumns({"t": F.sum("n").over(year), "c": F.sum("n").over(year.orderBy("age"))})
    return rows.where((F.col("t") >= least) & (F.col("c") * 2 >= F.col("t"))).groupBy("year").agg(F.min("age").alias("median_days"))


def discovery_lag(plays: DataFrame, albums: DataFrame) -> DataFrame:
    """Albums by the time from release to first play, for those released since the log began."""
    lo, _ = release_span(F.col("release_date"))
    first = plays.where("album_id is not null").groupBy("album_id").agg(F.min("lday").alias("first"))
    start = plays.agg(F.min("lday").alias("start"))
    rows = first.join(albums.select("album_id", "release_date", lo.alias("lo"), release_mid(F.col("release_date")).alias("mid")), "album_id").crossJoin(F.broadcast(start)).where("lo >= start")
    lag = F.greatest(F.lit(0), F.datediff("first", "mid"))
    return rows.groupBy(F.when(lag < 365, 0).when(lag < 1095, 1).when(lag < 3652, 2).otherwise(3).alias("bucket")).agg(F.count("*").alias("albums"))


def song_age(plays: DataFrame, albums: DataFrame, start: str, end: str) -> DataFrame:
    """Mean age in years of the dated plays of a range."""
    rows = dated_plays(plays.where(F.col("lday").between(start, end)), albums)
    age = F.greatest(F.lit(0), F.year("lday") - F.col("release_year"))
    return rows.agg(F.sum("n").alias("dated"), F.round(F.sum(age * F.col("n")) / F.sum("n"), 6).alias("years"))


def lag_albums(plays: DataFrame, albums: DataFrame, stats: DataFrame, birth: int | None = None) -> DataFrame:
    """Per dated album: plays, first play, lag (days from release to it) and era.

    era is 'tracked' if released since the log began, null if its partial date straddles that day, else 'before_birth'
    or 'pre_tracking'. Releases more than a year after the newest play are errors and left out.
    """
    lo, hi = release_span(F.col("release_date"))
    bounds = plays.agg(F.min("lday").alias("start"), F.max("lday").alias("newest"))
    by = plays.where("album_id is not null").groupBy("album_id").agg(F.count("*").alias("plays"), F.min("lday").alias("first"))
    known = albums.select("album_id", "artist_id", "release_date", lo.alias("lo"), hi.alias("hi"), release_mid(F.col("release_date")).alias("mid"), F.substring("release_date", 1, 4).cast("int").alias("release_year"))
    rows = by.join(known.where("mid is not null"), "album_id").crossJoin(F.broadcast(bounds)).where(F.col("release_year").between(1900, F.least(F.lit(2100), F.year("newest") + 1)))
    old = F.when(F.lit(birth is not None) & (F.col("release_year") < (birth or 0)), "before_birth").otherwise("pre_tracking")
    era = F.when(F.col("lo") >= F.col("start"), "tracked").when(F.col("hi") >= F.col("start"), None).otherwise(old)
    rows = rows.withColumns({"era": era, "lag": F.greatest(F.lit(0), F.datediff("first", "mid"))})
    return rows.join(stats.select("artist_id", "prehistory"), "artist_id", "left").select("album_id", "artist_id", "release_date", "plays", "first", "lag", "era", F.coalesce("prehistory", F.lit(0)).alias("prehistory"))


def lag_eras(lags: DataFrame) -> DataFrame:
    """Albums, plays and share of plays per era; albums without one have their own row."""
    by = lags.groupBy("era").agg(F.count("*").alias("albums"), F.sum("plays").alias("plays"))
    total = by.where("era is not null").agg(F.sum("plays").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("era", "albums", "plays", F.when(F.col("era").isNotNull(), F.round(F.col("plays") / F.col("t"), 6)).alias("share"))


def lag_dug_up(lags: DataFrame) -> DataFrame:
    """Per year and era the older albums first played then, of artists not known before the log; years between are zero."""
    rows = lags.where("era <> 'tracked' and prehistory = 0").groupBy(F.year("first").alias("year"), "era").agg(F.count("*").alias("n"))
    years = rows.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    grid = years.crossJoin(rows.select("era").distinct())
    return grid.join(rows, ["year", "era"], "left").select("year", "era", F.coalesce("n", F.lit(0)).alias("albums"))


def lag_late(lags: DataFrame, least: int = 5, limit: int = 10) -> DataFrame:
    """The longest waits of tracked albums."""
    return lags.where((F.col("era") == "tracked") & (F.col("plays") >= least)).orderBy(F.desc("lag"), F.desc("plays"), "album_id").limit(limit).select("album_id", "plays", "lag")


def lag_on_release(lags: DataFrame, least: int = 5, days: int = 30, limit: int = 10) -> DataFrame:
    """The most played of the albums with a full date that were heard within days of it."""
    early = lags.where((F.col("era") == "tracked") & (F.col("plays") >= least) & (F.length("release_date") == 10) & (F.col("lag") <= days))
    return early.orderBy(F.desc("plays"), "album_id").limit(limit).select("album_id", "plays", "lag")


def median_upper(lags: DataFrame) -> DataFrame:
    """The upper median of the lags of tracked albums, from counts of equal lags."""
    by = lags.where("era = 'tracked'").groupBy("lag").agg(F.count("*").alias("n"))
    rows = by.withColumns({"c": F.sum("n").over(Window.orderBy("lag")), "t": F.sum("n").over(Window.partitionBy())})  # a row a day of lag
    return rows.where(F.col("c") > F.floor(F.col("t") / 2)).agg(F.min("lag").alias("median_days"), F.max("t").alias("albums"))


def shown_decades(dated: DataFrame, share: float = 0.02, most: int = 8) -> DataFrame:
    """(decade, n, covered): the biggest decades of at least a share of the dated plays."""
    by = dated.groupBy(decade_of("release_year").alias("decade")).agg(F.sum("n").alias("n"))
    rows = by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("covered")))).where(F.round(F.col("n") / F.col("covered"), 9) >= share)
    return rows.orderBy(F.desc("n"), "decade").limit(most)


def decade_matrix(plays: DataFrame, albums: DataFrame, prior: float = 20, least: float = 30) -> DataFrame:
    """Shown decade x listening year: plays, expected plays and lift, which is null where fewer than least are expected."""
    dated = dated_plays(plays, albums)
    by = dated.groupBy(F.year("lday").alias("year"), decade_of("release_year").alias("decade")).agg(F.sum("n").alias("o"))
    years = by.groupBy("year").agg(F.sum("o").alias("t"))
    grid = years.crossJoin(F.broadcast(shown_decades(dated))).join(by, ["year", "decade"], "left")
    o, e = F.coalesce("o", F.lit(0)), F.col("t") * F.col("n") / F.col("covered")
    return grid.select("year", "decade", o.alias("plays"), F.round(e, 6).alias("expected"), F.when(F.round(e, 6) >= least, F.round((o + prior) / (e + prior), 6)).alias("lift"))


def decade_observed(plays: DataFrame, albums: DataFrame, year: Column, bucket: Column) -> DataFrame:
    """(year, bucket, key, o): dated plays with the release decade as key."""
    known = albums.select("album_id", F.substring("release_date", 1, 4).cast("int").alias("release_year")).where("release_year between 1900 and 2100")
    by = plays.where("album_id is not null").groupBy("album_id", year.alias("year"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return by.join(known, "album_id").groupBy("year", "bucket", decade_of("release_year").alias("key")).agg(F.sum("n").cast("double").alias("o"))


def genre_by_decade(plays: DataFrame, albums: DataFrame, shares: DataFrame, prior: float = 20) -> DataFrame:
    """Decade x genre: plays, expected plays by the overall mix of dated plays with genres, and lift."""
    by = dated_plays(plays, albums).groupBy("artist_id", decade_of("release_year").alias("decade")).agg(F.sum("n").alias("n")).join(shares, "artist_id")
    mix = by.groupBy("decade", "tag").agg(F.sum(F.col("n") * F.col("share")).alias("o"))
    decades, genres = mix.groupBy("decade").agg(F.sum("o").alias("d")), mix.groupBy("tag").agg(F.sum("o").alias("g"))
    grid = decades.crossJoin(genres).crossJoin(F.broadcast(genres.agg(F.sum("g").alias("t")))).join(mix, ["decade", "tag"], "left")
    o, e = F.coalesce("o", F.lit(0.0)), F.col("d") * F.col("g") / F.col("t")
    return grid.select("decade", "tag", F.round(o, 6).alias("plays"), F.round(e, 6).alias("expected"), F.when(F.round(e, 6) >= 30, F.round((o + prior) / (e + prior), 6)).alias("lift"))


def decade_signature(cells: DataFrame, least: float = 1.2, top: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("decade").orderBy(F.desc("lift"), "tag"))
    return cells.where(F.col("lift") >= least).withColumn("r", rank).where(F.col("r") <= top).select("decade", "tag", "lift")
