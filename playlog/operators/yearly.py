"""The yearly report, taste gap and current taste."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.operators.periods import streaks


def of_year(plays: DataFrame, year: int) -> DataFrame:
    """A range on lday, not a function of it, which reaches the scan; stored plays are pruned to the year's partition."""
    plays = plays.where(F.col("lyear") == year) if "lyear" in plays.columns else plays
    return plays.where(F.col("lday").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))


def year_totals(plays: DataFrame, stats: DataFrame, year: int) -> DataFrame:
    fresh = stats.where((F.year("first_lday") == year) & (F.col("prehistory") == 0)).select("artist_id", F.lit(1).alias("new"))
    rows = of_year(plays, year).join(fresh, "artist_id", "left")
    return rows.agg(F.count("*").alias("plays"), F.countDistinct("artist_id").alias("artists"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("lday").alias("active_days"), F.countDistinct(F.when(F.col("new") == 1, F.col("artist_id"))).alias("new_artists"), F.count("new").alias("new_plays"))


def year_vs_last(plays: DataFrame, year: int) -> DataFrame:
    rows = plays.where(F.col("lday").between(F.lit(f"{year - 1}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))
    by = rows.agg(F.count_if(F.year("lday") == year).alias("plays"), F.count_if(F.year("lday") == year - 1).alias("before"))
    return by.select("plays", "before", (F.col("plays") - F.col("before")).alias("change"), F.try_divide("plays", "before").alias("ratio"))


def artist_of_month(plays: DataFrame, year: int) -> DataFrame:
    """Twelve months with the most played artist (of equals the larger id), null where there is none."""
    by = of_year(plays, year).groupBy(F.month("lday").alias("month"), "artist_id").agg(F.count("*").alias("n")).groupBy("month").agg(F.max(F.struct("n", "artist_id")).alias("m"))
    axis = plays.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return axis.join(by, "month", "left").select("month", F.col("m.artist_id").alias("artist_id"), F.col("m.n").alias("plays"))


def busiest_day(plays: DataFrame, year: int) -> DataFrame:
    return of_year(plays, year).groupBy("lday").agg(F.count("*").alias("plays")).orderBy(F.desc("plays"), F.desc("lday")).limit(1)


def year_streak(plays: DataFrame, year: int) -> DataFrame:
    return streaks(of_year(plays, year)).orderBy(F.desc("length"), "start_day").limit(1)


def year_sessions(sessions: DataFrame, year: int, limit: int = 3) -> DataFrame:
    by = of_year(sessions, year).groupBy("session_id").agg(F.count("*").alias("plays"), F.min("ts").alias("first_ts"), ((F.max("ts") - F.min("ts")) / 60).alias("minutes"))
    return by.orderBy(F.desc("plays"), "first_ts").limit(limit).select("plays", "first_ts", "minutes")


def repeat_day(plays: DataFrame, year: int) -> DataFrame:
    by = of_year(plays, year).groupBy("lday", "track_id").agg(F.count("*").alias("plays")).where("plays > 1")
    return by.orderBy(F.desc("plays"), "lday", "track_id").limit(1)


def archetypes(plays: DataFrame, stats: DataFrame, year: int) -> DataFrame:
    """The measures behind the year's labels: share of plays of new artists, of the ten top artists, at night and early."""
    rows = of_year(plays, year)
    top = rows.groupBy("artist_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artist_id").limit(10).agg(F.sum("n").alias("top10"))
    base = year_totals(plays, stats, year).select("plays", "new_plays").crossJoin(top).crossJoin(rows.agg(F.count_if(F.col("lhour") < 6).alias("night"), F.count_if(F.col("lhour").between(6, 9)).alias("early")))
    return base.select("plays", *[(F.col(c) / F.col("plays")).alias(a) for c, a in (("new_plays", "explorer"), ("top10", "loyalist"), ("night", "night_owl"), ("early", "early_bird"))])


def gap_genres(plays: DataFrame, loved: DataFrame, shares: DataFrame) -> DataFrame:
    """Per genre its share of loved tracks against its share of plays, and the smoothed ratio."""
    by = plays.groupBy("artist_id").agg(F.count("*").alias("n")).join(loved.groupBy("artist_id").agg(F.count("*").alias("l")), "artist_id", "left")
    cells = by.join(shares, "artist_id").groupBy("tag").agg(F.sum(F.col("n") * F.col("share")).alias("p"), F.sum(F.coalesce("l", F.lit(0)) * F.col("share")).alias("l"))
    total = cells.agg(F.sum("p").alias("tp"), F.sum("l").alias("tl"))
    e = F.col("tl") * F.col("p") / F.col("tp")
    return cells.crossJoin(F.broadcast(total)).select("tag", F.round("l", 6).alias("loved"), F.round(e, 6).alias("expected"), F.round((F.col("l") + 5) / (e + 5), 6).alias("ratio"))


def gap_artists(plays: DataFrame, loved: DataFrame, least: int = 3) -> DataFrame:
    by = plays.groupBy("artist_id").agg(F.count("*").alias("plays")).join(loved.groupBy("artist_id").agg(F.count("*").alias("loved")), "artist_id", "full")
    rows = by.select("artist_id", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("loved", F.lit(0)).alias("loved"))
    total = rows.agg(F.sum("plays").alias("tp"), F.sum("loved").alias("tl"))
    e = F.col("tl") * F.col("plays") / F.col("tp")
    found = rows.crossJoin(F.broadcast(total)).withColumn("expected", F.round(e, 6)).withColumn("ratio", F.round((F.col("loved") + 2) / (e + 2), 6))
    return found.where((F.col("loved") >= least) | (F.col("expected") >= least)).select("artist_id", "plays", "loved", "expected", "ratio")


def weighted_decay(plays: DataFrame, span: DataFrame, half_life: int = 90) -> DataFrame:
    """Per artist the plays weighted down by half every half_life days of age."""
    age = F.floor((F.col("hi") - F.col("ts")) / 86400)
    return plays.crossJoin(F.broadcast(span)).groupBy("artist_id").agg(F.round(F.sum(F.pow(F.lit(0.5), age / half_life)), 6).alias("weight"))


def one_song(plays: DataFrame, year: int) -> DataFrame:
    """Artists heard with one song only and at most three plays, of all artists."""
    by = of_year(plays, year).groupBy("artist_id").agg(F.countDistinct("track_id").alias("t"), F.count("*").alias("n"))
    return by.agg(F.count_if((F.col("t") == 1) & (F.col("n") <= 3)).alias("artists"), F.count("*").alias("of_artists"))


def genre_months(plays: DataFrame, shares: DataFrame, year: int, top: int = 8) -> DataFrame:
    """The year's biggest genres in each of its twelve months."""
    by = of_year(plays, year).groupBy("artist_id", F.month("lday").alias("month")).agg(F.count("*").alias("n")).join(shares, "artist_id")
    cells = by.groupBy("tag", "month").agg(F.sum(F.col("n") * F.col("share")).alias("o"))
    biggest = cells.groupBy("tag").agg(F.round(F.sum("o"), 6).alias("s")).orderBy(F.desc("s"), "tag").limit(top).select("tag")
    axis = plays.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return F.broadcast(biggest).crossJoin(axis).join(cells, ["tag", "month"], "left").select("tag", "month", F.round(F.coalesce("o", F.lit(0.0)), 6).alias("score"))


def release_years(plays: DataFrame, albums: DataFrame, year: int) -> DataFrame:
    """One row: dated and all plays of the year, the share released in it, and the lower median release year."""
    rows = of_year(plays, year)
    known = albums.select("album_id", F.substring("release_date", 1, 4).cast("int").alias("release_year")).where("release_year between 1900 and 2100")
    hist = rows.where("album_id is not null").groupBy("album_id").agg(F.count("*").alias("n")).join(known, "album_id").groupBy("release_year").agg(F.sum("n").alias("n"))
    running = hist.withColumns({"c": F.sum("n").over(Window.orderBy("release_year")), "t": F.sum("n").over(Window.partitionBy())})  # a row a year
    out = running.agg(F.max("t").alias("dated"), F.coalesce(F.sum(F.when(F.col("release_year") == year, F.col("n"))), F.lit(0)).alias("own"), F.min(F.when(F.col("c") * 2 >= F.col("t"), F.col("release_year"))).alias("median"))
    return out.crossJoin(rows.agg(F.count("*").alias("total"))).select("dated", "total", F.round(F.col("own") / F.col("dated"), 6).alias("this_year_share"), "median")


def year_loved(loved: DataFrame, year: int, zone: str = "UTC", limit: int = 10) -> DataFrame:
    """The newest loves of a local year, with the count of all of them."""
    from playlog.model import local_parts

    own = loved.where(F.year(local_parts(F.col("loved_at"), zone)[0]) == year)
    return own.orderBy(F.desc("loved_at"), "track_id").limit(limit).select("track_id", "loved_at").crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))
