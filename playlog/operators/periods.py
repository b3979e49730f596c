"""Period queries: totals, time lines, top lists, streaks and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.model import ORDER


def in_range(plays: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Plays whose local day lies in an inclusive range, open where a side is None."""
    if start:
        plays = plays.where(F.col("lday") >= F.lit(start).cast("date"))
    return plays.where(F.col("lday") <= F.lit(end).cast("date")) if end else plays


def overview(plays: DataFrame, stats: DataFrame, recent_days: int = 30, top: int = 5) -> DataFrame:
    """One row over all plays: totals, rates, the part of the ten most played artists, streaks of days, and the artists of the last days.

    recent_top are the artist_ids played most lately, joined by commas; of equal streaks the first is the longest, the current one ends on the newest day.
    """
    totals = plays.agg(F.count("*").alias("plays"), F.countDistinct("artist_id").alias("artists"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("album_id").alias("albums"), F.countDistinct("lday").alias("days"), F.min("lday").alias("first_day"), F.max("lday").alias("last_day"), F.max("ts").alias("hi"))
    most = stats.orderBy(F.desc("plays"), "artist_id").limit(10).agg(F.sum("plays").alias("top10"))
    runs = streaks(plays).agg(F.max(F.struct("length", (-F.unix_date("end_day")).alias("e"))).alias("l"), F.max_by("length", "end_day").alias("current_streak"))
    start = totals.select((F.col("hi") - recent_days * 86400).alias("start"))
    new = stats.crossJoin(F.broadcast(start)).where((F.col("first_ts") > F.col("start")) & (F.col("prehistory") == 0)).agg(F.count("*").alias("new_artists_30d"))
    late = plays.crossJoin(F.broadcast(start)).where(F.col("ts") > F.col("start")).groupBy("artist_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artist_id").limit(top)
    names = late.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "artist_id"))), lambda x: x["artist_id"].cast("string")), ",").alias("recent_top"))
    length = F.datediff("last_day", "first_day") + 1
    row = totals.crossJoin(most).crossJoin(runs).crossJoin(new).crossJoin(names)  # one row each
    return row.select("plays", "artists", "tracks", "albums", "days", "first_day", "last_day", (F.col("plays") / length).alias("per_day"), (F.col("plays") / F.col("days")).alias("per_listening_day"), (F.col("top10") / F.col("plays")).alias("top10_share"),
                      F.col("l.length").alias("longest_streak"), F.date_from_unix_date(-F.col("l.e")).alias("longest_streak_end"), "current_streak", "new_artists_30d", "recent_top")


def months(plays: DataFrame) -> DataFrame:
    """A row for each month from the first play to the last."""
    span = plays.agg(F.trunc(F.min("lday"), "month").alias("a"), F.trunc(F.max("lday"), "month").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def timeline(plays: DataFrame, stats: DataFrame) -> DataFrame:
    """Per month, empty ones included: plays, new artists, novelty (share of plays of artists first heard within 365 days), top artist."""
    month = F.trunc("lday", "month")
    first = stats.select("artist_id", "first_ts", "first_lday", "prehistory")
    by_artist = plays.join(first, "artist_id").groupBy(month.alias("month"), "artist_id").agg(F.count("*").alias("n"), F.count_if((F.col("ts") - F.col("first_ts") < 365 * 86400) & (F.col("prehistory") == 0)).alias("fresh"))
    totals = by_artist.groupBy("month").agg(F.sum("n").alias("plays"), F.sum("fresh").alias("fresh"), F.max(F.struct("n", (-F.col("artist_id")).alias("a"))).alias("top"))
    new = stats.where("prehistory = 0").groupBy(F.trunc("first_lday", "month").alias("month")).agg(F.count("*").alias("new_artists"))
    return months(plays).join(totals, "month", "left").join(new, "month", "left").select("month", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("new_artists", F.lit(0)).alias("new_artists"), (F.col("fresh") / F.col("plays")).alias("novelty"), (-F.col("top.a")).alias("top_artist"))


def activity(plays: DataFrame, stats: DataFrame, unit: str) -> DataFrame:
    """Per 'day' or 'month' of the whole span, empty ones included: plays, artists first heard then, and the most played artist with its plays."""
    of = lambda day: F.trunc(day, "month") if unit == "month" else F.col(day)
    by = plays.groupBy(of("lday").alias("bucket"), "artist_id").agg(F.count("*").alias("n"))
    cells = by.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("artist_id")).alias("a"))).alias("top"))
    new = stats.where("prehistory = 0").groupBy(of("first_lday").alias("bucket")).agg(F.count("*").alias("new"))
    span = cells.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    rows = spine.join(cells, "bucket", "left").join(new, "bucket", "left")
    return rows.select("bucket", F.coalesce("n", F.lit(0)).alias("plays"), F.coalesce("new", F.lit(0)).alias("new_artists"), (-F.col("top.a")).alias("top_artist"), F.col("top.n").alias("top_plays"))


def top(plays: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The most played values of key with plays and listening days."""
    return plays.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("plays"), F.countDistinct("lday").alias("days")).orderBy(F.desc("plays"), key).limit(limit)


def clock(plays: DataFrame) -> DataFrame:
    """Plays per weekday and hour, all 168 cells."""
    spark = plays.sparkSession
    cells = spark.range(168).select((F.col("id") / 24).cast("int").alias("lwday"), (F.col("id") % 24).cast("int").alias("lhour"))
    return cells.join(plays.groupBy("lwday", "lhour").agg(F.count("*").alias("n")), ["lwday", "lhour"], "left").select("lwday", "lhour", F.coalesce("n", F.lit(0)).alias("plays"))


def streaks(plays: DataFrame) -> DataFrame:
    """Runs of consecutive listening days: start, end, length. Works on one row per day."""
    days = plays.select("lday").distinct()
    island = F.date_sub("lday", F.row_number().over(Window.orderBy("lday")))
    return days.withColumn("g", island).groupBy("g").agg(F.min("lday").alias("start_day"), F.max("lday").alias("end_day"), F.count("*").alias("length")).drop("g")


def obsessions(plays: DataFrame, least: int = 50) -> DataFrame:
    """Each month's most played artist and its share, months of at least least plays."""
    by = plays.groupBy(F.trunc("lday", "month").alias("month"), "artist_id").agg(F.count("*").alias("plays"))
    month = Window.partitionBy("month")
    ranked = by.withColumns({"total": F.sum("plays").over(month), "r": F.row_number().over(month.orderBy(F.desc("plays"), "artist_id"))})
    return ranked.where((F.col("r") == 1) & (F.col("total") >= least)).select("month", "artist_id", "plays", (F.col("plays") / F.col("total")).alias("share"))


def eras(plays: DataFrame) -> DataFrame:
    """Per year the signature artist: greatest lift of its share over its overall share, among artists of max(10, 0.5 %) plays."""
    by = plays.groupBy(F.year("lday").alias("year"), "artist_id").agg(F.count("*").alias("n"))
    year, artist, every = Window.partitionBy("year"), Window.partitionBy("artist_id"), plays.agg(F.count("*").alias("total"))
    rows = by.withColumns({"in_year": F.sum("n").over(year), "ever": F.sum("n").over(artist)}).crossJoin(F.broadcast(every))
    lift = (F.col("n") / F.col("in_year")) / (F.col("ever") / F.col("total"))
    ranked = rows.where(F.col("n") >= F.greatest(F.lit(10), F.col("in_year") * 0.005)).withColumn("lift", F.round(lift, 6))
    return ranked.withColumn("r", F.row_number().over(year.orderBy(F.desc("lift"), F.desc("n"), "artist_id"))).where("r = 1").select("year", "artist_id", F.col("n").alias("plays"), "lift")


def era_cards(plays: DataFrame, stats: DataFrame, top: int = 8) -> DataFrame:
    """Per year: plays, artists, new artists, the most played artists (ids joined by commas), the signature artist of eras(), and the new artist played most."""
    by = plays.groupBy(F.year("lday").alias("year"), "artist_id").agg(F.count("*").alias("n"))
    first = stats.where("prehistory = 0").select("artist_id", F.year("first_lday").alias("began"))
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "artist_id"))
    rows = by.join(first, "artist_id", "left").withColumns({"r": rank, "new": F.coalesce(F.col("began") == F.col("year"), F.lit(False))})
    listed = F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "artist_id"))))  # so many at most
    best_new = F.max(F.when(F.col("new"), F.struct("n", (-F.col("artist_id")).alias("a"))))
    years = rows.groupBy("year").agg(F.sum("n").alias("plays"), F.count("*").alias("artists"), F.count_if("new").alias("new_artists"), F.array_join(F.transform(listed, lambda x: x["artist_id"].cast("string")), ",").alias("top"), (-best_new["a"]).alias("best_new"))
    return years.join(eras(plays).select("year", F.col("artist_id").alias("signature"), "lift"), "year", "left")


def recent(plays: DataFrame, limit: int = 50) -> DataFrame:
    return plays.orderBy(*[F.desc(c) for c in ORDER]).limit(limit).select(*ORDER, "album_id")


def binges(plays: DataFrame, least: int = 5) -> DataFrame:
    return plays.groupBy("lday", "track_id").agg(F.count("*").alias("plays")).where(F.col("plays") >= least)


def one_track(plays: DataFrame, least: int = 15, share: float = 0.75) -> DataFrame:
    """Artists of at least least plays, of which the most played track has the given share or more."""
    by = plays.groupBy("artist_id", "track_id").agg(F.count("*").alias("n"))
    tops = by.groupBy("artist_id").agg(F.sum("n").alias("plays"), F.max(F.struct("n", (-F.col("track_id")).alias("t"))).alias("m"))
    found = tops.select("artist_id", "plays", (-F.col("m.t")).alias("track_id"), F.col("m.n").alias("top_plays"), (F.col("m.n") / F.col("plays")).alias("share"))
    return found.where((F.col("plays") >= least) & (F.round("share", 9) >= share))


def velocity_weekly(plays: DataFrame, artists: int = 6) -> DataFrame:
    """Cumulative plays per week (Mondays) of the most played artists on one axis of weeks."""
    chosen = F.broadcast(top(plays, "artist_id", artists).select("artist_id"))
    monday = F.date_sub("lday", F.weekday("lday"))
    weekly = plays.join(chosen, "artist_id").groupBy("artist_id", monday.alias("week")).agg(F.count("*").alias("n"))
    axis = weekly.agg(F.min("week").alias("a"), F.max("week").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 7 day"))).alias("week"))
    grid = chosen.crossJoin(axis).join(weekly, ["artist_id", "week"], "left")
    return grid.select("artist_id", "week", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("artist_id").orderBy("week")).alias("plays"))


def days_to_n(plays: DataFrame, marks: tuple[int, ...] = (100, 500, 1000)) -> DataFrame:
    """Per artist: days from the first play to the nth, null if never reached. Works on one row an artist and day."""
    daily = plays.groupBy("artist_id", "lday").agg(F.count("*").alias("n"))
    rows = daily.withColumn("k", F.sum("n").over(Window.partitionBy("artist_id").orderBy("lday")))
    by = rows.groupBy("artist_id").agg(F.min("lday").alias("first"), *[F.min(F.when(F.col("k") >= n, F.col("lday"))).alias(f"d{n}") for n in marks])
    return by.select("artist_id", *[F.datediff(f"d{n}", "first").alias(f"days_to_{n}") for n in marks])


def fastest_30d(plays: DataFrame) -> DataFrame:
    """Per artist the most plays in 30 consecutive days, and the first listening day of the earliest such span."""
    daily = plays.groupBy("artist_id", "lday").agg(F.count("*").alias("n")).withColumn("d", F.datediff("lday", F.lit("1970-01-01").cast("date")))
    span = Window.partitionBy("artist_id").orderBy("d").rangeBetween(-29, 0)
    rows = daily.withColumns({"plays": F.sum("n").over(span), "start_day": F.min("lday").over(span)})
    best = F.row_number().over(Window.partitionBy("artist_id").orderBy(F.desc("plays"), "d"))
    return rows.withColumn("r", best).where("r = 1").select("artist_id", "plays", "start_day")


def comeback(plays: DataFrame, gap_days: int = 365, before: int = 3, after: int = 3, listening: int = 100) -> DataFrame:
    """Returns to an artist after a gap of gap_days with at least so many plays before and after it, and so many listening days of any artist in between.

    Works on one row an artist and day: gaps lie between days. The listening days between two days are a difference of day numbers, not a range join.
    """
    daily = plays.groupBy("artist_id", "lday").agg(F.count("*").alias("c"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    days = daily.select("lday").distinct().withColumn("no", F.row_number().over(Window.orderBy("lday")))  # one row a day
    mine = Window.partitionBy("artist_id").orderBy("lday")
    rows = daily.withColumns({"prev": F.lag("lday").over(mine), "gap": F.col("first") - F.lag("last").over(mine), "upto": F.sum("c").over(mine), "n": F.sum("c").over(Window.partitionBy("artist_id"))})
    rows = rows.withColumn("plays_after", F.col("n") - F.col("upto") + F.col("c"))
    found = rows.where((F.col("gap") >= gap_days * 86400) & (F.col("upto") - F.col("c") >= before) & (F.col("plays_after") >= after))
    a, b = days.toDF("prev", "no_a"), days.toDF("lday", "no_b")
    counted = found.join(F.broadcast(a), "prev").join(F.broadcast(b), "lday").withColumn("between", F.col("no_b") - F.col("no_a") - 1)
    return counted.where(F.col("between") >= listening).select("artist_id", F.col("prev").alias("left_day"), F.col("lday").alias("back_day"), "gap", "plays_after")


def album_continuation(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Plays in a range with an album, after a play with one in their session, and how many stay on it."""
    before = F.lag("album_id").over(Window.partitionBy("session_id").orderBy(*ORDER))
    pairs = in_range(sessions.withColumn("prev_album", before), start, end).where("prev_album is not null and album_id is not null")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("album_id") == F.col("prev_album")).alias("same"))
