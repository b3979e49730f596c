"""The library views: a period's summary, cards of one artist, album or track, lists with a total, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.operators.periods import in_range

DAYS_PER_MONTH = 30.4375


def clip_range(plays: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the part of a requested range that the log covers, and whether it is empty."""
    span = plays.agg(F.min("lday").alias("lo"), F.max("lday").alias("hi"))
    rows = span.select(F.greatest(F.lit(start).cast("date"), "lo").alias("start_day"), F.least(F.lit(end).cast("date"), "hi").alias("end_day"))
    return rows.withColumn("empty", F.coalesce(F.col("start_day") > F.col("end_day"), F.lit(True)))


def previous_period(start: Column, end: Column) -> tuple[Column, Column]:
    """The period before: as many calendar months if the range is whole months, else as many days."""
    whole = (F.dayofmonth(start) == 1) & (end == F.last_day(end))
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1
    return F.when(whole, F.add_months(start, -months)).otherwise(F.date_sub(start, F.datediff(end, start) + 1)), F.date_sub(start, 1)


def summary(plays: DataFrame, stats: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the numbers of a range, its new artists, the plays of the period before and the change.

    Both periods come from one scan of their joint range. `partial` says that the log does not cover the period before.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    before, until = previous_period(a, b)
    inside = F.col("lday") >= a
    when = lambda c: F.when(inside, F.col(c))
    first = plays.agg(F.min("lday").alias("first"))
    rows = plays.where(F.col("lday").between(before, b)).agg(
        F.count_if(inside).alias("plays"), F.countDistinct(when("artist_id")).alias("artists"), F.countDistinct(when("track_id")).alias("tracks"),
        F.countDistinct(when("album_id")).alias("albums"), F.countDistinct(when("lday")).alias("days"), F.count_if(F.col("lday") <= until).alias("before"))
    new = stats.where((F.col("prehistory") == 0) & F.col("first_lday").between(a, b)).agg(F.count("*").alias("new_artists"))
    out = rows.crossJoin(new).crossJoin(first)
    return out.select("plays", "artists", "tracks", "albums", "days", "new_artists", "before", (F.col("plays") - F.col("before")).alias("change"), (F.col("first") > before).alias("partial"))


def discoveries(plays: DataFrame, stats: DataFrame, gateway: DataFrame, start: str, end: str, limit: int = 10) -> DataFrame:
    """The most played artists first heard in a range, with the artist that led to each."""
    new = stats.where((F.col("prehistory") == 0) & F.col("first_lday").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("artist_id")
    top = in_range(plays, start, end).join(new, "artist_id").groupBy("artist_id").agg(F.count("*").alias("plays")).orderBy(F.desc("plays"), "artist_id").limit(limit)
    return top.join(gateway, "artist_id", "left").select("artist_id", "plays", "gateway_id")


def artist_card(stats: DataFrame, gateway: DataFrame, artist_id: int) -> DataFrame:
    """One artist's statistics with its share of all plays, its rank (one more than the artists with more plays) and its gateway."""
    one = stats.where(F.col("artist_id") == artist_id)
    place = stats.crossJoin(F.broadcast(one.select(F.col("plays").alias("own")))).agg(F.sum("plays").alias("total"), (F.count_if(F.col("plays") > F.col("own")) + 1).alias("rank"))
    return one.crossJoin(place).join(gateway, "artist_id", "left").select("artist_id", "plays", "first_ts", "last_ts", "n_tracks", "n_days", "first_track_id", (F.col("plays") / F.col("total")).alias("share"), "rank", "gateway_id")


def peak_month(monthly: DataFrame) -> DataFrame:
    """The month of most plays, the first of equals, of rows (month, plays)."""
    return monthly.orderBy(F.desc("plays"), "month").limit(1)


def _counted(plays: DataFrame, *keys: str) -> DataFrame:
    return plays.groupBy(*keys).agg(F.count("*").alias("plays"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def artist_tracks(plays: DataFrame, loved: DataFrame, artist_id: int, limit: int = 50) -> DataFrame:
    top = _counted(plays.where(F.col("artist_id") == artist_id), "track_id").orderBy(F.desc("plays"), "track_id").limit(limit)
    return top.join(loved.groupBy("track_id").agg(F.min("loved_at").alias("loved_at")), "track_id", "left")


def artist_albums(plays: DataFrame, albums: DataFrame, artist_id: int, limit: int = 30) -> DataFrame:
    top = _counted(plays.where((F.col("artist_id") == artist_id) & F.col("album_id").isNotNull()), "album_id").orderBy(F.desc("plays"), "album_id").limit(limit)
    return top.join(albums.select("album_id", "release_date"), "album_id", "left")


def item_tags(tags: DataFrame, artist_id: int, limit: int = 12) -> DataFrame:
    return tags.where((F.col("artist_id") == artist_id) & (F.col("tag") != "other")).orderBy(F.desc("weight"), "tag").limit(limit).select("tag", "weight")


def album_card(plays: DataFrame, album_id: int) -> DataFrame:
    """The played tracks of one album."""
    return _counted(plays.where(F.col("album_id") == album_id), "track_id")


def track_card(plays: DataFrame, track_id: int) -> DataFrame:
    """One track's plays, span and best day (of equals the first)."""
    own = plays.where(F.col("track_id") == track_id)
    best = own.groupBy("lday").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lday").limit(1).select(F.col("lday").alias("best_day"), F.col("n").alias("best_plays"))
    return own.agg(F.count("*").alias("plays"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).crossJoin(best)


def track_years(plays: DataFrame, track_id: int) -> DataFrame:
    return plays.where(F.col("track_id") == track_id).groupBy(F.year("lday").alias("year")).agg(F.count("*").alias("plays"))


def with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in an order, each with the count of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with has_more: whether a row follows the page. One row more than the page is taken."""
    some = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = some.withColumn("__at", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    return numbered.withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("__at") <= limit).drop("__at")


def library_tracks(plays: DataFrame, loved: DataFrame, limit: int = 100) -> DataFrame:
    """Tracks by plays, whether they are loved, with the total."""
    rows = plays.groupBy("track_id", "artist_id").agg(F.count("*").alias("plays")).join(loved.select("track_id", F.lit(1).alias("loved")).distinct(), "track_id", "left")
    return with_total(rows.withColumn("loved", F.coalesce("loved", F.lit(0))), [F.desc("plays"), "track_id"], limit)


def library_albums(plays: DataFrame, albums: DataFrame, limit: int = 100) -> DataFrame:
    rows = plays.where("album_id is not null").groupBy("album_id").agg(F.count("*").alias("plays"), F.countDistinct("track_id").alias("tracks"))
    return with_total(rows.join(albums.select("album_id", "artist_id", "release_date"), "album_id"), [F.desc("plays"), "album_id"], limit)


def library_genres(plays: DataFrame, shares: DataFrame, limit: int = 100) -> DataFrame:
    by = plays.groupBy("artist_id").agg(F.count("*").alias("n")).join(shares, "artist_id")
    rows = by.groupBy("tag").agg(F.round(F.sum(F.col("n") * F.col("share")), 6).alias("score"), F.count("*").alias("artists"))
    return with_total(rows, [F.desc("score"), "tag"], limit)


def tag_detail(plays: DataFrame, shares: DataFrame, tag: str, limit: int = 20) -> DataFrame:
    """The artists of a tag by the plays that it gets of theirs."""
    by = plays.groupBy("artist_id").agg(F.count("*").alias("plays")).join(shares.where(F.col("tag") == tag), "artist_id")
    return by.select("artist_id", "plays", F.round(F.col("plays") * F.col("share"), 6).alias("score")).orderBy(F.desc("score"), "artist_id").limit(limit)


def tag_monthly(plays: DataFrame, shares: DataFrame, months: DataFrame, tag: str) -> DataFrame:
    """The plays that a tag gets in every month of the log."""
    by = plays.join(shares.where(F.col("tag") == tag), "artist_id").groupBy(F.trunc("lday", "month").alias("month")).agg(F.round(F.sum("share"), 6).alias("score"))
    return months.join(by, "month", "left").select("month", F.coalesce("score", F.lit(0.0)).alias("score"))


def pace(plays: DataFrame) -> DataFrame:
    """Per artist plays a month since its first day, and over the last 365 days; null where the span is under 30 or 365 days."""
    newest = plays.agg(F.max("lday").alias("today"))
    daily = plays.groupBy("artist_id", "lday").agg(F.count("*").alias("n")).crossJoin(F.broadcast(newest))
    late = F.datediff("today", "lday") < 365
    by = daily.groupBy("artist_id").agg(F.sum("n").alias("n"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late"), (F.datediff(F.max("today"), F.min("lday")) + 1).alias("span"))
    return by.select("artist_id", F.when(F.col("span") >= 30, F.round(F.col("n") / (F.col("span") / DAYS_PER_MONTH), 6)).alias("lifetime"), F.when(F.col("span") >= 365, F.round(F.col("late") / (365 / DAYS_PER_MONTH), 6)).alias("recent"))


def cover_targets(plays: DataFrame, start: str, end: str) -> DataFrame:
    """For each artist its most played album of a range, of equals the lowest id."""
    by = in_range(plays, start, end).where("album_id is not null").groupBy("artist_id", "album_id").agg(F.count("*").alias("n"))
    best = by.groupBy("artist_id").agg(F.max(F.struct("n", (-F.col("album_id")).alias("a"))).alias("m"))
    return best.select("artist_id", (-F.col("m.a")).alias("album_id"), F.col("m.n").alias("plays"))


def first_of_weekdays(rows: DataFrame) -> DataFrame:
    """The two first rows of each weekday of rows(artist_id, lwday, plays, ...) in the order of plays: at most 14, ranked.

    The first pair of another artist and weekday lies among them. A row before either half of it on its weekday would make an
    earlier pair with the other half, unless it is of that half's artist, and an artist has one row a weekday.
    """
    order = [F.desc("plays"), "artist_id"]
    two = rows.withColumn("k", F.row_number().over(Window.partitionBy("lwday").orderBy(*order))).where("k <= 2")
    return two.withColumn("r", F.row_number().over(Window.orderBy(*order, "lwday"))).select("r", "artist_id", "lwday", "plays")


def double_life(plays: DataFrame, start: str, end: str, least: int = 5, share: float = 1 / 3, of_day: float = 0.15) -> DataFrame:
    """Two weekdays that each belong to another artist: the first pair in the order of plays, the earlier weekday first."""
    by = in_range(plays, start, end).groupBy("artist_id", "lwday").agg(F.count("*").alias("plays"), F.countDistinct("lday").alias("days"))
    weekday = by.groupBy("lwday").agg(F.sum("plays").alias("wd"))  # seven rows
    every = by.withColumn("ever", F.sum("plays").over(Window.partitionBy("artist_id"))).join(F.broadcast(weekday), "lwday")
    some = every.where((F.col("plays") >= least) & (F.col("days") >= 2) & (F.round(F.col("plays") / F.col("ever"), 9) >= round(share, 9)) & (F.round(F.col("plays") / F.col("wd"), 9) >= of_day))
    ranked = first_of_weekdays(some)
    x, y = ranked.toDF("r", "artist_id", "lwday", "plays"), ranked.toDF("r2", "artist2", "lwday2", "plays2")
    pair = x.join(y, (F.col("r") < F.col("r2")) & (F.col("artist_id") != F.col("artist2")) & (F.col("lwday") != F.col("lwday2"))).orderBy("r", "r2").limit(1)
    both = F.array_sort(F.array(F.struct("lwday", "artist_id", "plays"), F.struct(F.col("lwday2").alias("lwday"), F.col("artist2").alias("artist_id"), F.col("plays2").alias("plays"))))
    return pair.select(F.explode(both).alias("d")).select("d.lwday", "d.artist_id", "d.plays")


def release_friday(day: Column) -> Column:
    """The Friday that ends the release week (Saturday to Friday) of a day."""
    return F.date_add(day, F.pmod(F.lit(4) - F.weekday(day), F.lit(7)))


def release_window(day: Column, ahead: int = 6) -> tuple[Column, Column]:
    """First and last day shown: the current release week and so many more."""
    return F.date_sub(release_friday(day), 6), F.date_add(release_friday(day), 7 * ahead)
