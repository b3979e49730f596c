"""Genre shares, cyclic lift with shrinkage, drift, diversity and seasonality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.model import local_parts
from playlog.store import saved

PRIOR, MIN_EXPECTED = 20.0, 30.0


def genre_shares(tags: DataFrame, top: int = 5) -> DataFrame:
    """(artist_id, tag, share) of each artist's heaviest tags."""
    artist = Window.partitionBy("artist_id")
    kept = tags.where("weight > 0").withColumn("r", F.row_number().over(artist.orderBy(F.desc("weight"), "tag"))).where(F.col("r") <= top)
    return kept.select("artist_id", "tag", (F.col("weight") / F.sum("weight").over(artist)).alias("share"))


def genre_profile(plays: DataFrame, shares: DataFrame) -> DataFrame:
    """(tag, score): plays attributed to each genre; plays are counted per artist before the join."""
    by = plays.groupBy("artist_id").agg(F.count("*").alias("n"))
    return by.join(shares, "artist_id").groupBy("tag").agg(F.round(F.sum(F.col("n") * F.col("share")), 6).alias("score"))


def bucket(dim: str) -> tuple[Column, Column]:
    """(year, bucket) of a play: month, season (December counts to the next winter), daypart or weekpart."""
    year = F.year("lday")
    if dim == "month":
        return year, F.month("lday")
    if dim == "season":
        return year + F.when(F.month("lday") == 12, 1).otherwise(0), F.floor((F.month("lday") % 12) / 3).cast("int")
    return year, F.floor(F.col("lhour") / 6).cast("int") if dim == "daypart" else (F.col("lwday") >= 5).cast("int")


DIMENSIONS = ("month", "season", "daypart", "weekpart")


def calendar_counts(plays: DataFrame, tasks: int | None = None) -> DataFrame:
    """(artist_id, dim, year, bucket, n) of all dimensions, from one pass: plays are shuffled once, by artist, and dealt over the dimensions where they are counted.

    An artist has nearly as many cells as plays, four times, so tasks says over how many tasks they go: left to AQE, which sees the plays before they are dealt, their number
    would not grow with the cells. The name of a dimension is an aggregate and no key, which makes Spark count sorted rows and not hold all cells in a hash table.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("dim"), year.alias("year"), part.alias("bucket")) for i, (d, (year, part)) in enumerate((d, bucket(d)) for d in DIMENSIONS)])
    own = plays.select("artist_id", "lday", "lhour", "lwday")
    own = own.repartition(tasks, "artist_id") if tasks else own.repartition("artist_id")
    cells = own.select("artist_id", F.explode(parts).alias("p")).groupBy("artist_id", "p.i", "p.year", "p.bucket").agg(F.max("p.dim").alias("dim"), F.count("*").alias("n"))
    return cells.select("artist_id", "dim", "year", "bucket", "n")


def dim_counts(plays: DataFrame, dim: str) -> DataFrame:
    year, part = bucket(dim)
    return plays.groupBy("artist_id", year.alias("year"), part.alias("bucket")).agg(F.count("*").alias("n"))


def observed(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """(dim, year, bucket, key, o): plays of counts(artist_id, dim, year, bucket, n) dealt over the genres of their artists."""
    return counts.join(shares.hint("shuffle_hash"), "artist_id").groupBy("dim", "year", "bucket", F.col("tag").alias("key")).agg(F.sum(F.col("n") * F.col("share")).alias("o"))


def coverage(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """(dim, year, bucket, plays, covered): all plays of a bucket, and those of artists that have a genre."""
    tagged = shares.select("artist_id").distinct().withColumn("has", F.lit(True))
    by = counts.join(tagged.hint("shuffle_hash"), "artist_id", "left").groupBy("dim", "year", "bucket")
    return by.agg(F.sum("n").alias("plays"), F.sum(F.when(F.col("has"), F.col("n")).otherwise(0)).alias("covered"))


def lift(counts: DataFrame, shares: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(bucket, key, plays, expected, lift, up, years) from counts(artist_id, year, bucket, n) and shares(artist_id, tag, share).

    Within a year a key is expected in each bucket by the bucket's part of the year; cells without plays count. Sums over years are
    shrunk by prior. Buckets and keys are grouped before the grid is built, which has years x buckets x keys rows.
    """
    seen = counts.join(shares, "artist_id")
    return lift_cells(seen.groupBy("year", "bucket", F.col("tag").alias("key")).agg(F.sum(F.col("n") * F.col("share")).alias("o")), prior)


def lift_cells(observed: DataFrame, prior: float = PRIOR, least: float = MIN_EXPECTED) -> DataFrame:
    """lift from observed(year, bucket, key, o), null where fewer than least are expected. The shares of a play sum to one, so a bucket's plays are the sum of its cells."""
    covered = observed.groupBy("year", "bucket").agg(F.round(F.sum("o")).alias("b"))
    keys = observed.groupBy("year", "key").agg(F.sum("o").alias("k"))
    grid = covered.withColumn("t", F.sum("b").over(Window.partitionBy("year"))).join(keys, "year").join(observed, ["year", "bucket", "key"], "left")
    cells = grid.select("bucket", "key", "t", F.coalesce("o", F.lit(0.0)).alias("o"), (F.col("b") * F.col("k") / F.col("t")).alias("e"))
    counted = (F.col("t") >= 200) & (F.round("e", 9) >= 3)
    by = cells.groupBy("bucket", "key").agg(F.sum("o").alias("o"), F.sum("e").alias("e"), F.count_if(counted & (F.round(F.col("o") - F.col("e"), 9) > 0)).alias("up"), F.count_if(counted).alias("years"))
    value = F.when(F.round("e", 6) >= least, F.round((F.col("o") + prior) / (F.col("e") + prior), 6))
    return by.select("bucket", "key", F.round("o", 6).alias("plays"), F.round("e", 6).alias("expected"), value.alias("lift"), "up", "years")


def season_cards(cells: DataFrame, least: float = 1.2, top: int = 4) -> DataFrame:
    """The keys that stand out in each bucket: lift of at least least, above expectation in half the years or more."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("lift"), "key"))
    return cells.where((F.col("lift") >= least) & (F.col("years") > 0) & (F.col("up") * 2 >= F.col("years"))).withColumn("r", rank).where(F.col("r") <= top).select("bucket", "key", "lift")


def drift(observed: DataFrame, top: int = 5) -> DataFrame:
    """Per year of observed(year, key, o) the shares of the keys that are biggest overall, and of all the others together (key null)."""
    cells = observed.groupBy("year", "key").agg(F.sum("o").alias("o"))
    biggest = cells.groupBy("key").agg(F.round(F.sum("o"), 6).alias("s")).orderBy(F.desc("s"), "key").limit(top).select("key", F.col("key").alias("shown"))
    rows = cells.join(F.broadcast(biggest), "key", "left").groupBy("year", "shown").agg(F.sum("o").alias("o"))
    total = F.sum("o").over(Window.partitionBy("year"))
    return rows.select("year", F.col("shown").alias("key"), F.round(F.col("o") / total, 6).alias("share"))


def diversity(plays: DataFrame, shares: DataFrame, least: float = 50) -> DataFrame:
    """Per month the effective number of genres, exp of the entropy."""
    by = plays.groupBy("artist_id", F.trunc("lday", "month").alias("month")).agg(F.count("*").alias("n")).join(shares, "artist_id")
    cells = by.groupBy("month", "tag").agg(F.sum(F.col("n") * F.col("share")).alias("o"))
    p = F.col("o") / F.sum("o").over(Window.partitionBy("month"))
    rows = cells.withColumns({"p": p, "t": F.sum("o").over(Window.partitionBy("month"))}).where(F.round("t", 6) >= least)
    return rows.groupBy("month").agg(F.round(F.exp(-F.sum(F.col("p") * F.log("p"))), 6).alias("diversity"))


def circ_year_vectors(plays: DataFrame, least: int = 3) -> DataFrame:
    """Per artist and year of at least least plays, the mean direction of the plays on the circle of the year."""
    angle = 2 * math.pi * (F.dayofyear("lday") - 1) / 365.25
    by = plays.groupBy("artist_id", F.year("lday").alias("year")).agg(F.count("*").alias("n"), F.avg(F.cos(angle)).alias("x"), F.avg(F.sin(angle)).alias("y"))
    return by.where(F.col("n") >= least).select("artist_id", "year", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def seasonal_artists(plays: DataFrame, strength: float = 0.5, least: int = 30, years: int = 3) -> DataFrame:
    """Artists whose plays gather around one time of the year in most years."""
    vectors = circ_year_vectors(plays)
    by = plays.groupBy("artist_id").agg(F.count("*").alias("plays"), F.countDistinct(F.year("lday")).alias("n_years")).where((F.col("plays") >= least) & (F.col("n_years") >= years))
    mean = vectors.groupBy("artist_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("valid")).where(F.col("valid") >= years)
    r = F.round(F.hypot("x", "y"), 6)
    peak = F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi)) * 365.25 / (2 * math.pi)
    found = mean.withColumns({"r": r, "peak": F.round(peak, 4)}).where(F.col("r") >= strength)
    own = F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi)) * 365.25 / (2 * math.pi)
    apart = F.abs(F.col("own") - F.col("peak"))
    agree = vectors.withColumn("own", own).select("artist_id", "own").join(found.select("artist_id", "peak", "r", "valid"), "artist_id").withColumn("close", F.least(apart, 365.25 - apart) <= 30)
    near = agree.groupBy("artist_id", "peak", "r", "valid").agg(F.count_if("close").alias("agree")).where("agree >= 0.6 * valid")
    return near.join(by, "artist_id").select("artist_id", "plays", "n_years", "r", "peak", "agree")


def season_artists(plays: DataFrame, least: int = 30, lift_least: float = 1.3, top: int = 5) -> DataFrame:
    """Artists that stand out in a season, each its own key with share one."""
    counts = saved(dim_counts(plays, "season"))  # read four times below
    own = counts.groupBy("artist_id").agg(F.sum("n").alias("p")).where(F.col("p") >= least).select("artist_id", F.col("artist_id").alias("tag"), F.lit(1.0).alias("share"))
    cells = lift(counts, own).where((F.col("plays") >= least) & (F.col("lift") >= lift_least) & (F.col("years") > 0) & (F.col("up") * 2 >= F.col("years")))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("lift"), "key"))
    return cells.withColumn("r", rank).where(F.col("r") <= top).select("bucket", F.col("key").alias("artist_id"), "lift")


def tag_months(cells: DataFrame, tag: str) -> DataFrame:
    """The twelve months of one tag from month cells; a month without a cell is null, and no month at all gives no rows."""
    own = cells.where(F.col("key") == tag).select(F.col("bucket").alias("month"), "lift", "plays")
    axis = cells.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    some = own.limit(1).select(F.lit(1).alias("one"))
    return axis.join(own, "month", "left").crossJoin(F.broadcast(some)).select("month", "lift", "plays")


def diversity_by_month(monthly: DataFrame) -> DataFrame:
    """The mean diversity of each calendar month of rows (month, diversity)."""
    return monthly.groupBy(F.month("month").alias("month")).agg(F.round(F.avg("diversity"), 5).alias("diversity"), F.count("*").alias("months"))


def matrix(cells: DataFrame, rows: int = 12) -> DataFrame:
    """The cells of the keys with most plays, in long form."""
    top = F.broadcast(cells.groupBy("key").agg(F.round(F.sum("plays"), 4).alias("s")).orderBy(F.desc("s"), "key").limit(rows).select("key"))
    return cells.join(top, "key").select("key", "bucket", "lift")


def seasonal_status(found: DataFrame, span: DataFrame, soon_days: int = 28) -> DataFrame:
    """(artist_id, status, starts_in_days) of seasonal artists against the newest day: now, soon or null; a season is the peak and its spread on both sides."""
    year = 365.25
    spread = F.greatest(F.lit(7.0), F.least(F.lit(60.0), F.sqrt(-2 * F.log("r")) * year / (2 * math.pi)))
    today = F.dayofyear(local_parts(F.col("hi"))[0]) - 1
    rows = found.crossJoin(F.broadcast(span.select("hi"))).withColumns({"spread": spread, "today": today})
    apart = F.pmod(F.abs(F.col("peak") - F.col("today")), F.lit(year))
    start = F.pmod(F.col("peak") - F.col("today") - F.col("spread"), F.lit(year))
    status = F.when(F.least(apart, year - apart) <= F.col("spread"), "now").when(start <= soon_days, "soon")
    return rows.select("artist_id", status.alias("status"), F.rint(start).cast("int").alias("starts_in_days"))
