"""Derived tables: sessions, artist statistics, gateways and co-listening links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.model import ORDER, local_parts

SESSION_GAP, PREHISTORY_DAYS = 1800, 30
SESSION_ARTISTS, MIN_SHARED = 30, 3


def marked(plays: DataFrame, gap: int = SESSION_GAP, by: tuple[str, ...] = ()) -> DataFrame:
    """plays with in_day: how many breaks of more than gap seconds lie before a play on its day. A window's key is (listener, day)."""
    day = Window.partitionBy(*by, "lday").orderBy(*ORDER)
    away = F.coalesce(F.col("ts") - F.lag("ts").over(day) > gap, F.lit(False)).cast("long")
    running = F.sum("__break").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return plays.drop("lyear").withColumn("__break", away).withColumn("in_day", running).drop("__break")


def marked_once(raw: DataFrame, gap: int = SESSION_GAP, zone: str = "UTC", keep: tuple[str, ...] = (), seen: dict[str, Column] | None = None) -> DataFrame:
    """marked(ingest(raw)) with lyear and the columns keep, in one shuffle and one sort of the raw plays: equal ones lie side by side on their day, the smallest album_id first.

    Rows of a task are in the order of lyear, so that a table by year is written without another sort. Of equal plays and albums the largest of keep comes first;
    seen are windows over (lyear, lday, and what follows in the order) of all equal plays, taken before one is kept.
    """
    rows = raw.select((F.col("ts") - F.pmod("ts", F.lit(60))).alias("ts"), *ORDER[1:], "album_id", *keep)
    rows = rows.withColumn("lday", local_parts(F.col("ts"), zone)[0]).withColumn("lyear", F.year("lday"))
    day = Window.partitionBy("lyear", "lday").orderBy(*ORDER, F.col("album_id").asc_nulls_last(), *[F.desc(c) for c in keep])
    again = F.lag(F.lit(True)).over(day)
    for c in ORDER:
        again = again & F.col(c).eqNullSafe(F.lag(c).over(day))
    away = F.coalesce(F.col("ts") - F.lag("ts").over(day) > gap, F.lit(False)).cast("long")
    running = F.sum("__break").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumns({"__again": F.coalesce(again, F.lit(False)), "__break": away}).withColumns({"in_day": running, **(seen or {})}).where("not __again")
    _, hour, weekday = local_parts(F.col("ts"), zone)
    return found.select(*ORDER, "album_id", "lday", hour.alias("lhour"), weekday.alias("lwday"), "in_day", "lyear", *keep, *(seen or {}))


def listening_days(breaks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a listener and day of marked() plays: first and last play, breaks, plays."""
    return breaks.groupBy(*by, "lday").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("in_day").alias("breaks"), F.count("*").alias("plays"))


def numbered(breaks: DataFrame, days: DataFrame, gap: int = SESSION_GAP, by: tuple[str, ...] = ()) -> DataFrame:
    """marked() plays with session_id 1..n of each listener: a day's first play looks at the newest play of the day before, in a
    table of one row per listener and day, whose running sum of breaks gives each day its offset."""
    order = Window.partitionBy(*by).orderBy("lday")  # over one row per day
    opened = days.withColumn("opens", F.coalesce(F.col("first") - F.lag("last").over(order) > gap, F.lit(True)).cast("long"))
    before = F.sum(F.col("opens") + F.col("breaks")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("breaks")
    offsets = opened.select(*by, "lday", before.alias("__offset"))
    return breaks.join(offsets, [*by, "lday"]).withColumn("session_id", F.col("__offset") + F.col("in_day")).drop("__offset", "in_day")


def sessionize(plays: DataFrame, gap: int = SESSION_GAP, by: tuple[str, ...] = ()) -> DataFrame:
    """plays with session_id: a new session after more than gap seconds without a play, of each listener where by names who listens.

    No global sort and no window wider than a listener's day; the log itself is shuffled once.
    """
    breaks = marked(plays, gap, by)
    return numbered(breaks, listening_days(breaks, by), gap, by)


def artist_stats(sessions: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Per artist: plays, first and last play, distinct tracks, days, years and sessions, first track, prehistory. start(lo) is when the log begins, else the first of sessions."""
    return with_prehistory(artist_totals(sessions), sessions.agg(F.min("ts").alias("lo")) if start is None else start)


def artist_totals(sessions: DataFrame) -> DataFrame:
    """artist_stats without what depends on when the log begins.

    Plays are shuffled once, by artist. In the order of days and times, days, years and session numbers of a listener do not fall, so what is distinct is counted where it changes.
    """
    mine = Window.partitionBy("artist_id").orderBy("lday", "ts")
    other = lambda of: F.coalesce(of(F.col("lday")) != of(F.lag("lday").over(mine)), F.lit(True))
    rows = sessions.select("artist_id", "ts", "track_id", "lday", "session_id").withColumns({
        "__day": other(lambda c: c), "__year": other(F.year), "__visit": F.coalesce(F.col("session_id") != F.lag("session_id").over(mine), F.lit(True)),
        "__first": F.min("ts").over(Window.partitionBy("artist_id"))})
    return rows.groupBy("artist_id").agg(
        F.count("*").alias("plays"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("lday").alias("first_lday"), F.countDistinct("track_id").alias("n_tracks"),
        F.count_if("__day").alias("n_days"), F.count_if("__year").alias("n_years"), F.count_if("__visit").alias("n_sessions"), F.min(F.when(F.col("ts") == F.col("__first"), F.col("track_id"))).alias("first_track_id"))


def with_prehistory(totals: DataFrame, start: DataFrame) -> DataFrame:
    """artist_totals with prehistory: 1 for artists of the first days of a log, which it does not discover."""
    flag = (F.col("first_ts") < F.col("lo") + PREHISTORY_DAYS * 86400).cast("int")
    rows = totals.crossJoin(F.broadcast(start.select("lo"))).withColumn("prehistory", flag)
    return rows.select(*[c for c in totals.columns if c != "first_track_id"], "prehistory", "first_track_id")


def entrances(sessions: DataFrame) -> DataFrame:
    """(artist_id, first_ts, gateway_id): an artist's first play and the artist played just before it in its session."""
    before = F.lag("artist_id").over(Window.partitionBy("session_id").orderBy(*ORDER))
    first = sessions.withColumn("gateway_id", before).groupBy("artist_id").agg(F.min(F.struct(*ORDER, "gateway_id")).alias("f"))
    return first.select("artist_id", F.col("f.ts").alias("first_ts"), F.col("f.gateway_id").alias("gateway_id"))


def discovered(entered: DataFrame, start: DataFrame) -> DataFrame:
    """(artist_id, gateway_id) of entrances after the first days of a log."""
    return entered.crossJoin(F.broadcast(start.select("lo"))).where(F.col("first_ts") >= F.col("lo") + PREHISTORY_DAYS * 86400).select("artist_id", "gateway_id")


def gateway(sessions: DataFrame) -> DataFrame:
    """(artist_id, gateway_id) of discovered artists: the artist played just before the first play, in its session."""
    return discovered(entrances(sessions), sessions.agg(F.min("ts").alias("lo")))


def visits(sessions: DataFrame, keep: int = SESSION_ARTISTS) -> DataFrame:
    """(session_id, artist_id): a session counts with its keep most played artists, which bounds its pairs, so no session can blow up a self-join."""
    heard = sessions.groupBy("session_id", "artist_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "artist_id"))
    return heard.withColumn("r", rank).where(F.col("r") <= keep).select("session_id", "artist_id")


def pair_counts(seen: DataFrame) -> DataFrame:
    """(a, b, shared) of artists that share visits."""
    pairs = seen.withColumnRenamed("artist_id", "a").join(seen.withColumnRenamed("artist_id", "b"), "session_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def scored_links(pairs: DataFrame, sizes: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(a, b, shared, score) of pairs of at least min_shared visits; sizes is (artist_id, n)."""
    scored = pairs.where(F.col("shared") >= min_shared).join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return scored.select("a", "b", "shared", (F.col("shared") / F.sqrt(F.col("na") * F.col("nb"))).alias("score"))


def co_links(sessions: DataFrame, keep: int = SESSION_ARTISTS, min_shared: int = MIN_SHARED) -> DataFrame:
    """(a, b, shared, score): artists that share sessions."""
    seen = visits(sessions, keep)
    return scored_links(pair_counts(seen), seen.groupBy("artist_id").agg(F.count("*").alias("n")), min_shared)


def related(links: DataFrame, limit: int = 15) -> DataFrame:
    """Both directions of the links, the limit strongest per artist."""
    both = links.select(F.col("a").alias("artist_id"), F.col("b").alias("other_id"), "shared", "score").unionByName(links.select(F.col("b").alias("artist_id"), F.col("a").alias("other_id"), "shared", "score"))
    rank = F.row_number().over(Window.partitionBy("artist_id").orderBy(F.desc(F.round("score", 9)), "other_id"))
    return both.withColumn("r", rank).where(F.col("r") <= limit).drop("r")
