"""Insight lists over artist statistics, loved tracks and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def forgotten(stats: DataFrame, span: DataFrame, plays: int = 20, days: int = 365) -> DataFrame:
    """Artists of at least plays plays, the last one more than days before the newest play."""
    return stats.crossJoin(F.broadcast(span)).where((F.col("last_ts") < F.col("hi") - days * DAY) & (F.col("plays") >= plays)).select("artist_id", "plays", "last_ts")


def rising(plays: DataFrame, span: DataFrame, least: int = 8, growth: float = 1.25) -> DataFrame:
    """Artists of the last 90 days against the 365 days before, by smoothed growth."""
    rows = plays.crossJoin(F.broadcast(span)).where(F.col("ts") > F.col("hi") - (90 + 365) * DAY)
    now = F.col("ts") > F.col("hi") - 90 * DAY
    by = rows.groupBy("artist_id").agg(F.count_if(now).alias("recent"), F.count_if(~now).alias("before"))
    rate = F.round((F.col("recent") + 1) / (F.col("before") * 90 / 365 + 1), 6)
    return by.withColumn("growth", rate).where((F.col("recent") >= least) & (F.col("growth") >= growth))


def gateways(stats: DataFrame, gateway: DataFrame) -> DataFrame:
    """Per gateway artist the artists it led to, and their plays."""
    led = gateway.where("gateway_id is not null").join(stats.select("artist_id", "plays"), "artist_id")
    return led.groupBy("gateway_id").agg(F.count("*").alias("led_to"), F.sum("plays").alias("downstream"))


def love_timing(plays: DataFrame, loved: DataFrame, in_progress: int = 600) -> DataFrame:
    """Per loved track: first play, plays, and plays finished before the love; one begun within in_progress seconds does not count."""
    rows = plays.join(loved.select("track_id", "loved_at"), "track_id")
    before = F.col("ts") <= F.col("loved_at")
    by = rows.groupBy("track_id", "artist_id", "loved_at").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("plays"), F.count_if(before).alias("n"), F.max(F.when(before, F.col("ts"))).alias("latest"))
    running = F.coalesce((F.col("latest") > F.col("loved_at") - in_progress).cast("long"), F.lit(0))
    return by.select("track_id", "artist_id", "loved_at", "first_ts", "last_ts", "plays", (F.col("n") - running).alias("plays_before"))


def instant_love(timing: DataFrame, span: DataFrame) -> DataFrame:
    early = (F.col("plays_before") <= 2) & (F.col("loved_at") >= F.col("first_ts") - DAY) & (F.col("first_ts") >= F.col("lo") + 30 * DAY)
    return timing.crossJoin(F.broadcast(span)).where(early).select("track_id", "loved_at", "plays_before")


def slow_burners(timing: DataFrame, least: int = 10) -> DataFrame:
    return timing.where(F.col("plays_before") >= least).select("track_id", "loved_at", "plays_before")


def loved_left(timing: DataFrame, span: DataFrame, days: int = 365) -> DataFrame:
    return timing.crossJoin(F.broadcast(span)).where(F.col("last_ts") < F.col("hi") - days * DAY).select("track_id", "plays", "last_ts")


def unloved(plays: DataFrame, loved: DataFrame, limit: int = 50) -> DataFrame:
    """The most played tracks that are not loved; nothing if nothing is loved."""
    some = loved.limit(1).select(F.lit(1).alias("one"))
    rows = plays.join(loved.select("track_id"), "track_id", "left_anti").groupBy("track_id").agg(F.count("*").alias("plays"))
    return rows.crossJoin(F.broadcast(some)).orderBy(F.desc("plays"), "track_id").limit(limit).select("track_id", "plays")


def loved_by_artist(loved: DataFrame) -> DataFrame:
    n = F.count("*")
    return loved.groupBy("artist_id").agg(n.alias("loved"), (1 + 0.5 * F.least(n, F.lit(4))).alias("boost"))


def rediscover(plays: DataFrame, links: DataFrame, loved: DataFrame, span: DataFrame, limit: int = 50) -> DataFrame:
    """Artists not heard for a year that link to the 20 most played of the last 90 days, ranked by link strength,
    plays and loves. Only the 20 core artists are broadcast."""
    now = plays.crossJoin(F.broadcast(span))
    core = now.where(F.col("ts") > F.col("hi") - 90 * DAY).groupBy("artist_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artist_id").limit(20).select(F.col("artist_id").alias("core_id"))
    by = now.groupBy("artist_id").agg(F.count("*").alias("plays"), F.max("ts").alias("last_ts"), F.max("hi").alias("hi"))
    stale = by.join(loved.groupBy("artist_id").agg(F.count("*").alias("loved")), "artist_id", "left").withColumn("loved", F.coalesce("loved", F.lit(0)))
    stale = stale.where((F.col("last_ts") < F.col("hi") - 365 * DAY) & ((F.col("plays") >= 5) | (F.col("loved") > 0)))
    both = links.select(F.col("a").alias("artist_id"), F.col("b").alias("core_id"), "score").unionByName(links.select(F.col("b").alias("artist_id"), F.col("a").alias("core_id"), "score"))
    near = both.join(F.broadcast(core), "core_id").groupBy("artist_id").agg(F.sum("score").alias("link"))
    loves = F.when(F.col("plays") < 5, F.least("loved", F.lit(1))).otherwise(F.least("loved", F.lit(4)))
    rank = F.round(F.col("link") * F.log1p("plays") * (1 + 0.5 * loves), 6)
    return near.join(stale, "artist_id").select("artist_id", "plays", "loved", rank.alias("rank")).orderBy(F.desc("rank"), "artist_id").limit(limit)


def graph_edges(links: DataFrame, stats: DataFrame, nodes: int = 120) -> DataFrame:
    """Links between the most played artists."""
    top = F.broadcast(stats.orderBy(F.desc("plays"), "artist_id").limit(nodes).select("artist_id"))
    return links.join(top.withColumnRenamed("artist_id", "a"), "a", "left_semi").join(top.withColumnRenamed("artist_id", "b"), "b", "left_semi").select("a", "b", "shared", "score")


def label_propagation(edges: DataFrame, stats: DataFrame, rounds: int = 30) -> DataFrame:
    """(artist_id, cluster) of the bounded graph: labels are updated in order of plays, ties take the lowest label.

    The order matters to the result, so one group does it; the graph has at most the nodes that graph_edges kept.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        weight: dict[int, int] = {}
        for r in pdf.itertuples():
            near.setdefault(r.a, []).append((r.b, r.score))
            near.setdefault(r.b, []).append((r.a, r.score))
            weight[r.a], weight[r.b] = r.pa, r.pb
        order = sorted(near, key=lambda x: (-weight[x], x))
        label = {x: i for i, x in enumerate(order)}
        for _ in range(rounds):
            before = dict(label)
            for x in order:
                score: dict[int, float] = {}
                for y, s in near[x]:
                    score[label[y]] = score.get(label[y], 0.0) + s
                label[x] = min(score, key=lambda k: (-round(score[k], 9), k))
            if label == before:
                break
        return pd.DataFrame({"artist_id": order, "cluster": [label[x] for x in order]})

    sized = edges.join(stats.select(F.col("artist_id").alias("a"), F.col("plays").alias("pa")), "a").join(stats.select(F.col("artist_id").alias("b"), F.col("plays").alias("pb")), "b")
    return sized.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "artist_id long, cluster long")


def artist_monthly(plays: DataFrame, months: DataFrame, artist_id: int) -> DataFrame:
    by = plays.where(F.col("artist_id") == artist_id).groupBy(F.trunc("lday", "month").alias("month")).agg(F.count("*").alias("n"))
    return months.join(by, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("plays"))


def library_artist(stats: DataFrame, artists: DataFrame, loved: DataFrame, q: str = "", limit: int = 100) -> DataFrame:
    """Artists whose name holds q, with plays, loved tracks and their share of the artist's tracks, and the total count."""
    rows = artists.where(F.contains(F.lower("name"), F.lit(q.lower()))).join(stats, "artist_id").join(loved_by_artist(loved), "artist_id", "left")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.select("artist_id", "name", "plays", "n_tracks", F.coalesce("loved", F.lit(0)).alias("loved")).orderBy(F.desc("plays"), "artist_id").limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("loved_rate", F.col("loved") / F.col("n_tracks"))
