"""Structured Streaming forms of ingest: idempotent plays and keyed sessions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "24 hours"


def event_plays(events: DataFrame) -> DataFrame:
    """Plays of the events table: listener, artist, track and event time."""
    return events.select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("listener_id"), F.col("event_type").alias("artist"), F.get_json_object("props", "$.k").cast("int").alias("track"))


def deduplicated(plays: DataFrame, late: str = LATE) -> DataFrame:
    """One play per (minute, listener, artist, track), late ones accepted for a day; the state is dropped behind the watermark."""
    rows = plays.withColumn("minute", F.date_trunc("minute", "at")).withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark(["minute", "listener_id", "artist", "track"])


def sessions(plays: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """Listening sessions per listener: start, end of the last play's gap, plays."""
    rows = plays.withWatermark("at", late) if plays.isStreaming else plays
    return rows.groupBy("listener_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("plays")).select("listener_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "plays")


def read_events(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """The events of a folder as a stream of files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def first_seen(plays: DataFrame) -> DataFrame:
    """(listener_id, artist, at): the first play of each artist; of a stream, the first to arrive."""
    if plays.isStreaming:
        return plays.select("listener_id", "artist", "at").dropDuplicates(["listener_id", "artist"])
    return plays.groupBy("listener_id", "artist").agg(F.min("at").alias("at"))


GAP = timedelta(hours=6)


def _led(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New artists of one listener in plays that arrived, each with the artist of the play before, if that is not long ago."""
    last, at, seen = state.get if state.exists else (None, None, [])
    known, out = set(seen), []
    for play in pd.concat(batches).sort_values(["at", "artist", "track"]).itertuples(index=False):
        if play.artist not in known:
            near = at is not None and play.at - pd.Timestamp(at) <= GAP
            out.append((key[0], play.artist, play.at, last if near else None))
            known.add(play.artist)
        last, at = play.artist, play.at
    state.update((last, pd.Timestamp(at).to_pydatetime(), sorted(known)))
    yield pd.DataFrame(out, columns=["listener_id", "artist", "at", "gateway"])


def gateways(plays: DataFrame) -> DataFrame:
    """(listener_id, artist, at, gateway): the first play of each artist and the artist played before it within six hours.

    A stream keeps a listener's last play and the artists heard, and takes plays in the order of arrival, sorted within a batch.
    A table is worked on by listener and day, with the last play of the day before carried in, so no listener is one task.
    """
    rows = plays.where("artist is not null and at is not null").select("listener_id", "artist", "track", "at")
    if plays.isStreaming:
        return rows.groupBy("listener_id").applyInPandasWithState(
            _led, "listener_id long, artist string, at timestamp, gateway string", "artist string, at timestamp, seen array<string>", "append", GroupStateTimeout.NoTimeout)
    days = rows.withColumns({"day": F.unix_date(F.to_date("at")), "carried": F.lit(False)})
    last = days.groupBy("listener_id", "day").agg(F.max(F.struct("at", "artist", "track")).alias("l"))
    carry = last.select("listener_id", "l.artist", "l.track", "l.at", (F.col("day") + 1).alias("day"), F.lit(True).alias("carried"))
    order = Window.partitionBy("listener_id", "day").orderBy("at", "artist", "track")
    near = F.lag("at").over(order) >= F.col("at") - F.expr("interval 6 hours")
    before = days.unionByName(carry).withColumn("gateway", F.when(near, F.lag("artist").over(order))).where("not carried")
    first = before.groupBy("listener_id", "artist").agg(F.min(F.struct("at", "track", "gateway")).alias("f"))
    return first.select("listener_id", "artist", "f.at", "f.gateway")
