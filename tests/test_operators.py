"""Operators on tiny tables with known answers."""

import pytest
from pyspark.sql import functions as F

from playlog.functions.text import csv_guard, loose_key, norm_key, parse_date
from playlog.model import ingest, local_parts
from playlog.operators import cohorts, derive, insights, library, periods, resolve
from playlog.sources.csvlog import read_csv, write_csv
from playlog.streaming import ingest as streams


def values(df, column):
    return [r[column] for r in df.collect()]


def plays(spark, rows):
    return ingest(spark.createDataFrame(rows, "ts long, artist_id long, track_id long, album_id long"))


def test_parse_date(spark):
    texts = ["22 May 2014, 20:11", "1400789483", "1400789483000", "2014-05-22T20:11:00Z", "", "yesterday", None]
    got = values(spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date(F.col("t")).alias("v")), "v")
    assert got == [1400789460, 1400789483, 1400789483, 1400789460, None, None, None]


def test_parse_date_forms(spark):
    texts = ["  1 January 1970, 00:01 ", "2 Sept 1970 10:00:07", "2 jan 1970, 24:00", "31 Feb 2014, 10:00", "1970-01-02", "1970-01-02 00:00", "1970-01-02T00:00:00+01:00", "1970-01-02T00:00:00.5", "2 Foo 1970, 10:00"]
    want = [60, 21117607, None, None, 86400, 86400, 82800, 86400, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert values(df.select(parse_date(F.col("t")).alias("v")), "v") == want
            day, hour, weekday = local_parts(F.lit(0).cast("long"), "UTC")
            assert [(str(r.d), r.h, r.w) for r in df.limit(1).select(day.alias("d"), hour.alias("h"), weekday.alias("w")).collect()] == [("1970-01-01", 0, 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_local_time_over_daylight_saving(spark):
    df = spark.createDataFrame([(1743294600,), (1743298200,), (1767220200,)], "ts long")
    day, hour, weekday = local_parts(F.col("ts"), "Europe/Helsinki")
    assert [(str(r.d), r.h, r.w) for r in df.select(day.alias("d"), hour.alias("h"), weekday.alias("w")).collect()] == [("2025-03-30", 2, 6), ("2025-03-30", 4, 6), ("2026-01-01", 0, 3)]


def test_keys_and_guard(spark):
    df = spark.createDataFrame([("The  Cure",), ("cure",), ("Sunn 0)))",), ("Sunn O)))",), ("!!!",), ("Björk & X",), (None,)], "n string")
    assert values(df.select(loose_key("n").alias("k")), "k") == ["cure", "cure", "sunno", "sunno", "", "bjorkandx", None]
    assert values(df.select(norm_key("n").alias("k")), "k")[0] == "the cure"
    assert values(df.select(csv_guard(F.lit("=Ääniwalli")).alias("k")).limit(1), "k") == ["'=Ääniwalli"]


def test_ingest_is_idempotent_and_floors_to_the_minute(spark):
    rows = [(61, 1, 1, 7), (119, 1, 1, 5), (120, 1, 1, None)]
    assert sorted((r.ts, r.album_id) for r in plays(spark, rows + rows).collect()) == [(60, 5), (120, None)]
    assert plays(spark, []).count() == 0


def test_session_gap_is_strict_and_crosses_days(spark):
    at = [0, 1800, 3660, 86340, 86400]
    got = derive.sessionize(plays(spark, [(t, 1, 1, None) for t in at])).orderBy("ts")
    assert values(got, "session_id") == [1, 1, 2, 3, 3]


def test_love_timing(spark):
    day = 86400
    log = plays(spark, [(day * i, 1, 10, None) for i in range(15)] + [(0, 2, 20, None)])
    loved = spark.createDataFrame([(10, 1, 10 * day + 3600), (20, 2, 120)], "track_id long, artist_id long, loved_at long")
    assert {r.track_id: r.plays_before for r in insights.love_timing(log, loved).collect()} == {10: 11, 20: 0}


def test_partial_dates(spark):
    df = spark.createDataFrame([("1985",), ("1994-05",), ("1962-03-09",), ("x",), (None,)], "d string")
    lo, hi = cohorts.release_span(F.col("d"))
    assert [tuple(map(str, r)) for r in df.select(cohorts.release_mid(F.col("d")), lo, hi).collect()] == [("1985-07-01", "1985-01-01", "1985-12-31"), ("1994-05-15", "1994-05-01", "1994-05-31"), ("1962-03-09",) * 3, ("None",) * 3, ("None",) * 3]


def test_velocity(spark):
    day = 86400
    steady = [(day * i, 1, 1, None) for i in range(300)]
    late = [(day * (200 + i) + 3600 + 60 * k, 2, 2, None) for i in range(30) for k in range(14)]
    log = plays(spark, steady + late)
    assert {r.artist_id: (r.days_to_100, r.days_to_500) for r in periods.days_to_n(log).collect()} == {1: (99, None), 2: (7, None)}
    assert {r.artist_id: r.plays for r in periods.fastest_30d(log).collect()} == {1: 30, 2: 420}


def test_merges_follow_chains_and_drop_collisions(spark):
    rules = resolve.resolved_rules(spark.createDataFrame([(1, 2), (2, 3)], "from_id long, to_id long"))
    assert sorted((r.from_id, r.to_id) for r in rules.collect()) == [(1, 3), (2, 3)]
    log = plays(spark, [(60, 1, 9, None), (60, 3, 9, None), (120, 2, 9, None)])
    assert sorted((r.ts, r.artist_id) for r in resolve.merge_artists(log, rules).collect()) == [(60, 3), (120, 3)]


def test_merge_chains_have_no_bound_and_circles_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1500)], "from_id long, to_id long")
    assert {r.to_id for r in resolve.resolved_rules(chain).collect()} == {1500}
    for circle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            resolve.resolved_rules(spark.createDataFrame(circle, "from_id long, to_id long"))


def test_csv_keeps_an_artist_named_like_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("artistname,song,played at,mbid\nArtist,T,1400789483,\n\nB,U,1400789484,x\n")
    got, skipped = read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r.artist, r.track_mbid) for r in got.collect()) == [("Artist", None), ("B", "x")] and skipped.first().skipped == 0


def test_double_life(spark):
    week = 7 * 86400
    log = plays(spark, [(week * i + 86400 * d + 3600, d + 1, 1, None) for i in range(6) for d in (0, 2)])
    got = library.double_life(log, "1970-01-01", "1970-12-31").orderBy("lwday").collect()
    assert [(r.lwday, r.artist_id, r.plays) for r in got] == [(3, 1, 6), (5, 3, 6)]


def test_pages(spark):
    rows = spark.range(5).select(F.col("id").alias("x"))
    assert [(r.x, r.has_more) for r in library.page(rows, ["x"], 2, 2).collect()] == [(2, True), (3, True)]
    assert [(r.x, r.has_more) for r in library.page(rows, ["x"], 2, 3).collect()] == [(3, False), (4, False)]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Artist,Album,Track,Date\nA,"x ""y""",T,"22 May 2014, 20:11"\n=B,,U,1400789483\nC,,,1400789483\n', encoding="utf-8")
    got, skipped = read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r.artist, r.album, r.ts) for r in got.collect()) == [("=B", "", 1400789483), ("A", 'x "y"', 1400789460)]
    assert skipped.first().skipped == 1
    write_csv(got, str(tmp_path / "out"))
    assert "'=B" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    stream = streams.sessions(streams.event_plays(streams.read_events(spark, folder)))
    query = stream.writeStream.format("memory").queryName("stream_sessions").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = streams.sessions(streams.event_plays(spark.read.parquet(f"{folder}/events.parquet")))
    assert sorted(map(tuple, spark.table("stream_sessions").collect())) == sorted(map(tuple, batch.collect()))
    plays_once = streams.deduplicated(streams.event_plays(streams.read_events(spark, folder)))
    query = plays_once.writeStream.format("memory").queryName("stream_plays").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("stream_plays").count() > 0


def test_label_propagation_finds_the_cliques(spark):
    """Two cliques with a weak link between them, and a pair; checked against updates in order of plays, by hand on a dictionary."""
    cliques = [(1, 2, 3, 4), (5, 6, 7), (8, 9)]
    edges = [(a, b, 3, 1.0) for c in cliques for i, a in enumerate(c) for b in c[i + 1 :]] + [(4, 5, 3, 0.5)]
    stats = [(x, 100 - x) for x in range(1, 10)]
    found = insights.label_propagation(spark.createDataFrame(edges, "a long, b long, shared long, score double"), spark.createDataFrame(stats, "artist_id long, plays long")).collect()
    label = {x: i for i, (x, _) in enumerate(stats)}
    for _ in range(30):
        for x, _ in stats:
            score = {}
            for a, b, _, s in edges:
                if x in (a, b):
                    y = b if x == a else a
                    score[label[y]] = score.get(label[y], 0) + s
            label[x] = min(score, key=lambda k: (-score[k], k))
    assert {r.artist_id: r.cluster for r in found} == label
    assert [len({label[x] for x in c}) for c in cliques] == [1, 1, 1] and len(set(label.values())) == 3
