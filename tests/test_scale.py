"""What keeps the large tables' work in proportion to them."""

import datetime
import random

from pyspark.sql import functions as F

from playlog.functions.text import keyed
from playlog.functions.titles import loose_title
from playlog.model import ingest, left_by
from playlog.operators import derive, editions, genres, library, resolve
from playlog.store import size_of
from playlog.streaming.stored import StoredLog


def test_the_first_pair_of_weekdays_is_among_fourteen_rows(spark):
    rng = random.Random(1)
    for _ in range(12):
        cells = rng.sample([(a, d) for a in range(1, 5) for d in range(7)], rng.randint(2, 12))
        rows = sorted(((-rng.randint(1, 3), a, d) for a, d in cells))
        want = next(((x, y) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[1] != y[1] and x[2] != y[2]), None)
        table = spark.createDataFrame([(a, d, -n) for n, a, d in rows], "artist_id long, lwday int, plays long")
        kept = [(-r.plays, r.artist_id, r.lwday) for r in library.first_of_weekdays(table).orderBy("r").collect()]
        assert len(kept) <= 14 and next(((x, y) for i, x in enumerate(kept) for y in kept[i + 1 :] if x[1] != y[1] and x[2] != y[2]), None) == want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plays_are_marked_with_one_shuffle(spark):
    rng = random.Random(2)
    some = [(rng.randrange(0, 4 * 86400, 20), rng.randrange(3), rng.randrange(3), rng.choice([None, 1, 2])) for _ in range(3000)]
    raw = spark.createDataFrame(some + [(5, None, 1, 4), (6, None, 1, 3)], "ts long, artist_id long, track_id long, album_id long")
    got = derive.marked_once(raw, 300)
    want = derive.marked(ingest(raw), 300)
    assert sorted(map(tuple, got.drop("lyear").collect()), key=repr) == sorted(map(tuple, want.select(*got.drop("lyear").columns).collect()), key=repr)
    assert exchanges(got) == 1 and exchanges(want) > 1


def test_totals_and_counts_take_one_shuffle(spark):
    rng = random.Random(3)
    raw = spark.createDataFrame([(rng.randrange(0, 900 * 86400, 60), rng.randrange(5), rng.randrange(9), None) for _ in range(2000)], "ts long, artist_id long, track_id long, album_id long")
    sessions = derive.sessionize(ingest(raw)).localCheckpoint()
    totals = derive.artist_totals(sessions)
    want = {}
    for r in sessions.collect():
        want.setdefault(r.artist_id, []).append((r.ts, r.track_id, r.lday, r.session_id))
    for r in totals.collect():
        own = sorted(want.pop(r.artist_id))
        count = lambda f: len({f(x) for x in own})
        assert tuple(r)[1:] == (len(own), own[0][0], own[-1][0], own[0][2], count(lambda x: x[1]), count(lambda x: x[2]), count(lambda x: x[2].year), count(lambda x: x[3]), own[0][1])
    assert not want and exchanges(derive.artist_totals(sessions)) == 1 and exchanges(genres.calendar_counts(sessions)) == 1


def test_counts_by_calendar_are_sorted_in_tasks_of_the_data(spark, tmp_path):
    rng = random.Random(5)
    rows = ingest(spark.createDataFrame([(rng.randrange(0, 900 * 86400, 60), rng.randrange(50), rng.randrange(9), None) for _ in range(2000)], "ts long, artist_id long, track_id long, album_id long"))
    rows.write.partitionBy("lhour").parquet(str(tmp_path / "plays of a log"))
    plays = spark.read.parquet(str(tmp_path / "plays of a log"))
    assert size_of(plays) == sum(f.stat().st_size for f in (tmp_path / "plays of a log").rglob("*.parquet")) > 0
    few, many = genres.calendar_counts(plays), genres.calendar_counts(plays, 21)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and exchanges(many) == 1  # cells are not held in a hash table
    assert many.rdd.getNumPartitions() == 21
    want = {}
    for r in plays.collect():
        d = r.lday
        for key in (("month", d.year, d.month), ("season", d.year + (d.month == 12), d.month % 12 // 3), ("daypart", d.year, r.lhour // 6), ("weekpart", d.year, int(r.lwday >= 5))):
            want[r.artist_id, *key] = want.get((r.artist_id, *key), 0) + 1
    for got in (few, many):
        assert {tuple(r)[:4]: r.n for r in got.collect()} == want and got.count() == len(want)


def test_small_and_large_batches_are_one_build(spark, tmp_path):
    rng = random.Random(4)
    raw = spark.createDataFrame([(rng.randrange(0, 200 * 86400, 60), rng.randrange(12), rng.randrange(40), rng.choice([None, 1, 2])) for _ in range(1500)], "ts long, artist_id long, track_id long, album_id long").localCheckpoint()
    stored = StoredLog(spark, str(tmp_path / "log"), min_shared=1)
    late = F.col("ts") / 60 % 25 == 0
    stored.merge(raw.where(~late))
    assert stored.store.numbers("totals", stored.version)[0] is None  # of all plays, so made when it is read
    stored.merge(raw.where(late))
    assert all(stored.store.numbers(n, stored.version)[0] for n in ("totals", "entrances", "pairs", "sizes"))  # a small batch is brought in at once
    sessions = derive.sessionize(ingest(raw)).localCheckpoint()
    for got, want in ((stored.stats, derive.artist_stats(sessions)), (stored.gateway, derive.gateway(sessions)), (stored.links, derive.co_links(sessions, min_shared=1))):
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_plays_without_an_album_do_not_meet_in_one_task(spark):
    rows = spark.range(1000).select(F.col("id").alias("ts"), (F.col("id") % 9).alias("artist_id"), F.col("id").alias("track_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 100).alias("album_id"))
    facts = spark.range(0, 60).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = left_by(rows, facts, "album_id", "from_id")
        want = rows.join(facts, F.col("album_id") == F.col("from_id"), "left")
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        spark.conf.set("spark.sql.adaptive.enabled", False)
        assert most(got) < 400 < most(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_titles_are_worked_on_once_where_a_filter_or_a_join_follows(spark, tmp_path):
    rows = [(t, t // 9, f"Song {t % 3}" + " (Remastered 2011)" * (t % 2)) for t in range(90)]
    spark.createDataFrame(rows, "track_id long, artist_id long, title string").write.parquet(str(tmp_path / "tracks"))
    tracks = spark.read.parquet(str(tmp_path / "tracks"))
    entries = spark.createDataFrame([("a", "song 0 (live)", 1), ("b", "sung", 2), ("c", "", 3)], "artist_key string, title_key string, artist_id long")
    filtered, joined = keyed(tracks, "title", loose_title).where("key <> ''"), editions.edition_rules(editions.with_keys(tracks).groupBy(*editions.GROUP).agg(F.min("track_id").alias("target_id")), tracks, "track_id")
    found = resolve.title_suggestions(entries, tracks, tracks)
    for df in (filtered, joined, found):  # in the tree of the plan, every branch that has Python has the distinct titles, or pairs of them, below it
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        python = [i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith("ArrowEvalPython")]
        assert python
        for i in python:
            below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
            assert any(x.lstrip(" :+-").startswith("Aggregate") for x in below), "\n".join(lines)
    assert filtered.count() == 90
    assert [tuple(r) for r in found.orderBy("artist_key", "rank").collect()] == [("a", "song 0 (live)", 1, 9, 1), ("a", "song 0 (live)", 2, 12, 1), ("a", "song 0 (live)", 3, 15, 1)]


def test_season_artists_reads_the_plays_once(spark, tmp_path):
    rng = random.Random(6)
    some = [(a, datetime.date(y, rng.choice([12, 1, 2] if a == 1 and i % 2 else range(1, 13)), 5)) for a in range(1, 6) for y in (2001, 2002, 2003) for i in range(200)]
    spark.createDataFrame(some, "artist_id long, lday date").write.parquet(str(tmp_path / "plays"))
    plays = spark.read.parquet(str(tmp_path / "plays"))
    got = genres.season_artists(plays)
    assert got.inputFiles() and not set(got.inputFiles()) & set(plays.inputFiles())  # counts of it are stored, and only they are read again
    counts = genres.dim_counts(plays, "season")
    own = plays.select("artist_id", F.col("artist_id").alias("tag"), F.lit(1.0).alias("share")).distinct()
    want = genres.lift(counts, own).where("lift >= 1.3 and up * 2 >= years").select("bucket", F.col("key").alias("artist_id"), "lift")
    assert [r[:2] for r in got.collect()] == [(0, 1)] and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
