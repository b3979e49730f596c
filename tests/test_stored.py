"""A log that takes new rows gives the tables of one full build."""

import pytest
from pyspark.sql import functions as F

from playlog.model import PlayLog
from playlog.operators import derive
from playlog.streaming.stored import OVERLAP_S, Snapshots, StoredLog

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def full(spark):
    log = PlayLog(spark, SF, "supp")
    return log, log.plays.select("ts", "artist_id", "track_id", "album_id").cache()


def same(stored, log):
    assert rows(stored.sessions.drop("lmonth")) == rows(log.sessions.drop("lyear"))
    assert rows(stored.stats) == rows(derive.artist_stats(log.sessions)) and rows(stored.gateway) == rows(derive.gateway(log.sessions))
    assert rows(stored.links) == rows(derive.co_links(log.sessions))


def test_two_batches_are_one_build(spark, full, tmp_path):
    log, plays = full
    stored = StoredLog(spark, str(tmp_path / "log"))
    assert stored.since() is None and stored.plays.count() == 0
    late = (F.col("ts") / 60) % 5 == 0  # all over the log, between plays that were there
    first = stored.merge(plays.where(~late), "first", 1)
    assert first["duplicates"] == 0 and first["rows_added"] == plays.where(~late).count()
    again = plays.where(late | (F.col("ts") > 800_000_000))
    second = stored.merge(again, "second", 2)
    assert second["rows_read"] == again.count() and second["rows_added"] == plays.where(late).count()
    same(stored, log)
    version = stored.version
    assert stored.merge(again, "second", 3)["rows_added"] == 0 and stored.version == version  # nothing is even written
    assert [r.label for r in stored.imports().orderBy("at").collect()] == ["first", "second", "second"]
    assert stored.since() == plays.agg(F.max("ts")).first()[0] - OVERLAP_S and stored.since(1000) == 0


def test_tables_left_behind_are_made(spark, full, tmp_path):
    log, plays = full
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.merge(plays.limit(50))
    # plays were written, then the run died
    month = F.date_format("lday", "yyyy-MM")
    from playlog.model import ingest

    whole = derive.marked(ingest(plays)).withColumn("lmonth", month)
    whole.write.mode("overwrite").partitionBy("lmonth").parquet(f"{stored.folder}/plays")
    assert stored.repair() == ["totals", "entrances", "pairs", "sizes"] and stored.repair() == []
    same(stored, log)


def test_odd_rows_are_not_taken(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"))
    table = spark.createDataFrame([(60, 1, 1, 7), (61, 1, 1, 5), (None, 1, 1, 1), (60, None, 1, 1), (60, 1, None, 1)], "ts long, artist_id long, track_id long, album_id long")
    assert stored.merge(table) == {"rows_read": 5, "rows_added": 1, "duplicates": 4}
    assert [(r.ts, r.album_id) for r in stored.plays.collect()] == [(60, 5)]
    assert stored.merge(table.limit(0)) == {"rows_read": 0, "rows_added": 0, "duplicates": 0}


def test_a_stream_that_is_started_again(spark, full, tmp_path):
    _, plays = full
    plays.where("ts % 120 = 0").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stored = StoredLog(spark, str(tmp_path / "log"))

    def run():
        source = spark.readStream.schema(plays.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        source.writeStream.foreachBatch(stored.into()).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    plays.where("ts % 120 <> 0 or ts % 240 = 0").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    run()
    assert stored.plays.count() == plays.count() and [r.rows_added > 0 for r in stored.imports().collect()] == [True, True]


def test_whole_lists_replace_each_other(spark, tmp_path):
    schema = "artist_key string, title_key string, loved_at long"
    held = Snapshots(spark, str(tmp_path / "loved"), ("artist_key", "title_key"), "loved_at")
    table = lambda *r: spark.createDataFrame(list(r), schema)
    assert held.current() is None
    assert held.replace(table(("a", "x", 5), ("a", "x", 3), ("b", "y", 1), ("c", None, 1))) == {"rows": 2, "changed": True}
    assert sorted(map(tuple, held.current().collect())) == [("a", "x", 3), ("b", "y", 1)]
    assert held.replace(table(("b", "y", 1), ("a", "x", 3))) == {"rows": 2, "changed": False}
    with pytest.raises(ValueError):
        held.replace(table(("b", "y", 1)), expected=100)
    assert held.current().count() == 2
    held.into()(table(), 0)  # no answer
    held.into()(table(("d", "z", 9)), 1)
    assert [tuple(r) for r in held.current().collect()] == [("d", "z", 9)]
