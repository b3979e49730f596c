"""Questions in SQL that are refused, matches of credits, and streams against the same tables."""

import datetime

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from playlog.model import PlayLog
from playlog.operators import adhoc, releases
from playlog.streaming import ingest as streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", ["drop table plays", "insert into plays select 1", "select 1) ; drop view plays --", "set a=b", "select * from parquet.`/root/testdata/sf0.001/nation.parquet`", "select reflect('java.lang.System', 'exit', 1)"])
def test_only_queries_run(spark, text):
    with pytest.raises((AnalysisException, ParseException, ValueError)):
        adhoc.query_sql(PlayLog(spark, SF), text)
    assert not spark.catalog.tableExists("plays") and spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_rows_are_limited_and_views_gone(spark):
    log = PlayLog(spark, SF)
    assert adhoc.query_sql(log, "select * from plays -- all", 7).count() == 7
    assert {r.table for r in adhoc.describe_schema(log).collect()} == set(adhoc.TABLES)


@pytest.mark.parametrize("text", ["select 1 a) union all (select 2 a", "select 1) x join (select 2", "select * from kept_table", "select (select max(id) from kept_table) as m", "with q as (select * from default.kept_table) select * from q",
                                  "show tables", "select 1; select 2"])
def test_nothing_else_is_open(spark, text):
    spark.sql("create table if not exists kept_table using parquet as select id from range(3)")
    try:
        with pytest.raises((AnalysisException, ParseException, ValueError)):
            adhoc.query_sql(PlayLog(spark, SF), text)
    finally:
        spark.sql("drop table if exists kept_table")


def test_answers_have_an_end(spark):
    log = PlayLog(spark, SF)
    assert [tuple(r) for r in adhoc.answer(log, "select repeat('x', 5000) as t, 1 as n", cell=10)] == [("x" * 10, 1)]
    assert len(adhoc.answer(log, "select artist_id, (select count(*) from stats) as n from artists where artist_id in (select artist_id from plays) order by 1")) > 0
    with pytest.raises(TimeoutError):
        adhoc.answer(log, "select count(*) from range(1000000000000) a", seconds=1)
    assert adhoc.answer(log, "select 1 as a")[0].a == 1


def test_credits(spark):
    rows = [(1, "a", ["m1"], []), (2, "a", ["other"], []), (3, "b", ["other"], []), (4, "a & b", [], ["a", "b"]), (5, "nick", [], []), (6, "nobody", [], None), (7, None, None, None), (8, "a", None, ["b"])]
    df = spark.createDataFrame(rows, "release_id long, credit_key string, ids array<string>, part_keys array<string>")
    names = spark.createDataFrame([("a", 1), ("b", 2), ("nick", 1)], "name_key string, artist_id long")
    aliases = spark.createDataFrame([("nick", 2)], "name_key string, artist_id long")
    ids = spark.createDataFrame([("m1", 1), ("", 2)], "mbid string, artist_id long")
    assert sorted(map(tuple, releases.release_match(df, names, aliases, ids).collect())) == [(1, 1), (3, 2), (4, 1), (4, 2), (5, 2), (8, 1)]


def test_streams_agree_with_tables(spark, tmp_path):
    day = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    plays = [(0, 7, "a", 1), (1, 7, "b", 1), (9, 7, "c", 1), (23, 7, "a", 2), (25, 7, "d", 1), (26, 8, "d", 1), (27, 8, "d", 2), (32, 7, "e", 1)]
    frames = [spark.createDataFrame([(day(h), *r) for h, *r in plays[i : i + 4]], "at timestamp, listener_id long, artist string, track int").coalesce(1) for i in (0, 4)]
    for frame in frames:
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    want = {(7, "a", None), (7, "b", "a"), (7, "c", None), (7, "d", "a"), (8, "d", None), (7, "e", None)}
    assert {(r.listener_id, r.artist, r.gateway) for r in streams.gateways(table).collect()} == want
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made, columns in (("led", streams.gateways(stream), ("listener_id", "artist", "gateway")), ("seen", streams.first_seen(stream), ("listener_id", "artist"))):
        query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = [tuple(r[c] for c in columns) for r in spark.table(name).collect()]
        assert len(got) == len(set(got)) and set(got) == {w[: len(columns)] for w in want}


def test_releases_told_twice(spark):
    rows = [(1, "listenbrainz", "a", "t", "EP"), (2, "listenbrainz", "a", "t", "Album"), (3, "listenbrainz", "b", "u", "Single"), (4, "listenbrainz", "c", "v", "Album"),
            (11, "wikipedia", "a", "t", "Album"), (12, "wikipedia", "b", "u", "Album"), (13, "wikipedia", "C!", "v", "Album"), (14, "wikipedia", "d", "w", "Album"), (15, "wikipedia", None, None, None)]
    df = spark.createDataFrame([(*r, datetime.date(2024, 1, 5)) for r in rows], "release_id long, source string, credit_key string, title_key string, kind string, day date")
    matches = spark.createDataFrame([(4, 9), (13, 9)], "release_id long, artist_id long")
    assert {r.release_id: r.into_id for r in releases.release_merge(df, matches).collect()} == {11: 2, 12: None, 13: 4, 14: None, 15: None}
    facts = spark.createDataFrame([(9, 2.5)], "artist_id long, fit double")
    day = F.lit("2024-01-05").cast("date")
    lists = releases.upcoming_lists(df, releases.release_merge(df, matches), matches, facts, day, day)
    assert {(r.release_id, r.list) for r in lists.collect()} == {(1, "more"), (2, "also"), (4, "mine"), (12, "also"), (14, "also"), (15, "also")}
