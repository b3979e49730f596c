"""Stored tables follow the data below them."""

import os
import shutil
import time

import pyarrow.parquet as pq
import pytest

from playlog.model import PlayLog
from playlog.operators import derive, genres
from playlog.store import Store, base_folder, snapshot, store_of

SF = "/root/testdata/sf0.001"


@pytest.fixture
def library(tmp_path):
    for t in ("orders", "lineitem", "part", "supplier"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def changed(library, table, rows):
    """Replace a table of the library by its first rows."""
    pq.write_table(pq.read_table(f"{library}/{table}.parquet").slice(0, rows), f"{library}/{table}.new")
    os.replace(f"{library}/{table}.new", f"{library}/{table}.parquet")


def folders(log, name):
    path = f"{log.store.folder}/{name}".removeprefix("file://")
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_changed_plays_change_every_table(spark, library):
    log = PlayLog(spark, library)
    before = log.plays.count()
    first = {r.table: r.rows for r in log.rebuild().collect()}
    assert first["plays"] == before > 100
    changed(library, "lineitem", 100)
    again = PlayLog(spark, library)
    assert 0 < again.plays.count() <= 100 and again.version != log.version
    after = {r.table: r.rows for r in again.rebuild().collect()}
    assert after["plays"] == after["sessions"] == again.plays.count() and after["stats"] < first["stats"]


def test_tags_alone_leave_plays_alone(spark, library):
    log = PlayLog(spark, library)
    log.observed.count()
    plays, observed = folders(log, "plays"), folders(log, "observed")
    assert len(plays) == len(observed) == 1
    changed(library, "part", 50)
    now = PlayLog(spark, library)
    assert now.observed.count() < log.observed.count()
    assert folders(log, "plays") == plays and folders(log, "counts") and len(folders(log, "observed")) == 2


def test_rebuild_writes_anew_and_disturbs_nobody(spark, library):
    log = PlayLog(spark, library)
    reader = log.stats
    old = reader.count()
    log.rebuild().collect()
    assert len(folders(log, "stats")) == 2 and reader.count() == old
    assert log.store.vacuum() == 3 and len(folders(log, "stats")) == 1
    assert PlayLog(spark, library).stats.count() == old


def test_half_written_tables_are_not_read(spark, library):
    log = PlayLog(spark, library)
    os.makedirs(f"{log.store.folder}/stats/{log.version}.1".removeprefix("file://"))  # a write that failed
    assert log.stats.count() > 0 and sorted(folders(log, "stats")) == [f"{log.version}.1", f"{log.version}.2"]


def test_another_application_finds_the_tables(spark, library):
    log = PlayLog(spark, library)
    rows = log.stats.count()
    other = Store(spark, library, "part")
    assert other.kept("stats", log.version, lambda: pytest.fail("made again")).count() == rows
    assert other.folder.startswith(base_folder(spark)) and store_of(spark, library, "part") is log.store


def test_snapshots(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a").write_text("x")
    first = snapshot(spark, [str(tmp_path / "t")])
    assert first == snapshot(spark, [str(tmp_path / "t")]) != snapshot(spark, [str(tmp_path / "none")])
    time.sleep(0.01)
    (tmp_path / "t" / "b").write_text("x")
    assert snapshot(spark, [str(tmp_path / "t")]) != first


def test_sessions_of_several_listeners(spark):
    rows = [(who, day * 86400 + t, who, 1, None) for who in (1, 2) for day in range(3) for t in (60, 1200, 4000, 86340)]
    plays = spark.createDataFrame(rows, "listener_id int, ts long, artist_id int, track_id int, album_id int")
    plays = plays.selectExpr("*", "date_from_unix_date(cast(floor(ts / 86400) as int)) as lday")
    got = derive.sessionize(plays, by=("listener_id",)).collect()
    numbers = {who: [r.session_id for r in sorted(got, key=lambda r: r.ts) if r.listener_id == who] for who in (1, 2)}
    assert numbers[1] == numbers[2] == [1, 1, 2, 3, 3, 3, 4, 5, 5, 5, 6, 7]


def test_one_pass_over_the_log_counts_all_dimensions(spark):
    log = PlayLog(spark, SF)
    plays = log.plays.select("artist_id", "lday", "lhour", "lwday")
    counted = genres.calendar_counts(plays)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    for dim in genres.DIMENSIONS:
        assert counted.where(f"dim = '{dim}'").drop("dim").exceptAll(genres.dim_counts(plays, dim)).isEmpty()
        assert genres.dim_counts(plays, dim).exceptAll(counted.where(f"dim = '{dim}'").drop("dim")).isEmpty()
