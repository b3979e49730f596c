"""Editions, loved entries, duplicates and lookups on small known cases."""

import pytest
from pyspark.sql import functions as F

from playlog.functions import titles
from playlog.functions.text import tag_classify
from playlog.operators import editions, lookups, resolve

TITLES = [
    ("Song (Remastered 2011)", "Song"), ("Song [Deluxe Edition] (Mono)", "Song"), ("Song - Remastered 2009", "Song"), ("Song - 2011 - Remaster", "Song - 2011"),
    ("Song (Live)", "Song (Live)"), ("Song - Live at Home", "Song - Live at Home"), ("(Remastered)", "(Remastered)"), ("Song (Collector’s Edition)", "Song"), ("Song (Tour)", "Song (Tour)"),
    ("Song (Edition)", "Song (Edition)"), ("Song  -  Mono - Remastered", "Song"), ("Song (live - remastered)", "Song (live - remastered)"), ("Song (25th Anniversary Edition)", "Song"),
    ("Stereo", "Stereo"), ("Song (Monorail)", "Song (Monorail)"), ("", ""), (None, None), ("Song ()", "Song ()"), ("Song (Deluxe (Remastered)) [x]", "Song [x]"), ("Song - Live (2011 Remaster)", "Song - Live"), ("Song (", "Song ("), ("Song) (Mono)", "Song)"), ("Song (50th Tour Edition)", "Song"), ("Song (5000th Mono)", "Song (5000th Mono)"), ("Song - - Mono", "Song"), ("Song (a - Mono", "Song (a - Mono"), ("Deluxe Song", "Deluxe Song"),
]


def test_strip_edition(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TITLES)], "i int, t string").select("i", editions.strip_edition("t").alias("s"))
    assert {r.i: r.s for r in df.collect()} == {i: s for i, (_, s) in enumerate(TITLES)}


def test_loose_title_and_likeness(spark):
    cases = [("Déjà Vu (Remastered 2011)", "dejavu"), ("Song - Single Version", "song"), ("Song feat. Someone", "song"), ("Rock & Roll", "rockandroll"), ("Without (You)", "withoutyou"), ("!!", ""), (None, None), ("Radioactive (Without You)", "radioactivewithoutyou"), ("A (with B) [C] ft. D", "ac"), ("Song ft D", "songftd"), ("A - B - 2011 Mix", "a"), ("パ - demo", "パ"), ("One (x", "onex")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", resolve.loose_title("t").alias("k"))
    assert {r.i: r.k for r in df.collect()} == {i: k for i, (_, k) in enumerate(cases)}
    pairs = spark.createDataFrame([("a", "a"), ("part1", "part2"), ("abcde", "abcdx")], "a string, b string")
    assert [round(r[0], 2) for r in pairs.select(resolve.likeness("a", "b")).collect()] == [2.0, 0.0, 0.8]


ALBUMS = [
    ("Rumours (Deluxe Edition)", ("Rumours", None)), ("Thriller - 2003 Remaster", ("Thriller", None)), ("Foo (Special Guest)", ("Foo (Special Guest)", None)), ("Foo (Bonus)", ("Foo (Bonus)", None)),
    ("Foo (Bonus Tracks)", ("Foo", None)), ("Foo - EP", ("Foo", "EP")), ("Foo (Deluxe) - Single", ("Foo", "Single")), ("Foo - EP (Remastered)", ("Foo", "EP")), ("(Remastered)", ("(Remastered)", None)),
    ("Foo 【Deluxe】", ("Foo", None)), ("Foo (Live )", ("Foo (Live)", None)), ("Foo – Expanded – EP", ("Foo", "EP")), ("Foo - Bar", ("Foo - Bar", None)), ("EP", ("EP", None)), ("", ("", None)), (None, (None, None)),
]


def test_album_titles(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ALBUMS)], "i int, t string").select("i", titles.clean_title("t").alias("c"), titles.edition_free_title("t").alias("f"))
    rows = {r.i: r for r in df.collect()}
    assert {i: tuple(r.c) for i, r in rows.items()} == {i: want for i, (_, want) in enumerate(ALBUMS)}
    assert rows[0].f == "Rumours" and rows[12].f == "Foo - Bar" and rows[10].f == "Foo (Live)" and rows[15].f is None


PLAYS = "ts long, artist_id long, track_id long, album_id long"


def test_track_groups_know_why_a_merge_is_unsafe(spark):
    plays = spark.createDataFrame([(0, 1, 10, 100), (60, 1, 11, 101), (120, 1, 11, 101), (180, 2, 20, 200), (240, 2, 21, None), (300, 3, 30, 300)], PLAYS)
    tracks = spark.createDataFrame([(10, 1, "A"), (11, 1, "A (Mono)"), (20, 2, "Intro"), (21, 2, "Intro - Remastered"), (30, 3, "A"), (31, 3, None)], "track_id long, artist_id long, title string")
    albums = spark.createDataFrame([(100, 1, "R"), (101, 1, "R (Deluxe Edition)"), (200, 2, "Live in X"), (300, 3, "R")], "album_id long, artist_id long, title string")
    rows = {r.artist_id: r for r in editions.track_edition_groups(plays, tracks, albums).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].target_id, rows[1].plays, rows[1].same_album, rows[1].no_album, rows[1].generic, rows[1].other_recording) == (10, 3, True, False, False, False)
    assert (rows[2].target_id, rows[2].same_album, rows[2].no_album, rows[2].generic, rows[2].other_recording, rows[2].many) == (20, False, True, True, True, False)
    rules = editions.edition_rules(editions.track_edition_groups(plays, tracks, albums), tracks, "track_id")
    assert sorted(map(tuple, rules.collect())) == [(11, 10), (21, 20)]
    assert sorted(r.track_id for r in editions.merge_items(plays, rules, "track_id").collect()) == [10, 10, 10, 20, 20, 30]
    assert editions.track_edition_groups(plays.limit(0), tracks.limit(0), albums.limit(0)).count() == 0


def test_album_groups_and_facts(spark):
    plays = spark.createDataFrame([(i * 60, 1, t, a) for i, (t, a) in enumerate([(1, 100), (2, 100), (3, 100), (1, 101), (2, 101), (4, 102)])], PLAYS)
    tracks = spark.createDataFrame([(i, 1, f"T{i}") for i in range(1, 5)], "track_id long, artist_id long, title string")
    albums = spark.createDataFrame([(100, 1, "R"), (101, 1, "R (Expanded)"), (102, 1, "Best of R")], "album_id long, artist_id long, title string")
    row = editions.album_edition_groups(plays, albums, tracks).collect()
    assert [(r.target_id, r.versions, r.plays, r.overlap, r.same_tracks, r.compilation, r.nothing_shared) for r in row] == [(100, 2, 5, 1.0, True, False, False)]
    facts = spark.createDataFrame([(101, "x"), (102, "y")], "album_id long, cover string")
    rules = spark.createDataFrame([(101, 100)], "from_id long, to_id long")
    assert sorted((r.album_id, r.cover) for r in editions.merged_facts(facts, rules, "album_id").collect()) == [(100, "x"), (102, "y")]


def test_duplicates_join_over_both_keys(spark):
    names = spark.createDataFrame([(1, "The Band"), (2, "Band"), (3, "Bänd"), (4, "Bnad"), (5, "Other"), (6, "!!!"), (7, None)], "artist_id long, name string")
    stats = spark.createDataFrame([(1, 5), (2, 9), (4, 1), (5, 3)], "artist_id long, plays long")
    fixed = spark.createDataFrame([(1, "the band"), (4, "The Band"), (5, None)], "artist_id long, corrected string")
    found = resolve.duplicate_candidates(names, stats, fixed).collect()
    assert [tuple(r) for r in found] == [(1, 4, 1, 15)]
    gone = spark.createDataFrame([("\n".join(sorted(["the band", "band", "bänd", "bnad"])),)], "group_key string")
    assert resolve.duplicate_candidates(names, stats, fixed, gone).count() == 0


@pytest.mark.parametrize(("number", "about"), [(1234, 1200), (1250, 1200), (1350, 1400), (99, 99), (7, 7), (20000, 20000)])
def test_two_digits(spark, number, about):
    assert spark.range(1).select(lookups.two_digits(F.lit(number))).first()[0] == about


def test_tag_kinds(spark):
    df = spark.createDataFrame([("1998",), ("80's",), ("finnish",), ("seen_live",), ("x",), ("post-rock",), (None,)], "k string")
    assert [r[0] for r in df.select(tag_classify(F.col("k"))).collect()] == ["year", "decade", "place", "other", "other", "genre", "genre"]
