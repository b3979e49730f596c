"""Rules over sessions and merges of artists with their titles, on known cases."""

import pytest
from pyspark.sql import functions as F

from playlog.operators import rules

PLAYS = "ts long, artist_id long, track_id long, album_id long"


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_what_is_said_later_holds(spark, tmp_path):
    log = rules.RuleLog(spark, str(tmp_path / "rules"))
    assert log.current("hide").count() == 0
    say = lambda kind, rows, at, **more: log.say(kind, spark.createDataFrame(rows, "key string, value long"), at, **more)
    assert say("alias", [("b", 1), ("c", 1), (None, 9)], 10) == 1
    assert say("alias", [("b", 2)], 20) == 2
    assert say("alias", [("c", None)], 30, removed=True) == 3
    say("hide", [("b", None)], 40)  # another kind of rule about the same key
    later = rules.RuleLog(spark, str(tmp_path / "rules"))
    assert pairs(later.current("alias")) == [("b", 2, 20)] and pairs(later.current("hide")) == [("b", None, 40)]
    assert later.history().count() == 5
    say("alias", [("c", 3), ("c", 2)], 50)
    assert [r.key for r in later.listed("alias").collect()] == ["c", "b"] and later.current("alias").where("key = 'c'").first().value == 2
    with pytest.raises(ValueError):
        say("unheard of", [("b", 1)], 1)


def test_hidden_artists_are_not_suggested(spark, tmp_path):
    log = rules.RuleLog(spark, str(tmp_path / "rules"))
    rows = spark.createDataFrame([(1,), (2,)], "artist_id long")
    assert rules.without_hidden(rows, log).count() == 2
    log.say("hide", spark.createDataFrame([("1",)], "key string"), 1)
    assert pairs(rules.without_hidden(rows, log)) == [(2,)]
    log.say("hide", spark.createDataFrame([("1",)], "key string"), 2, removed=True)
    assert rules.without_hidden(rows, log).count() == 2


@pytest.fixture(scope="module")
def merge(spark):
    """Artist 2 goes to 1: one track and one album of the same title, one minute at which both were played."""
    return {
        "rules": spark.createDataFrame([(2, 1)], "from_id long, to_id long"),
        "tracks": spark.createDataFrame([(10, 1, "a"), (20, 2, "a"), (21, 2, "b"), (30, 3, "a"), (22, 2, None), (11, 1, None)], "track_id long, artist_id long, title_key string"),
        "albums": spark.createDataFrame([(100, 1, "r"), (200, 2, "r"), (201, 2, "s")], "album_id long, artist_id long, title_key string"),
        "plays": spark.createDataFrame([(60, 1, 10, 100), (60, 2, 20, 200), (120, 2, 20, 200), (180, 2, 21, 201), (240, 3, 30, None)], PLAYS),
        "names": spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "artist_id long, name_key string"),
    }


def test_titles_meet(spark, merge):
    tracks = rules.titles_after(merge["tracks"], merge["rules"], "track_id")
    assert pairs(tracks) == [(10, 1, 10), (11, 1, 11), (20, 1, 10), (21, 1, 21), (22, 1, 22), (30, 3, 30)]
    albums = rules.titles_after(merge["albums"], merge["rules"], "album_id")
    after = rules.merged_plays(merge["plays"], merge["rules"], tracks, albums)
    assert pairs(after.select("ts", "artist_id", "track_id", "album_id")) == [(120, 1, 10, 100), (180, 1, 21, 201), (240, 3, 30, None), (60, 1, 10, 100)]
    assert tuple(rules.merge_outcome(merge["plays"], after, merge["rules"], tracks, albums).first()) == (3, 1, 1, 1)
    loved = spark.createDataFrame([("x", "y", 20), ("x", "z", 21)], "artist_key string, title_key string, track_id long")
    assert pairs(rules.repointed(loved, tracks, "track_id")) == [("x", "y", 10), ("x", "z", 21)]


def test_names_follow_and_shadow_nobody(spark, merge):
    old = spark.createDataFrame([("deux", 2), ("one", 2), ("uno", 1), ("three", 2)], "name_key string, artist_id long")
    assert pairs(rules.aliases_after(old, merge["names"], merge["rules"])) == [("deux", 1), ("two", 1), ("uno", 1)]
    hidden = spark.createDataFrame([(2, 5), (3, 7)], "artist_id long, at long")
    assert pairs(rules.hidden_after(hidden, merge["rules"])) == [(1, 5), (3, 7)]
    own = spark.createDataFrame([(1, 9), (2, 5)], "artist_id long, at long")
    assert pairs(rules.hidden_after(own, merge["rules"])) == [(1, 9)]


def test_title_rules_follow_and_clash_with_nothing(spark, merge):
    after = rules.titles_after(merge["tracks"], merge["rules"], "track_id")
    old = spark.createDataFrame([(2, "old a", 20), (2, "a", 21), (1, "other", 10), (2, "other", 21)], "artist_id long, title_key string, track_id long")
    assert pairs(rules.title_rules_after(old, merge["tracks"], after, merge["rules"], "track_id")) == [(1, "old a", 10), (1, "other", 10)]


def test_an_alias_of_a_known_name_is_a_merge(spark, merge):
    asked = spark.createDataFrame([("two", 1), ("new", 1), ("one", 1), ("", 1), (None, 1), ("new", 9)], "name_key string, target_id long")
    got = {(r.name_key, r.target_id): (r.outcome, r.from_id) for r in rules.asked_aliases(asked, merge["names"]).collect()}
    assert got == {("two", 1): ("merge", 2), ("new", 1): ("alias", None), ("one", 1): ("own name", None), ("", 1): ("empty name", None), (None, 1): ("empty name", None), ("new", 9): ("artist not found", None)}


def test_loved_rules_are_checked(spark, merge):
    entries = spark.createDataFrame([("one", t, 1) for t in ("q", "a", "w", "e")] + [("nobody", "q", 1)], "artist_key string, title_key string, loved_at long")
    resolved = entries.select("artist_key", "title_key", F.when(F.col("artist_key") == "one", 1).alias("artist_id"), F.when(F.col("title_key") == "a", 10).alias("track_id"))
    held = spark.createDataFrame([("one\ne", 10)], "key string, value long")
    asked = spark.createDataFrame([("one", "q", 10), ("one", "a", 10), ("one", "w", 20), ("one", "e", 10), ("nobody", "q", 10), ("one", "none", 10), ("one", "q", 99)], "artist_key string, title_key string, track_id long")
    got = {(r.artist_key, r.title_key, r.track_id): r.outcome for r in rules.asked_loved(asked, entries, resolved, merge["tracks"], held).collect()}
    assert got == {("one", "q", 10): "ok", ("one", "a", 10): "already matches", ("one", "w", 20): "another artist", ("one", "e", 10): "already linked", ("nobody", "q", 10): "artist unknown",
                   ("one", "none", 10): "not loved", ("one", "q", 99): "track not found"}


def test_because(spark):
    links = spark.createDataFrame([(1, 5, 0.5), (2, 5, 0.9), (5, 6, 0.7), (1, 7, 0.1)], "a long, b long, score double")
    core = spark.createDataFrame([(1,), (2,), (6,)], "core_id long")
    found = spark.createDataFrame([(5,), (7,)], "artist_id long")
    assert pairs(rules.because(links, core, found, 2)) == [(5, [2, 6]), (7, [1])]
