"""Releases by new artists, on known cases."""

import datetime

import pytest

from playlog.functions.text import PLACE_NAMES
from playlog.operators import newcomers

CANDIDATES = "release_id long, name_key string, part_keys array<string>, ids array<string>, title string, kind string, day date"


@pytest.fixture(scope="module")
def known(spark):
    day = datetime.date(2026, 10, 21)
    candidates = spark.createDataFrame([
        (1, "stranger", [], [], "Unknown", "Album", day), (2, "stranger", [], [], "Unknown (Deluxe Edition)", "EP", day), (3, "a & b", ["a", "b"], [], "Joint", "Album", day),
        (4, "by id", None, ["m1"], "T", "EP", day), (5, "nobody", [], [], "N", "Album", day), (6, "genre", [], [], "G", "Album", day)], CANDIDATES)
    seeds = spark.createDataFrame([("s1", 0.5), ("s2", 0.3)], "seed_key string, weight double")
    similar = spark.createDataFrame([("s1", "stranger", "", 0.4), ("s2", "stranger", "", 1.0), ("s1", "a", "", 0.2), ("s1", "b", "", 0.6), ("s2", "other name", "m1", 0.5), ("s9", "nobody", "", 1.0), ("s1", "nobody", "", 0.0)],
                                    "seed_key string, name_key string, mbid string, match double")
    tags = spark.createDataFrame([("stranger", "Dream Pop", 100), ("stranger", "dreampop", 40), ("genre", "dream-pop", 50), ("genre", "unheard", 10), ("nobody", "unheard", 100)], "name_key string, tag string, weight int")
    vector = spark.createDataFrame([("dreampop", 0.8, 1.0), ("folk", 0.2, 2.0)], "fold string, now double, idf double")
    return candidates, seeds, similar, tags, vector


def test_seeds_count_once_by_name_part_or_id(spark, known):
    candidates, seeds, similar, _, _ = known
    rows = {r.release_id: (round(r.similarity, 6), r.like) for r in newcomers.likeness(candidates, seeds, similar).collect()}
    assert rows == {1: (0.5, ["s2", "s1"]), 2: (0.5, ["s2", "s1"]), 3: (0.3, ["s1"]), 4: (0.15, ["s2"])}


def test_spellings_of_a_genre_are_one(spark, known):
    candidates, _, _, tags, vector = known
    rows = {r.release_id: (round(r.genre_fit, 6), r.genres) for r in newcomers.genre_fit(candidates, tags, vector).collect()}
    you = (0.8**2 + 0.4**2) ** 0.5  # 0.2 folk, twice as rare
    assert rows[1] == (round(0.8 / you, 6), ["Dream Pop"])
    assert rows[6][0] == round(0.8 * 50 / (you * (50**2 + 20**2) ** 0.5), 6) and set(rows) == {1, 2, 6}  # an unheard tag is the rarest: 10 x 2


def test_the_best_of_a_week(spark, known):
    found = newcomers.new_to_you(*known)
    rows = {r.release_id: r for r in found.collect()}
    assert set(rows) == {1, 2, 3, 4, 6}  # 5 is like none and fits nothing
    assert (rows[1].similarity, rows[3].similarity, rows[6].similarity) == (1.0, 0.6, 0.0)
    assert rows[1].score == round(0.5 + 0.5 * rows[1].genre_fit, 4) and rows[4].score == 0.15
    weeks = newcomers.new_weeks(found).collect()
    assert [r.release_id for r in sorted(weeks, key=lambda r: r.place)] == [1, 6, 3, 4] and {str(r.friday) for r in weeks} == {"2026-10-23"}
    assert [r.release_id for r in newcomers.new_weeks(found, 2).orderBy("place").collect()] == [1, 6]
    assert newcomers.new_to_you(known[0].limit(0), *known[1:]).count() == 0
    assert newcomers.new_to_you(known[0], known[1].limit(0), known[2], known[3], known[4].limit(0)).count() == 0


def test_places_have_several_names(spark):
    weighted = spark.createDataFrame([(1, 6.0), (2, 3.0), (3, 1.0)], "artist_id long, now double")
    tags = spark.createDataFrame([(1, "Finland", 100), (1, "finnish", 50), (1, "nordic", 10), (2, "UK", 5), (3, "usa", 0), (3, "japan", 1)], "artist_id long, tag string, weight int")
    rows = [tuple(r) for r in newcomers.places(weighted, tags, PLACE_NAMES).collect()]
    assert rows == [("finnish", 0.6), ("nordic", 0.6), ("british", 0.3), ("japanese", 0.1)]
