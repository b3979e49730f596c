"""JSON pages and files of any encoding, on known forms."""

import json

import pytest

from playlog.sources import decode, pages

PLAY = lambda n, uts=1, artist="A", album="L", **more: {"name": n, "artist": {"#text": artist, "mbid": ""}, "album": {"#text": album}, **({"date": {"uts": str(uts)}} if uts else {}), **more}
RECENT = [
    {"recenttracks": {"track": [PLAY("one", 60), PLAY("now", None, **{"@attr": {"nowplaying": "true"}})], "@attr": {"page": "1", "totalPages": "4"}}},
    {"recenttracks": {"track": PLAY("bare", 120), "@attr": {"page": "2", "totalPages": "4"}}},
    {"recenttracks": {"track": "", "@attr": {"page": 3, "totalPages": 4}}},
    {"recenttracks": {"track": [{"name": " N  n ", "artist": {"name": "B", "mbid": "m"}, "date": {"uts": 180}, "mbid": "t"}, "odd", PLAY("", 5), PLAY("x", 5, artist=""), PLAY("x", "soon")], "@attr": {"page": "4", "totalPages": "4"}}},
]


@pytest.fixture
def folder(tmp_path):
    def write(*answers, name="page"):
        (tmp_path / "in").mkdir(exist_ok=True)
        for i, a in enumerate(answers):
            (tmp_path / "in" / f"{name}-{i}.json").write_text(a if isinstance(a, str) else json.dumps(a))
        return str(tmp_path / "in")

    return write


def plays(rows):
    return sorted((r.ts, r.artist, r.track, r.album, r.artist_mbid, r.track_mbid) for r in rows.collect())


def test_recent_plays(spark, folder):
    read = pages.read_pages(spark, folder(*RECENT))
    want = [(60, "A", "one", "L", None, None), (120, "A", "bare", "L", None, None), (180, "B", "N n", "", "m", "t")]
    assert plays(pages.recent_plays(read)) == want and pages.faults(read, "recenttracks").count() == 0
    assert tuple(pages.completeness(read, "recenttracks").first()) == (4, 4, 7, None, True)


def test_what_is_no_answer_is_set_aside(spark, folder):
    read = pages.read_pages(spark, folder(RECENT[0], "<html>", {"error": 8, "message": "m"}, {"recenttracks": "nothing"}, {"x": 1}))
    assert sorted((r.file, r.fault) for r in pages.faults(read, "recenttracks").collect()) == [
        ("page-1.json", "not JSON"), ("page-2.json", "error 8"), ("page-3.json", "no recenttracks block"), ("page-4.json", "no recenttracks block")]
    assert len(plays(pages.recent_plays(read))) == 1 and not pages.completeness(read, "recenttracks").first().whole


def test_the_same_plays_from_a_stream_that_is_started_again(spark, folder, tmp_path):
    at = folder(*RECENT[:2])

    def run():
        found = pages.recent_plays(pages.read_pages(spark, at, stream=True))
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    folder(*RECENT[2:], name="more")
    run()
    run()
    assert plays(spark.read.parquet(str(tmp_path / "out"))) == plays(pages.recent_plays(pages.read_pages(spark, at)))


def test_a_short_list_of_loved_tracks_is_a_bad_answer(spark, folder):
    entry = lambda i: {"name": f"t{i}", "artist": {"name": "A"}, "date": {"uts": str(i)}}
    page = lambda n, total: {"lovedtracks": {"track": [entry(i) for i in range(1, n + 1)], "@attr": {"page": "1", "totalPages": "1", "total": str(total)}}}
    read = pages.read_pages(spark, folder(page(10, 12)))
    assert pages.completeness(read, "lovedtracks").first().whole and pages.loved_tracks(read).count() == 10
    assert not pages.completeness(pages.read_pages(spark, folder(page(10, 20))), "lovedtracks").first().whole


def test_artists_albums_and_tags(spark, folder):
    read = pages.read_pages(spark, folder(
        {"artist": {"name": "A", "mbid": "", "stats": {"listeners": "12", "playcount": "many"}, "image": [{"#text": "a"}, {"#text": "b"}, {"#text": ""}], "bio": {"summary": " s "}, "tags": {"tag": [{"name": "x"}, {"name": ""}, {"name": "y", "count": "7"}]}}},
        {"artist": {"name": "B", "tags": {"tag": {"name": "z"}}, "image": {"#text": f"http://{pages.NO_PICTURE}.png"}}},
        {"artist": {"name": "C", "tags": ""}}, {"artist": ""}, {"error": 6}))
    rows = {r.name: r for r in pages.artist_info(read).collect()}
    assert (rows["A"].mbid, rows["A"].image_url, rows["A"].listeners, rows["A"].playcount, rows["A"].bio) == (None, "b", 12, None, "s")
    assert [[tuple(t) for t in rows[n].tags] for n in "ABC"] == [[("x", 100), ("y", 7)], [("z", 100)], []] and rows["B"].image_url is None
    read = pages.read_pages(spark, folder({"album": {"name": "L", "listeners": "3", "tracks": {"track": {"name": "t"}}}}, {"album": {"name": "M", "tracks": ""}}, "x", "x", "x"))
    assert {r.name: (r.listeners, r.n_tracks) for r in pages.album_info(read).collect()} == {"L": (3, 1), "M": (None, None)}
    read = pages.read_pages(spark, folder({"toptags": {"tag": [{"name": "x", "count": 9}, {"count": 1}]}}, {"similarartists": {"artist": [{"name": "S", "match": "0.5", "mbid": ""}, {"match": 1}, {"name": "T", "match": "?"}]}}))
    assert [(r.tag, r.weight) for r in pages.top_tags(read).collect()] == [("x", 9)]
    assert [(r.place, r.name, r.mbid, r.match) for r in pages.similar_artists(read).orderBy("place").collect()] == [(0, "S", None, 0.5), (1, "T", None, 0.0)]


def test_encodings(spark, tmp_path):
    files = {"a": "é".encode(), "b": b"\xef\xbb\xbfx", "c": "é€".encode("cp1252"), "d": b"\x81\xe9"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file[-1]: (r.text, r.encoding) for r in decode.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a": ("é", "utf-8-sig"), "b": ("x", "utf-8-sig"), "c": ("é€", "cp1252"), "d": ("\x81é", "latin-1")}
    assert spark.range(1).selectExpr("cast(null as binary) as b").select(decode.decode("b")["text"]).first()[0] is None
