"""Release groups of albums, on known cases."""

from playlog.operators import groups


def test_two_passes(spark):
    albums = spark.createDataFrame([
        (1, "Band", "Exact"), (2, "Band", "Deluxe (Deluxe Edition)"), (3, "Band", "Foo - EP"), (4, "Band", "Stage (Remastered)"), (5, "Band", "Stage Live (Remastered)"), (6, "Band", "The Very Best Of (Deluxe Edition)"),
        (7, "Band", "Both (Deluxe)"), (8, "Other", "Exact"), (9, "Band", "Weak"), (10, None, "Exact"), (11, "Band", None), (12, "Band", "Song (Deluxe)"), (13, "Band", "Kept (Deluxe)")], "album_id long, artist string, title string")
    known = [
        (1, "EXACT", "The Band & friends", "Album", [], 100), (2, "Deluxe", "Band", "Album", [], 95), (3, "Foo", "Band", "Album", [], 95), (4, "Foo", "Band", "EP", ["Live"], 91), (5, "Stage", "Band", "Album", ["Live"], 99),
        (6, "Stage Live", "Band", "Album", ["Live"], 99), (7, "The Very Best Of", "Band", "Album", ["Compilation"], 99), (8, "Both", "Band", "EP", None, 100), (9, "Both", "Band", "Album", [], 90), (10, "Weak", "Band", "Album", [], 89),
        (11, "Song", "Band", "Single", [], 100), (12, "Kept (Deluxe)", "Band", "Album", [], 95), (13, "Kept", "Band", "Album", [], 100)]
    table = spark.createDataFrame(known, "group_id long, title string, credit string, kind string, others array<string>, score int")
    got = {r.album_id: (r.group_id, r.outcome) for r in groups.matched(albums, table).collect()}
    assert got == {1: (1, "exact"), 2: (2, "edition-free"), 3: (4, "edition-free"), 4: (None, "none"), 5: (6, "edition-free"), 6: (7, "edition-free"), 7: (9, "edition-free"), 8: (None, "none"),
                   9: (None, "none"), 10: (None, "none"), 11: (None, "none"), 12: (None, "none"), 13: (12, "exact")}
    assert groups.matched(albums, table.limit(0)).where("outcome <> 'none'").count() == 0 and groups.matched(albums.limit(0), table).count() == 0
