"""Albums of a month from wikitext, on known forms and against tables that are written from rows."""

import datetime
import random

from pyspark.sql import functions as F

from playlog.sources import wikitext

HARD = "\n".join([
    "|-", '! scope="row" rowspan="4" | October&nbsp;23',
    '| rowspan="2" style="x" | [[Alpha Band]]', "| ''First''", "| Pop", "| Indie", "| <ref>{{cite web", " |url=https://example.com/alpha", " |title=t}}</ref>",
    "|-", "| ''Second''", "| Pop", "| Indie", "|",
    "|-", "| {{sortname|Theta|Band}} || ''Third<ref name=\"a/b\">some text</ref>'' || || Label",
    "|-", "| Belle and Sebastian || ''Fourth''",
    "|-", "| Kappa", "| ''Fifth''<ref>{{cite web", "|url=https://example.com/fifth", "|title=t}}</ref>", "| Rock", "| Label",
    "|-", "| E=MC2 || ''Sixth<ref>{{citation|url=http://x}}</ref>''",
    "|-", "! October<br/>31 (Saturday)", "| [[A|Ay]] and [[Bee]] || [[T (album)|T &amp; U]]<!-- | x --> || {{nowrap|{{lang|fr|Pop}}}}<br>Rock || [https://e.org Big Label]",
    "|-", "! October 32", "| X || Y", "|-", "| ''only an artist''", "|-", "| || no artist", "|}"])


def read(spark, *texts, year=2026, month=10):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page int, text string")
    return wikitext.month_releases(df, F.col("text"), F.lit(year), F.lit(month)).collect()


def test_forms(spark):
    rows = read(spark, HARD)
    assert [(r.release_date.day, r.artist, r.title) for r in rows] == [
        (23, "Alpha Band", "First"), (23, "Alpha Band", "Second"), (23, "Theta Band", "Third"), (23, "Belle and Sebastian", "Fourth"), (23, "Kappa", "Fifth"), (23, "E=MC2", "Sixth"), (31, "Ay and Bee", "T & U")]
    assert (rows[0].genre, rows[0].label, rows[0].source_url) == ("Pop", "Indie", "https://example.com/alpha")
    assert (rows[2].genre, rows[2].label) == (None, "Label") and rows[3].artist_parts is None and (rows[4].genre, rows[4].label) == ("Rock", "Label")
    assert rows[6].artist_parts == ["Ay", "Bee"] and (rows[6].genre, rows[6].label) == ("Pop, Rock", "Big Label")


def test_nothing_to_read(spark):
    assert read(spark, None, "", "=== November ===\n{|\n|}", "|-\n! February<br>30\n| Someone\n| ''Something''\n|}", month=2) == []
    assert read(spark, "|-\n! May 1\n| {{a || b\n| [[c | d", month=5) is not None  # what is never closed does not crash


def test_written_tables_come_back(spark):
    """Tables written from rows, with spans over days and artists of random length."""
    r = random.Random(7)
    texts, want = [], []
    for page in range(30):
        lines, rows, n = ['{| class="wikitable"', "! Date !! Artist !! Album"], [], 0
        for day in sorted(r.sample(range(1, 29), r.randint(1, 6))):
            albums, first = r.randint(1, 5), True
            while albums:
                span = r.randint(1, albums)
                for k in range(span):
                    lines.append("|-")
                    if first:
                        lines.append(f'! scope="row" rowspan="{albums}" | May {day}')
                        first = False
                    n += 1
                    if k == 0:
                        artist = f"Artist {page}.{n}"
                        lines.append(f'| rowspan="{span}" | [[{artist}]]' if span > 1 else f"| {artist}")
                    lines.append(f"| ''Album {n}'' || {r.choice(['Pop', ''])} || <ref>x</ref>" if r.random() < 0.5 else f"| ''Album {n}''")
                    rows.append((page, datetime.date(2025, 5, day), artist, f"Album {n}"))
                albums -= span
        texts.append("\n".join([*lines, "|}"]))
        want += rows
    got = [(x.page, x.release_date, x.artist, x.title) for x in read(spark, *texts, year=2025, month=5)]
    assert sorted(got) == sorted(want) and len(want) > 150
