"""Play exports as CSV: header aliases or positional columns, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.functions.text import clean, csv_guard, parse_date

# The header names that stand for each field.
ALIASES = {
    "artist": ("artist", "artist name", "artist_name", "artistname"),
    "album": ("album", "album name", "album_name", "albumname"),
    "track": ("track", "name", "title", "track name", "track_name", "song"),
    "date": ("date", "uts", "timestamp", "time", "played at", "played_at", "date#text"),
    "artist_mbid": ("artist_mbid", "artist mbid"),
    "track_mbid": ("track_mbid", "mbid", "track mbid"),
    "album_mbid": ("album_mbid", "album mbid"),
}


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(plays, skipped): plays(artist, track, album, ts and the three mbids) and one row with the count of rows that lack a field.

    The first line is a header if it names an artist, a track and a date; otherwise columns are artist, album, track, date.
    Blank lines are neither. Every file of a folder has the same form.
    """
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", True)
    head = reader.csv(path).limit(1).collect()
    names = [(v or "").strip().lstrip("\ufeff").lower() for v in head[0]] if head else []
    found = {field: next(i for i, n in enumerate(names) if n in aliases) for field, aliases in ALIASES.items() if set(aliases) & set(names)}
    header = {"artist", "track", "date"} <= set(found)
    place = found if header else {"artist": 0, "album": 1, "track": 2, "date": 3}
    # the reader itself leaves the header line out, so a play whose artist is called like the column stays
    raw = reader.schema(", ".join(f"c{i} string" for i in range(len(names)))).option("header", header).option("enforceSchema", True).csv(path) if names else None
    if raw is None:
        empty = spark.createDataFrame([], "artist string, track string, album string, ts long, artist_mbid string, track_mbid string, album_mbid string")
        return empty, empty.agg(F.count("*").alias("skipped"))
    cell = lambda field: F.col(f"c{place[field]}") if place.get(field, len(names)) < len(names) else F.lit(None).cast("string")
    some = raw.where(F.length(F.trim(F.concat_ws("", *raw.columns))) > 0)
    rows = some.select(*[clean(cell(f)).alias(f) for f in ALIASES]).withColumn("ts", parse_date(F.col("date")))
    ok = (F.col("artist") != "") & (F.col("track") != "") & F.col("ts").isNotNull()
    ids = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ALIASES if c.endswith("mbid")]
    return rows.where(ok).select("artist", "track", "album", "ts", *ids), rows.where(~ok).agg(F.count("*").alias("skipped"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A report table as one CSV file, guarded against formulas. For tables of bounded size, such as top lists."""
    text = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    rows.withColumns({c: csv_guard(F.col(c)) for c in text}).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
