"""JSON pages of a listening service, from a folder: plays, loved tracks, artists, albums, tags and similar artists.

A page is a file.  The service writes numbers as text, a list of one as that one, and an empty list as an empty text or not at all; a page can
also be an error, or no JSON.  Pages are read as variants, so no form of a field breaks the reading of the others, and what is
no answer goes to a table of faults.  A folder can be read as a table or as a stream, whose file source keeps what it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.functions.text import clean

#: The picture that stands for a missing one; a fixed value of the service.
NO_PICTURE = "2a96cbd8b46e442fc41c2b86b821562f"


def read_pages(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """(file, text) of the pages of a folder."""
    reader = (spark.readStream if stream else spark.read).option("wholetext", True).option("recursiveFileLookup", True)
    if stream:
        reader = reader.schema("value string")
    return reader.format("text").load(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def parsed(pages: DataFrame) -> DataFrame:
    """pages with page, a variant; null where the text is no JSON."""
    return pages.withColumn("page", F.try_parse_json("text"))


def _get(page: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(page, path, kind)


def text_at(page: Column, *paths: str) -> Column:
    """The first of the paths with a text that is not empty, in clean form."""
    return F.coalesce(*[F.nullif(clean(_get(page, p)), F.lit("")) for p in paths])


def list_at(page: Column, path: str) -> Column:
    """The objects of a list, which may be one object or nothing."""
    kind = F.schema_of_variant(_get(page, path, "variant"))
    some = F.when(kind.startswith("ARRAY"), _get(page, path, "array<variant>")).when(kind.startswith("OBJECT"), F.array(_get(page, path, "variant")))
    return F.filter(F.coalesce(some, F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def faults(pages: DataFrame, block: str) -> DataFrame:
    """(file, fault) of pages without the block: no JSON, an error of the service with its number, or another answer."""
    rows = parsed(pages)
    there = F.coalesce(F.schema_of_variant(_get(F.col("page"), f"$.{block}", "variant")).startswith("OBJECT"), F.lit(False))
    error = F.concat(F.lit("error "), _get(F.col("page"), "$.error"))
    why = F.when(F.col("page").isNull(), "not JSON").otherwise(F.coalesce(error, F.concat(F.lit(f"no {block} block"))))
    return rows.where(~there).select("file", why.alias("fault"))


def recent_plays(pages: DataFrame) -> DataFrame:
    """(file, artist, track, album, ts and the three mbids) of pages of recent plays. What is playing now has no date and is left out, like an entry without artist or title."""
    t = F.col("t")
    rows = parsed(pages).select("file", F.explode(list_at(F.col("page"), "$.recenttracks.track")).alias("t"))
    rows = rows.select(
        "file", text_at(t, "$.artist['#text']", "$.artist.name").alias("artist"), text_at(t, "$.name").alias("track"), F.coalesce(text_at(t, "$.album['#text']"), F.lit("")).alias("album"),
        _get(t, "$.date.uts").try_cast("long").alias("ts"), text_at(t, "$.artist.mbid").alias("artist_mbid"), text_at(t, "$.mbid").alias("track_mbid"), text_at(t, "$.album.mbid").alias("album_mbid"))
    return rows.where("ts <> 0 and artist is not null and track is not null")


def loved_tracks(pages: DataFrame) -> DataFrame:
    """(file, artist, title, loved_at) of pages of loved tracks; entries without a date, artist or title are left out."""
    t = F.col("t")
    rows = parsed(pages).select("file", F.explode(list_at(F.col("page"), "$.lovedtracks.track")).alias("t"))
    rows = rows.select("file", text_at(t, "$.artist.name", "$.artist['#text']").alias("artist"), text_at(t, "$.name").alias("title"), _get(t, "$.date.uts").try_cast("long").alias("loved_at"))
    return rows.where("loved_at <> 0 and artist is not null and title is not null")


def completeness(pages: DataFrame, block: str) -> DataFrame:
    """One row: pages there and pages told of, entries there and entries told of, and whether the list is whole.

    A few entries may be missing, as a list can change while it is read; more, a missing page or a page that is no answer mean a bad answer.
    """
    page = F.col("page")
    number = lambda name: _get(page, f"$.{block}['@attr'].{name}").try_cast("long")
    rows = parsed(pages).select(F.size(list_at(page, f"$.{block}.track")).alias("n"), number("totalPages").alias("pages"), number("total").alias("total"), number("page").alias("at"),
                                F.coalesce(F.schema_of_variant(_get(page, f"$.{block}", "variant")).startswith("OBJECT"), F.lit(False)).alias("ok"))
    row = rows.agg(F.count_distinct("at").alias("pages"), F.coalesce(F.max("pages"), F.lit(0)).alias("of_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.max("total").alias("of_entries"), F.coalesce(F.every("ok"), F.lit(False)).alias("answers"))
    few = F.coalesce(F.col("entries") >= F.col("of_entries") - F.greatest(F.lit(5), F.floor(F.col("of_entries") / 50)), F.lit(True))
    return row.select("pages", "of_pages", "entries", "of_entries", (F.col("answers") & (F.col("pages") >= F.col("of_pages")) & few).alias("whole"))


def _tags(page: Column, path: str) -> Column:
    """(name, weight) of a block of tags; without counts the weights fall by place, so that the order stays."""
    rows = F.transform(list_at(page, f"{path}.tag"), lambda t, i: F.struct(
        F.nullif(_get(t, "$.name"), F.lit("")).alias("name"), F.coalesce(_get(t, "$.count").try_cast("int"), F.greatest(F.lit(0), F.lit(100) - 20 * i)).alias("weight")))
    return F.filter(rows, lambda x: x["name"].isNotNull())


def _picture(page: Column, path: str) -> Column:
    """The last picture that has an address, and none if that stands for a missing one."""
    urls = F.filter(F.transform(list_at(page, path), lambda i: _get(i, "$['#text']")), lambda u: F.coalesce(u, F.lit("")) != "")
    last = F.try_element_at(urls, F.lit(-1))
    return F.when(~last.contains(NO_PICTURE), last)


def artist_info(pages: DataFrame) -> DataFrame:
    """(file, name, mbid, url, image_url, listeners, playcount, bio, tags) of pages about artists."""
    a = _get(F.col("page"), "$.artist", "variant")
    return parsed(pages).where(F.schema_of_variant(a).startswith("OBJECT")).select(
        "file", _get(a, "$.name").alias("name"), F.nullif(_get(a, "$.mbid"), F.lit("")).alias("mbid"), _get(a, "$.url").alias("url"), _picture(a, "$.image").alias("image_url"),
        _get(a, "$.stats.listeners").try_cast("long").alias("listeners"), _get(a, "$.stats.playcount").try_cast("long").alias("playcount"),
        F.nullif(F.trim(_get(a, "$.bio.summary")), F.lit("")).alias("bio"), _tags(a, "$.tags").alias("tags"))


def album_info(pages: DataFrame) -> DataFrame:
    """(file, name, mbid, url, image_url, listeners, playcount, n_tracks, tags) of pages about albums."""
    a = _get(F.col("page"), "$.album", "variant")
    return parsed(pages).where(F.schema_of_variant(a).startswith("OBJECT")).select(
        "file", _get(a, "$.name").alias("name"), F.nullif(_get(a, "$.mbid"), F.lit("")).alias("mbid"), _get(a, "$.url").alias("url"), _picture(a, "$.image").alias("image_url"),
        _get(a, "$.listeners").try_cast("long").alias("listeners"), _get(a, "$.playcount").try_cast("long").alias("playcount"),
        F.nullif(F.size(list_at(a, "$.tracks.track")), F.lit(0)).alias("n_tracks"), _tags(a, "$.tags").alias("tags"))


def top_tags(pages: DataFrame) -> DataFrame:
    """(file, tag, weight) of pages of tags."""
    rows = parsed(pages).select("file", F.explode(_tags(F.col("page"), "$.toptags")).alias("t"))
    return rows.select("file", F.col("t.name").alias("tag"), F.col("t.weight").alias("weight"))


def similar_artists(pages: DataFrame) -> DataFrame:
    """(file, place, name, mbid, match) of pages of similar artists, as ranked; a match that is no number is 0."""
    rows = parsed(pages).select("file", F.posexplode(F.filter(list_at(F.col("page"), "$.similarartists.artist"), lambda a: F.coalesce(_get(a, "$.name"), F.lit("")) != "")).alias("place", "a"))
    a = F.col("a")
    return rows.select("file", "place", _get(a, "$.name").alias("name"), F.nullif(_get(a, "$.mbid"), F.lit("")).alias("mbid"), F.coalesce(_get(a, "$.match").try_cast("double"), F.lit(0.0)).alias("match"))
