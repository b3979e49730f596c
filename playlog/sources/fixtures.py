"""What a play log keeps besides plays, made from the test tables: titles, lookup results, loved entries and name rules.

Every column is arithmetic on ids, so that SQL makes the same rows.  "Now" is the newest play.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.model import PlayLog

DAY = 86400


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def tracks(log: PlayLog) -> DataFrame:
    """(track_id, artist_id, title): an artist's tracks 0 and 1 differ by an edition note alone."""
    note = F.when(F.col("track_id") % 100 == 1, " (Remastered 2011)").when(F.col("track_id") % 100 == 5, " - Live at Home").otherwise("")
    number = F.when(F.col("track_id") % 100 == 1, 0).otherwise(F.col("track_id") % 100).cast("string")
    return log.plays.select("track_id", "artist_id").distinct().withColumn("title", F.concat(F.lit("Song "), number, note))


def album_titles(log: PlayLog) -> DataFrame:
    """(album_id, artist_id, title): an artist's albums 0 and 1 differ by an edition note alone."""
    other = F.when(F.col("artist_id") % 4 == 0, "Live Record").otherwise("Best of Record")
    kind = F.col("album_id") % 100
    return log.albums.select("album_id", "artist_id", F.when(kind == 0, "Record").when(kind == 1, "Record (Deluxe Edition)").otherwise(other).alias("title"))


def artist_info(log: PlayLog) -> DataFrame:
    """(artist_id, status, fetched_at, listeners, corrected): four of five artists were looked up; some names were corrected."""
    a = F.col("artist_id")
    corrected = F.when(a % 11 == 0, F.upper("name")).when(a % 40 == 3, F.concat(F.split("name", " ")[0], F.lit(" ring")))
    return log.artists.where(a % 5 != 0).crossJoin(F.broadcast(log.span)).select(
        "artist_id", _pick(a, "ok", "ok", "not_found", "error").alias("status"), (F.col("hi") - a * 7919 % 200 * DAY).alias("fetched_at"),
        (F.lit(50) + a * 37 % 30011).alias("listeners"), corrected.alias("corrected"))


def album_info(log: PlayLog) -> DataFrame:
    """(album_id, status, fetched_at, mb_status, mb_fetched_at, has_cover) of the albums that were looked up."""
    a = F.col("album_id")
    owner = F.floor(a / 100)
    mb = F.when(owner % 3 == 1, "ok").when(owner % 3 == 2, "error")
    return log.albums.where((owner + a) % 5 != 0).crossJoin(F.broadcast(log.span)).select(
        "album_id", "release_date", _pick(owner, "ok", "ok", "not_found", "error").alias("status"), (F.col("hi") - a * 31 % 200 * DAY).alias("fetched_at"),
        mb.alias("mb_status"), F.when(mb.isNotNull(), F.col("hi") - a * 13 % 200 * DAY).alias("mb_fetched_at"), (a % 2 == 0).alias("has_cover"))


def place_tags(log: PlayLog) -> DataFrame:
    """(artist_id, tag, weight): the nation of two suppliers in three."""
    read = lambda t: log.spark.read.parquet(f"{log.sf_dir}/{t}.parquet")
    rows = read("supplier").where("s_suppkey % 3 <> 0").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("artist_id"), F.col("n_name").alias("tag"), F.lit(100).alias("weight"))


def loved_entries(log: PlayLog) -> DataFrame:
    """(artist_key, title_key, loved_at) as a service lists them, by name: known ones, unknown titles and unknown artists."""
    names = log.artists.select("artist_id", F.lower("name").alias("artist_key"))
    known = log.loved.join(tracks(log), ["track_id", "artist_id"]).join(names, "artist_id").select("artist_key", F.lower("title").alias("title_key"), "loved_at")
    odd = names.where("artist_id % 5 = 0").select("artist_key", F.lit("song 0 (live)").alias("title_key"), (F.col("artist_id") * DAY).alias("loved_at"))
    nations = log.spark.read.parquet(f"{log.sf_dir}/nation.parquet")
    far = nations.select(F.lower("n_name").alias("artist_key"), F.lit("song 0").alias("title_key"), (F.col("n_nationkey").cast("long") * DAY).alias("loved_at"))
    return known.unionByName(odd).unionByName(far)


def artist_aliases(log: PlayLog) -> DataFrame:
    """(name_key, artist_id): every second nation is another name of the supplier of its number, where there is one."""
    nations = log.spark.read.parquet(f"{log.sf_dir}/nation.parquet").where("n_nationkey % 2 = 0")
    rows = nations.select(F.lower("n_name").alias("name_key"), F.col("n_nationkey").cast("long").alias("artist_id"))
    return rows.join(log.artists.select("artist_id"), "artist_id", "left_semi").select("name_key", "artist_id")


def title_rules(log: PlayLog) -> DataFrame:
    """(artist_key, title_key, track_id): loved entries that a user has matched by hand."""
    return log.artists.where("artist_id % 20 = 0").select(F.lower("name").alias("artist_key"), F.lit("song 0 (live)").alias("title_key"), (F.col("artist_id") * 100).alias("track_id"))


def track_aliases(log: PlayLog) -> DataFrame:
    """(artist_id, title_key, track_id): titles that were merged into another track."""
    return log.artists.where("artist_id % 30 = 10").select("artist_id", F.lit("song 0 (live)").alias("title_key"), (F.col("artist_id") * 100 + 3).alias("track_id"))


def artist_ids(log: PlayLog) -> DataFrame:
    """(mbid, artist_id): ids known of every third artist."""
    return log.artists.where("artist_id % 3 = 0").select(F.concat(F.lit("id-"), F.col("artist_id").cast("string")).alias("mbid"), "artist_id")


def releases(log: PlayLog) -> DataFrame:
    """(release_id, credit_key, ids, part_keys): one a supplier, by id, by name, by a namesake's id or with a second name, and one a nation."""
    a = F.col("artist_id")
    ids = F.when(a % 4 == 0, F.array(F.concat(F.lit("id-"), a.cast("string")))).when(a % 4 == 1, F.array(F.lit("id-of-another"))).otherwise(F.array().cast("array<string>"))
    joint = a % 4 == 3
    credit = F.when(joint, F.concat(F.lower("name"), F.lit(" & nation_2"))).otherwise(F.lower("name"))
    parts = F.when(joint, F.array(F.lower("name"), F.lit("nation_2"))).otherwise(F.array().cast("array<string>"))
    own = log.artists.select(a.alias("release_id"), credit.alias("credit_key"), ids.alias("ids"), parts.alias("part_keys"))
    nations = log.spark.read.parquet(f"{log.sf_dir}/nation.parquet")
    none = F.array().cast("array<string>")
    return own.unionByName(nations.select((F.lit(10_000_000) + F.col("n_nationkey")).cast("long").alias("release_id"), F.lower("n_name").alias("credit_key"), none.alias("ids"), none.alias("part_keys")))


def release_list(log: PlayLog) -> DataFrame:
    """releases with (title_key, kind, day, source): the above as one source lists them, and every fifth supplier's told of by another."""
    own = releases(log).withColumns({"source": F.lit("listenbrainz"), "number": F.col("release_id")})
    other = log.artists.where("artist_id % 5 = 0").select((F.lit(20_000_000) + F.col("artist_id")).alias("release_id"), F.lower("name").alias("credit_key"), F.col("artist_id").alias("number"))
    none = F.array().cast("array<string>")
    other = other.withColumns({"ids": none, "part_keys": none, "source": F.lit("wikipedia")})
    newest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("hi") / DAY).cast("int"))
    kind = F.when(F.col("source") == "wikipedia", "Album").otherwise(_pick(F.col("number"), "Album", "EP", "Single"))
    rows = own.unionByName(other).crossJoin(F.broadcast(log.span.select("hi")))
    return rows.select("release_id", "credit_key", "ids", "part_keys", F.concat(F.lit("title "), F.col("number").cast("string")).alias("title_key"), kind.alias("kind"),
                       F.date_add(newest, (F.col("number") * 5 % 60).cast("int")).alias("day"), "source")


def new_releases(log: PlayLog) -> DataFrame:
    """release_list rows of artists that the library does not know: one a customer, every sixth with an EP of the same name, some with ids or another artist."""
    read = lambda t: log.spark.read.parquet(f"{log.sf_dir}/{t}.parquet")
    customers = read("customer").select(F.col("c_custkey").alias("c"), F.lower("c_name").alias("name_key"))
    parts = F.broadcast(read("part").agg(F.count("*").alias("parts")))
    named = customers.crossJoin(parts).withColumn("p", F.col("c") % F.col("parts") + F.lit(1)).join(read("part").select(F.col("p_partkey").alias("p"), "p_name"), "p")
    guests = customers.select((F.col("c") - 1).alias("c"), F.col("name_key").alias("guest"))
    rows = named.join(guests, "c", "left").crossJoin(F.broadcast(log.span.select("hi")))
    twice = F.explode(F.when(F.col("c") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("second")
    none = F.array().cast("array<string>")
    rows = rows.select("*", twice)
    title = F.concat("p_name", F.when((F.col("c") % 5 == 0) | (F.col("second") == 1), " (Deluxe Edition)").otherwise(""))
    kind = F.when(F.col("second") == 1, "EP").otherwise(_pick(F.col("c"), "Album", "EP", "Single"))
    return rows.select(
        (F.lit(30_000_000) + F.col("second") * 10_000_000 + F.col("c")).alias("release_id"), F.col("name_key").alias("credit_key"), "name_key",
        F.when(F.col("c") % 3 == 0, F.array(F.concat(F.lit("cid-"), F.col("c").cast("string")))).otherwise(none).alias("ids"),
        F.when((F.col("c") % 4 == 0) & F.col("guest").isNotNull(), F.array("guest")).otherwise(none).alias("part_keys"), title.alias("title"), F.lower(title).alias("title_key"), kind.alias("kind"),
        F.date_add(local_day(F.col("hi")), (F.col("c") * 5 % 60).cast("int")).alias("day"), F.lit("listenbrainz").alias("source"))


def local_day(ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / DAY).cast("int"))


def similar_artists(log: PlayLog) -> DataFrame:
    """(seed_key, name_key, mbid, match): a supplier is like the customers that bought from it; every second of those with an id are known by that alone."""
    read = lambda t: log.spark.read.parquet(f"{log.sf_dir}/{t}.parquet")
    bought = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s"), F.col("o_custkey").alias("c")).distinct()
    rows = bought.join(read("supplier").select(F.col("s_suppkey").alias("s"), F.lower("s_name").alias("seed_key")), "s")
    rows = rows.join(read("customer").select(F.col("c_custkey").alias("c"), F.lower("c_name").alias("name")), "c")
    by_id = (F.col("c") % 3 == 0) & (F.col("s") % 2 == 0)
    number = F.col("c").cast("string")
    return rows.select("seed_key", F.when(by_id, F.concat(F.lit("alias "), number)).otherwise(F.col("name")).alias("name_key"),
                       F.when(by_id, F.concat(F.lit("cid-"), number)).otherwise("").alias("mbid"), ((F.col("s") * 7 + F.col("c") * 3) % 100 / 100).alias("match"))


def new_artist_tags(log: PlayLog) -> DataFrame:
    """(name_key, tag, weight): genres of the customers, spelled in another way than the library's, and one that it lacks."""
    read = lambda t: log.spark.read.parquet(f"{log.sf_dir}/{t}.parquet")
    parts = F.broadcast(read("part").agg(F.count("*").alias("parts")))
    rows = read("customer").where("c_custkey % 7 <> 0").crossJoin(parts).withColumn("p", F.col("c_custkey") % F.col("parts") + F.lit(1))
    rows = rows.join(read("part").select(F.col("p_partkey").alias("p"), "p_type", "p_brand", "p_name"), "p")
    pairs = ((F.upper("p_type"), 100), (F.lower("p_brand"), 60), (F.concat(F.lit("-"), F.split("p_name", " ")[0]), 40), (F.concat(F.split("p_name", " ")[0], F.lit("_")), 30), (F.col("c_mktsegment"), 20))
    return rows.select(F.lower("c_name").alias("name_key"), F.explode(F.array(*[F.struct(tag.alias("tag"), F.lit(weight).alias("weight")) for tag, weight in pairs])).alias("t")).select("name_key", "t.tag", "t.weight")
