"""Queries over the forms that data comes in: JSON pages, files of other encodings. Their text is made of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.functions.titles import clean_title
from playlog.functions.text import keyed
from playlog.model import PlayLog
from playlog.plans.catalog import _add
from playlog.operators import groups
from playlog.sources import decode, pages, wikitext


def _json(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"{key}": '), value, F.lit("}"))


def _recent(log: PlayLog) -> DataFrame:
    """One page an order: its lines are plays; one line is a bare object, some lines have no date, some pages are no answer."""
    line = F.struct(
        F.col("l_linenumber").alias("at"), F.concat(F.lit("Song "), F.col("l_partkey").cast("string")).alias("name"), F.struct(F.concat(F.lit("Supplier  "), F.col("l_suppkey").cast("string")).alias("#text")).alias("artist"),
        F.struct(F.when(F.col("l_returnflag") != "N", "Record").otherwise("").alias("#text")).alias("album"),
        F.when(F.col("l_linenumber") % 5 != 4, F.struct((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 60).cast("string").alias("uts"))).alias("date"))
    rows = log.spark.read.parquet(f"{log.sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(line)).alias("tracks"))  # an order has few lines
    track = F.when(F.size("tracks") == 1, F.to_json(F.col("tracks")[0])).otherwise(F.to_json("tracks"))
    answer = F.concat(F.lit('{"recenttracks": '), F.concat(F.lit('{"track": '), track, F.lit(', "@attr": {"page": "'), (F.col("o") + 1).cast("string"), F.lit('", "totalPages": 1}}')), F.lit("}"))
    text = F.when(F.col("o") % 97 == 5, "<html>busy</html>").when(F.col("o") % 89 == 3, '{"error": 8, "message": "later"}').otherwise(answer)
    return rows.select(F.col("o").cast("string").alias("file"), text.alias("text"))


def _artists(log: PlayLog) -> DataFrame:
    """One page a part, about an artist: tags as one bare object, as a list, or as an empty text."""
    p = F.col("p_partkey")
    tag = lambda *fields: F.to_json(F.struct(*fields))
    one = tag(F.col("p_type").alias("name"))
    several = F.concat(F.lit("["), one, F.lit(", "), tag(F.col("p_brand").alias("name"), F.lit("60").alias("count")), F.lit(', {"name": "", "count": "9"}, '), tag(F.col("p_name").alias("name"), F.lit("few").alias("count")), F.lit("]"))
    tags = F.when(p % 3 == 0, _json("tag", one)).when(p % 3 == 1, _json("tag", several)).otherwise(F.lit('""'))
    head = F.to_json(F.struct(F.col("p_name").alias("name"), F.when(p % 2 == 0, F.concat(F.lit("m-"), p.cast("string"))).otherwise("").alias("mbid"), F.struct((p * 7).cast("string").alias("listeners"), F.lit("many").alias("playcount")).alias("stats")))
    whole = F.concat(F.lit('{"artist": '), F.expr("substring(h, 1, length(h) - 1)"), F.lit(', "tags": '), F.col("t"), F.lit("}}"))
    rows = log.spark.read.parquet(f"{log.sf_dir}/part.parquet").select(p.cast("string").alias("file"), head.alias("h"), tags.alias("t"))
    return rows.select("file", whole.alias("text"))


_add("recent_pages", lambda x: pages.recent_plays(_recent(x)).select(F.col("file").cast("long").alias("o"), "artist", "track", "album", "ts"), [],
     """select l_orderkey as o, 'Supplier ' || l_suppkey as artist, 'Song ' || l_partkey as track, case when l_returnflag <> 'N' then 'Record' else '' end as album, l_orderkey * 1000 + l_linenumber * 60 as ts
from lineitem where l_linenumber % 5 <> 4 and l_orderkey % 97 <> 5 and l_orderkey % 89 <> 3""")
_add("recent_page_faults", lambda x: pages.faults(_recent(x), "recenttracks").select(F.col("file").cast("long").alias("o"), "fault"), [],
     "select distinct l_orderkey as o, case when l_orderkey % 97 = 5 then 'not JSON' else 'error 8' end as fault from lineitem where l_orderkey % 97 = 5 or l_orderkey % 89 = 3")
_add("artist_pages", lambda x: pages.artist_info(_artists(x)).select(F.col("file").cast("long").alias("p"), "name", "mbid", "listeners", "playcount", F.array_join(F.transform("tags", lambda t: F.concat(t["name"], F.lit(":"), t["weight"].cast("string"))), ",").alias("tags")), [],
     """select p_partkey as p, p_name as name, case when p_partkey % 2 = 0 then 'm-' || p_partkey end as mbid, p_partkey * 7 as listeners, null::bigint as playcount,
case p_partkey % 3 when 0 then p_type || ':100' when 1 then p_type || ':100,' || p_brand || ':60,' || p_name || ':40' else '' end as tags from part""")


def _decoded(log: PlayLog) -> DataFrame:
    """Customers' names with letters beyond ASCII, as bytes of one encoding or another."""
    name = F.concat("c_name", F.lit(" é€"))
    data = F.when(F.col("c_custkey") % 3 == 0, F.encode(name, "UTF-8")).when(F.col("c_custkey") % 3 == 1, F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit("20E980")))).otherwise(F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit("81E9"))))
    return log.spark.read.parquet(f"{log.sf_dir}/customer.parquet").select("c_custkey", decode.decode(data).alias("d")).select("c_custkey", "d.text", "d.encoding")


_add("decode_text", _decoded, [], "select c_custkey, c_name || case c_custkey % 3 when 2 then chr(129) || 'é' else ' é€' end as text, ['utf-8-sig', 'cp1252', 'latin-1'][c_custkey % 3 + 1] as encoding from customer")


def _album_titles(log: PlayLog) -> DataFrame:
    """Parts' names as albums' titles, as shops write them."""
    p = F.col("p_partkey")
    note = F.element_at(F.array(*[F.lit(n) for n in ("", " (Deluxe Edition)", " - EP", " - 2003 Remaster", " (Live)", " [Bonus Tracks] - Single")]), (p % 6 + 1).cast("int"))
    rows = log.spark.read.parquet(f"{log.sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", note).alias("title"))
    return keyed(rows, "title", clean_title).select("p_partkey", F.col("key.title").alias("title"), F.col("key.kind").alias("kind"))


_add("clean_title", _album_titles, [], "select p_partkey, case p_partkey % 6 when 4 then p_name || ' (Live)' else p_name end as title, case p_partkey % 6 when 2 then 'EP' when 5 then 'Single' end as kind from part")


def _month_pages(log: PlayLog) -> DataFrame:
    """One page a customer and month, with a table of its orders: a day's heading spans its rows, and so does the customer."""
    read = lambda t: log.spark.read.parquet(f"{log.sf_dir}/{t}.parquet")
    day = F.to_date("o_orderdate")
    orders = read("orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c"), F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))
    orders = orders.join(read("customer").select(F.col("c_custkey").alias("c"), "c_name"), "c")
    number = F.col("o_orderkey").cast("string")
    title = F.concat(F.lit(" ''Order "), number, F.lit("'' || {{nowrap|"), F.col("o_orderstatus"), F.lit("}} || || <ref>{{cite web\n|url=http://o/"), number, F.lit("\n|title=x}}</ref>"))
    days = orders.groupBy("c", "c_name", "year", "month", "day").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", title.alias("title")))).alias("rows"))  # a customer's orders of a day are few
    span = F.size("rows").cast("string")
    head = F.concat(F.lit("|-\n! scope=\"row\" rowspan="), span, F.lit(" | "), F.date_format(F.make_date("year", "month", "day"), "MMMM d"), F.lit("\n| rowspan="), span, F.lit(" | [[x|"), F.col("c_name"), F.lit("]]\n|"))
    text = F.concat(head, F.array_join(F.transform("rows", lambda r: r["title"]), "\n|-\n|"))
    pages_of = days.select("c", "year", "month", F.struct("day", text.alias("text")).alias("d")).groupBy("c", "year", "month").agg(F.sort_array(F.collect_list("d")).alias("days"))
    return pages_of.select("c", "year", "month", F.concat(F.lit("{|\n"), F.array_join(F.transform("days", lambda d: d["text"]), "\n"), F.lit("\n|}")).alias("text"))


_add("wikitext_rows", lambda x: wikitext.month_releases(_month_pages(x), F.col("text"), F.col("year"), F.col("month")).select("release_date", "artist", "title", "genre", "source_url"), [],
     "select o_orderdate::date as release_date, c_name as artist, 'Order ' || o_orderkey as title, o_orderstatus as genre, 'http://o/' || o_orderkey as source_url from orders join customer on c_custkey = o_custkey")


def _wanted(log: PlayLog) -> DataFrame:
    """Parts as albums, as shops write their titles."""
    p = F.col("p_partkey")
    note = F.element_at(F.array(*[F.lit(n) for n in ("", " (Deluxe Edition)", " - EP", " - 2003 Remaster", " (Live)", " [Bonus Tracks] - Single")]), (p % 6 + 1).cast("int"))
    rows = log.spark.read.parquet(f"{log.sf_dir}/part.parquet")
    return rows.select(p.alias("album_id"), F.concat(F.lit("Maker "), (p % 10).cast("string")).alias("artist"), F.concat("p_name", F.lit(" "), p.cast("string"), note).alias("title"))


def _groups(log: PlayLog) -> DataFrame:
    """Release groups of three parts in four, some of another type, live, or found with little confidence."""
    p = F.col("p_partkey")
    rows = log.spark.read.parquet(f"{log.sf_dir}/part.parquet").where("p_partkey % 4 <> 3")
    kind = F.element_at(F.array(F.lit("Album"), F.lit("EP"), F.lit("Single")), (F.floor(p / 6) % 3 + 1).cast("int"))
    return rows.select((p + 1000000).alias("group_id"), F.upper(F.concat("p_name", F.lit(" "), p.cast("string"))).alias("title"), F.concat(F.lit("MAKER "), (p % 10).cast("string"), F.lit(" & friends")).alias("credit"), kind.alias("kind"),
                       F.when(p % 5 == 0, F.array(F.lit("Live"))).otherwise(F.array().cast("array<string>")).alias("others"), F.when(p % 11 == 0, 80).otherwise(95).alias("score"))


_add("release_groups", lambda x: groups.matched(_wanted(x), _groups(x)), [], """select p_partkey as album_id, case when ok then p_partkey + 1000000 end as group_id, case when not ok then 'none' when p_partkey % 6 = 0 then 'exact' else 'edition-free' end as outcome from (
  select p_partkey, p_partkey % 4 <> 3 and p_partkey % 11 <> 0 and case p_partkey % 6 when 0 then true when 2 then kind = 1 when 5 then kind = 2 when 4 then false else kind < 2 and p_partkey % 5 <> 0 end as ok
  from (select p_partkey, p_partkey // 6 % 3 as kind from part))""")
