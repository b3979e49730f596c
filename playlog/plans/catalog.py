"""Every query of the play-log operators, with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.functions.text import csv_guard, keyed, parse_date, tag_classify, tag_fold, tag_normalize
from playlog.model import PlayLog
from playlog.operators import adhoc, cohorts, derive, editions, genres, insights, library, lookups, periods, releases, resolve, taste, yearly
from playlog.sources import fixtures
from playlog.streaming import ingest as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
YEAR = 1998


def _plays_sql(profile: str) -> str:
    a, b = ("l_partkey", "l_suppkey") if profile == "part" else ("l_suppkey", "l_partkey")
    return f"""raw as (select epoch(o_orderdate)::bigint + (o_orderkey * 7919) % 79200 + l_linenumber * 210 as t, {a} as a, {b} as b, l_returnflag as f
  from orders join lineitem on l_orderkey = o_orderkey),
p0 as (select t - t % 60 as ts, a as artist_id, a * 100 + (b % 7) * (b % 2) as track_id, min(case when f <> 'N' then a * 100 + b % 3 end) as album_id from raw group by 1, 2, 3),
p as materialized (select *, make_timestamp(ts * 1000000)::date as lday, hour(make_timestamp(ts * 1000000))::int as lhour, (isodow(make_timestamp(ts * 1000000)) - 1)::int as lwday from p0),
sp as (select min(ts) as lo, max(ts) as hi from p)"""


SESSIONS = """g as (select *, case when ts - lag(ts) over (order by ts, artist_id, track_id) <= 1800 then 0 else 1 end as brk from p),
s as materialized (select * exclude (brk), sum(brk) over (order by ts, artist_id, track_id rows unbounded preceding)::bigint as session_id from g)"""
STATS = """st as (select artist_id, count(*) as plays, min(ts) as first_ts, max(ts) as last_ts, min(lday) as first_lday, count(distinct track_id) as n_tracks,
  count(distinct lday) as n_days, count(distinct year(lday)) as n_years, count(distinct session_id) as n_sessions,
  (min(ts) < (select lo from sp) + 30 * 86400)::int as prehistory, arg_min(track_id, ts * 1000000000 + track_id) as first_track_id from s group by artist_id)"""
GATEWAY = """gl as (select *, lag(artist_id) over (partition by session_id order by ts, artist_id, track_id) as gw,
  row_number() over (partition by artist_id order by ts, track_id) as k from s),
gt as (select artist_id, gw as gateway_id from gl where k = 1 and ts >= (select lo from sp) + 30 * 86400)"""
LOVED = """lv as (select track_id, artist_id, min(ts) + (track_id % 40) * 864000 as loved_at from p where track_id % 17 = 0 group by track_id, artist_id)"""
TIMING = """lt0 as (select p.track_id, p.artist_id, loved_at, min(ts) as first_ts, max(ts) as last_ts, count(*) as plays, count(*) filter (where ts <= loved_at) as n,
  max(ts) filter (where ts <= loved_at) as latest from p join lv on lv.track_id = p.track_id group by 1, 2, 3),
lt as (select track_id, artist_id, loved_at, first_ts, last_ts, plays, n - coalesce((latest > loved_at - 600)::bigint, 0) as plays_before from lt0)"""
TAGS = """tg as (select p_partkey as artist_id, unnest([p_type, p_brand, split_part(p_name, ' ', 1)]) as tag, unnest([100, 60, 40]) as weight from part),
sh as (select artist_id, tag, weight / sum(weight) over (partition by artist_id) as share from tg)"""
ALBUMS = """al as (select distinct album_id, artist_id, substr((date '1965-01-01' + ((album_id * 37) % 13000)::int)::varchar, 1, [4, 7, 10][album_id % 3 + 1]) as release_date from p where album_id is not null),
ad as (select *, substr(release_date, 1, 4)::int as ry, case length(release_date) when 4 then release_date || '-07-01' when 7 then release_date || '-15' else release_date end::date as mid,
  case length(release_date) when 4 then release_date || '-01-01' when 7 then release_date || '-01' else release_date end::date as lo from al),
dp as (select p.album_id, p.artist_id, lday, count(*) as n, ry, mid from p join ad on ad.album_id = p.album_id group by all)"""
LINKS = """hd as (select session_id, artist_id, row_number() over (partition by session_id order by count(*) desc, artist_id) as r from s group by session_id, artist_id),
cp as materialized (select session_id, artist_id from hd where r <= 30), sz as (select artist_id, count(*) as n from cp group by artist_id),
pr as (select x.artist_id as a, y.artist_id as b, count(*) as shared from cp x join cp y on x.session_id = y.session_id and x.artist_id < y.artist_id group by 1, 2),
lk as (select a, b, shared, shared / sqrt(x.n * y.n) as score from pr join sz x on x.artist_id = a join sz y on y.artist_id = b where shared >= {least})"""


def _add(name: str, run: Callable[[PlayLog], DataFrame], parts: list[str] | None = None, sql: str = "", profile: str = "part", **values) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(PlayLog(spark, sf_dir, profile))
    if parts is not None:
        ORACLES[name] = "with " + ",\n".join([_plays_sql(profile), *[p.format(**values) if "{least}" in p else p for p in parts]]) + ("" if sql.startswith(",") else "\n") + sql


def _sessions(log: PlayLog) -> DataFrame:
    return log.sessions


def _stats(log: PlayLog) -> DataFrame:
    return log.stats


def _timing(log: PlayLog) -> DataFrame:
    return insights.love_timing(log.plays, log.loved)


def _shares(log: PlayLog) -> DataFrame:
    return genres.genre_shares(log.tags)


def _cells(log: PlayLog, dim: str) -> DataFrame:
    return genres.lift_cells(log.observed.where(F.col("dim") == dim).drop("dim"))


# derived tables
_add("sessionize", lambda x: _sessions(x).select("ts", "artist_id", "track_id", "session_id"), [SESSIONS], "select ts, artist_id, track_id, session_id from s")
_add("recompute_local_time", lambda x: x.plays.select("ts", "artist_id", "track_id", "lday", "lhour", "lwday"), [], "select ts, artist_id, track_id, lday, lhour, lwday from p")
_add("ingest_dedup", lambda x: x.plays.select("ts", "artist_id", "track_id", "album_id"), [], "select ts, artist_id, track_id, album_id from p")
_add("artist_stats", _stats, [SESSIONS, STATS], "select * from st")
_add("prehistory", lambda x: _stats(x).where("prehistory = 1").select("artist_id", "first_ts"), [SESSIONS, STATS], "select artist_id, first_ts from st where prehistory = 1")
_add("gateway", lambda x: x.gateway, [SESSIONS, GATEWAY], "select * from gt")
_add("co_links", lambda x: x.links, [SESSIONS, LINKS], "select * from lk", profile="supp", least=3)
_add("related", lambda x: derive.related(x.links), [SESSIONS, LINKS],
     """, bo as (select a as artist_id, b as other_id, shared, score from lk union all select b, a, shared, score from lk)
select artist_id, other_id, shared, score from bo qualify row_number() over (partition by artist_id order by round(score, 9) desc, other_id) <= 15""", profile="supp", least=3)
# periods
_add("range_filter", lambda x: periods.in_range(x.plays, "1996-01-01", "1997-06-30").select("ts", "artist_id", "track_id"), [], "select ts, artist_id, track_id from p where lday between date '1996-01-01' and date '1997-06-30'")
_add("overview", lambda x: periods.overview(x.plays, _stats(x)), [SESSIONS, STATS], """, dd as (select lday, lday - row_number() over (order by lday)::int as g from (select distinct lday from p)), sk as (select min(lday) as a, max(lday) as b, count(*) as n from dd group by g),
rt as (select artist_id, count(*) as n from p where ts > (select hi from sp) - 30 * 86400 group by 1 order by n desc, artist_id limit 5)
select count(*) as plays, count(distinct artist_id) as artists, count(distinct track_id) as tracks, count(distinct album_id) as albums, count(distinct lday) as days,
min(lday) as first_day, max(lday) as last_day, count(*) / (max(lday) - min(lday) + 1) as per_day, count(*) / count(distinct lday) as per_listening_day,
(select sum(n) from (select count(*) as n from p group by artist_id order by n desc, artist_id limit 10)) / count(*) as top10_share,
(select max(n) from sk) as longest_streak, (select min(b) from sk where n = (select max(n) from sk)) as longest_streak_end, (select n from sk order by b desc limit 1) as current_streak,
(select count(*) from st where first_ts > (select hi from sp) - 30 * 86400 and prehistory = 0) as new_artists_30d, coalesce((select string_agg(artist_id::varchar, ',' order by n desc, artist_id) from rt), '') as recent_top from p""")
_add("timeline", lambda x: periods.timeline(x.plays, _stats(x)), [SESSIONS, STATS], """, m as (select unnest(generate_series(date_trunc('month', min(lday)), date_trunc('month', max(lday)), interval 1 month))::date as month from p),
a as (select date_trunc('month', lday)::date as month, p.artist_id, count(*) as n, count(*) filter (where ts - first_ts < 365 * 86400 and prehistory = 0) as fresh from p join st using (artist_id) group by 1, 2),
t as (select month, sum(n)::bigint as plays, sum(fresh)::bigint as fresh, arg_max(artist_id, n * 1000000000 - artist_id) as top_artist from a group by month),
nw as (select date_trunc('month', first_lday)::date as month, count(*) as k from st where prehistory = 0 group by 1)
select m.month, coalesce(plays, 0)::bigint as plays, coalesce(k, 0)::bigint as new_artists, fresh / plays as novelty, top_artist from m left join t using (month) left join nw using (month)""")
for _unit in ("day", "month"):
    _add("activity_daily" if _unit == "day" else "activity_monthly", lambda x, u=_unit: periods.activity(x.plays, _stats(x), u), [SESSIONS, STATS], f""", c as (select date_trunc('{_unit}', lday)::date as bucket, artist_id, count(*) as n from p group by 1, 2),
d as (select bucket, sum(n)::bigint as n, arg_max(artist_id, n * 1000000000 - artist_id) as top_artist, max(n) as top_plays from c group by 1), w as (select date_trunc('{_unit}', first_lday)::date as bucket, count(*) as k from st where prehistory = 0 group by 1)
select b.bucket, coalesce(n, 0)::bigint as plays, coalesce(k, 0)::bigint as new_artists, top_artist, top_plays from (select unnest(generate_series((select min(bucket) from d), (select max(bucket) from d), interval 1 {_unit}))::date as bucket) b left join d using (bucket) left join w using (bucket)""")
for _key in ("artist", "track", "album"):
    _add(f"top_{_key}s", lambda x, k=_key: periods.top(x.plays, f"{k}_id"), [], f"select {_key}_id, count(*) as plays, count(distinct lday) as days from p where {_key}_id is not null group by 1 order by plays desc, {_key}_id limit 50")
    _add(f"year_top_{_key}s", lambda x, k=_key: periods.top(yearly.of_year(x.plays, YEAR), f"{k}_id", 10), [], f"select {_key}_id, count(*) as plays, count(distinct lday) as days from p where year(lday) = {YEAR} and {_key}_id is not null group by 1 order by plays desc, {_key}_id limit 10")
for _name, _where in (("clock", "true"), ("year_clock", f"year(lday) = {YEAR}")):
    _add(_name, lambda x, y=_name: periods.clock(x.plays if y == "clock" else yearly.of_year(x.plays, YEAR)), [], f""", c as (select w::int as lwday, h::int as lhour from range(7) a(w), range(24) b(h))
select lwday, lhour, (select count(*) from p where p.lwday = c.lwday and p.lhour = c.lhour and {_where}) as plays from c""")
_add("streaks", lambda x: periods.streaks(x.plays), [], """, d as (select lday, lday - row_number() over (order by lday)::int as g from (select distinct lday from p))
select min(lday) as start_day, max(lday) as end_day, count(*) as length from d group by g""")
OBSESSION = """, c as (select date_trunc('month', lday)::date as month, artist_id, count(*) as plays from p group by 1, 2),
b as (select *, sum(plays) over (partition by month) as total, row_number() over (partition by month order by plays desc, artist_id) as r from c)
select month, artist_id, plays, plays / total as share from b where r = 1 and total >= 50"""
_add("obsessions", lambda x: periods.obsessions(x.plays), [], OBSESSION)
_add("eras", lambda x: periods.eras(x.plays), [], """, b as (select year(lday)::int as year, artist_id, count(*) as n from p group by 1, 2),
w as (select *, sum(n) over (partition by year) as iy, sum(n) over (partition by artist_id) as ever, (select count(*) from p) as t from b)
select year, artist_id, n as plays, round((n / iy) / (ever / t), 6) as lift from w where n >= greatest(10, iy * 0.005)
qualify row_number() over (partition by year order by round((n / iy) / (ever / t), 6) desc, n desc, artist_id) = 1""", profile="supp")
_add("era_cards", lambda x: periods.era_cards(x.plays, _stats(x)), [SESSIONS, STATS], """, b as (select year(lday)::int as year, artist_id, count(*) as n from p group by 1, 2),
w as (select *, sum(n) over (partition by year) as iy, sum(n) over (partition by artist_id) as ever, (select count(*) from p) as t from b),
eg as (select year, artist_id as signature, round((n / iy) / (ever / t), 6) as lift from w where n >= greatest(10, iy * 0.005) qualify row_number() over (partition by year order by round((n / iy) / (ever / t), 6) desc, n desc, artist_id) = 1),
r as (select b.*, row_number() over (partition by year order by n desc, b.artist_id) as r, coalesce(prehistory = 0 and year(first_lday) = year, false) as new from b left join st using (artist_id)),
y as (select year, sum(n)::bigint as plays, count(*) as artists, count(*) filter (where new) as new_artists, string_agg(artist_id::varchar, ',' order by r) filter (where r <= 8) as top, arg_max(artist_id, n * 1000000000 - artist_id) filter (where new) as best_new from r group by 1)
select y.*, signature, lift from y left join eg using (year)""", profile="supp")
_add("recent", lambda x: periods.recent(x.plays), [], "select ts, artist_id, track_id, album_id from p order by ts desc, artist_id desc, track_id desc limit 50")
_add("binges", lambda x: periods.binges(x.plays, 3), [], "select lday, track_id, count(*) as plays from p group by 1, 2 having count(*) >= 3", profile="supp")
_add("binges_relaxed", lambda x: periods.binges(x.plays, 3), [], "select lday, track_id, count(*) as plays from p group by 1, 2 having count(*) >= 3", profile="supp")
_add("one_track", lambda x: periods.one_track(x.plays), [], """, b as (select artist_id, track_id, count(*) as n from p group by 1, 2),
t as (select artist_id, sum(n)::bigint as plays, arg_max(track_id, n * 1000000000 - track_id) as track_id, max(n) as top_plays from b group by 1)
select *, top_plays / plays as share from t where plays >= 15 and round(top_plays / plays, 9) >= 0.75""")
_add("velocity_weekly", lambda x: periods.velocity_weekly(x.plays), [], """, c as (select artist_id from p group by 1 order by count(*) desc, artist_id limit 6),
w as (select artist_id, lday - lwday as week, count(*) as n from p where artist_id in (from c) group by 1, 2),
ax as (select unnest(generate_series((select min(week) from w), (select max(week) from w), interval 7 day))::date as week)
select artist_id, week, sum(coalesce(n, 0)) over (partition by artist_id order by week)::bigint as plays from c cross join ax left join w using (artist_id, week)""", profile="supp")
_add("days_to_n", lambda x: periods.days_to_n(x.plays), [], """, k as (select *, row_number() over (partition by artist_id order by ts, track_id) as k from p)
select artist_id, min(lday) filter (where k = 100) - min(lday) as days_to_100, min(lday) filter (where k = 500) - min(lday) as days_to_500, min(lday) filter (where k = 1000) - min(lday) as days_to_1000 from k group by 1""", profile="supp")
_add("fastest_30d", lambda x: periods.fastest_30d(x.plays), [], """, d as (select artist_id, lday, count(*) as n from p group by 1, 2),
f as (select artist_id, lday, sum(n) over w as plays, min(lday) over w as start_day from d window w as (partition by artist_id order by lday range between interval 29 day preceding and current row))
select artist_id, plays::bigint as plays, start_day from f qualify row_number() over (partition by artist_id order by plays desc, lday) = 1""", profile="supp")
_add("comeback", lambda x: periods.comeback(x.plays), [], """, d as (select lday, row_number() over (order by lday) as no from (select distinct lday from p)),
k as (select *, lag(lday) over w as prev, ts - lag(ts) over w as gap, row_number() over w as k, count(*) over (partition by artist_id) as n from p window w as (partition by artist_id order by ts, track_id))
select artist_id, prev as left_day, k.lday as back_day, gap, n - k + 1 as plays_after from k join d x on x.lday = prev join d y on y.lday = k.lday where gap >= 365 * 86400 and k - 1 >= 3 and n - k + 1 >= 3 and y.no - x.no - 1 >= 100""")
_add("album_continuation", lambda x: periods.album_continuation(_sessions(x), f"{YEAR}-01-01", f"{YEAR}-12-31"), [SESSIONS], f""", q as (select *, lag(album_id) over (partition by session_id order by ts, artist_id, track_id) as pa from s)
select count(*) as pairs, count(*) filter (where pa = album_id) as same from q where year(lday) = {YEAR} and pa is not null and album_id is not null""")
# insights
_add("forgotten", lambda x: insights.forgotten(_stats(x), x.span), [SESSIONS, STATS], "select artist_id, plays, last_ts from st where last_ts < (select hi from sp) - 365 * 86400 and plays >= 20")
RISING = """, b as (select artist_id, count(*) filter (where ts > hi - 90 * 86400) as recent, count(*) filter (where ts <= hi - 90 * 86400) as before from p, sp where ts > hi - 455 * 86400 group by 1)
select *, round((recent + 1) / (before * 90 / 365 + 1), 6) as growth from b where recent >= 8 and round((recent + 1) / (before * 90 / 365 + 1), 6) >= 1.25"""
_add("rising", lambda x: insights.rising(x.plays, x.span), [], RISING, profile="supp")
_add("staying_power", lambda x: _stats(x).where("n_years >= 2").select("artist_id", "n_years", "plays"), [SESSIONS, STATS], "select artist_id, n_years, plays from st where n_years >= 2")
_add("deep_dives", lambda x: _stats(x).orderBy(F.desc("n_tracks"), F.desc("plays"), "artist_id").limit(50).select("artist_id", "n_tracks", "plays"), [SESSIONS, STATS], "select artist_id, n_tracks, plays from st order by n_tracks desc, plays desc, artist_id limit 50")
_add("gateways", lambda x: insights.gateways(_stats(x), x.gateway), [SESSIONS, STATS, GATEWAY], "select gateway_id, count(*) as led_to, sum(plays)::bigint as downstream from gt join st using (artist_id) where gateway_id is not null group by 1")
_add("led_to", lambda x: x.gateway.where("gateway_id = 1").select("artist_id"), [SESSIONS, GATEWAY], "select artist_id from gt where gateway_id = 1")
_add("love_timing", _timing, [LOVED, TIMING], "select * from lt")
_add("instant_love", lambda x: insights.instant_love(_timing(x), x.span), [LOVED, TIMING], "select track_id, loved_at, plays_before from lt, sp where plays_before <= 2 and loved_at >= first_ts - 86400 and first_ts >= lo + 30 * 86400")
_add("slow_burners", lambda x: insights.slow_burners(_timing(x), 5), [LOVED, TIMING], "select track_id, loved_at, plays_before from lt where plays_before >= 5", profile="supp")
_add("slow_burners_relaxed", lambda x: insights.slow_burners(_timing(x), 5), [LOVED, TIMING], "select track_id, loved_at, plays_before from lt where plays_before >= 5", profile="supp")
_add("loved_left", lambda x: insights.loved_left(_timing(x), x.span), [LOVED, TIMING], "select track_id, plays, last_ts from lt, sp where last_ts < hi - 365 * 86400")
_add("unloved", lambda x: insights.unloved(x.plays, x.loved), [LOVED], "select track_id, count(*) as plays from p where track_id not in (select track_id from lv) and exists (from lv) group by 1 order by plays desc, track_id limit 50")
_add("loved_by_artist", lambda x: insights.loved_by_artist(x.loved), [LOVED], "select artist_id, count(*) as loved, 1 + 0.5::double * least(count(*), 4) as boost from lv group by 1")
_add("rediscover", lambda x: insights.rediscover(x.plays, x.weak_links, x.loved, x.span), [SESSIONS, LINKS, LOVED], """, c as (select artist_id as core_id from p, sp where ts > hi - 90 * 86400 group by 1 order by count(*) desc, artist_id limit 20),
q as (select artist_id, count(*) as plays, max(ts) as last_ts from p group by 1), l as (select artist_id, count(*) as loved from lv group by 1),
z as (select q.artist_id, plays, coalesce(loved, 0) as loved from q left join l using (artist_id), sp where last_ts < hi - 365 * 86400 and (plays >= 5 or coalesce(loved, 0) > 0)),
bo as (select a as artist_id, b as core_id, score from lk union all select b, a, score from lk),
n as (select artist_id, sum(score) as link from bo where core_id in (from c) group by 1)
select artist_id, plays, loved, round(link * ln(1 + plays) * (1 + 0.5::double * case when plays < 5 then least(loved, 1) else least(loved, 4) end), 6) as rank from n join z using (artist_id) order by rank desc, artist_id limit 50""", least=2)
_add("rediscover_relaxed", lambda x: insights.rediscover(x.plays, x.weak_links, x.loved, x.span), [SESSIONS, LINKS, LOVED], """, c as (select artist_id as core_id from p, sp where ts > hi - 90 * 86400 group by 1 order by count(*) desc, artist_id limit 20),
q as (select artist_id, count(*) as plays, max(ts) as last_ts from p group by 1), l as (select artist_id, count(*) as loved from lv group by 1),
z as (select q.artist_id, plays, coalesce(loved, 0) as loved from q left join l using (artist_id), sp where last_ts < hi - 365 * 86400 and (plays >= 5 or coalesce(loved, 0) > 0)),
bo as (select a as artist_id, b as core_id, score from lk union all select b, a, score from lk),
n as (select artist_id, sum(score) as link from bo where core_id in (from c) group by 1)
select artist_id, plays, loved, round(link * ln(1 + plays) * (1 + 0.5::double * case when plays < 5 then least(loved, 1) else least(loved, 4) end), 6) as rank from n join z using (artist_id) order by rank desc, artist_id limit 50""", least=2)
_add("graph_edges", lambda x: insights.graph_edges(x.links, _stats(x)), [SESSIONS, STATS, LINKS], """, t as (select artist_id from st order by plays desc, artist_id limit 120)
select a, b, shared, score from lk where a in (from t) and b in (from t)""", profile="supp", least=3)
_add("label_propagation", lambda x: insights.label_propagation(insights.graph_edges(x.links, _stats(x)), _stats(x)), profile="supp")
_add("artist_monthly", lambda x: insights.artist_monthly(x.plays, periods.months(x.plays), 1), [], """, m as (select unnest(generate_series(date_trunc('month', min(lday)), date_trunc('month', max(lday)), interval 1 month))::date as month from p)
select month, (select count(*) from p where artist_id = 1 and date_trunc('month', lday)::date = m.month) as plays from m""")
_add("artist_hours", lambda x: x.plays.where("artist_id = 1").groupBy("lhour").agg(F.count("*").alias("plays")), [], "select lhour, count(*) as plays from p where artist_id = 1 group by 1")
_add("artists_sorted", lambda x: _stats(x).orderBy(F.desc("n_days"), "artist_id").offset(10).limit(20).select("artist_id", "n_days", "plays"), [SESSIONS, STATS], "select artist_id, n_days, plays from st order by n_days desc, artist_id limit 20 offset 10")
_add("like_literal", lambda x: x.artists.where(F.contains(F.lower("name"), F.lit("re"))), [], "select p_partkey as artist_id, p_name as name from part where contains(lower(p_name), 're')")
_add("search", lambda x: x.artists.where(F.contains(F.lower("name"), F.lit("r"))).join(_stats(x), "artist_id").orderBy(F.desc("plays"), "artist_id").limit(8).select("artist_id", "name", "plays"), [SESSIONS, STATS], "select artist_id, p_name as name, plays from st join part on p_partkey = artist_id where contains(lower(p_name), 'r') order by plays desc, artist_id limit 8")
_add("library_artist", lambda x: insights.library_artist(_stats(x), x.artists, x.loved, "r"), [SESSIONS, STATS, LOVED], """, l as (select artist_id, count(*) as loved from lv group by 1),
r as (select st.artist_id, p_name as name, plays, n_tracks, coalesce(loved, 0)::bigint as loved, count(*) over () as total from st join part on p_partkey = st.artist_id left join l on l.artist_id = st.artist_id where contains(lower(p_name), 'r'))
select *, loved / n_tracks as loved_rate from r order by plays desc, artist_id limit 100""")
# genres and cycles
_add("genre_shares", _shares, [TAGS], "select * from sh")
_add("genre_profile", lambda x: genres.genre_profile(x.plays, _shares(x)), [TAGS], "select tag, round(sum(share), 6) as score from p join sh using (artist_id) group by 1")
_add("genre_idf", lambda x: x.tags.groupBy("tag").agg(F.count("*").alias("df")).crossJoin(x.tags.agg(F.countDistinct("artist_id").alias("n"))).select("tag", F.round(F.log1p(F.col("n") / F.col("df")), 6).alias("idf")), [TAGS], "select tag, round(ln(1 + (select count(distinct artist_id) from tg) / count(*)), 6) as idf from tg group by 1")
_add("weighted_decay", lambda x: yearly.weighted_decay(x.plays, x.span), [], "select artist_id, round(sum(pow(0.5, ((hi - ts) // 86400) / 90)), 6) as weight from p, sp group by 1")
_BUCKETS = {"month": ("year(lday)", "month(lday)"), "season": ("year(lday) + (month(lday) = 12)::int", "(month(lday) % 12) // 3"), "daypart": ("year(lday)", "lhour // 6"), "weekpart": ("year(lday)", "(lwday >= 5)::int")}
LIFT = """dc as (select artist_id, ({y})::int as year, ({b})::int as bucket, count(*) as n from p group by 1, 2, 3),
ob as (select year, bucket, tag as key, sum(n * share) as o from dc join sh using (artist_id) group by 1, 2, 3),
cv as (select year, bucket, sum(n) as b from dc where artist_id in (select artist_id from sh) group by 1, 2),
kk as (select year, key, sum(o) as k from ob group by 1, 2),
ce as (select cv.bucket, kk.key, t, coalesce(o, 0) as o, b * k / t as e from (select *, sum(b) over (partition by year) as t from cv) cv join kk on kk.year = cv.year left join ob on ob.year = cv.year and ob.bucket = cv.bucket and ob.key = kk.key),
lf as (select bucket, key, round(sum(o), 6) as plays, round(sum(e), 6) as expected, case when round(sum(e), 6) >= 30 then round((sum(o) + 20) / (sum(e) + 20), 6) end as lift, count(*) filter (where t >= 200 and round(e, 9) >= 3 and round(o - e, 9) > 0) as up, count(*) filter (where t >= 200 and round(e, 9) >= 3) as years from ce group by 1, 2)"""
for _dim, (_y, _b) in _BUCKETS.items():
    _add(f"lift_{_dim}", lambda x, d=_dim: _cells(x, d), [TAGS, LIFT.replace("{y}", _y).replace("{b}", _b)], "select * from lf")
    _add(f"dim_counts_{_dim}", lambda x, d=_dim: x.counts.where(F.col("dim") == d).drop("dim"), [], f"select artist_id, ({_y})::int as year, ({_b})::int as bucket, count(*) as n from p group by 1, 2, 3")
_add("season_cards", lambda x: genres.season_cards(_cells(x, "season"), 1.02), [TAGS, LIFT.replace("{y}", _BUCKETS["season"][0]).replace("{b}", _BUCKETS["season"][1])], "select bucket, key, lift from lf where lift >= 1.02 and years > 0 and up * 2 >= years qualify row_number() over (partition by bucket order by lift desc, key) <= 4")
_add("season_cards_relaxed", lambda x: genres.season_cards(_cells(x, "season"), 1.02), [TAGS, LIFT.replace("{y}", _BUCKETS["season"][0]).replace("{b}", _BUCKETS["season"][1])], "select bucket, key, lift from lf where lift >= 1.02 and years > 0 and up * 2 >= years qualify row_number() over (partition by bucket order by lift desc, key) <= 4")
_add("drift", lambda x: genres.drift(x.observed.where("dim = 'month'")), [TAGS], """, c as (select year(lday)::int as year, tag, sum(share) as o from p join sh using (artist_id) group by 1, 2),
t as (select tag from c group by 1 order by round(sum(o), 6) desc, tag limit 5), k as (select year, t.tag as key, sum(o) as o from c left join t on t.tag = c.tag group by 1, 2) select year, key, round(o / sum(o) over (partition by year), 6) as share from k""")
for _dim, (_y, _b) in _BUCKETS.items():
    _add(f"spread_{_dim}", lambda x, d=_dim: genres.coverage(x.counts.where(F.col("dim") == d), _shares(x)).drop("dim"), [TAGS], f"select ({_y})::int as year, ({_b})::int as bucket, count(*) as plays, count(*) filter (where artist_id in (select artist_id from sh)) as covered from p group by 1, 2")
_add("diversity", lambda x: genres.diversity(x.plays, _shares(x)), [TAGS], """, c as (select date_trunc('month', lday)::date as month, tag, sum(share) as o from p join sh using (artist_id) group by 1, 2),
q as (select *, o / sum(o) over (partition by month) as q, sum(o) over (partition by month) as t from c) select month, round(exp(-sum(q * ln(q))), 6) as diversity from q where round(t, 6) >= 50 group by 1""")
_add("circ_year_vectors", lambda x: genres.circ_year_vectors(x.plays), [], "select artist_id, year(lday)::int as year, count(*) as n, round(avg(cos(2 * pi() * (dayofyear(lday) - 1) / 365.25)), 6) as x, round(avg(sin(2 * pi() * (dayofyear(lday) - 1) / 365.25)), 6) as y from p group by 1, 2 having count(*) >= 3")
# cohorts
_add("decade_overview", lambda x: cohorts.decade_overview(x.plays, x.albums), [ALBUMS], "select (ry // 10 * 10)::int as decade, sum(n)::bigint as plays, count(distinct album_id) as albums, round(sum(n) / (select sum(n) from dp), 6) as share from dp group by 1")
_add("release_year_hist", lambda x: cohorts.release_year_hist(x.plays, x.albums), [ALBUMS], "select y::int as release_year, coalesce((select sum(n) from dp where ry = y), 0)::bigint as plays from range((select min(ry) from dp), (select max(ry) + 1 from dp)) r(y)")
_add("decade_drift", lambda x: cohorts.decade_drift(x.plays, x.albums), [ALBUMS], """, c as (select year(lday)::int as year, (ry // 10 * 10)::int as decade, sum(n) as n from dp group by 1, 2), t as (select decade from c group by 1 order by sum(n) desc, decade limit 5)
select year, t.decade, round(sum(n) / sum(sum(n)) over (partition by year), 6) as share from c left join t on t.decade = c.decade group by 1, 2""")
_add("vogue", lambda x: cohorts.vogue(x.plays, x.albums, x.span), [ALBUMS], """, c as (select (ry // 10 * 10)::int as decade, coalesce(sum(n) filter (where (select max(lday) from p) - lday < 365), 0) as o, coalesce(sum(n) filter (where (select max(lday) from p) - lday >= 365), 0) as b from dp group by 1),
e as (select *, sum(o) over () * b / sum(b) over () as e, sum(o) over () as t from c) select decade, o::bigint as plays, round(e, 6) as expected, round((o + 20) / (e + 20), 6) as lift from e where t >= 50 and round(e + o, 6) >= 10""")
AGE = "greatest(0, lday - mid)"
_add("album_age", lambda x: cohorts.album_age(x.plays, x.albums), [ALBUMS], f", c as (select year(lday)::int as year, (case when {AGE} < 365 then 0 when {AGE} < 1826 then 1 when {AGE} < 7305 then 2 else 3 end)::int as age, sum(n)::bigint as plays from dp group by 1, 2) select *, round(plays / sum(plays) over (partition by year), 6) as share from c")
_add("album_age_median", lambda x: cohorts.album_age_median(x.plays, x.albums), [ALBUMS], f", c as (select year(lday)::int as year, {AGE} as age, sum(n) as n from dp group by 1, 2), w as (select *, sum(n) over (partition by year) as t, sum(n) over (partition by year order by age) as k from c) select year, min(age)::int as median_days from w where t >= 100 and k * 2 >= t group by 1")
_add("discovery_lag", lambda x: cohorts.discovery_lag(x.plays, x.albums), [ALBUMS], ", f as (select album_id, min(lday) as first from p where album_id is not null group by 1), l as (select greatest(0, first - mid) as g from f join ad using (album_id) where lo >= (select min(lday) from p)) select (case when g < 365 then 0 when g < 1095 then 1 when g < 3652 then 2 else 3 end)::int as bucket, count(*) as albums from l group by 1")
_add("song_age", lambda x: cohorts.song_age(x.plays, x.albums, f"{YEAR}-01-01", f"{YEAR}-12-31"), [ALBUMS], f"select sum(n)::bigint as dated, round(sum(greatest(0, year(lday) - ry) * n) / sum(n), 6) as years from dp where year(lday) = {YEAR}")
_add("release_mid", lambda x: x.albums.select("album_id", cohorts.release_mid(F.col("release_date")).alias("mid"), *[c.alias(n) for c, n in zip(cohorts.release_span(F.col("release_date")), ("lo", "hi"), strict=True)]), [ALBUMS], "select album_id, mid, lo, case length(release_date) when 4 then (release_date || '-12-31')::date when 7 then last_day(lo) else lo end as hi from ad")
# yearly report, gap, taste
_add("year_totals", lambda x: yearly.year_totals(x.plays, _stats(x), YEAR), [SESSIONS, STATS], f", f as (select artist_id from st where year(first_lday) = {YEAR} and prehistory = 0) select count(*) as plays, count(distinct artist_id) as artists, count(distinct track_id) as tracks, count(distinct lday) as active_days, count(distinct artist_id) filter (where artist_id in (from f)) as new_artists, count(*) filter (where artist_id in (from f)) as new_plays from p where year(lday) = {YEAR}", profile="part")
_add("year_vs_last", lambda x: yearly.year_vs_last(x.plays, YEAR), [], f", c as (select count(*) filter (where year(lday) = {YEAR}) as plays, count(*) filter (where year(lday) = {YEAR - 1}) as before from p) select *, plays - before as change, plays / before as ratio from c")
_add("artist_of_month", lambda x: yearly.artist_of_month(x.plays, YEAR), [], f", c as (select month(lday) as month, artist_id, count(*) as n from p where year(lday) = {YEAR} group by 1, 2), m as (select month, artist_id, n from c qualify row_number() over (partition by month order by n desc, artist_id desc) = 1) select x::int as month, artist_id, n as plays from range(1, 13) r(x) left join m on m.month = x")
_add("busiest_day", lambda x: yearly.busiest_day(x.plays, YEAR), [], f"select lday, count(*) as plays from p where year(lday) = {YEAR} group by 1 order by plays desc, lday desc limit 1")
_add("year_calendar", lambda x: yearly.of_year(x.plays, YEAR).groupBy("lday").agg(F.count("*").alias("plays")), [], f"select lday, count(*) as plays from p where year(lday) = {YEAR} group by 1")
_add("year_streak", lambda x: yearly.year_streak(x.plays, YEAR), [], f", d as (select lday, lday - row_number() over (order by lday)::int as g from (select distinct lday from p where year(lday) = {YEAR})) select min(lday) as start_day, max(lday) as end_day, count(*) as length from d group by g order by length desc, start_day limit 1")
_add("year_sessions", lambda x: yearly.year_sessions(_sessions(x), YEAR), [SESSIONS], f"select count(*) as plays, min(ts) as first_ts, (max(ts) - min(ts)) / 60 as minutes from s where year(lday) = {YEAR} group by session_id order by plays desc, first_ts limit 3")
_add("repeat_day", lambda x: yearly.repeat_day(x.plays, YEAR), [], f"select lday, track_id, count(*) as plays from p where year(lday) = {YEAR} group by 1, 2 having count(*) > 1 order by plays desc, lday, track_id limit 1")
_add("archetypes", lambda x: yearly.archetypes(x.plays, _stats(x), YEAR), [SESSIONS, STATS], f", y as (select * from p where year(lday) = {YEAR}), f as (select artist_id from st where year(first_lday) = {YEAR} and prehistory = 0) select count(*) as plays, count(*) filter (where artist_id in (from f)) / count(*) as explorer, (select sum(n) from (select count(*) as n from y group by artist_id order by n desc, artist_id limit 10)) / count(*) as loyalist, count(*) filter (where lhour < 6) / count(*) as night_owl, count(*) filter (where lhour between 6 and 9) / count(*) as early_bird from y")
_add("one_song", lambda x: yearly.one_song(x.plays, YEAR), [], f", c as (select artist_id, count(distinct track_id) as t, count(*) as n from p where year(lday) = {YEAR} group by 1) select count(*) filter (where t = 1 and n <= 3) as artists, count(*) as of_artists from c")
_add("gap_genres", lambda x: yearly.gap_genres(x.plays, x.loved, _shares(x)), [LOVED, TAGS], ", q as (select artist_id, count(*) as n from p group by 1), l as (select artist_id, count(*) as l from lv group by 1), c as (select tag, sum(n * share) as p, sum(coalesce(l, 0) * share) as l from q left join l using (artist_id) join sh using (artist_id) group by 1), e as (select *, sum(l) over () * p / sum(p) over () as e from c) select tag, round(l, 6) as loved, round(e, 6) as expected, round((l + 5) / (e + 5), 6) as ratio from e")
_add("gap_artists", lambda x: yearly.gap_artists(x.plays, x.loved, 1), [LOVED], ", q as (select artist_id, count(*) as plays from p group by 1), l as (select artist_id, count(*) as loved from lv group by 1), c as (select artist_id, plays, coalesce(loved, 0) as loved from q left join l using (artist_id)), e as (select *, sum(loved) over () * plays / sum(plays) over () as e from c) select artist_id, plays, loved::bigint as loved, round(e, 6) as expected, round((loved + 2) / (e + 2), 6) as ratio from e where loved >= 1 or round(e, 6) >= 1", profile="supp")
_add("gap_artists_relaxed", lambda x: yearly.gap_artists(x.plays, x.loved, 1), [LOVED], ", q as (select artist_id, count(*) as plays from p group by 1), l as (select artist_id, count(*) as loved from lv group by 1), c as (select artist_id, plays, coalesce(loved, 0) as loved from q left join l using (artist_id)), e as (select *, sum(loved) over () * plays / sum(plays) over () as e from c) select artist_id, plays, loved::bigint as loved, round(e, 6) as expected, round((loved + 2) / (e + 2), 6) as ratio from e where loved >= 1 or round(e, 6) >= 1", profile="supp")
# names and rules
_add("norm_key", lambda x: keyed(x.artists, "name").select("artist_id", "key"), [], "select p_partkey as artist_id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) as key from part")
_add("csv_guard", lambda x: x.spark.read.parquet(f"{x.sf_dir}/customer.parquet").select("c_custkey", csv_guard(F.col("c_acctbal").cast("decimal(14,2)").cast("string")).alias("cell"), csv_guard(F.col("c_name")).alias("name")), [], "select c_custkey, case when c_acctbal < 0 then '''' else '' end || c_acctbal::decimal(14,2)::varchar as cell, c_name as name from customer")
_add("parse_date", lambda x: x.spark.read.parquet(f"{x.sf_dir}/orders.parquet").select("o_orderkey", parse_date(F.date_format("o_orderdate", "d MMM yyyy, HH:mm")).alias("a"), parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b"), parse_date(F.lit("soon")).alias("c")), [], "select o_orderkey, epoch(o_orderdate)::bigint as a, epoch(o_orderdate)::bigint as b, null::bigint as c from orders")
_add("loose_dups", lambda x: resolve.loose_dups(x.artists), [], "select regexp_replace(regexp_replace(replace(lower(p_name), '0', 'o'), '^the ', ''), '[^a-z0-9]', '', 'g') as key, count(*) as artists, min(p_partkey) as first_id from part group by 1 having count(*) > 1")


def _rules(log: PlayLog) -> DataFrame:
    chain = log.artists.where("artist_id % 10 in (3, 7)").select(F.col("artist_id").alias("from_id"), (F.col("artist_id") - F.when(F.col("artist_id") % 10 == 7, 4).otherwise(2)).alias("to_id"))
    return resolve.resolved_rules(chain)


MERGED = "mg as (select ts, case when artist_id % 10 = 3 then artist_id - 2 when artist_id % 10 = 7 then artist_id - 6 else artist_id end as artist_id, track_id, min(album_id) as album_id from p group by 1, 2, 3)"
_add("merge_artists", lambda x: resolve.merge_artists(x.plays, _rules(x)).select("ts", "artist_id", "track_id", "album_id"), [MERGED], "select * from mg")
_add("merge_preview", lambda x: resolve.merge_preview(x.plays, _rules(x)), [MERGED], "select count(*) filter (where artist_id % 10 in (3, 7)) as moved, count(*) - (select count(*) from mg) as duplicates from p")
_add("check_library", lambda x: resolve.check_library(x.spark.read.parquet(f"{x.sf_dir}/nation.parquet").select(F.col("n_name").alias("candidate")).unionByName(x.artists.select(F.upper("name").alias("candidate"))).distinct(), x.artists, _stats(x)), [SESSIONS, STATS], """, k as (select lower(p_name) as k, max({'a': plays, 'b': artist_id, 'c': first_ts, 'd': last_ts}) as m from st join part on p_partkey = artist_id group by 1),
c as (select n_name as candidate from nation union select upper(p_name) from part) select candidate, m is not null as known, m.a as plays, m.c as first_ts, m.d as last_ts from c left join k on lower(candidate) = k""")
_add("event_sessions", lambda x: streams.sessions(streams.event_plays(x.spark.read.parquet(f"{x.sf_dir}/events.parquet"))).select("listener_id", F.unix_seconds("start_ts").alias("start_s"), "plays"), [], """, e as (select user_id as listener_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as b from events),
i as (select *, sum(b) over (partition by listener_id order by ts rows unbounded preceding) as g from e) select listener_id, floor(epoch(min(ts)))::bigint as start_s, count(*) as plays from i group by listener_id, g""")
# the stored library
_CELLS = " union all ".join(f"select distinct '{d}' as dim, ({y})::int as year, ({b})::int as bucket, artist_id from p" for d, (y, b) in _BUCKETS.items())
_add("rebuild", lambda x: x.rebuild(), [SESSIONS, STATS, GATEWAY, LINKS, ALBUMS, TAGS, f"cb as ({_CELLS})"], """, r as (select 'plays' as t, count(*) as n from p union all select 'sessions', count(*) from s union all select 'stats', count(*) from st
union all select 'gateway', count(*) from gt union all select 'links', count(*) from lk where shared >= 3 union all select 'albums', count(*) from al union all select 'span', 1 union all select 'counts', count(*) from cb
union all select 'observed', count(*) from (select distinct dim, year, bucket, tag from cb join sh using (artist_id))) select t as table, n as rows from r""", least=2)
# summaries, cards, lists and pages
FROM, TO = "1996-01-01", "1996-06-30"
_add("clip_range", lambda x: library.clip_range(x.plays, "1990-01-01", "1995-06-30"), [], "select greatest(date '1990-01-01', min(lday)) as start_day, least(date '1995-06-30', max(lday)) as end_day, greatest(date '1990-01-01', min(lday)) > least(date '1995-06-30', max(lday)) as empty from p")


def _periods(log: PlayLog) -> DataFrame:
    rows = periods.months(log.plays).select(F.explode(F.array(F.struct(F.col("month").alias("a"), F.last_day("month").alias("b")), F.struct(F.date_add("month", 3).alias("a"), F.last_day("month").alias("b")), F.struct(F.col("month").alias("a"), F.last_day(F.add_months("month", 2)).alias("b")))).alias("r"))
    return rows.select("r.a", "r.b", *[c.alias(n) for c, n in zip(library.previous_period(F.col("r.a"), F.col("r.b")), ("c", "d"), strict=True)])


_add("previous_period", _periods, [], """, m as (select unnest(generate_series(date_trunc('month', min(lday)), date_trunc('month', max(lday)), interval 1 month))::date as m from p),
r as (select m as a, last_day(m) as b, 1 as k from m union all select m + 3, last_day(m), 0 from m union all select m, last_day((m + interval 2 month)::date), 3 from m)
select a, b, (case when k = 0 then a - ((b - a)::int + 1) else a - to_months(k) end)::date as c, a - 1 as d from r""")
_add("summary", lambda x: library.summary(x.plays, x.stats, FROM, TO), [SESSIONS, STATS], f""", r as (select * from p where lday between date '{FROM}' and date '{TO}'), b as (select count(*) as n from p where lday between date '1995-07-01' and date '1995-12-31')
select count(*) as plays, count(distinct artist_id) as artists, count(distinct track_id) as tracks, count(distinct album_id) as albums, count(distinct lday) as days,
(select count(*) from st where prehistory = 0 and first_lday between date '{FROM}' and date '{TO}') as new_artists, (select n from b) as before, count(*) - (select n from b) as change, (select min(lday) from p) > date '1995-07-01' as partial from r""")
_add("discoveries", lambda x: library.discoveries(x.plays, x.stats, x.gateway, "1995-01-01", "1995-12-31"), [SESSIONS, STATS, GATEWAY], """, n as (select artist_id from st where prehistory = 0 and first_lday between date '1995-01-01' and date '1995-12-31'),
t as (select artist_id, count(*) as plays from p where lday between date '1995-01-01' and date '1995-12-31' and artist_id in (from n) group by 1 order by plays desc, artist_id limit 10) select t.artist_id, plays, gateway_id from t left join gt using (artist_id)""")
_add("artist_card", lambda x: library.artist_card(x.stats, x.gateway, 7), [SESSIONS, STATS, GATEWAY], "select st.artist_id, plays, first_ts, last_ts, n_tracks, n_days, first_track_id, plays / (select sum(plays) from st) as share, 1 + (select count(*) from st b where b.plays > st.plays) as rank, gateway_id from st left join gt using (artist_id) where st.artist_id = 7")
_add("peak_month", lambda x: library.peak_month(insights.artist_monthly(x.plays, periods.months(x.plays), 7)), [], "select date_trunc('month', lday)::date as month, count(*) as plays from p where artist_id = 7 group by 1 order by plays desc, month limit 1")
_add("artist_tracks", lambda x: library.artist_tracks(x.plays, x.loved, 7), [LOVED], ", t as (select track_id, count(*) as plays, min(ts) as first_ts, max(ts) as last_ts from p where artist_id = 7 group by 1 order by plays desc, track_id limit 50) select t.*, (select min(loved_at) from lv where lv.track_id = t.track_id) as loved_at from t")
_add("artist_albums", lambda x: library.artist_albums(x.plays, x.albums, 7), [ALBUMS], ", t as (select album_id, count(*) as plays, min(ts) as first_ts, max(ts) as last_ts from p where artist_id = 7 and album_id is not null group by 1 order by plays desc, album_id limit 30) select t.*, release_date from t left join al using (album_id)")
_add("item_tags", lambda x: library.item_tags(x.tags, 7), [TAGS], "select tag, weight from tg where artist_id = 7 and tag <> 'other' order by weight desc, tag limit 12")
_add("album_card", lambda x: library.album_card(x.plays, 700), [], "select track_id, count(*) as plays, min(ts) as first_ts, max(ts) as last_ts from p where album_id = 700 group by 1", profile="supp")
_add("track_card", lambda x: library.track_card(x.plays, 700), [], ", o as (select * from p where track_id = 700), b as (select lday as best_day, count(*) as best_plays from o group by 1 order by 2 desc, 1 limit 1) select count(*) as plays, min(ts) as first_ts, max(ts) as last_ts, any_value(best_day) as best_day, any_value(best_plays) as best_plays from o, b", profile="supp")
_add("track_years", lambda x: library.track_years(x.plays, 700), [], "select year(lday)::int as year, count(*) as plays from p where track_id = 700 group by 1", profile="supp")
_add("library_track", lambda x: library.library_tracks(x.plays, x.loved), [LOVED], ", r as (select track_id, artist_id, count(*) as plays from p group by 1, 2) select r.*, (track_id in (select track_id from lv))::int as loved, (select count(*) from r) as total from r order by plays desc, track_id limit 100")
_add("library_album", lambda x: library.library_albums(x.plays, x.albums), [ALBUMS], ", r as (select album_id, count(*) as plays, count(distinct track_id) as tracks from p where album_id is not null group by 1) select r.*, al.artist_id, release_date, (select count(*) from r) as total from r join al using (album_id) order by plays desc, album_id limit 100")
_add("library_genre", lambda x: library.library_genres(x.plays, _shares(x)), [TAGS], ", q as (select artist_id, count(*) as n from p group by 1), r as (select tag, round(sum(n * share), 6) as score, count(*) as artists from q join sh using (artist_id) group by 1) select *, (select count(*) from r) as total from r order by score desc, tag limit 100")
_add("insights_page", lambda x: library.page(x.stats.where("n_years >= 2").select("artist_id", "n_years", "plays"), [F.desc("n_years"), F.desc("plays"), "artist_id"], 20, 20), [SESSIONS, STATS], "select artist_id, n_years, plays, (select count(*) from st where n_years >= 2) > 40 as has_more from st where n_years >= 2 order by n_years desc, plays desc, artist_id limit 20 offset 20")
_add("tag_detail", lambda x: library.tag_detail(x.plays, _shares(x), "Brand#13"), [TAGS], ", q as (select artist_id, count(*) as plays from p group by 1) select artist_id, plays, round(plays * share, 6) as score from q join sh using (artist_id) where tag = 'Brand#13' order by score desc, artist_id limit 20")
_add("tag_monthly", lambda x: library.tag_monthly(x.plays, _shares(x), periods.months(x.plays), "Brand#13"), [TAGS], """, m as (select unnest(generate_series(date_trunc('month', min(lday)), date_trunc('month', max(lday)), interval 1 month))::date as month from p),
c as (select date_trunc('month', lday)::date as month, round(sum(share), 6) as score from p join sh using (artist_id) where tag = 'Brand#13' group by 1) select month, coalesce(score, 0) as score from m left join c using (month)""")
_add("pace", lambda x: library.pace(x.plays), [], """, n as (select max(lday) as today from p), b as (select artist_id, count(*) as n, count(*) filter (where today - lday < 365) as late, max(today) - min(lday) + 1 as span from p, n group by 1)
select artist_id, case when span >= 30 then round(n / (span / 30.4375::double), 6) end as lifetime, case when span >= 365 then round(late / (365 / 30.4375::double), 6) end as recent from b""", profile="supp")
_add("cover_targets", lambda x: library.cover_targets(x.plays, FROM, TO), [], f", c as (select artist_id, album_id, count(*) as plays from p where album_id is not null and lday between date '{FROM}' and date '{TO}' group by 1, 2) select * from c qualify row_number() over (partition by artist_id order by plays desc, album_id) = 1")
for _name, _least, _share, _day in (("double_life", 5, 1 / 3, 0.15), ("double_life_relaxed", 3, 0.15, 0.0)):
    _add(_name, lambda x, a=_least, b=_share, c=_day: library.double_life(x.plays, f"{YEAR}-01-01", f"{YEAR}-12-31", a, b, c), [], f""", b as (select artist_id, lwday, count(*) as plays, count(distinct lday) as days from p where year(lday) = {YEAR} group by 1, 2),
w as (select *, sum(plays) over (partition by artist_id) as ever, sum(plays) over (partition by lwday) as wd from b),
k as (select row_number() over (order by plays desc, artist_id, lwday) as r, artist_id, lwday, plays from w where plays >= {_least} and days >= 2 and round(plays / ever, 9) >= round({_share}, 9) and round(plays / wd, 9) >= {_day}),
q as (select x.r as r, y.r as r2 from k x join k y on x.r < y.r and x.artist_id <> y.artist_id and x.lwday <> y.lwday order by 1, 2 limit 1) select lwday, artist_id, plays from k where r in (select r from q) or r in (select r2 from q)""")
_add("release_window", lambda x: x.plays.select("lday").distinct().select("lday", library.release_friday(F.col("lday")).alias("friday"), *[c.alias(n) for c, n in zip(library.release_window(F.col("lday")), ("start_day", "end_day"), strict=True)]), [], ", d as (select distinct lday, lday + ((5 - isodow(lday)::int + 7) % 7) as friday from p) select lday, friday, friday - 6 as start_day, friday + 42 as end_day from d")
# taste
TRENDS = """wt as (select artist_id, sum(pow(0.5::double, ((hi - ts) // 86400) / 90)) as now, count(*) as ever from p, sp group by 1),
tc as (select tag, sum(now * share) as n, sum(ever * share) as e from wt join sh using (artist_id) group by 1),
tr as (select tag, round(n / (select sum(now) from wt), 6) as shown, round(e / sum(e) over (), 6) as ever, round((n / sum(n) over () + 0.005::double) / (e / sum(e) over () + 0.005::double), 6) as ratio, round(n, 6) as weight, round(e, 6) as plays, round(sum(n) over () / (select sum(now) from wt), 6) as coverage from tc)"""


def _trends(log: PlayLog) -> DataFrame:
    return taste.genre_trends(taste.weights(log.plays, log.span), _shares(log))


_add("taste_now", lambda x: taste.now(_trends(x)), [TAGS, TRENDS], "select tag, shown from tr where shown >= 0.005 order by shown desc, tag limit 15")
_add("taste_core", lambda x: taste.core(_trends(x)), [TAGS, TRENDS], "select tag, ever from tr order by ever desc, tag limit 8")
for _name, _bar in (("taste_rising", 1.5), ("taste_rising_relaxed", 1.0)):
    _add(_name, lambda x, b=_bar: taste.rising(_trends(x), b), [TAGS, TRENDS], f"select tag, ratio from tr where coverage >= 0.5 and shown >= 0.02 and weight >= 10 and ratio >= {_bar} order by ratio desc, tag limit 6")
for _name, _bar in (("taste_fading", 0.5), ("taste_fading_relaxed", 1.0)):
    _add(_name, lambda x, b=_bar: taste.fading(_trends(x), b), [TAGS, TRENDS], f"select tag, ratio from tr where coverage >= 0.5 and ever >= 0.02 and plays >= 10 and ratio <= {_bar} order by ratio, tag limit 5")
_add("taste_discoveries", lambda x: taste.discoveries(x.stats, x.span), [SESSIONS, STATS], "select artist_id, plays from st, sp where first_ts > hi - 180 * 86400 and prehistory = 0 and plays >= 5 order by plays desc, artist_id limit 8")
_add("taste_discoveries_relaxed", lambda x: taste.discoveries(x.stats, x.span, 2200, 1), [SESSIONS, STATS], "select artist_id, plays from st, sp where first_ts > hi - 2200 * 86400 and prehistory = 0 and plays >= 1 order by plays desc, artist_id limit 8")
_add("taste_staples", lambda x: taste.staples(taste.weights(x.plays, x.span)), [], "select artist_id, count(*) as plays from p group by 1 order by plays desc, artist_id limit 8")
_add("taste_seeds", lambda x: taste.seeds(taste.weights(x.plays, x.span)), [TAGS, TRENDS], "select artist_id, round(round(now, 6) / (select sum(now) from wt), 6) as weight from wt order by round(now, 6) desc, artist_id limit 150")
_add("gap_decades", lambda x: taste.gap_decades(x.plays, x.albums, x.loved), [LOVED, ALBUMS], """, k as (select track_id, p.album_id, ry, count(*) as n from p join ad on ad.album_id = p.album_id where track_id in (select track_id from lv) group by all),
b as (select track_id, ry from k qualify row_number() over (partition by track_id order by n desc, ry, album_id) = 1), l as (select (ry // 10 * 10)::int as decade, count(*) as loved from b group by 1), q as (select (ry // 10 * 10)::int as decade, sum(n) as plays from dp group by 1),
r as (select decade, coalesce(loved, 0) as loved, coalesce(plays, 0) as plays, sum(loved) over () as tl, sum(plays) over () as tp from q full join l using (decade))
select decade, loved, round(tl * plays / tp, 6) as expected, round((loved + 5) / (tl * plays / tp + 5), 6) as ratio from r where tl >= 10 and (round(loved / tl, 9) >= 0.02 or round(plays / tp, 9) >= 0.02)""")
_add("sparse_cosine", lambda x: taste.sparse_cosine(_shares(x), 7), [TAGS], ", o as (select tag, share as w from sh where artist_id = 7), n as (select artist_id, sqrt(sum(share * share)) as norm from sh group by 1), d as (select artist_id, sum(share * w) as dot from sh join o using (tag) where artist_id <> 7 group by 1) select artist_id, round(dot / (norm * (select norm from n where artist_id = 7)), 6) as cosine from d join n using (artist_id)")
_add("album_overlap", lambda x: taste.overlap(x.plays.where("album_id is not null").select("artist_id", "album_id", "track_id")), [], ", o as (select distinct artist_id, album_id, track_id from p where album_id is not null), z as (select album_id, count(*) as n from o group by 1), q as (select x.album_id as a, y.album_id as b, count(*) as shared from o x join o y on x.artist_id = y.artist_id and x.track_id = y.track_id and x.album_id < y.album_id group by 1, 2) select a, b, shared, round(shared / least(u.n, v.n), 6) as overlap from q join z u on u.album_id = a join z v on v.album_id = b")
# rhythms
_add("season_artists", lambda x: genres.season_artists(x.plays, lift_least=1.02), ["own as (select artist_id from p group by 1 having count(*) >= 30), sh as (select artist_id, artist_id as tag, 1.0::double as share from own)", LIFT.replace("{y}", _BUCKETS["season"][0]).replace("{b}", _BUCKETS["season"][1])], "select bucket, key as artist_id, lift from lf where plays >= 30 and lift >= 1.02 and years > 0 and up * 2 >= years qualify row_number() over (partition by bucket order by lift desc, key) <= 5", profile="supp")
_add("season_artists_relaxed", lambda x: genres.season_artists(x.plays, lift_least=1.02), ["own as (select artist_id from p group by 1 having count(*) >= 30), sh as (select artist_id, artist_id as tag, 1.0::double as share from own)", LIFT.replace("{y}", _BUCKETS["season"][0]).replace("{b}", _BUCKETS["season"][1])], "select bucket, key as artist_id, lift from lf where plays >= 30 and lift >= 1.02 and years > 0 and up * 2 >= years qualify row_number() over (partition by bucket order by lift desc, key) <= 5", profile="supp")
_add("season_artists_default", lambda x: genres.season_artists(x.plays), ["own as (select artist_id from p group by 1 having count(*) >= 30), sh as (select artist_id, artist_id as tag, 1.0::double as share from own)", LIFT.replace("{y}", _BUCKETS["season"][0]).replace("{b}", _BUCKETS["season"][1])], "select bucket, key as artist_id, lift from lf where plays >= 30 and lift >= 1.3 and years > 0 and up * 2 >= years qualify row_number() over (partition by bucket order by lift desc, key) <= 5", profile="supp")
_MONTHS = LIFT.replace("{y}", _BUCKETS["month"][0]).replace("{b}", _BUCKETS["month"][1])
_add("tag_months", lambda x: genres.tag_months(_cells(x, "month"), "ECONOMY"), [TAGS, _MONTHS], "select m::int as month, lift, plays from range(1, 13) r(m) left join lf on bucket = m and key = 'ECONOMY' where exists (from lf where key = 'ECONOMY')")
_add("matrix", lambda x: genres.matrix(_cells(x, "month")), [TAGS, _MONTHS], "select key, bucket, lift from lf where key in (select key from lf group by 1 order by round(sum(plays), 4) desc, key limit 12)")
_add("diversity_by_month", lambda x: genres.diversity_by_month(genres.diversity(x.plays, _shares(x))), [TAGS], """, c as (select date_trunc('month', lday)::date as month, tag, sum(share) as o from p join sh using (artist_id) group by 1, 2),
q as (select *, o / sum(o) over (partition by month) as q, sum(o) over (partition by month) as t from c), d as (select month, round(exp(-sum(q * ln(q))), 6) as diversity from q where round(t, 6) >= 50 group by 1) select month(month)::int as month, round(avg(diversity), 5) as diversity, count(*) as months from d group by 1""")
# decades
LAGS = """fa as (select album_id, count(*) as plays, min(lday) as first from p where album_id is not null group by 1),
lg as (select album_id, ad.artist_id, release_date, fa.plays, first, greatest(0, first - mid) as lag, coalesce(prehistory, 0) as prehistory,
  case when lo >= (select min(lday) from p) then 'tracked' when case length(release_date) when 4 then (release_date || '-12-31')::date when 7 then last_day(lo) else lo end >= (select min(lday) from p) then null when ry < 1980 then 'before_birth' else 'pre_tracking' end as era
  from fa join ad using (album_id) left join st on st.artist_id = ad.artist_id where ry between 1900 and (select year(max(lday)) + 1 from p))"""


def _lags(log: PlayLog) -> DataFrame:
    return cohorts.lag_albums(log.plays, log.albums, log.stats, 1980)


_LAG = [SESSIONS, STATS, ALBUMS, LAGS]
_add("lag_eras", lambda x: cohorts.lag_eras(_lags(x)), _LAG, "select era, count(*) as albums, sum(plays)::bigint as plays, case when era is not null then round(sum(plays) / (select sum(plays) from lg where era is not null), 6) end as share from lg group by 1")
_add("lag_dug_up", lambda x: cohorts.lag_dug_up(_lags(x)), _LAG, ", o as (select year(first)::int as year, era, count(*) as n from lg where era <> 'tracked' and prehistory = 0 group by 1, 2) select y::int as year, e.era, coalesce(n, 0)::bigint as albums from range((select min(year) from o), (select max(year) + 1 from o)) r(y) cross join (select distinct era from o) e left join o on o.year = y and o.era = e.era")
_add("lag_late", lambda x: cohorts.lag_late(_lags(x)), _LAG, "select album_id, plays, lag from lg where era = 'tracked' and plays >= 5 order by lag desc, plays desc, album_id limit 10")
_add("lag_on_release", lambda x: cohorts.lag_on_release(_lags(x)), _LAG, "select album_id, plays, lag from lg where era = 'tracked' and plays >= 5 and length(release_date) = 10 and lag <= 30 order by plays desc, album_id limit 10")
_add("lag_on_release_relaxed", lambda x: cohorts.lag_on_release(_lags(x), 1, 400), _LAG, "select album_id, plays, lag from lg where era = 'tracked' and plays >= 1 and length(release_date) = 10 and lag <= 400 order by plays desc, album_id limit 10")
_add("median_upper", lambda x: cohorts.median_upper(_lags(x)), _LAG, ", k as (select lag, row_number() over (order by lag) as r, count(*) over () as n from lg where era = 'tracked') select min(lag)::int as median_days, min(n) as albums from k where r = n // 2 + 1")
_add("decade_matrix", lambda x: cohorts.decade_matrix(x.plays, x.albums), [ALBUMS], """, c as (select year(lday)::int as year, (ry // 10 * 10)::int as decade, sum(n) as o from dp group by 1, 2), d as (select decade, sum(o) as n, (select sum(n) from dp) as covered from c group by 1), k as (select * from d where round(n / covered, 9) >= 0.02 order by n desc, decade limit 8),
g as (select y.year, k.decade, coalesce(o, 0) as o, t * n / covered as e from (select year, sum(o) as t from c group by 1) y cross join k left join c on c.year = y.year and c.decade = k.decade) select year, decade, o::bigint as plays, round(e, 6) as expected, case when round(e, 6) >= 30 then round((o + 20) / (e + 20), 6) end as lift from g""")
for _dim in ("season", "daypart", "weekpart"):
    _y, _b = _BUCKETS[_dim]
    _add(f"decade_lift_{_dim}", lambda x, d=_dim: genres.lift_cells(cohorts.decade_observed(x.plays, x.albums, *genres.bucket(d))), [ALBUMS, f"od as (select ({_y})::int as year, ({_b})::int as bucket, (ry // 10 * 10)::int as key, count(*) as o from p join ad on ad.album_id = p.album_id group by 1, 2, 3)", """cv as (select year, bucket, sum(o) as b from od group by 1, 2), kk as (select year, key, sum(o) as k from od group by 1, 2),
ce as (select cv.bucket, kk.key, t, coalesce(o, 0) as o, b * k / t as e from (select *, sum(b) over (partition by year) as t from cv) cv join kk on kk.year = cv.year left join od on od.year = cv.year and od.bucket = cv.bucket and od.key = kk.key)"""], "select bucket, key, round(sum(o)::double, 6) as plays, round(sum(e), 6) as expected, case when round(sum(e), 6) >= 30 then round((sum(o) + 20) / (sum(e) + 20), 6) end as lift, count(*) filter (where t >= 200 and round(e, 9) >= 3 and round(o - e, 9) > 0) as up, count(*) filter (where t >= 200 and round(e, 9) >= 3) as years from ce group by 1, 2")
MIX = """mx as (select (ry // 10 * 10)::int as decade, tag, sum(n * share) as o from dp join sh using (artist_id) group by 1, 2), de as (select decade, sum(o) as d from mx group by 1), gn as (select tag, sum(o) as g from mx group by 1),
gd as (select de.decade, gn.tag, coalesce(o, 0) as o, d * g / (select sum(o) from mx) as e from de cross join gn left join mx on mx.decade = de.decade and mx.tag = gn.tag),
gb as (select decade, tag, round(o, 6) as plays, round(e, 6) as expected, case when round(e, 6) >= 30 then round((o + 20) / (e + 20), 6) end as lift from gd)"""
_add("genre_by_decade", lambda x: cohorts.genre_by_decade(x.plays, x.albums, _shares(x)), [TAGS, ALBUMS, MIX], "select * from gb")
for _name, _bar in (("decade_signature", 1.2), ("decade_signature_relaxed", 1.02)):
    _add(_name, lambda x, b=_bar: cohorts.decade_signature(cohorts.genre_by_decade(x.plays, x.albums, _shares(x)), b), [TAGS, ALBUMS, MIX], f"select decade, tag, lift from gb where lift >= {_bar} qualify row_number() over (partition by decade order by lift desc, tag) <= 3")
# yearly rest
_add("year_genres", lambda x: genres.genre_profile(yearly.of_year(x.plays, YEAR), _shares(x)).orderBy(F.desc("score"), "tag").limit(8), [TAGS], f"select tag, round(sum(share), 6) as score from p join sh using (artist_id) where year(lday) = {YEAR} group by 1 order by score desc, tag limit 8")
_add("genre_months", lambda x: yearly.genre_months(x.plays, _shares(x), YEAR), [TAGS], f", c as (select tag, month(lday) as month, sum(share) as o from p join sh using (artist_id) where year(lday) = {YEAR} group by 1, 2), t as (select tag from c group by 1 order by round(sum(o), 6) desc, tag limit 8) select t.tag, m::int as month, round(coalesce(o, 0), 6) as score from t cross join range(1, 13) r(m) left join c on c.tag = t.tag and c.month = m")
_add("release_years", lambda x: yearly.release_years(x.plays, x.albums, YEAR), [ALBUMS], f", h as (select ry, sum(n) as n from dp where year(lday) = {YEAR} group by 1), w as (select *, sum(n) over (order by ry) as c, sum(n) over () as t from h) select max(t)::bigint as dated, (select count(*) from p where year(lday) = {YEAR}) as total, round(coalesce(sum(n) filter (where ry = {YEAR}), 0) / max(t), 6) as this_year_share, (min(ry) filter (where c * 2 >= t))::int as median from w")
_add("year_loved", lambda x: yearly.year_loved(x.loved, YEAR), [LOVED], f", o as (select * from lv where year(make_timestamp(loved_at * 1000000)) = {YEAR}) select track_id, loved_at, (select count(*) from o) as total from o order by loved_at desc, track_id limit 10")
# lookups
INFO = """ai as (select p_partkey as artist_id, ['ok', 'ok', 'not_found', 'error'][p_partkey % 4 + 1] as status, (select hi from sp) - p_partkey * 7919 % 200 * 86400 as fetched_at,
  50 + p_partkey * 37 % 30011 as listeners from part where p_partkey % 5 <> 0),
ac as (select artist_id, count(*) as plays from p group by 1), bc as (select album_id, count(*) as plays from p where album_id is not null group by 1),
bi as (select album_id, release_date, ['ok', 'ok', 'not_found', 'error'][album_id // 100 % 4 + 1] as status, (select hi from sp) - album_id * 31 % 200 * 86400 as fetched_at, [null, 'ok', 'error'][album_id // 100 % 3 + 1] as mb_status,
  case when album_id // 100 % 3 > 0 then (select hi from sp) - album_id * 13 % 200 * 86400 end as mb_fetched_at, album_id % 2 = 0 as has_cover from al where (album_id // 100 + album_id) % 5 <> 0),
cu as (select hi - 120 * 86400 as cut from sp)"""
_add("pending_artists", lambda x: lookups.pending_artists(x.stats, fixtures.artist_info(x), x.span), [ALBUMS, INFO], "select ac.artist_id, plays from ac left join ai using (artist_id) where fetched_at is null or status = 'error' or fetched_at < (select cut from cu)")
_add("pending_albums", lambda x: lookups.pending_albums(x.plays, fixtures.album_info(x), x.span), [ALBUMS, INFO], "select bc.album_id, plays from bc left join bi using (album_id) where plays >= 3 and (fetched_at is null or status = 'error' or fetched_at < (select cut from cu))")
_add("pending_releases", lambda x: lookups.pending_releases(x.plays, fixtures.album_info(x), x.span), [ALBUMS, INFO], "select bi.album_id, plays from bi left join bc using (album_id) where status = 'ok' and (mb_fetched_at is null or mb_status = 'error' or mb_fetched_at < (select cut from cu))")
_add("enrich_status", lambda x: lookups.enrich_status(x.plays, x.stats, x.tags, fixtures.artist_info(x), fixtures.album_info(x)), [ALBUMS, INFO], """select (select count(*) from ac) as artists, (select count(*) from p) as plays, (select count(*) from ai where status in ('ok', 'not_found')) as artists_done, (select max(fetched_at) from ai) as last_fetch,
  (select count(*) from part) as artists_tagged, (select count(*) from p where artist_id in (select p_partkey from part)) as plays_covered, (select count(*) from bc where plays >= 3) as albums_eligible, (select count(*) from bi where status in ('ok', 'not_found')) as albums_done,
  (select count(release_date) from bi) as albums_dated, (select count(*) from bi where has_cover) as albums_with_cover""")
_add("obscure", lambda x: lookups.obscure(x.plays, fixtures.artist_info(x), x.artists, FROM, TO), [ALBUMS, INFO], f", c as (select artist_id, count(*) as plays from p where lday between date '{FROM}' and date '{TO}' group by 1 having count(*) >= 3), f as (select *, pow(10, greatest(length(listeners::varchar) - 2, 0)) as u from c join ai using (artist_id) join part on p_partkey = artist_id where status = 'ok' and listeners between 100 and 20000 order by listeners, p_name, artist_id limit 1) select artist_id, (round_even(listeners / u, 0) * u)::bigint as listeners, plays from f")
_add("place_shares", lambda x: lookups.place_shares(fixtures.place_tags(x), fixtures.artist_info(x)), [], "select s_suppkey as artist_id, case when s_suppkey % 3 <> 0 then n_name end as tag, 1.0::double as share from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 <> 0 or (s_suppkey % 5 <> 0 and s_suppkey % 4 < 3)", profile="supp")
_add("rolling", lambda x: lookups.rolling(x.plays, x.span), [], "select d::int as days, count(*) as plays, count(distinct artist_id) as artists, count(distinct track_id) as tracks from p join unnest([30, 90, 365]) w(d) on ts > (select hi from sp) - d * 86400 group by 1")
_add("snapshot_changes", lambda x: lookups.snapshot_changes(x.loved.crossJoin(F.broadcast(x.span)).where("loved_at <= hi - 365 * 86400"), x.loved.where("track_id % 3 <> 0"), "track_id"), [LOVED], ", o as (select track_id, loved_at <= (select hi from sp) - 365 * 86400 as was, track_id % 3 <> 0 as isn from lv) select case when not was then 'added' when not isn then 'removed' else 'kept' end as state, count(*) as rows from o where was or isn group by 1")
_ODD_TAGS = "('Suomi'), ('seen_live'), (' -Post-Rock- '), ('80''s'), ('1990s'), ('1998'), ('1899'), ('x'), ('UK'), ('FIP')"


def _tags_seen(log: PlayLog) -> DataFrame:
    nations = log.spark.read.parquet(f"{log.sf_dir}/nation.parquet").select(F.col("n_name").alias("tag"))
    rows = keyed(log.tags.select("tag").union(nations).union(log.spark.sql(f"select * from values {_ODD_TAGS} as t(tag)")).distinct(), "tag")
    return rows.select("tag", tag_normalize(F.col("key")).alias("normal"), tag_fold(F.col("key")).alias("fold"), tag_classify(F.col("key")).alias("kind"))


_add("tag_classify", _tags_seen, [TAGS, f"ta as (select tag from tg union select n_name from nation union select * from (values {_ODD_TAGS}))"], ", n as (select tag, trim(replace(lower(trim(tag)), '_', ' '), ' -') as normal from ta) select tag, normal, replace(replace(normal, ' ', ''), '-', '') as fold, case when regexp_full_match(normal, '(19|20)[0-9]{2}') then 'year' when regexp_full_match(normal, '(19|20)?[0-9]0''?s') then 'decade' when normal in ('suomi', 'uk') then 'place' when normal in ('seen live', 'fip') or length(normal) < 2 then 'other' else 'genre' end as kind from n")
SEASONAL = """cv as (select artist_id, year(lday) as y, round(avg(cos(2 * pi() * (dayofyear(lday) - 1) / 365.25)), 6) as cx, round(avg(sin(2 * pi() * (dayofyear(lday) - 1) / 365.25)), 6) as cy from p group by 1, 2 having count(*) >= 3),
cd as (select *, (case when cy < 0 then atan2(cy, cx) + 2 * pi() else atan2(cy, cx) end) * 365.25 / (2 * pi()) as own from cv),
cm as (select artist_id, avg(cx) as mx, avg(cy) as my, count(*) as valid from cv group by 1 having count(*) >= 3),
cf as (select artist_id, valid, round(sqrt(mx * mx + my * my), 6) as r, round((case when my < 0 then atan2(my, mx) + 2 * pi() else atan2(my, mx) end) * 365.25 / (2 * pi()), 4) as peak from cm),
cn as (select cf.artist_id, r, peak, valid, count(*) filter (where least(abs(own - peak), 365.25 - abs(own - peak)) <= 30) as agree from cf join cd using (artist_id) where r >= 0.2 group by 1, 2, 3, 4),
ss as (select artist_id, plays, n_years, r, peak, agree from cn join (select artist_id, count(*) as plays, count(distinct year(lday)) as n_years from p group by 1 having count(*) >= 20 and count(distinct year(lday)) >= 3) using (artist_id) where agree >= 0.6 * valid)"""
_add("seasonal_artists_relaxed", lambda x: genres.seasonal_artists(x.plays, 0.2, 20), [SEASONAL], "select * from ss")
_add("seasonal_artists", lambda x: genres.seasonal_artists(x.plays, 0.2, 20), [SEASONAL], "select * from ss")
_add("seasonal_status", lambda x: genres.seasonal_status(genres.seasonal_artists(x.plays, 0.2, 20), x.span), [SEASONAL], """, w as (select *, greatest(7, least(60, sqrt(-2 * ln(r)) * 365.25 / (2 * pi()))) as spread, (select dayofyear(max(lday)) - 1 from p) as t from ss),
v as (select *, least(abs(peak - t), 365.25 - abs(peak - t)) as apart, (peak - t - spread + 730.5) % 365.25 as start from w) select artist_id, case when apart <= spread then 'now' when start <= 28 then 'soon' end as status, round_even(start, 0)::int as starts_in_days from v""")
# editions
TITLES = """tt as (select distinct track_id, artist_id, 'Song ' || (case when track_id % 100 = 1 then 0 else track_id % 100 end) || case track_id % 100 when 1 then ' (Remastered 2011)' when 5 then ' - Live at Home' else '' end as title from p),
atl as (select album_id, artist_id, case album_id % 100 when 0 then 'Record' when 1 then 'Record (Deluxe Edition)' else case when artist_id % 4 = 0 then 'Live Record' else 'Best of Record' end end as title from (select distinct album_id, artist_id from p where album_id is not null)),
tk as (select *, lower(title) as tkey, lower(replace(title, ' (Remastered 2011)', '')) as ek from tt), ak as (select *, lower(title) as akey, lower(replace(title, ' (Deluxe Edition)', '')) as ek from atl)"""
TRACK_GROUPS = """tm as (select * from tk semi join (select artist_id, ek from tk group by 1, 2 having count(distinct tkey) > 1) g using (artist_id, ek)),
se as (select tm.artist_id, tm.ek, tm.track_id, ak.title, ak.ek as album_key from tm join (select distinct track_id, album_id from p) q on q.track_id = tm.track_id join ak on ak.album_id = q.album_id),
an as (select distinct track_id from se semi join (select artist_id, ek, album_key from se group by all having count(distinct track_id) > 1) g using (artist_id, ek, album_key)),
me as (select tm.*, n, an.track_id is not null as anch, other from tm join (select track_id, count(*) as n from p group by 1) c using (track_id) left join an using (track_id) left join (select track_id, bool_or(regexp_matches(title, '(?i)live')) as other from se group by 1) o using (track_id)),
gr as (select artist_id, ek as edition_key, first(track_id order by tkey <> ek, n desc, track_id) as target_id, count(*) as versions, sum(n)::bigint as plays, bool_or(anch) as same_album, bool_or(not anch) and count(*) > 3 as many,
  coalesce(bool_or(not anch and other), false) as other_recording, false as generic, bool_or(not anch and other is null) as no_album from me group by 1, 2)"""
ALBUM_GROUPS = """am as (select * from ak semi join (select artist_id, ek from ak group by 1, 2 having count(distinct akey) > 1) g using (artist_id, ek)),
sg as (select distinct am.artist_id, am.ek, am.album_id, tk.ek as song from am join p using (album_id) join tk on tk.track_id = p.track_id), sn as (select album_id, count(*) as songs from sg group by 1),
bp as (select x.album_id, y.album_id as b, count(*) as shared from sg x join sg y on x.artist_id = y.artist_id and x.ek = y.ek and x.song = y.song and x.album_id <> y.album_id group by 1, 2),
bb as (select bp.album_id, max(shared / least(u.songs, v.songs)) as best from bp join sn u on u.album_id = bp.album_id join sn v on v.album_id = b group by 1),
bm as (select am.*, coalesce(n, 0) as n, coalesce(songs, 0) as songs, coalesce(best, 0) as best from am left join (select album_id, count(*) as n from p group by 1) c using (album_id) left join sn using (album_id) left join bb using (album_id)),
gr as (select artist_id, ek as edition_key, first(album_id order by akey <> ek, n desc, album_id) as target_id, count(*) as versions, sum(n)::bigint as plays, round(min(best), 2) as overlap, min(best) >= 0.5 as same_tracks,
  min(best) < 0.5 and count(*) > 3 as many, min(best) < 0.5 and bool_or(title ilike '%best of%') as compilation, min(best) = 0 and min(songs) >= 3 as nothing_shared from bm group by 1, 2)"""


def _track_groups(log: PlayLog) -> DataFrame:
    return editions.track_edition_groups(log.plays, fixtures.tracks(log), fixtures.album_titles(log))


def _album_groups(log: PlayLog) -> DataFrame:
    return editions.album_edition_groups(log.plays, fixtures.album_titles(log), fixtures.tracks(log))


def _merged(log: PlayLog, groups: DataFrame, items: DataFrame, item: str) -> DataFrame:
    return editions.merge_items(log.plays, editions.edition_rules(groups, items, item), item).select("ts", "artist_id", "track_id", "album_id")


_add("track_edition_groups", _track_groups, [TITLES, TRACK_GROUPS], "select * from gr")
_add("album_edition_groups", _album_groups, [TITLES, ALBUM_GROUPS], "select * from gr")
_add("merge_tracks", lambda x: _merged(x, _track_groups(x).where("same_album"), fixtures.tracks(x), "track_id"), [TITLES, TRACK_GROUPS], ", r as (select track_id as from_id, target_id from tm join gr on gr.artist_id = tm.artist_id and edition_key = ek where same_album and track_id <> target_id) select ts, artist_id, coalesce(target_id, track_id) as track_id, min(album_id) as album_id from p left join r on from_id = track_id group by 1, 2, 3")
_add("merge_albums", lambda x: _merged(x, _album_groups(x).where("same_tracks"), fixtures.album_titles(x), "album_id"), [TITLES, ALBUM_GROUPS], ", r as (select album_id as from_id, target_id from am join gr on gr.artist_id = am.artist_id and edition_key = ek where same_tracks and album_id <> target_id) select ts, artist_id, track_id, coalesce(target_id, album_id) as album_id from p left join r on from_id = album_id")
# loved entries and duplicates
ENTRIES = """le as (select lower(s_name) as artist_key, lower(title) as title_key, loved_at from lv join tt on tt.track_id = lv.track_id and tt.artist_id = lv.artist_id join supplier on s_suppkey = lv.artist_id
  union all select lower(s_name), 'song 0 (live)', s_suppkey * 86400 from supplier where s_suppkey % 5 = 0 union all select lower(n_name), 'song 0', n_nationkey::bigint * 86400 from nation),
lr as (select le.*, coalesce(rt.artist_id, x.artist_id, s_suppkey) as artist_id, coalesce(rt.track_id, tk.track_id, ta.track_id) as track_id from le
  left join supplier on lower(s_name) = artist_key left join (select lower(n_name) as k, n_nationkey as artist_id from nation where n_nationkey % 2 = 0 and n_nationkey in (select s_suppkey from supplier)) x on x.k = artist_key
  left join (select lower(s_name) as ra, 'song 0 (live)' as rk, s_suppkey * 100 as tid from supplier where s_suppkey % 20 = 0) r on ra = artist_key and rk = title_key left join tt rt on rt.track_id = tid
  left join tk on tk.artist_id = coalesce(x.artist_id, s_suppkey) and tkey = title_key
  left join (select s_suppkey as aid, 'song 0 (live)' as ak, s_suppkey * 100 + 3 as track_id from supplier where s_suppkey % 30 = 10) ta on aid = coalesce(x.artist_id, s_suppkey) and ta.ak = title_key)"""


def _resolved(log: PlayLog) -> DataFrame:
    names = log.artists.select("artist_id", F.lower("name").alias("name_key"))
    titles = fixtures.tracks(log).select("track_id", "artist_id", F.lower("title").alias("title_key"))
    return resolve.loved_resolve(fixtures.loved_entries(log), names, titles, fixtures.artist_aliases(log), fixtures.title_rules(log), fixtures.track_aliases(log))


_add("loved_resolve", _resolved, [TITLES, LOVED, ENTRIES], "select * from lr", profile="supp")
_add("unmatched_loved", lambda x: resolve.unmatched_loved(_resolved(x)), [TITLES, LOVED, ENTRIES], "select artist_key, title_key, loved_at, artist_id, case when artist_id is null then 'artist unknown' else 'title unknown' end as reason from lr where track_id is null", profile="supp")
_add("title_suggestions", lambda x: resolve.title_suggestions(resolve.unmatched_loved(_resolved(x)), fixtures.tracks(x), x.plays), [TITLES, LOVED, ENTRIES], ", u as (select distinct artist_key, title_key, artist_id from lr where track_id is null and artist_id is not null), c as (select track_id, count(*) as plays from p group by 1), q as (select artist_key, title_key, row_number() over (partition by artist_key, title_key order by plays desc, track_id)::int as rank, track_id, plays from u join tk using (artist_id) join c using (track_id) where ek = 'song 0') select * from q where rank <= 3", profile="supp")
_add("duplicate_candidates", lambda x: resolve.duplicate_candidates(x.artists, x.stats, fixtures.artist_info(x)), ["""dn as (select p_partkey as id, lower(p_name) as nk, 'l:' || regexp_replace(regexp_replace(replace(lower(p_name), '0', 'o'), '^the ', ''), '[^a-z0-9]', '', 'g') as a,
  'f:' || case when p_partkey % 5 = 0 then null when p_partkey % 11 = 0 then lower(p_name) when p_partkey % 40 = 3 then split_part(lower(p_name), ' ', 1) || ' ring' end as b from part),
de as (select distinct a as x, b as y from dn where b is not null union select distinct b, a from dn where b is not null),
dr(key, label) as (select a, a from dn union select de.y, dr.label from dr join de on de.x = dr.key),
dl as (select key, min(label) as label from dr group by 1),
dg as (select id, label, coalesce(plays, 0) as plays, coalesce(b = 'f:' || nk, false) as own from dn join dl on key = a left join (select artist_id, count(*) as plays from p group by 1) c on artist_id = id)"""], "select min(id) as group_id, count(*) as artists, first(id order by not own, plays desc, id) as target_id, sum(plays)::bigint as plays from dg group by label having count(*) > 1 order by plays desc, group_id limit 100")
ORACLES["duplicate_candidates"] = "with recursive " + ORACLES["duplicate_candidates"].removeprefix("with ")
# releases, questions in SQL, streams
FACTS = """rp as (select artist_id, count(*) as n from p where ts > (select hi from sp) - 365 * 86400 group by 1), lo as (select artist_id, count(distinct track_id) as n from lv group by 1),
fc as (select c.artist_id, plays, coalesce(rp.n, 0) as recent_plays, coalesce(lo.n, 0) as loved, round(ln(1 + plays) + 1.5 * ln(1 + coalesce(rp.n, 0)) + 0.5 * least(coalesce(lo.n, 0), 6), 6) as fit
  from (select artist_id, count(*) as plays from p group by 1 having count(*) >= 3) c left join rp on rp.artist_id = c.artist_id left join lo on lo.artist_id = c.artist_id)"""
MATCHES = """nm as (select lower(s_name) as k, s_suppkey as artist_id from supplier union all select lower(n_name), n_nationkey from nation where n_nationkey % 2 = 0 and n_nationkey in (select s_suppkey from supplier)),
rm as (select s_suppkey as release_id, s_suppkey as artist_id from supplier where s_suppkey % 4 = 0 and s_suppkey % 3 = 0
  union select s_suppkey, s_suppkey from supplier where s_suppkey % 4 in (0, 1) and s_suppkey % 3 > 0 union select s_suppkey, s_suppkey from supplier where s_suppkey % 4 in (2, 3)
  union select s_suppkey, artist_id from supplier join nm on k = 'nation_2' where s_suppkey % 4 = 3 union select 10000000 + n_nationkey, artist_id from nation join nm on k = lower(n_name))"""


def _matches(log: PlayLog) -> DataFrame:
    names = log.artists.select(F.lower("name").alias("name_key"), "artist_id")
    return releases.release_match(fixtures.releases(log), names, fixtures.artist_aliases(log), fixtures.artist_ids(log))


def _facts(log: PlayLog) -> DataFrame:
    return releases.artist_facts(log.plays, log.stats, log.loved, log.span)


_add("release_match", _matches, [MATCHES], "select * from rm", profile="supp")
_add("artist_facts", _facts, [LOVED, FACTS], "select * from fc")
_add("release_fit", lambda x: releases.release_fit(_matches(x), _facts(x)), [LOVED, FACTS, MATCHES], "select release_id, first(artist_id order by fit desc, artist_id) as artist_id, max(fit) as fit from rm join fc using (artist_id) group by 1", profile="supp")
_ASKED = "select lwday, count(*) as plays, count(distinct artist_id) as artists from {} group by lwday"
_add("query_sql", lambda x: adhoc.query_sql(x, _ASKED.format("plays")), [], _ASKED.format("p"))
_SCHEMA = {
    "plays p": "ts bigint, artist_id bigint, track_id bigint, album_id bigint, lday date, lhour int, lwday int, lyear int",
    "sessions s": "lday date, ts bigint, artist_id bigint, track_id bigint, album_id bigint, lhour int, lwday int, lyear int, session_id bigint",
    "stats st": "artist_id bigint, plays bigint, first_ts bigint, last_ts bigint, first_lday date, n_tracks bigint, n_days bigint, n_years bigint, n_sessions bigint, prehistory int, first_track_id bigint",
    "gateway gt": "artist_id bigint, gateway_id bigint", "links lk": "a bigint, b bigint, shared bigint, score double", "albums al": "album_id bigint, artist_id bigint, release_date string",
    "artists part": "artist_id bigint, name string", "tags tg": "artist_id bigint, tag string, weight int", "loved lv": "track_id bigint, artist_id bigint, loved_at bigint",
}
_add("describe_schema", adhoc.describe_schema, [SESSIONS, STATS, GATEWAY, LINKS, ALBUMS, TAGS, LOVED], " union all ".join(
    f"select '{k.split()[0]}' as table, unnest({[c.split()[0] for c in v.split(', ')]}) as column, unnest({[c.split()[1] for c in v.split(', ')]}) as type, (select count(*) from {k.split()[1]}) as rows" for k, v in _SCHEMA.items()), least=3)
_EVENTS = "e as (select user_id as listener_id, event_type as artist, ts, (props->>'$.k')::int as track from events)"


def _events(log: PlayLog) -> DataFrame:
    return streams.event_plays(log.spark.read.parquet(f"{log.sf_dir}/events.parquet"))


_add("event_first_seen", lambda x: streams.first_seen(_events(x)).select("listener_id", "artist", F.unix_seconds("at").alias("at_s")), [_EVENTS], "select listener_id, artist, floor(epoch(min(ts)))::bigint as at_s from e group by 1, 2")
_add("event_gateway", lambda x: streams.gateways(_events(x)).select("listener_id", "artist", F.unix_seconds("at").alias("at_s"), "gateway"), [_EVENTS], ", g as (select *, case when lag(ts) over w >= ts - interval 6 hour then lag(artist) over w end as gateway, row_number() over (partition by listener_id, artist order by ts, track) as r from e window w as (partition by listener_id order by ts, artist, track)) select listener_id, artist, floor(epoch(ts))::bigint as at_s, gateway from g where r = 1")
WEEKS = """ms as (select * from rm union select 20000000 + s_suppkey, s_suppkey from supplier where s_suppkey % 5 = 0),
rl as (select s_suppkey as release_id, s_suppkey as number, 'listenbrainz' as source, ['Album', 'EP', 'Single'][s_suppkey % 3 + 1] as kind from supplier
  union all select 10000000 + n_nationkey, 10000000 + n_nationkey, 'listenbrainz', ['Album', 'EP', 'Single'][(10000000 + n_nationkey) % 3 + 1] from nation union all select 20000000 + s_suppkey, s_suppkey, 'wikipedia', 'Album' from supplier where s_suppkey % 5 = 0),
rd as (select *, (select max(lday) from p) + (number * 5 % 60)::int as day from rl),
rg as (select 20000000 + s_suppkey as release_id, case when s_suppkey % 4 <> 3 and s_suppkey % 3 <> 2 then s_suppkey end as into_id from supplier where s_suppkey % 5 = 0)"""


def _merges(log: PlayLog) -> tuple[DataFrame, DataFrame, DataFrame]:
    listed = fixtures.release_list(log)
    names = log.artists.select(F.lower("name").alias("name_key"), "artist_id")
    matches = releases.release_match(listed, names, fixtures.artist_aliases(log), fixtures.artist_ids(log))
    return listed, matches, releases.release_merge(listed, matches)


def _weeks(log: PlayLog) -> DataFrame:
    listed, matches, merges = _merges(log)
    start, end = library.release_window(F.col("day0"))
    day = log.plays.agg(F.max("lday").alias("day0")).select(start.alias("s"), end.alias("e"))
    inside = listed.crossJoin(F.broadcast(day))
    return releases.upcoming_weeks(releases.upcoming_lists(inside, merges, matches, _facts(log), F.col("s"), F.col("e")))


_add("release_merge", lambda x: _merges(x)[2], [], "select 20000000 + s_suppkey as release_id, case when s_suppkey % 4 <> 3 and s_suppkey % 3 <> 2 then s_suppkey end as into_id from supplier where s_suppkey % 5 = 0", profile="supp")
_add("upcoming_weeks", _weeks, [LOVED, FACTS, MATCHES, WEEKS], """, f as (select release_id, max(fit) as fit from ms join fc using (artist_id) group by 1), w as (select max(lday) + ((5 - isodow(max(lday))::int + 7) % 7) as friday from p),
l as (select day + ((5 - isodow(day)::int + 7) % 7) as friday, release_id, fit, case when fit is not null then 'mine' when source = 'wikipedia' or release_id in (select into_id from rg where into_id is not null) then 'also' when kind <> 'Single' then 'more' end as list
  from rd left join f using (release_id) where day between (select friday - 6 from w) and (select friday + 42 from w) and release_id not in (select release_id from rg where into_id is not null))
select friday, count(*) filter (where list = 'mine') as mine, count(*) filter (where list = 'also') as also, count(*) filter (where list = 'more') as more, first(release_id order by fit desc, release_id) filter (where list = 'mine') as best_id from l where list is not null group by 1""", profile="supp")
