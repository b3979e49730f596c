"""Queries for rules that last and for merges of artists with their titles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.model import PlayLog
from playlog.operators import insights, resolve, rules
from playlog.plans import catalog
from playlog.plans.catalog import ENTRIES, GATEWAY, LINKS, LOVED, SESSIONS, STATS, _add, _rules
from playlog.sources import fixtures
from playlog.store import base_folder
from playlog.streaming.stored import Snapshots, StoredLog


def _log(log: PlayLog) -> rules.RuleLog:
    """Rules of three sessions: artists hidden, some of them shown again, and other names, of which some are taken back."""
    said = rules.RuleLog(log.spark, f"{base_folder(log.spark)}/rules-{uuid.uuid4().hex}")
    ids = log.artists.select(F.col("artist_id").cast("string").alias("key"), "artist_id")
    names = log.artists.select(F.concat(F.lit("aka "), F.lower("name")).alias("key"), F.col("artist_id").alias("value"))
    said.say("hide", ids.where("artist_id % 4 = 0").select("key"), 100)
    said.say("alias", names.where("value % 3 = 0"), 200)
    said.say("hide", ids.where("artist_id % 8 = 0").select("key"), 300, removed=True)
    said.say("alias", names.where("value % 6 = 0").withColumn("value", F.col("value") + 1), 400)
    said.say("alias", names.where("value % 12 = 0").select("key"), 500, removed=True)
    return rules.RuleLog(log.spark, said.folder)  # as a later session opens it


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("title_key", F.lower("title")).drop("title")


def _merged(log: PlayLog) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    found = _rules(log)
    tracks, albums = rules.titles_after(_keyed(fixtures.tracks(log)), found, "track_id"), rules.titles_after(_keyed(fixtures.album_titles(log)), found, "album_id")
    return found, tracks, albums, rules.merged_plays(log.plays, found, tracks, albums)


_MOVE = "case when {0} % 10 = 3 then {0} - 2 when {0} % 10 = 7 then {0} - 6 else {0} end".format
TITLES = f"""tt as (select distinct track_id, artist_id, 'song ' || case track_id % 100 when 1 then 0 else track_id % 100 end || case track_id % 100 when 1 then ' (remastered 2011)' when 5 then ' - live at home' else '' end as title_key from p),
tu as (select track_id, artist_id as was, {_MOVE('artist_id')} as artist_id, title_key from tt),
tm as (select *, first_value(track_id) over (partition by artist_id, title_key order by artist_id <> was, track_id) as into_id from tu),
ab as (select distinct album_id, artist_id, case album_id % 100 when 0 then 'record' when 1 then 'record (deluxe edition)' else case artist_id % 4 when 0 then 'live record' else 'best of record' end end as title_key from p where album_id is not null),
au as (select album_id, artist_id as was, {_MOVE('artist_id')} as artist_id, title_key from ab),
am as (select *, first_value(album_id) over (partition by artist_id, title_key order by artist_id <> was, album_id) as into_id from au),
mp as (select ts, {_MOVE('p.artist_id')} as artist_id, tm.into_id as track_id, min(am.into_id) as album_id from p join tm on tm.track_id = p.track_id left join am on am.album_id = p.album_id group by 1, 2, 3)"""
_add("merge_titles", lambda x: _merged(x)[3].select("ts", "artist_id", "track_id", "album_id"), [TITLES], "select * from mp")


def _outcome(log: PlayLog) -> DataFrame:
    found, tracks, albums, after = _merged(log)
    return rules.merge_outcome(log.plays, after, found, tracks, albums)


_add("merge_outcome", _outcome, [TITLES], """select (select count(*) from p where artist_id % 10 in (3, 7)) as moved, (select count(*) from p) - (select count(*) from mp) as duplicates,
(select count(*) from tm where into_id <> track_id) as tracks_combined, (select count(*) from am where into_id <> album_id) as albums_combined""")


def _names_after(log: PlayLog) -> DataFrame:
    names = log.artists.select("artist_id", F.lower("name").alias("name_key"))
    old = names.where("artist_id % 5 = 2").select(F.concat(F.lit("aka "), "name_key").alias("name_key"), "artist_id")
    shadow = names.where("artist_id % 10 = 1").select("name_key", (F.col("artist_id") + 2).alias("artist_id"))  # would hide an artist's own name
    return rules.aliases_after(old.unionByName(shadow), names, _rules(log))


_add("aliases_after_merge", _names_after, [], f"""select 'aka ' || lower(s_name) as name_key, {_MOVE('s_suppkey')} as artist_id from supplier where s_suppkey % 5 = 2
union all select lower(s_name), {_MOVE('s_suppkey')} from supplier where s_suppkey % 10 in (3, 7)""", profile="supp")
_add("rules_current", lambda x: _log(x).current("alias").select("key", "value", "at"), [], """select 'aka ' || lower(s_name) as key, case when s_suppkey % 6 = 0 then s_suppkey + 1 else s_suppkey end as value, case when s_suppkey % 6 = 0 then 400 else 200 end::bigint as at
from supplier where s_suppkey % 3 = 0 and s_suppkey % 12 <> 0""", profile="supp")
_add("forgotten_shown", lambda x: rules.without_hidden(insights.forgotten(x.stats, x.span, 15, 100), _log(x)), [SESSIONS, STATS],
     "select artist_id, plays, last_ts from st where last_ts < (select hi from sp) - 100 * 86400 and plays >= 15 and not (artist_id % 4 = 0 and artist_id % 8 <> 0)")


def _asked(log: PlayLog) -> DataFrame:
    names = log.artists.select("artist_id", F.lower("name").alias("name_key"))
    asked = names.select(F.when(F.col("artist_id") % 5 == 0, F.col("name_key")).when(F.col("artist_id") % 5 == 1, F.concat("name_key", F.lit(" band"))).when(F.col("artist_id") % 5 == 2, "").otherwise(F.col("name_key")).alias("name_key"),
                         (F.col("artist_id") + F.when(F.col("artist_id") % 5 == 3, 1).when(F.col("artist_id") % 5 == 4, 10_000_000).otherwise(0)).alias("target_id"))
    return rules.asked_aliases(asked, names)


_add("asked_aliases", _asked, [], """select case s_suppkey % 5 when 1 then lower(s_name) || ' band' when 2 then '' else lower(s_name) end as name_key, s_suppkey + case s_suppkey % 5 when 3 then 1 when 4 then 10000000 else 0 end as target_id,
case s_suppkey % 5 when 0 then 'own name' when 1 then 'alias' when 2 then 'empty name' when 3 then case when s_suppkey + 1 in (select s_suppkey from supplier) then 'merge' else 'artist not found' end else 'artist not found' end as outcome,
case when s_suppkey % 5 = 3 and s_suppkey + 1 in (select s_suppkey from supplier) then s_suppkey end as from_id from supplier""", profile="supp")


def _loved_by_rule(log: PlayLog) -> DataFrame:
    """Loved entries with the rules of an earlier session, kept in the log."""
    said = rules.RuleLog(log.spark, f"{base_folder(log.spark)}/rules-{uuid.uuid4().hex}")
    asked = fixtures.title_rules(log).select(rules.pair_key(F.col("artist_key"), F.col("title_key")).alias("key"), F.col("track_id").alias("value"))
    said.say("loved", asked, 1)
    said.say("alias", fixtures.artist_aliases(log).select(F.col("name_key").alias("key"), F.col("artist_id").alias("value")), 2)
    later = rules.RuleLog(log.spark, said.folder)
    parts = F.split("key", "\n")
    title_rules = later.current("loved").select(parts[0].alias("artist_key"), parts[1].alias("title_key"), F.col("value").alias("track_id"))
    aliases = later.current("alias").select(F.col("key").alias("name_key"), F.col("value").alias("artist_id"))
    names = log.artists.select("artist_id", F.lower("name").alias("name_key"))
    return resolve.loved_resolve(fixtures.loved_entries(log), names, _keyed(fixtures.tracks(log)), aliases, title_rules, fixtures.track_aliases(log))


_add("loved_resolve_by_rules", _loved_by_rule, [catalog.TITLES, LOVED, ENTRIES], "select * from lr", profile="supp")

# a log that takes new rows
_logs: dict[tuple[str, str, str], StoredLog] = {}


def _grown(log: PlayLog) -> StoredLog:
    """The library's plays as three batches brought them: two thirds, the rest with some that were there, and those again."""
    own = (log.spark.sparkContext.applicationId, f"{log.sf_dir} {log.profile}", log.version)
    if own not in _logs:
        stored = StoredLog(log.spark, f"{base_folder(log.spark)}/grown-{uuid.uuid4().hex}", min_shared=2)
        plays = log.plays.select("ts", "artist_id", "track_id", "album_id")
        late = (F.col("ts") / 60) % 3 == 0
        stored.merge(plays.where(~late), "first", 1)
        for _ in range(2):
            stored.merge(plays.where(late | (F.col("artist_id") % 7 == 0)), "second", 2)
        _logs[own] = stored
    return _logs[own]


_add("incremental_sessions", lambda x: _grown(x).sessions.select("ts", "artist_id", "track_id", "album_id", "session_id"), [SESSIONS], "select ts, artist_id, track_id, album_id, session_id from s")
_add("incremental_stats", lambda x: _grown(x).stats, [SESSIONS, STATS], "select * from st")
_add("incremental_gateway", lambda x: _grown(x).gateway, [SESSIONS, GATEWAY], "select * from gt")
_add("incremental_links", lambda x: _grown(x).links, [SESSIONS, LINKS], "select * from lk", least=2)
_add("imports_log", lambda x: _grown(x).imports().groupBy("label").agg(F.count("*").alias("runs"), F.sum("rows_read").alias("rows_read"), F.sum("rows_added").alias("rows_added"), F.sum("duplicates").alias("duplicates"),
                                                                        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")), [],
     """, a as (select 'first' as label, 1 as runs, ts, (ts // 60) % 3 <> 0 as fresh from p where (ts // 60) % 3 <> 0 union all select 'second', 2, ts, (ts // 60) % 3 = 0 from p where (ts // 60) % 3 = 0 or artist_id % 7 = 0)
select label, max(runs)::bigint as runs, (count(*) * max(runs))::bigint as rows_read, count(*) filter (where fresh) as rows_added, (count(*) * max(runs) - count(*) filter (where fresh))::bigint as duplicates, min(ts) as first_ts, max(ts) as last_ts from a group by 1""")


def _replaced(log: PlayLog) -> DataFrame:
    """Loved entries as a source sent them whole three times, at last with other dates and some gone."""
    held = Snapshots(log.spark, f"{base_folder(log.spark)}/loved-{uuid.uuid4().hex}", ("artist_key", "title_key"), "loved_at")
    entries = fixtures.loved_entries(log).select("artist_key", "title_key", "loved_at")
    held.replace(entries)
    last = entries.where("(loved_at div 60) % 7 <> 0").withColumn("loved_at", F.col("loved_at") + 60)
    for _ in range(2):
        held.replace(last.unionByName(last.withColumn("loved_at", F.col("loved_at") + 5)))
    return held.current()


_add("snapshot_replace", _replaced, [catalog.TITLES, LOVED, ENTRIES], "select artist_key, title_key, min(loved_at + 60) as loved_at from lr where (loved_at // 60) % 7 <> 0 group by 1, 2", profile="supp")
