"""Queries for releases by new artists, and for places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlog.functions.text import PLACE_NAMES
from playlog.model import PlayLog
from playlog.operators import newcomers, releases, taste
from playlog.plans.catalog import TAGS, TRENDS, _add, _facts, _shares
from playlog.sources import fixtures
from playlog.store import saved

VECTOR = """fs as (select artist_id, replace(replace(lower(trim(replace(tag, '_', ' '), ' -')), ' ', ''), '-', '') as fold, share from sh),
fn as (select fold, sum(now * share) as n from wt join fs using (artist_id) group by 1),
gv as (select fold, coalesce(n / (select sum(n) from fn), 0) as now, ln(1 + (select count(distinct artist_id) from sh) / df) as idf
  from (select fold, count(distinct artist_id) as df from fs group by 1) left join fn using (fold))"""
NEW = """sd as (select lower(s_name) as seed_key, round(round(now, 6) / (select sum(now) from wt), 6) as weight from wt join supplier on s_suppkey = artist_id order by round(now, 6) desc, artist_id limit 150),
cu as (select c_custkey as c, lower(c_name) as name_key, p_name, c_mktsegment, p_type, p_brand from customer join part on p_partkey = c_custkey % (select count(*) from part) + 1),
nr as (select 30000000 + second * 10000000 + c as release_id, c, name_key, second, p_name || case when c % 5 = 0 or second = 1 then ' (Deluxe Edition)' else '' end as title,
  case when second = 1 then 'EP' else ['Album', 'EP', 'Single'][c % 3 + 1] end as kind, (select max(lday) from p) + (c * 5 % 60)::int as day from cu, (values (0), (1)) v(second) where second = 0 or c % 6 = 0),
cn as (select * from nr where kind <> 'Single'),
si as (select distinct l_suppkey as s, o_custkey as c from lineitem join orders on l_orderkey = o_orderkey),
sl as (select lower(s_name) as seed_key, case when c % 3 = 0 and s % 2 = 0 then 'mbid:cid-' || c else lower(c_name) end as key, weight * ((s * 7 + c * 3) % 100 / 100) as value
  from si join supplier on s_suppkey = s join customer on c_custkey = c join sd on sd.seed_key = lower(s_name)),
ck as (select release_id, name_key as key from cn union select release_id, 'mbid:cid-' || c from cn where c % 3 = 0 union select release_id, lower(c_name) from cn join customer on c_custkey = c + 1 where c % 4 = 0),
sb as (select release_id, seed_key, max(value) as value from ck join sl using (key) where value > 0 group by 1, 2),
sm as (select release_id, sum(value) as similarity, array_to_string(list_slice(list(seed_key order by round(value, 12) desc, seed_key), 1, 3), ',') as liked from sb group by 1),
ct as (select name_key, unnest([upper(p_type), lower(p_brand), '-' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || '_', c_mktsegment]) as tag, unnest([100, 60, 40, 30, 20]) as weight from cu where c % 7 <> 0),
cf as (select name_key, fold, max(weight * coalesce(idf, (select max(idf) from gv))) as w, min(tag) as tag from (select *, replace(replace(lower(trim(replace(tag, '_', ' '), ' -')), ' ', ''), '-', '') as fold from ct) left join gv using (fold) group by 1, 2),
cb as (select cf.*, w * now * idf as met from cf left join gv on gv.fold = cf.fold and now > 0),
cg as (select name_key, sum(met) / (sqrt(sum(w * w)) * (select sqrt(sum(now * idf * now * idf)) from gv)) as genre_fit,
  array_to_string(list_slice(list(tag order by round(met, 12) desc, fold) filter (where met is not null), 1, 3), ',') as genres from cb group by 1 having sum(met) is not null),
nk as (select cn.*, coalesce(similarity, 0) as similarity, coalesce(genre_fit, 0) as genre_fit, coalesce(liked, '') as liked, coalesce(genres, '') as genres from cn left join sm using (release_id) left join cg using (name_key)
  where coalesce(similarity, 0) > 0 or round(coalesce(genre_fit, 0), 9) >= 0.4),
nt as (select * replace (round(genre_fit, 3) as genre_fit, round(similarity / m, 4) as similarity), round(0.5 * similarity / m + 0.5 * round(genre_fit, 3), 4) as score from nk, (select coalesce(nullif(max(similarity), 0), 1) as m from nk))"""


def _vector(log: PlayLog) -> DataFrame:
    return newcomers.genre_vector(taste.weights(log.plays, log.span), _shares(log))


def _new(log: PlayLog) -> DataFrame:
    listed = saved(fixtures.release_list(log).unionByName(fixtures.new_releases(log), allowMissingColumns=True))
    names = log.artists.select(F.lower("name").alias("name_key"), "artist_id")
    matches = saved(releases.release_match(listed, names, fixtures.artist_aliases(log), fixtures.artist_ids(log)))
    strangers = newcomers.not_yours(listed, releases.release_merge(listed, matches), matches, _facts(log)).withColumns({"name_key": F.col("credit_key"), "title": F.coalesce("title", "title_key")})
    seeds = taste.seeds(taste.weights(log.plays, log.span)).join(names.withColumnRenamed("name_key", "seed_key"), "artist_id").select("seed_key", "weight")
    return newcomers.new_to_you(strangers, seeds, fixtures.similar_artists(log), fixtures.new_artist_tags(log), _vector(log))


_add("genre_vector", lambda x: _vector(x).select("fold", F.round("now", 6).alias("now"), F.round("idf", 6).alias("idf")), [TAGS, TRENDS, VECTOR], "select fold, round(now, 6) as now, round(idf, 6) as idf from gv")
_text = lambda name: F.coalesce(F.array_join(name, ","), F.lit("")).alias(name)
_add("new_to_you", lambda x: _new(x).select("release_id", "similarity", "genre_fit", "score", _text("like"), _text("genres")), [TAGS, TRENDS, VECTOR, NEW],
     'select release_id, similarity, genre_fit, score, liked as "like", genres from nt', profile="supp")
_add("new_to_you_weeks", lambda x: newcomers.new_weeks(_new(x)), [TAGS, TRENDS, VECTOR, NEW], """, w as (select *, day + ((5 - isodow(day)::int + 7) % 7) as friday, replace(title, ' (Deluxe Edition)', '') as plain, case kind when 'Album' then 1 else 2 end as k from nt),
o as (select * from w qualify row_number() over (partition by friday, name_key, plain order by score desc, day, name_key, k, release_id) = 1)
select friday, row_number() over (partition by friday order by score desc, day, name_key, k, release_id)::int as place, release_id, score from o qualify place <= 15""", profile="supp")
_PLACES = "case lower(n_name) when 'france' then 'french' when 'germany' then 'german' when 'japan' then 'japanese' else lower(n_name) end"
for _name, _least in (("taste_places", 0.05), ("taste_places_relaxed", 0.0)):
    _add(_name, lambda x, a=_least: newcomers.places(taste.weights(x.plays, x.span), fixtures.place_tags(x), PLACE_NAMES, least=a), [TAGS, TRENDS], f""", t as (select artist_id, {_PLACES} as place from wt join supplier on s_suppkey = artist_id join nation on n_nationkey = s_nationkey where artist_id % 3 <> 0)
select place, round(sum(now) / (select sum(now) from wt), 6) as share from t join wt using (artist_id) group by 1 having round(sum(now) / (select sum(now) from wt), 6) >= {_least} order by share desc, place limit 4""", profile="supp")
