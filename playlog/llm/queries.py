"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playlog.llm import archive, collocations, decontam, dialogue, langid, linededup, minhash, ngramjoin, spotsigs, substrings, tokencount, tokenfile, wordbpe


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.removed_words(_documents(spark, sf_dir)))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digests(spotsigs.compared(_documents(spark, sf_dir)))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(_documents(spark, sf_dir))


def op6_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(wordbpe.encode(_documents(spark, sf_dir)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_documents(spark, sf_dir)).select("doc_id", "n_removed", "n_chars", "text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(_documents(spark, sf_dir), store=False)
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {tokencount.LIMIT} as over_limit", "fits_chars")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.restored(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_arc_to_warc, op3_substring_dedup, op4_spotsigs, op5_ngram_jaccard, op6_bpe_words, op7_line_dedup, op8_token_counts, op9_token_files, op10_language_id, op11_minhash, op12_collocations, op13_conversation_repair)}

ORACLES = {
    "op2_arc_to_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
from f""",
    "op3_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, unnest(range(1, len(ws) - 48)) as s, ws from w where len(ws) >= 50),
h as (select doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) as k from win),
dup as (select doc_id, s from (select doc_id, s, min(doc_id) over (partition by k) as least from h) where least < doc_id),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as p from dup),
g as (select doc_id, list(p) as ps from gone group by doc_id),
kept as (select w.doc_id, len(ws) as n, coalesce(len(ps), 0) as r,
                case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i)) end as k
         from w left join g using (doc_id))
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
    "op5_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
sym as (select a, b from e union all select b, a from e),
r as (select doc_id as id, doc_id as node from documents union select r.id, sym.b from r join sym on sym.a = r.node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from documents d left join n using (doc_id)
join (select id, min(node) as component_id from r group by id) c on c.id = d.doc_id""",
    "op12_collocations": r"""
with w as (
  select lang, words from (
    select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as words
    from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents))
  where len(words) > 0),
n as (select lang, sum(len(words))::bigint as n from w group by lang),
g as (select lang, size, array_to_string(list_slice(words, i, i + size - 1), ' ') as phrase, count(*) as f
      from (select lang, words, size, unnest(range(1, len(words) - size + 2)) as i from w, (values (1), (2), (3)) s(size) where len(words) >= size) group by all),
c as (select lang, size, phrase, f as a from g where size >= 2 and f >= 10),
cut as (select c.*, k, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
        from (select *, string_split(phrase, ' ') as ws, unnest(range(1, size)) as k from c) c
        join g l on l.lang = c.lang and l.phrase = array_to_string(list_slice(ws, 1, k), ' ')
        join g r on r.lang = c.lang and r.phrase = array_to_string(list_slice(ws, k + 1, c.size), ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase, a as longer from (select *, string_split(phrase, ' ') as ws from c where size = 3)),
over as (select lang, phrase, max(longer) as longer from inside group by all),
kept as (select b.* from best b left join over o on o.lang = b.lang and o.phrase = b.phrase where longer is null or 100 * longer < 50 * a)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score
from kept k join n on n.lang = k.lang qualify rank <= 2000""",
    "op13_conversation_repair": r"""
with recursive steps as (select list(v order by i) as t from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) r(i))),
k as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
crc as (select key, xor(list_reduce([4294967295::bigint] || list_transform(string_split(key, ''), lambda c: ascii(c)::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as kind
        from (select distinct key from k), steps),
d as (select conv_id, turn, case kind when 4 then 'user' else coalesce(role, ' ') end as role,
        case kind when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
      from k join crc using (key) where kind <> 0),
o as (select *, left(role, 1) as letter, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
h as (select *, row_number() over (partition by conv_id, role, text order by i) as said from o),
f as materialized (select *, lag(letter) over (partition by conv_id order by i) as before,
        case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when said > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else 'none' end as fault from h),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
        count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where i > 1 and before || letter not in ('su', 'ua', 'au')) as illegal, max(i) as rows from f group by conv_id),
dp(conv_id, i, s) as (
  select conv_id, rows + 1, [{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] from c
  union all
  select conv_id, i, list_transform([1, 2, 3, 4], lambda q: list_min([b[q], {'c': b[[3, 3, 4, 3][q]].c + 3, 'a': 'I' || b[[3, 3, 4, 3][q]].a}])) from (
    select conv_id, i, list_transform([1, 2, 3, 4], lambda q: list_min([b[q], {'c': b[[3, 3, 4, 3][q]].c + 3, 'a': 'I' || b[[3, 3, 4, 3][q]].a}])) as b from (
      select conv_id, i, list_transform([1, 2, 3, 4], lambda q: list_min([b[q], {'c': b[[3, 3, 4, 3][q]].c + 3, 'a': 'I' || b[[3, 3, 4, 3][q]].a}])) as b from (
        select f.conv_id, f.i, list_transform([1, 2, 3, 4], lambda q: list_min([{'c': s[q].c + 4, 'a': 'D' || s[q].a}]
          || case when fault in ('blank', 'duplicate') then [] else [{'c': s[[3, 3, 4, 3][q]].c + 3 + (fault = 'truncated')::int * 3, 'a': 'R' || s[[3, 3, 4, 3][q]].a}] end
          || case when fault in ('blank', 'duplicate') or not list_contains([['s', 'u'], ['u'], ['a'], ['u']][q], letter) then []
                  else [{'c': s[case letter when 's' then 2 when 'u' then 3 else 4 end].c + (fault = 'truncated')::int * 3, 'a': 'K' || s[case letter when 's' then 2 when 'u' then 3 else 4 end].a}] end)) as b
        from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i - 1)))),
best as (select conv_id, s[1].c as cost, s[1].a as audit from dp where i = 1),
e as (select conv_id, unnest(string_split(audit, '')) as edit, unnest(range(1, length(audit) + 1)) as j from best where audit <> ''),
p as (select *, count(*) filter (where edit <> 'I') over (partition by conv_id order by j) as i, count(*) filter (where edit <> 'D') over (partition by conv_id order by j) as place from e),
r as (select p.conv_id, j, edit, place, f.role, f.text, max((place = 1 and edit = 'K' and letter = 's')::int) over (partition by p.conv_id) as opened
      from p left join f on f.conv_id is not distinct from p.conv_id and f.i = p.i and edit <> 'I' where edit <> 'D'),
t as (select conv_id, string_agg(case when edit = 'K' then role when (place - opened) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by j) as repaired from r group by conv_id)
select x.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) x left join c on c.conv_id is not distinct from x.conv_id left join best b on b.conv_id is not distinct from x.conv_id left join t on t.conv_id is not distinct from x.conv_id""",
}

ORACLES["op11_minhash"] = ORACLES["op5_ngram_jaccard"].replace(">= 75 *", ">= 85 *").replace("c.component_id\nfrom", "c.component_id, d.doc_id = c.component_id as kept\nfrom")
