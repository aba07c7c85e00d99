"""SQL that gives the rows of some queries, for whole tables of moderate size."""

from __future__ import annotations

from quietlog.llm.license_scan import DICE, TEMPLATES

#: Words without ASCII punctuation, as textcore.PUNCTUATED has them.
PLAIN = r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

OP2 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from d, unnest(range(1, len(w) - 48)) as r(i)),
firsts as (select h, min(doc_id) as m from win group by h),
hit as (select win.doc_id, i from win join firsts using (h) where m < win.doc_id),
gone as (select distinct doc_id, p from hit, unnest(range(i, i + 50)) as r(p)),
words as (select doc_id, p, w[p] as word from d, unnest(range(1, len(w) + 1)) as r(p)),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

_ROWS = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name in sorted(TEMPLATES) for text in TEMPLATES[name])
OP7 = rf"""
with recursive t as (select row_number() over () as tid, licence, regexp_extract_all(lower(x), '{PLAIN}') as w from (values {_ROWS}) v(licence, x)),
tb as (select tid, licence, list_distinct(case when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as b from t),
lines as (select doc_id, text, regexp_split_to_array(text, '\r\n|\n|\r') as l from documents where text is not null),
parts as (select distinct doc_id, s from (
  select doc_id, unnest(l) as s from lines union all select doc_id, unnest(string_split(replace(text, E'\r\n', E'\n'), E'\n\n')) from lines where len(l) > 1 union all select doc_id, text from lines where len(l) > 1)
  where trim(s, E' \t\n\r\x0b\x0c') <> ''),
pw as (select doc_id, s, regexp_extract_all(lower(s), '{PLAIN}') as w from parts),
pb as (select row_number() over () as pid, doc_id, list_distinct(case when len(w) = 1 then [w[1]] when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end) as b from pw),
met as (select p.pid, q.tid, count(*) as n from (select pid, unnest(b) as g from pb) p join (select tid, unnest(b) as g from tb) q on p.g = q.g group by 1, 2),
scored as (select doc_id, licence, met.pid, 2.0 * n / (len(pb.b) + len(tb.b)) as v from met join pb using (pid) join tb using (tid))
select doc_id, licence, round(max(v), 6) as dice, cast(count(distinct pid) as bigint) as stretches from scored where v >= {DICE} - 1e-9 group by doc_id, licence"""

OP9 = rf"""
with recursive d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{PLAIN}') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [''] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
u as (select doc_id, len(g) as n, unnest(g) as x from s),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs where c >= 0.8 * (na + nb - c) - 1e-9),
ways as (select a as f, b as t from links union select b, a from links),
reach(doc_id, seen) as (select doc_id, doc_id from d union select r.doc_id, w.t from reach r join ways w on r.seen = w.f)
select doc_id, min(seen) as class_id from reach group by doc_id"""

ORACLE_SQL = {"op2_fm_index_dedup": OP2, "op7_license_scan": OP7, "op9_dart_minhash_dedup": OP9}
