"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

OP1 = """
with x as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents where doc_id is not null),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) as s from (select doc_id, h, unnest(range(length(h) // 2 - 99)) as p from x)),
g as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as nth from w) where nth > 1),
i as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from
  (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as fresh from g)),
r as (select doc_id, run, min(p) as a, max(p) + 100 as e from i group by all),
c as (select r.doc_id, a, e, substr(h, 2 * coalesce(lag(e) over (partition by r.doc_id order by a), 0) + 1, 2 * (a - coalesce(lag(e) over (partition by r.doc_id order by a), 0))) as piece
  from r join x on x.doc_id = r.doc_id),
k as (select doc_id, string_agg(piece, '' order by a) as kept, max(e) as last, count(*) as n_spans, sum(e - a) as n_removed from c group by doc_id)
select x.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
 sha256(unhex(case when k.doc_id is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from x left join k on k.doc_id = x.doc_id
"""

OP2 = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents where doc_id is not null),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d left join n on n.doc_id = d.doc_id join c on c.a = d.doc_id
"""

OP4 = """
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents where doc_id is not null),
e as (select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from t),
o as (select * from e where trim(line, ' ') <> ''),
f as (select line, min((doc_id, line_no)) as first from o group by line),
m as (select line, first, length(line) as n, left(line, 7) as a, right(line, 7) as z, left(line, 10) as aa, right(line, 10) as zz, substr(line, length(line) // 2 - 4, 10) as c from f where length(line) >= 15),
near as (select distinct y.line from m x join m y on x.first < y.first and abs(x.n - y.n) <= 2 and x.n >= 40 and y.n >= 40
  and (x.aa = y.aa or x.zz = y.zz or contains(y.line, x.c)) and levenshtein(x.line, y.line) <= 2
  union select distinct y.line from m x join m y on x.first < y.first and abs(x.n - y.n) <= 1 and least(x.n, y.n) < 40 and (x.a = y.a or x.z = y.z) and levenshtein(x.line, y.line) <= 1),
gone as (select o.doc_id, o.line_no from o join f on f.line = o.line where (o.doc_id, o.line_no) <> f.first or o.line in (select line from near)),
k as (select e.doc_id, string_agg(e.line, chr(10) order by e.line_no) as kept from e anti join gone on gone.doc_id = e.doc_id and gone.line_no = e.line_no group by e.doc_id),
g as (select doc_id, count(*) as n from gone group by doc_id)
select t.doc_id, cast(len(ls) as bigint) as n_lines, coalesce(g.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join k on k.doc_id = t.doc_id left join g on g.doc_id = t.doc_id
"""

OP5 = f"""
with d as (select doc_id, unnest({_WORDS}) as term from documents where doc_id is not null),
tf as (select doc_id, term, count(*) as tf from d group by all),
dl as (select doc_id, sum(tf) as words from tf group by doc_id),
st as (select (select count(*) from documents where doc_id is not null) as n, (select sum(words) from dl) / (select count(*) from documents where doc_id is not null) as mean),
df as (select term, count(*) as df from tf group by term),
w as (select tf.doc_id, tf.term, df.df, ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) as idf, tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.words / mean)) as sat
  from tf join df on df.term = tf.term join dl on dl.doc_id = tf.doc_id cross join st),
q as (select doc_id as query_id, term from tf where doc_id % 20 = 0),
s as (select query_id, w.doc_id, cast(round(sum(idf * sat) * 1e6) as bigint) as score_micro from q join w on w.term = q.term group by all)
select query_id, cast(rank as bigint) as rank, doc_id, score_micro from (select *, row_number() over (partition by query_id order by score_micro desc, doc_id) as rank from s) where rank <= 10
"""

_PIECES = f"regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')"
OP12 = f"""
with p as (select coalesce(lang, 'und') as lang, unnest({_PIECES}) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
tot as (select lang, sum(len(w)) as n from w group by lang),
g as (select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase, k
  from w, (select unnest(range(1, 6)) as k) where len(w) >= k),
f as (select lang, phrase, k, count(*) as a from g group by all having count(*) >= 100),
c as (select lang, phrase, k, a, string_split(phrase, ' ') as ws from f where k >= 2),
cuts as (select c.lang, c.phrase, c.k, c.a, unnest(range(1, c.k)) as cut, ws from c),
sc as (select cuts.lang, cuts.phrase, cuts.k, cuts.a, cut, x.a as l, y.a as r, n, (1000 * cuts.a::hugeint * n::hugeint) // (x.a::hugeint * y.a::hugeint) as score
  from cuts join tot on tot.lang = cuts.lang join f x on x.lang = cuts.lang and x.phrase = array_to_string(ws[:cut], ' ') join f y on y.lang = cuts.lang and y.phrase = array_to_string(ws[cut + 1:], ' ')),
best as (select *, row_number() over (partition by lang, phrase order by score, cut) as nth from sc),
inside as (select distinct c.lang, sub.phrase from c, lateral (select unnest(list_concat([array_to_string(ws[:k - 1], ' ')], [array_to_string(ws[2:], ' ')])) as phrase) sub
  join f on f.lang = c.lang and f.phrase = sub.phrase where c.k >= 3 and f.a <= c.a),
kept as (select b.* from best b anti join inside i on i.lang = b.lang and i.phrase = b.phrase where nth = 1)
select lang, rank, phrase, a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
with t as (select row_number() over () as d, doc_id, {_TERMS} as ts from documents where doc_id is not null),
st as (select count(*) filter (len(ts) > 0) as big_n, cast(sum(len(ts)) as bigint) as big_l from t),
tf as (select d, doc_id, term, count(*) as tf, any_value(n) as n from (select d, doc_id, len(ts) as n, unnest(ts) as term from t) group by all),
df as (select term, count(*) as df from tf group by term),
i as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark where item_id is not null) group by all),
w as (select term, cast(floor(1000.0 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from df cross join st),
s as (select item_id, doc_id, d, cast(sum(times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * n * big_n) // big_l)))) as bigint) as score
  from i join tf on tf.term = i.term join w on w.term = i.term cross join st group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 20
"""
