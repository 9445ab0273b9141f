"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from kerbline.llm import url_filter

_HELD = f"least(greatest(sum(n * (good / n - prior) * (good / n - prior) - prior * (1 - prior)) / nullif(sum((n - 1) * prior * (1 - prior)), 0), {1 / (url_filter.HEAVIEST + 1)!r}), {1 / (url_filter.LIGHTEST + 1)!r})"
_WEIGHT = f"1 / coalesce({_HELD}, {1 / (url_filter.HEAVIEST + 1)!r}) - 1"
_PUBLIC = f"array_to_string(string_split(host, '.')[-2:], '.') in ({', '.join(repr(x) for x in url_filter.SUFFIXES)})"
_FITS = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
_CASE = "\n".join(f"    when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{}}'" for _, h, p in _FITS)

OP1 = f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parsed as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from cut
), mine as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
  from parsed
), hosts as (
  select host, array_to_string(string_split(host, '.')[(case when {_PUBLIC} then -3 else -2 end):], '.') as domain,
         case when {_PUBLIC} then array_to_string(string_split(host, '.')[-2:], '.') else string_split(host, '.')[-1] end as suffix,
         count(quality)::double as n, coalesce(sum(quality), 0)::double as good
  from mine left join labels on page_id = doc_id group by all
), domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by all),
s0 as (select suffix, n, good, (sum(good) over () + 1) / (sum(n) over () + 2) as prior from (select suffix, sum(n) as n, sum(good) as good from domains group by all)),
s1 as (select suffix, (good + prior * w) / (n + w) as m from s0, (select {_WEIGHT} as w from s0 where n > 0)),
d0 as (select domain, n, good, m as prior from domains join s1 using (suffix)),
d1 as (select domain, (good + prior * w) / (n + w) as m from d0, (select {_WEIGHT} as w from d0 where n > 0)),
h0 as (select host, n, good, m as prior from hosts join d1 using (domain)),
h1 as (select host, good + prior * w as a, n - good + (1 - prior) * w as b from h0, (select {_WEIGHT} as w from h0 where n > 0)),
learned as (select host, a / (a + b) - {url_filter.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {url_filter.ENOUGH} as good from h1)
select page_id, host, path,
  case
{_CASE.format(*(h + p for _, h, p in _FITS))}
  end as rule,
  case
{_CASE.format(*(v for v, _, _ in _FITS))}
    when good then 'allow' else 'block' end as verdict
from mine left join learned using (host)
"""

_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP4 = f"""
with d as (select row_number() over () as r, doc_id, {_SPLIT} as w from documents),
g as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
low as (select k, min(doc_id) as lo from g group by k),
gone as (select distinct r, unnest(range(i, i + 13)) as i from g join low using (k) where lo < doc_id),
each as (select r, doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
kept as (select e.r, string_agg(w[e.i], ' ' order by e.i) as t, count(*) as n from each e left join gone o on o.r = e.r and o.i = e.i where o.r is null group by e.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (r)
"""

_ROWS = "select conv_id, turn, role, text from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')"

#: The formatted length: every example holds its prefix; a turn adds the four control strings, role and text with what escaping adds.
_ESCAPED = "length(replace({0}, chr(92), chr(92) || chr(92))) + (length({0}) - length(replace({0}, '<s>', ''))) // 3 + (length({0}) - length(replace({0}, '</s>', ''))) // 4 + (length({0}) - length(replace({0}, '[INST]', ''))) // 6 + (length({0}) - length(replace({0}, '[/INST]', ''))) // 7"

OP3 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i, count(*) over (partition by conv_id) as n from ({_ROWS})),
s as (select *, 20 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')} as size from t),
p as (select *, sum(size) over (partition by conv_id order by i) as upto from s)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (where role = 'assistant' or i = n) as bigint) as formatted_chars
from p group by conv_id
"""

_NEAREST = """
d{0} as (select q.r, q.p, b.e, sum((q.x - b.c) * (q.x - b.c)) as d from q join b{0} b on b.p = q.p and b.j = q.j group by all),
a{0} as (select r, p, min(d * 64 + e) as m from d{0} group by all)"""
_MEANS = """
s{0} as (select q.p, m % 64 as e, j, sum(x) as s, count(*) as n from q join a{0} a on a.r = q.r and a.p = q.p group by all),
b{1} as (select b.p, b.e, b.j, coalesce((s - ((s % n) + n) % n) // n, c) as c from b{0} b left join s{0} s on s.p = b.p and s.e = b.e and s.j = b.j)"""

OP11 = f"""
with ok as (select vec_id, label, embedding from embeddings where embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false)),
n as (select row_number() over (order by vec_id) as r, *, len(embedding) // 16 as w from ok),
q as (select r, p, j, floor(256 * embedding[p * w + j + 1]::double)::bigint as x from (select r, w, embedding, unnest(range(16)) as p, range(w) as js from n), unnest(js) as t(j)),
b0 as (select p, r - 1 as e, j, x as c from q where r <= 64),{_NEAREST.format(0)},{_MEANS.format(0, 1)},{_NEAREST.format(1)},{_MEANS.format(1, 2)},{_NEAREST.format(2)},
coded as (select r, string_agg(printf('%02x', cast(m % 64 as integer)), '' order by p) as code, cast(sum(m // 64) as bigint) as error from a2 group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by p, e, j)) from b2) as codebooks_sha256
from coded join n using (r)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
with tab as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as tab),
d as (select doc_id, {_WORDS} as w from documents),
f as (select doc_id, 0 as t, unnest(w) as word from d union all select null, 1, unnest({_WORDS}) from benchmark),
b as (select word, list_transform(range(len(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint) as bytes from (select distinct word from f)),
c as (select word, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from b, tab),
n as (select bucket, (count(*) filter (where t = 0))::double as s, (count(*) filter (where t = 1))::double as t from f join c using (word) group by bucket),
g as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from n) + 10000) / ((s + 1) * ((select sum(t) from n) + 10000))))::bigint as gain from n),
weights as (select doc_id, sum(gain) as weight from f join c using (word) join g using (bucket) where t = 0 group by doc_id),
scores as (
  select doc_id, cast(len(w) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296))) as bigint) as score
  from d left join weights using (doc_id)
),
ranks as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scores where n_features >= 20)
select s.doc_id, n_features, weight, score, cast(rank as bigint) as rank from scores s left join (select * from ranks where rank <= 10 * n // 100) using (doc_id)
"""

_LEVEL = """
s{0} as (select {1}, sum(n) as seen, sum(case when n > 0 then n * (ln(n - 1 + 4 * p) - ln(p)) else 0 end) - sum(n) * ln(sum(n) - 1 + 4) as gain from g{0} group by all having sum(n) > 1),
p{0} as (select g{0}.* exclude (n, p), case when gain >= 3 then (n + 4 * p) / (seen + 4) else p end as p from g{0} left join s{0} using ({1}))"""

#: The end of a text is the word '', what comes before it the word of a line break.
OP13 = f"""
with tab as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as tab),
d as (
  select row_number() over () as r, doc_id,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') as w,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295::bigint) % 7 = 2 as held_out
  from documents, tab
),
t as (select r, held_out, w[i] as x, case when i > 1 then w[i - 1] else chr(10) end as a, case when i > 2 then w[i - 2] when i = 2 then chr(10) end as b from (select *, unnest(range(1, len(w) + 1)) as i from d)),
c as (select x, (count(*) filter (where not held_out))::double as n from t group by x),
size as (select sum(n) as n_all, (count(*) filter (where n > 0))::double as n_words from c),
p0 as (select x, n, (n + 1) / (n_all + n_words + 1) as p from c, size),
g1 as (select a, x, (count(*) filter (where not held_out))::double as n, any_value(p) as p from t join p0 using (x) group by a, x),{_LEVEL.format(1, 'a')},
g2 as (select b, a, x, (count(*) filter (where not held_out))::double as n, any_value(p) as p from t join p1 using (a, x) where b is not null group by b, a, x),{_LEVEL.format(2, 'b, a')},
sums as (
  select r, count(*) as n_tokens, count(*) filter (where p0.n > 0) as n_known, sum(log10(p0.p)) as base_score, sum(log10(coalesce(p2.p, p1.p))) as score
  from t join p0 using (x) join p1 using (a, x) left join p2 on p2.b = t.b and p2.a = t.a and p2.x = t.x group by r
)
select doc_id, held_out, n_tokens, n_known, cast(n_all as bigint) as train_tokens, base_score, score from d join sums using (r), size
"""
