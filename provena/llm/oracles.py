"""DuckDB SQL for the queries that SQL can express."""

op8_source_mixing = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('17:' || coalesce(doc_id::varchar, 'null')) as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
    row_number() over (order by source is null, encode(source)) as place
  from d group by source),
w as (
  select *, list_extract(list_value(5.0::double, 2.0::double, 1.0::double), ((place - 1) % 3 + 1)::bigint) as weight,
    source_size * 3.0::double as cap from s),
r as (
  select *, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as spent,
    coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as used
  from w),
l as (select *, (total - spent) / (weights - used) as water, row_number() over (order by cap / weight, place) as rk from r),
f as (select *, min(case when cap / weight >= water then rk end) over () as at_rk from l),
t as (
  select f.source, f.source_size,
    least(case when f.at_rk is null or f.rk < f.at_rk then f.cap else f.weight * g.water end, f.cap) as target
  from f left join f g on g.rk = f.at_rk),
m as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from t),
n as (select *, target - whole * source_size as more from m),
e as (
  select d.*, n.source_size, n.target, n.whole, n.more, ('0x' || substr(d.key, 1, 3))::int as slice
  from d join n on d.source is not distinct from n.source),
k as (select source, slice, key, any_value(more) as more, sum(size) as words from e group by source, slice, key),
c as (
  select *, sum(words) over (partition by source, slice) as slice_words,
    sum(words) over (partition by source order by slice, key rows between unbounded preceding and current row) - words as before
  from k),
b as (
  select *, sum(words) over (partition by source order by slice range between unbounded preceding and current row) as slice_end
  from c),
x as (
  select source, key, more > 0 and (slice_end <= more
    or (slice_end - slice_words < more and before + words / 2.0 <= more)) as extra from b)
select e.doc_id, e.size, e.source_size, e.target, (e.size * (e.whole + case when x.extra then 1 else 0 end))::bigint as taken
from e join x on e.key = x.key and e.source is not distinct from x.source
"""

op4_line_dedup = r"""
with raw as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line0, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents where text is not null),
l as (
  select doc_id, pos, regexp_replace(line0, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from raw),
u as (select line, min((doc_id, pos)) as first, len(line) as n from l where line <> '' group by line),
h as (
  select line, first, n, b, side,
    case when side = 0 then left(line, (b // 2)::int) else right(line, (b - b // 2)::int) end as half
  from (select *, unnest([n, n - 1]) as b from u), (values (0), (1)) t(side)),
p as (
  select distinct x.line as a, y.line as c, x.n as na, y.n as nc, x.first as fa, y.first as fc
  from h x join h y on x.b = y.b and x.side = y.side and x.half = y.half and x.line <> y.line
    and (x.n = y.n or y.n = x.n + 1) and (x.b = x.n)),
v as (
  select *, list_max(list_transform(range(0, na + 1), lambda i: case when left(a, i) = left(c, i) then i else 0 end)) as head
  from p),
g as (
  select * from v where case when na = nc then substr(a, head + 2) = substr(c, head + 2) else substr(a, head + 1) = substr(c, head + 2) end),
near as (select a as line, fa as own, fc as other from g union select c, fc, fa from g),
gone as (select distinct line from near where other < own),
k as (
  select doc_id, pos from l where line <> '' and (line in (select line from gone)
    or (doc_id, pos) <> (select first from u where u.line = l.line))),
o as (
  select raw.doc_id, string_agg(line0, chr(10) order by raw.pos) filter (where k.pos is null) as text,
    count(*) as lines_in, count(*) filter (where k.pos is null) as lines_out
  from raw left join k on raw.doc_id = k.doc_id and raw.pos = k.pos group by raw.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(o.text, '') end as text,
  coalesce(lines_in, 0)::bigint as lines_in, coalesce(lines_out, 0)::bigint as lines_out
from documents d left join o on d.doc_id = o.doc_id
"""

op6_chat_formatting = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(replace(text, '\', '\b'), '(<\||</?s>|\[/?INST\]|<</?SYS>>|<(?:unk|pad|bos|eos|start_of_turn|end_of_turn)>)', '..\1', 'g') as longer
  from r)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(len(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(12 + len(role) + 1 + len(longer) + 10 + 1)::bigint as formatted_chars
from e group by conv_id
"""
