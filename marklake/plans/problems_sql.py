"""SQL for the queries on measurements and nested records."""

from __future__ import annotations

_LEAPS = " union all ".join(
    f"""select host, field, n, {size} as size from (select *, min(x) over (w rows between current row and {size - 1} following) as low, max(x) over (w rows between current row and {size - 1} following) as high,
quantile_cont(x, 0.5) over (w rows between 5 preceding and 1 preceding) as b, count(x) over (w rows between 5 preceding and 1 preceding) as nb, quantile_cont(x, 0.5) over (w rows between {size} following and {size + 4} following) as a, count(x) over (w rows between {size} following and {size + 4} following) as na,
count(x) over (w rows between current row and {size - 1} following) as own, lag(x) over w as l, lead(x, {size}) over w as r from s window w as (partition by host, field order by n)) join scale using (host, field) where nb >= 2 and na >= 2 and own = {size} and total >= 5 and ((low - greatest(a, b) > 6 * greatest(scale, 1e-9) and low - greatest(l, r) > 3 * greatest(scale, 1e-9)) or (least(a, b) - high > 6 * greatest(scale, 1e-9) and least(l, r) - high > 3 * greatest(scale, 1e-9)))"""
    for size in (1, 2, 3)
)

P1 = f"""with o as (select distinct on (reading_id) * from telemetry where reading_id is not null), f as (select reading_id, host, ts, 'load' as field, load as v from o union all select reading_id, host, ts, 'temp_c', temp_c from o union all select reading_id, host, ts, 'single_p95_ms', single_p95_ms from o),
k as (select *, case field when 'load' then v between 0 and 1 when 'temp_c' then v between -50 and 140 else v between 0 and 3600000 end as fits from f where v is not null and not isnan(v)),
c as (select *, fits and not (field = 'single_p95_ms' and v = 0) as counted from k where host is not null and ts is not null),
g as (select *, case when lag(v) over w = v then 0 else 1 end as new from c window w as (partition by host, field order by ts, reading_id)), i as (select *, sum(new) over (partition by host, field order by ts, reading_id rows unbounded preceding) as run from g),
r as (select host, field, run, count(*) as n, bool_and(counted) as counted from i group by all), u as (select host, field, quantile_disc(n, 0.95) as usual from r where counted group by all), stuck as (select host, field, run from r join u using (host, field) where counted and n > 2.75 * greatest(usual, 4)),
s as (select *, row_number() over (partition by host, field order by ts, reading_id) as n, count(*) over (partition by host, field) as total from (select reading_id, host, ts, field, case when field = 'single_p95_ms' then ln(v) else v end as x from c where counted)),
q as (select host, field, abs(x - lag(x) over (partition by host, field order by n)) as d from s), scale as (select host, field, greatest(quantile_disc(d, 0.5) / 0.6745, quantile_disc(d, 0.8) / 1.2816, quantile_disc(d, 0.95) / 1.96) / sqrt(2) as scale from q where d is not null group by all),
l as ({_LEAPS})
select distinct reading_id, field from (select reading_id, field from k where not fits union all select reading_id, field from i join stuck using (host, field, run) union all select s.reading_id, s.field from l join s on s.host = l.host and s.field = l.field and s.n between l.n and l.n + l.size - 1)"""

_OPEN = "case when json_type({0}) = 'VARCHAR' and regexp_matches({0} ->> '$', '^[ \\t\\r\\n]*[\\[{{]') and json_valid({0} ->> '$') then ({0} ->> '$')::json else {0} end"

P6 = f"""with recursive b as (select record_id, max(body) as body from raw_record where record_id is not null group by record_id),
n as (select record_id, '' as parent_path, '' as node_path, {_OPEN.format("body::json")} as j from b where json_valid(body)
union all select record_id, node_path, node_path || '/' || k, {_OPEN.format("c")} from (select record_id, node_path, k, case when json_type(j) = 'ARRAY' then json_extract(j, '$[' || k || ']') else json_extract(j, '$."' || k || '"') end as c
from (select record_id, node_path, j, unnest(case when json_type(j) = 'OBJECT' then json_keys(j) when json_type(j) = 'ARRAY' then list_transform(range(cast(json_array_length(j) as bigint)), lambda x: cast(x as varchar)) else [] end) as k from n)))
select record_id, parent_path, node_path from n where node_path <> ''"""

_GENERIC = r"regexp_replace(regexp_replace(node_path, '/[0-9]+(/|$)', '/[]\1', 'g'), '/[0-9]+(/|$)', '/[]\1', 'g')"
_KIND = "case json_type(j) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end"

P6_SCHEMA = P6[: P6.rindex("select record_id")] + f"""select path, array_to_string(list_sort(list(distinct kind)), '|') as kinds, count(*) as nodes, count(distinct record_id) as records
from (select record_id, {_GENERIC} as path, {_KIND} as kind from n where node_path <> '') group by path"""

_LED = r"^[~≈<>=\s]*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(?:[a-zA-Zµ%/°]{1,8})?\s*(?:\([^()]*\))?\s*$"

P5 = rf"""with recursive fo as (select exp, file, row_number() over (partition by exp order by written_at, file) as seq, count(*) over (partition by exp) as last_seq from (select file, min(exp) as exp, min(written_at) as written_at from result_files where exp is not null and file is not null and written_at is not null group by file)),
lv as (select file, path, max(text) as text, max(num) as num from results where file is not null and path is not null group by file, path),
sp as (select *, coalesce(nullif(regexp_extract(path, '/(\d{{1,9}})$', 1), ''), nullif(regexp_extract(path, '\[(len|mean)\]$', 1), ''), nullif(regexp_extract(path, '/(value|unit)$', 1), '')) as part from lv),
wh as (select *, case when part is null then path else regexp_replace(path, '(?:/\d{{1,9}}|\[(?:len|mean)\]|/(?:value|unit))$', '') end as whole, try_cast(part as bigint) as number from sp),
kd as (select *, case when number is not null and max(number) over w + 1 = count(number) over w then 'list' when part in ('len', 'mean') and max((part = 'len')::int) over w = 1 and max((part = 'mean')::int) over w = 1 then 'list'
when part in ('value', 'unit') and max((part = 'value')::int) over w = 1 and max((part = 'unit')::int) over w = 1 then 'object' end as kind from wh window w as (partition by file, whole)),
ty as (select file, case when kind is null then path else whole end as field, part, coalesce(kind, case when text = 'None' or (num is null and text is null) then null when text in ('True', 'False') then 'flag' when text is null then 'number' else 'text' end) as type, num, text from kd),
nu as (select file, field, part, type, coalesce(num, case when type = 'text' then try_cast(nullif(regexp_extract(text, '{_LED}', 1), '') as double) end) as num, text from ty),
fd as (select file, field, max(type) as type, case max(type) when 'list' then coalesce(max(case when part = 'mean' then num end), avg(case when part is distinct from 'len' then num end)) when 'object' then max(case when part = 'value' then num end) else max(num) end as num,
case when max(type) = 'list' or max(type) is null then null when max(type) = 'object' then max(case when part = 'unit' then text end) else max(text) end as text from nu group by file, field),
sq as (select fd.*, exp, seq, last_seq from fd join fo using (file)),
il as (select *, coalesce(seq - lag(seq) over w > 1, true) as starts, coalesce(lead(seq) over w - seq > 1, true) as ends from sq window w as (partition by exp, field order by seq)),
ig as (select *, sum(starts::int) over (partition by exp, field order by seq) as island, case when type is not null then {{'type': type, 'num': num, 'text': text}} end as known from il),
ct as (select *, last_value(known ignore nulls) over (partition by exp, field, island order by seq rows between unbounded preceding and 1 preceding) as before, last_value(known ignore nulls) over (partition by exp, field, island order by seq rows between unbounded preceding and current row) as last from ig),
sd as (select exp, seq, 'started' as side, field, type, num, text from ct where starts and seq > 1 union all select exp, seq + 1, 'ended', field, last.type, last.num, last.text from ct where ends and seq < last_seq),
gb as (select *, case when type in ('number', 'list') or (type = 'text' and num is not null) then '' else coalesce(text, '') end as same, case when type in ('number', 'list', 'object') or type = 'text' then num end as near from sd where type is not null and (num is not null or type in ('flag', 'text'))),
ek as (select *, row_number() over (partition by exp, seq, type, same, near, side order by field) as k from gb where near is not null),
eq as (select o.exp, o.seq, o.field as old, n.field as new from ek o join ek n on o.side = 'ended' and n.side = 'started' and o.exp = n.exp and o.seq = n.seq and o.type = n.type and o.same = n.same and o.near = n.near and o.k = n.k),
lf as (select * from ek where not exists (select 1 from eq where eq.exp = ek.exp and eq.seq = ek.seq and ((side = 'ended' and eq.old = field) or (side = 'started' and eq.new = field)))),
cp as (select o.exp, o.seq, o.type, o.same, o.field as old, n.field as new, row_number() over (partition by o.exp, o.seq, o.type, o.same order by abs(o.near - n.near), o.near, n.near, o.field, n.field) as k
from lf o join lf n on o.side = 'ended' and n.side = 'started' and o.exp = n.exp and o.seq = n.seq and o.type = n.type and o.same = n.same where abs(o.near - n.near) <= 0.05 * abs(o.near)),
gr as (select exp, seq, type, same, cast(0 as bigint) as k, cast([] as varchar[]) as olds, cast([] as varchar[]) as news, cast(null as varchar) as old, cast(null as varchar) as new from cp group by exp, seq, type, same
union all select c.exp, c.seq, c.type, c.same, c.k, case when free then list_append(olds, c.old) else olds end, case when free then list_append(news, c.new) else news end, case when free then c.old end, case when free then c.new end
from (select c.*, g.olds, g.news, not list_contains(g.olds, c.old) and not list_contains(g.news, c.new) as free from gr g join cp c on g.exp = c.exp and g.seq = c.seq and g.type = c.type and g.same = c.same and c.k = g.k + 1) c),
tk as (select *, row_number() over (partition by exp, seq, type, same, side order by list_extract(string_split(field, '/'), -1), field) as k from gb where near is null),
rn as (select exp, seq, old, new from eq union all select exp, seq, old, new from gr where old is not null union all
select o.exp, o.seq, o.field, n.field from tk o join tk n on o.side = 'ended' and n.side = 'started' and o.exp = n.exp and o.seq = n.seq and o.type = n.type and o.same = n.same and o.k = n.k),
ch as (select exp, seq, case when side = 'started' then 'added' else 'removed' end as change, field as path, '' as new_path from sd where not exists (select 1 from rn where rn.exp = sd.exp and rn.seq = sd.seq and ((side = 'ended' and rn.old = field) or (side = 'started' and rn.new = field)))
union all select exp, seq, 'renamed', old, new from rn union all select exp, seq, 'type_changed', field, '' from ct where type is not null and before.type <> type)
select fo.file, change, path, new_path from ch join fo using (exp, seq)"""
