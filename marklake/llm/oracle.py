"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_STEPS = """t as (select sess, pos, step_id, tool, coalesce(arg, '(none)') as arg from tri where tool is not null and sess is not null and pos is not null group by all)"""

P2 = f"""with {_STEPS}, n as (select sess, row_number() over (partition by sess order by pos, step_id) as n, tool || ':' || arg as i from t), need as (select greatest(4, ceil(count(distinct sess) / 40.0)) as need from t),
f as (select i from n group by i having count(distinct sess) >= (select need from need)), k as (select sess, n, i from n where i in (select i from f)),
p2 as (select a.sess, a.i || ' > ' || b.i as p, [a.i, b.i] as m, b.n from k a join k b on a.sess = b.sess and b.n between a.n + 1 and a.n + 4 and a.i <> b.i group by all),
f2 as (select p from p2 group by p having count(distinct sess) >= (select need from need)),
p3 as (select a.sess, a.p || ' > ' || b.i as p, a.m || [b.i] as m, b.n from p2 a join k b on a.sess = b.sess and b.n between a.n + 1 and a.n + 4 and not list_contains(a.m, b.i) where a.p in (select p from f2) group by all),
f3 as (select p from p3 group by p having count(distinct sess) >= (select need from need)),
p4 as (select a.sess, a.p || ' > ' || b.i as p from p3 a join k b on a.sess = b.sess and b.n between a.n + 1 and a.n + 4 and not list_contains(a.m, b.i) where a.p in (select p from f3) group by all),
f4 as (select p from p4 group by p having count(distinct sess) >= (select need from need)) select p as pattern from f2 union all select p from f3 union all select p from f4"""

_MARK = r"(?:\s*(?:#\s*\d+|[(\[{]\s*(?:retry|attempt|try|again|take)[\s:#=_-]*\d*\s*[)\]}]))+$"
_TARGET = f"""regexp_replace(regexp_replace(regexp_replace(trim(lower(arg)), '{_MARK}', ''), '^"(.*)"$', '\\1'), '^(?:\\./)+', '')"""

P4 = f"""with {_STEPS}, c as (select sess, pos, step_id, lower(trim(tool)) as tool, coalesce(nullif({_TARGET}, ''), '(none)') as target from t),
g as (select *, case when lag(tool || chr(1) || target) over w = tool || chr(1) || target then 0 else 1 end as new from c window w as (partition by sess order by pos, step_id)),
r as (select *, sum(new) over (partition by sess order by pos, step_id rows unbounded preceding) as run from g) select sess, min(pos) as first_pos, max(pos) as last_pos from r group by sess, run having count(*) >= 2"""

P3 = """with v as (select distinct on (event_id) event_id as id, list_transform(x, lambda e: cast(e as double)) as x from loop_event where event_id is not null and len(x) = 64),
u as (select id, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) as x from v where not list_contains(list_transform(x, lambda e: isnan(e)), true) and list_inner_product(x, x) > 0),
l as (select distinct on (mark_id) mark_id as id, lattice from vm_lattice where mark_id is not null and len(lattice) = 128 and list_min(lattice) >= 0 and list_max(lattice) < 16),
m as (select id, list_transform(lattice, lambda e: cos(e * pi() / 8)) || list_transform(lattice, lambda e: sin(e * pi() / 8)) as x from l),
s as (select 'loop_event' as coll, a.id as a, b.id as b, list_inner_product(a.x, b.x) as s from u a join u b on a.id <> b.id union all select 'vm_lattice', a.id, b.id, list_inner_product(a.x, b.x) from m a join m b on a.id <> b.id),
r as (select coll, a, b, row_number() over (partition by coll, a order by s desc, b) as r from s) select distinct coll, least(a, b) as id_a, greatest(a, b) as id_b from r where r <= 5"""

P8 = r"""with d as (select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+', 0) as w from documents where text is not null), e as (select item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+', 0) as w from eval_item),
dg as (select distinct doc_id, array_to_string(w[k:k+9], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 8)) as k from d where len(w) >= 10)), eg as (select distinct item_id, array_to_string(w[k:k+9], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 8)) as k from e where len(w) >= 10))
select distinct doc_id, item_id from dg join eg using (g)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p3_found": P3, "p4_found": P4, "p8_found": P8}
