"""More queries for the engine's own operators: joins, logic, texts, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marklake.functions import phases as P
from marklake.functions import text as X
from marklake.operators import decode, folds, logic, neural, similarity, triples
from marklake.operators.shifts import shifts
from marklake.plans.reference import _C8, _PAIRS, _Q, _S8, PERFECT, _quantized, _searched, query
from marklake.sources.shared import table
from marklake.streaming.loop import sessions, windows

# Triples: supplier, return flag, part

_T = "t as (select l_suppkey as s, l_returnflag as r, l_partkey as o, l_orderkey from lineitem)"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("r"), F.col("l_partkey").alias("o"), "l_orderkey")


@query(f"""with {_T}, q as (select distinct s, r, o from t where l_orderkey % 100 = 0), f as (select distinct s, r, o from t)
select q.s, q.r, q.o, coalesce(a.n, 0) as n_s, coalesce(b.n, 0) as n_r, coalesce(c.n, 0) as n_o from q left join (select r, o, count(*) as n from f group by r, o) a on a.r = q.r and a.o = q.o
left join (select s, o, count(*) as n from f group by s, o) b on b.s = q.s and b.o = q.o left join (select s, r, count(*) as n from f group by s, r) c on c.s = q.s and c.r = q.r""")
def triple_lookups(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    return triples.answer_counts(facts, facts.where("l_orderkey % 100 = 0").select("s", "r", "o").distinct()).select("s", "r", "o", "n_s", "n_r", "n_o")


@query(f"""with {_T}, q as (select distinct s, r from t where l_orderkey % 100 = 0), a as (select q.s, q.r, t.o, count(*) as n from q join t on t.s = q.s and t.r = q.r group by all)
select s, r, count(*) as answers, cast(sum(n) as bigint) as facts, cast(sum(case when exists (select 1 from t where t.s = a.s and t.o = a.o and t.r = a.r) then 1 else 0 end) as bigint) as confirmed from a group by s, r""")
def triple_confirmed(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    answers = triples.completed(facts, facts.where("l_orderkey % 100 = 0"), "o")
    ok = triples.confirmed(answers, facts).groupBy("s", "r").agg(F.count(F.lit(1)).alias("confirmed"))
    return answers.groupBy("s", "r").agg(F.count(F.lit(1)).alias("answers"), F.sum("n").alias("facts")).join(ok, ["s", "r"], "left").fillna(0, ["confirmed"])


@query(f"""with {_T}, c as (select s, o, count(distinct r) as v, count(*) as n from t group by s, o) select cast(case when v > 1 then -1 when n >= 2 then 1 else 0 end as bigint) as verdict, count(*) as pairs, cast(sum(n) as bigint) as facts from c group by 1""")
def triage(spark: SparkSession, d: str) -> DataFrame:
    return triples.triage(_facts(spark, d), ["s", "o"], "r").groupBy("verdict").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("facts"))


@query("""select r_name as start, l_suppkey as supplier, count(*) as n from (select distinct r_name, n_nationkey, l_suppkey from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey) group by all""")
def hop_nations(spark: SparkSession, d: str) -> DataFrame:
    """Which suppliers a region's nations order from over four hops, and how many of its nations do."""
    t = lambda n: table(spark, d, n)
    starts = t("nation").select(F.col("n_nationkey").cast("string").alias("node"))
    nation_customer = t("customer").select(F.col("c_nationkey").cast("string").alias("src"), F.col("c_custkey").cast("string").alias("dst"))
    customer_order = t("orders").select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"))
    order_supplier = t("lineitem").select(F.col("l_orderkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"))
    reached = triples.hops(starts, [nation_customer, customer_order, order_supplier])
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("start"), "r_name")
    return reached.join(nations, "start").groupBy(F.col("r_name").alias("start"), F.col("node").cast("long").alias("supplier")).agg(F.count(F.lit(1)).alias("n"))


_EDGES = "e as (select n_nationkey as src, (n_nationkey * 3 + 1) % 25 as dst from nation union select n_nationkey, (n_nationkey + 5) % 25 from nation where n_nationkey % 2 = 0)"


@query(f"""with recursive {_EDGES}, c as (select cast(src as bigint) as src, cast(dst as bigint) as dst, cast(1 as bigint) as hops from e union select c.src, cast(e.dst as bigint), c.hops + 1 from c join e on e.src = c.dst where c.hops < 30) select src, dst, min(hops) as hops from c group by src, dst""")
def closure(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = n.select(F.col("k").alias("src"), ((F.col("k") * 3 + 1) % 25).alias("dst")).unionAll(n.where("k % 2 = 0").select("k", (F.col("k") + 5) % 25))
    return triples.closure(edges)


@query("""with q as (select item_id as qid, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}', 0)))[1:3] as terms from eval_item), w as (select qid, len(terms) as need, unnest(terms) as term from q where len(terms) > 0),
p as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}', 0))) as term from documents where text is not null)
select qid, doc_id as doc from w join p using (term) group by qid, need, doc_id having count(distinct term) = need""")
def documents_with_all_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = F.slice(F.array_sort(F.array_distinct(X.tokens(F.col("text")))), 1, 3)
    return triples.all_terms(table(spark, d, "documents"), "doc_id", F.col("text"), table(spark, d, "eval_item").select(F.col("item_id").alias("qid"), terms.alias("terms")))


_SURFACE = "case cast(p_partkey / 100 as bigint) % 3 when 0 then p_name when 1 then array_to_string(list_reverse(string_split(p_name, ' ')), '  ') else substr(p_name, 2) || 'x' end"
_GRAMS = """g as (select k, kind, unnest(list_distinct(list_transform(range(1, len(f) - 1), lambda i: substr(f, i, 3)))) as gram, f from (select k, kind, '#' || lower(n) || '#' as f from names)),
z as (select k, kind, count(*) as n from g group by k, kind)"""


@query(f"""with q as (select p_partkey as qid, {_SURFACE} as surface from part where p_partkey % 100 = 0), d as (select distinct p_name as name from part where p_name is not null),
names as (select cast(qid as varchar) as k, 'q' as kind, surface as n from q union all select name, 'n', name from d), {_GRAMS},
j as (select a.k as qid, b.k as name, count(*) as shared from g a join g b on a.gram = b.gram and a.kind = 'q' and b.kind = 'n' group by all),
s as (select j.qid, j.name, shared::double / (x.n + y.n - shared) as sim from j join z x on x.k = j.qid and x.kind = 'q' join z y on y.k = j.name and y.kind = 'n'), f as (select qid, name, sim, row_number() over (partition by qid order by sim desc, name) as r from s),
b as (select q.qid, 1 as p, d.name, 'exact' as route from q join d on d.name = q.surface union all
select q.qid, 2, min(d.name), 'words' from q join d on array_to_string(list_sort(regexp_extract_all(lower(q.surface), '[a-z0-9]{{2,}}', 0)), ' ') = array_to_string(list_sort(regexp_extract_all(lower(d.name), '[a-z0-9]{{2,}}', 0)), ' ') group by q.qid
union all select cast(qid as bigint), 3, name, 'spelling' from f where r = 1 and sim >= 0.3), o as (select *, row_number() over (partition by qid order by p) as rn from b) select qid, name, route from o where rn = 1""")
def routed_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    kind = F.floor(F.round(F.col("p_partkey") / 100, 0)).cast("long") % 3
    surface = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.array_join(F.reverse(F.split("p_name", " ")), "  ")).otherwise(F.concat(F.substring("p_name", 2, 1000), F.lit("x")))
    return triples.routed(part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), surface.alias("surface")), part.select(F.col("p_name").alias("name")))


@query(f"""with q as (select p_partkey as qid, substr(p_name, 2) || 'x' as surface from part where p_partkey % 100 = 0), d as (select distinct p_name as name from part where p_name is not null),
names as (select cast(qid as varchar) as k, 'q' as kind, surface as n from q union all select name, 'n', name from d), {_GRAMS},
j as (select a.k as qid, b.k as name, count(*) as shared from g a join g b on a.gram = b.gram and a.kind = 'q' and b.kind = 'n' group by all),
s as (select j.qid, j.name, shared::double / (x.n + y.n - shared) as sim from j join z x on x.k = j.qid and x.kind = 'q' join z y on y.k = j.name and y.kind = 'n'), f as (select *, row_number() over (partition by qid order by sim desc, name) as r from s),
t as (select qid, max(case when r = 1 then name end) as name, max(sim) as sim, max(case when r = 2 then sim end) as second from f where r <= 2 group by qid)
select cast(qid as bigint) as qid, name, round(sim, 6) as similarity, round(sim - coalesce(second, 0), 6) as lead from t where sim >= 0.4 and sim - coalesce(second, 0) >= 0.05""")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    queries = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.concat(F.substring("p_name", 2, 1000), F.lit("x")).alias("surface"))
    out = triples.resolved(queries, part.select(F.col("p_name").alias("name")).where("name is not null"), 0.4, 0.05)
    return out.select("qid", "name", F.round("similarity", 6).alias("similarity"), F.round("lead", 6).alias("lead"))


@query("""select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def membership(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return table(spark, d, "customer").select("c_custkey").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(orders.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


# Logic

_RULES = [logic.Rule(("ancestor", "X", "Y"), (("parent", "X", "Y"),)), logic.Rule(("ancestor", "X", "Z"), (("ancestor", "X", "Y"), ("parent", "Y", "Z")))]
_PARENTS = "p as (select 'world' as a, r_name as b from region union select r_name, n_name from region join nation on n_regionkey = r_regionkey union select n_name, s_name from nation join supplier on s_nationkey = n_nationkey)"
_ANCESTORS = f"with recursive {_PARENTS}, c as (select a, b, cast(1 as bigint) as depth from p union select c.a, p.b, c.depth + 1 from c join p on p.a = c.b)"


def _parents(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    regional = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = region.select(F.lit("world").alias("a"), F.col("r_name").alias("b")).unionAll(regional.select("r_name", "n_name")).unionAll(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name"))
    return pairs.select(F.lit("parent").alias("pred"), F.array("a", "b").alias("args"))


@query(f"{_ANCESTORS} select a, b, min(depth) as depth from c group by a, b")
def logic_ancestors(spark: SparkSession, d: str) -> DataFrame:
    beliefs, _ = logic.chained(_parents(spark, d), _RULES, justify=False)
    return beliefs.where("pred = 'ancestor'").select(F.col("args")[0].alias("a"), F.col("args")[1].alias("b"), "depth")


@query(f"""{_ANCESTORS}, k as (select a, b, cast(1 as bigint) as depth from p where not (a = 'world' and b = 'ASIA') union select k.a, p.b, k.depth + 1 from k join p on p.a = k.b where not (p.a = 'world' and p.b = 'ASIA'))
select 'ancestor' as pred, a, b from (select distinct a, b from c except select distinct a, b from k) union all select 'parent', 'world', 'ASIA' where exists (select 1 from p where a = 'world' and b = 'ASIA')""")
def logic_retracted(spark: SparkSession, d: str) -> DataFrame:
    gone = _parents(spark, d).where("args[0] = 'world' and args[1] = 'ASIA'")
    return logic.retracted(_parents(spark, d), _RULES, gone).select("pred", F.col("args")[0].alias("a"), F.col("args")[1].alias("b"))


@query(f"""{_ANCESTORS} select a, b, min(depth) as depth, true as holds from c group by a, b""")
def logic_proofs(spark: SparkSession, d: str) -> DataFrame:
    facts = _parents(spark, d)
    beliefs, uses = logic.chained(facts, _RULES)
    steps = logic.proofs(beliefs, uses)
    return steps.join(logic.sound(steps, facts, _RULES), ["pred", "args"]).select(F.col("args")[0].alias("a"), F.col("args")[1].alias("b"), "depth", "holds")


@query(f"""{_ANCESTORS} select n_name as goal, exists (select 1 from c where a = 'ASIA' and b = n_name) as proved from nation""")
def logic_goals(spark: SparkSession, d: str) -> DataFrame:
    goals = table(spark, d, "nation").select(F.lit("ancestor").alias("pred"), F.array(F.lit("ASIA"), "n_name").alias("args"))
    return logic.proved(goals, _parents(spark, d), _RULES).select(F.col("args")[1].alias("goal"), "proved")


@query("""select distinct cast(a.user_id as varchar) as who, a.event_type as what from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type where a.value >= 50 and b.value < 50""")
def logic_contradictions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    said = e.where("value >= 50").select(F.lit("strong").alias("pred"), F.array(F.col("user_id").cast("string"), "event_type").alias("args"))
    denied = e.where("value < 50").select(F.lit("not").alias("pred"), F.array(F.lit("strong"), F.col("user_id").cast("string"), F.col("event_type")).alias("args"))
    return logic.contradictions(said.unionAll(denied).distinct()).select(F.col("args")[0].alias("who"), F.col("args")[1].alias("what"))


# Texts

_WORDS = "[A-Za-z'']+"


@query(rf"""with d as (select doc_id, text, list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x) <> '') as lines from documents where text is not null),
p as (select *, array_to_string(list_filter(lines, lambda x: not regexp_matches(x, '^\s*(?:\||[-*]\s|\d+[.)]\s)')), ' ') as prose, regexp_extract_all(text, '{_WORDS}', 0) as words from d),
s as (select *, list_filter(string_split_regex(prose, '[.!?]\s+'), lambda x: regexp_matches(x, '[0-9A-Za-z_]')) as sents from p),
l as (select *, case when len(sents) > 0 then list_transform(sents, lambda x: len(regexp_extract_all(x, '{_WORDS}', 0))::double) else [0.0::double] end as n, greatest(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 1) as letters from s)
select doc_id, cast(len(words) as bigint) as words, cast(coalesce(list_sum(list_transform(words, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+', 0))))), 0) as bigint) as syllables,
round(length(regexp_replace(lower(text), '[^aeiouylmnrw]', '', 'g')) / letters::double, 6) as sonority, round(length(regexp_replace(lower(text), '[^ptkbdg]', '', 'g')) / letters::double, 6) as plosive from l""")
def text_style(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    s = X.style(F.col("text"))
    spoken = F.aggregate(X.words_of(F.col("text")), F.lit(0), lambda a, w: a + X.syllables(w))
    return docs.select("doc_id", F.size(X.words_of(F.col("text"))).cast("long").alias("words"), spoken.cast("long").alias("syllables"), F.round(s["sonority"], 6).alias("sonority"), F.round(s["plosive"], 6).alias("plosive"))


@query()
def text_rhythm(spark: SparkSession, d: str) -> DataFrame:
    """Sentence and list measures; their splitting by look-behind has no SQL form."""
    s = X.style(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[F.round(s[k], 6).alias(k) for k in ("sent_mean", "sent_cv", "para_cv", "list_density", "reading_ease")], F.array_join(X.structure(F.col("text")), ";").alias("structure"))


@query(r"""select event_id, regexp_replace(replace(replace('user=' || user_id || chr(9) || 'token=' || md5(cast(event_id as varchar)) || ' ' || event_type || ' ' || sha256(cast(event_id as varchar)) || ' ghs_' || md5(event_type), chr(9), ' '), chr(10), ' '),
'sk-[A-Za-z0-9_-]{16,}|AIza[0-9A-Za-z_-]{30,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:api[_-]?key|token|secret|password)\s*[:=]\s*\S+|[A-Za-z0-9+/=_-]{40,}', '[REDACTED]', 'g') as text from events""")
def redacted_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit("\ttoken="), F.md5(F.col("event_id").cast("string")), F.lit(" "), F.col("event_type"), F.lit(" "), F.sha2(F.col("event_id").cast("string"), 256), F.lit(" ghs_"), F.md5("event_type"))
    return table(spark, d, "events").select("event_id", X.redacted(label).alias("text"))


@query("""select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1""")
def json_members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""select unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}', 0)) as token, count(*) as n from documents where text is not null group by 1""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# Neural

@query(f"""with w as (select vec_id, label, embedding, list_sum(list_transform(embedding, lambda x: abs(cast(x as double)))) * 0.7::double / 64 as cut from embeddings)
select vec_id, cast(list_sum(list_transform(embedding, lambda x: case when cast(x as double) > cut then 1 else 0 end)) as bigint) as plus, cast(list_sum(list_transform(embedding, lambda x: case when cast(x as double) < -cut then 1 else 0 end)) as bigint) as minus from w""")
def ternary_layer(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select("vec_id", neural.ternary_weights(F.col("embedding")).alias("w"))
    count = lambda v: F.size(F.filter("w", lambda x: x == v)).cast("long")
    return t.select("vec_id", count(1).alias("plus"), count(-1).alias("minus"))


@query(f"""with {_PAIRS}, z as (select qid, id, score / 8000.0::double as z from s where id < 8), e as (select qid, id, exp(z - max(z) over (partition by qid)) as e from z), w as (select qid, id, e / sum(e) over (partition by qid) as weight from e)
select w.qid, cast(k - 1 as bigint) as place, round(sum(weight * q.q[k]), 4) as value from (select *, unnest(range(1, 65)) as k from w where weight > 0.01) w join q on q.vec_id = w.id group by all""")
def slot_attention(spark: SparkSession, d: str) -> DataFrame:
    """Attention over the eight working slots (ids 0..7, the feature's fixed number of slots)."""
    marks, queries = _searched(spark, d)
    held = marks.where("id < 8")
    out = neural.attended(similarity.scan(held, queries), held.select("id", F.col("mark").alias("vector")), 8000.0)
    return out.select("qid", F.col("place").cast("long").alias("place"), F.round("value", 4).alias("value"))


# Slots

@query("""with m as (select distinct o_custkey as slot, o_orderkey % 1365 as x from orders), n as (select slot, count(*) as n from m group by slot) select slot, n as members, n as found, n as "right" from n""")
def slots_read(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in one slot, read back against the whole lattice: members, found, wrongly found."""
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("slot"), (F.col("o_orderkey") % decode.STATES).alias("x")).distinct()
    known = members.groupBy("slot").agg(F.count(F.lit(1)).alias("members"), F.collect_list("x").alias("xs"))  # 1,365 numbers at most
    found = decode.read(decode.slots(members, "slot", "x")).select("slot", F.col("members.x").alias("read"))
    read = known.join(found, "slot", "left").withColumn("read", F.coalesce("read", F.array().cast("array<bigint>")))
    return read.select("slot", "members", F.size("read").cast("long").alias("found"), F.size(F.array_intersect("read", "xs")).cast("long").alias("right"))


@query("""with m as (select distinct o_custkey as slot, o_orderkey % 1365 as x from orders), n as (select slot, count(*) as n from m group by slot) select case when n = 1 then 'SIEVE' else 'SCAN' end as rung, count(*) as slots, cast(sum(n) as bigint) as members from n group by 1""")
def slots_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Which reader of the ladder answers, by the number of members."""
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("slot"), (F.col("o_orderkey") % decode.STATES).alias("x")).distinct()
    return decode.read(decode.slots(members, "slot", "x"), "ladder").groupBy("rung").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.size("members")).alias("members"))


# Windows and time

@query("""select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all""")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows(table(spark, d, "events"), "ts", ["event_type"], "1 day").select("start", "event_type", "n")


@query("""select s as start, event_type, count(*) as n from (select event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as s from events) group by all""")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows(table(spark, d, "events"), "ts", ["event_type"], "2 hours", "1 hour").select("start", "event_type", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), i as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from g) select user_id, min(ts) as start, count(*) as n from i group by user_id, i""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes").select("user_id", "start", "n")


@query("""with recursive t as (select host, ts, reading_id, singles_waiting as s, singles_waiting + batch_waiting as b, load from (select *, row_number() over (partition by host, ts, reading_id order by arrived_at) as r from telemetry) where r = 1 and host is not null and ts is not null),
n as (select *, row_number() over w - 1 as n, coalesce(lag(b) over w, case when row_number() over w = 1 then 0 end) as b0 from t window w as (partition by host order by ts, reading_id)),
q as (select host, n, coalesce(b > b0, false) as g, coalesce(load >= 0.92 and b > 0, false) as l, coalesce(b = 0 and load < 0.5, false) as c, coalesce(s > 0, false) as w from n),
r as (select host, cast(-1 as bigint) as n, 1 as gear, 0 as grown, 0 as quiet, 1 as was from q group by host
union all select host, n, case when batch then gear - 1 when up and not stay then gear + 1 when down then gear - 1 else gear end, case when batch or (up and not stay) then 0 else grown end, case when batch or down then 0 else quiet end, gear
from (select *, not batch and (grown >= 2 or l) and gear < 3 as up, gear = 2 and w as stay, not batch and not ((grown >= 2 or l) and gear < 3) and quiet >= 4 and gear > 1 as down
from (select q.host, q.n, r.gear, r.gear = 3 and q.w as batch, q.l, q.w, case when q.g then least(r.grown + 1, 2) else 0 end as grown, case when q.c then least(r.quiet + 1, 4) else 0 end as quiet from r join q on q.host = r.host and q.n = r.n + 1)))
select host as key, cast(n as bigint) as n, cast(was as integer) as gear, cast(gear - was as bigint) as shift from r where n >= 0 and gear <> was""")
def gear_shifts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").where("host is not null and ts is not null")
    once = t.groupBy("host", "ts", "reading_id").agg(F.min_by(F.struct("singles_waiting", "batch_waiting", "load"), "arrived_at").alias("v")).select("host", "ts", "reading_id", "v.*")
    cut = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_800_000_000)
    return shifts(once, "host", cut, ["ts", "reading_id"], F.col("singles_waiting") + F.col("batch_waiting"), F.col("load"), waiting=F.col("singles_waiting"))


@query("""select e.event_id, o.o_orderkey as last_order from events e asof left join (select o_orderkey, o_custkey, o_orderdate from (select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) as r from orders) where r = 1) o on o.o_custkey = e.user_id and e.ts >= o.o_orderdate""")
def as_of_order(spark: SparkSession, d: str) -> DataFrame:
    """The latest order of the user before each event: both sides in one order, the last order carried forward within months and from month to month."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), "ts", "event_id", F.lit(None).cast("long").alias("order"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("order"))
    order = ["ts", F.coalesce("event_id", F.lit(-1)), F.coalesce("order", F.lit(-1))]  # at one time, orders come before events
    out = folds.carried(o.unionByName(e), "k", F.date_trunc("month", F.col("ts")), order, "order", "last_order")
    return out.where("event_id is not null").select("event_id", "last_order")


# Sets and groupings of the host engine, within reach of all operators

@query("""select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)""")
def cube_flags(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query("""select c_custkey as k from customer intersect select o_custkey from orders except select s_suppkey from supplier""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, o, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select("o_custkey"), table(spark, d, "supplier").select("s_suppkey")
    return c.intersect(o).subtract(s)


@query("""select o_custkey, o_orderkey, cast(ntile(4) over w as bigint) as quarter, round(cume_dist() over w, 6) as share, round(sum(o_totalprice) over (w rows between 2 preceding and current row), 2) as last_three from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.cume_dist().over(w), 6).alias("share"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"))
