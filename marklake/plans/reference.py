"""Queries for the engine's own operators over the driver's tables, each beside the SQL it is checked against.

Searches take as queries every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marklake.functions import phases as P
from marklake.functions import residue as R
from marklake.functions import text as X
from marklake.operators import decode, folds, logic, memory, neural, program, similarity, triples
from marklake.operators.shifts import shifts
from marklake.sources.store import latest
from marklake.sources.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


# Residues

_W5, _M5 = R.crt_weights((3, 5, 7, 13, 17))
_BACK = "(" + " + ".join(f"r{m} * {w}" for m, w in zip((3, 5, 7, 13, 17), _W5)) + f") % {_M5}"


@query(f"""with r as (select o_orderkey, {", ".join(f"(o_orderkey % 1365) % {m} as r{m}" for m in (3, 5, 7, 13, 17))} from orders)
select o_orderkey, {", ".join(f"cast(r{m} as bigint) as r{m}" for m in (3, 5, 7, 13, 17))}, cast({_BACK} as bigint) as x from r""")
def residue_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    parts = R.residues(F.pmod(F.col("o_orderkey"), F.lit(1365)))
    named = [p.cast("long").alias(f"r{m}") for p, m in zip(parts, (*R.RINGS, R.CHECK))]
    return table(spark, d, "orders").select("o_orderkey", *named, R.solve_crt(parts, (*R.RINGS, R.CHECK)).alias("x"))


@query(f"""with x as (select unnest(range(1365)) as x), m as (select * from (values {", ".join(f"({m}, {w})" for m, w in zip((3, 5, 7, 13, 17), _W5))}) t(m, w)),
c as (select x, m, w, unnest(range(1, m)) as err from x, m)
select cast(m as bigint) as ring, count(*) as cases, cast(sum(case when (x + (((x % m + err) % m) - x % m) * w % {_M5} + {_M5}) % {_M5} < 1365 then 1 else 0 end) as bigint) as missed from c group by m""")
def residue_corruptions(spark: SparkSession, d: str) -> DataFrame:
    """All 54,600 single wrong rings; the check ring misses none."""
    rings = (*R.RINGS, R.CHECK)
    x = spark.range(prod(R.RINGS)).select(F.col("id").alias("x"), F.explode(F.array(*[F.lit(m) for m in rings])).alias("ring"))
    cases = x.select("x", "ring", F.explode(F.sequence(F.lit(1), F.col("ring") - 1)).alias("err"))
    parts = [F.pmod(F.col("x") + F.when(F.col("ring") == m, F.col("err")).otherwise(0), F.lit(m)) for m in rings]
    missed = (R.checked(parts) == "VERIFIED").cast("long")
    return cases.groupBy(F.col("ring").cast("long").alias("ring")).agg(F.count(F.lit(1)).alias("cases"), F.sum(missed).alias("missed"))


@query(f"""with r as (select o_orderpriority, {", ".join(f"cast((o_orderkey % 1365 + case when o_custkey % 3 = 0 and o_orderkey % 5 = {k} then 1 + o_custkey % {m - 1} else 0 end) % {m} as bigint) as r{m}" for k, m in enumerate((3, 5, 7, 13, 17)))} from orders)
select o_orderpriority, case when {_BACK} < 1365 then 'VERIFIED' else 'REJECTED' end as status, count(*) as n from r group by all""")
def residue_status(spark: SparkSession, d: str) -> DataFrame:
    x, c = F.pmod(F.col("o_orderkey"), F.lit(1365)), F.col("o_custkey")
    parts = [F.pmod(x + F.when((c % 3 == 0) & (F.col("o_orderkey") % 5 == k), 1 + c % (m - 1)).otherwise(0), F.lit(m)) for k, m in enumerate((*R.RINGS, R.CHECK))]
    return table(spark, d, "orders").groupBy("o_orderpriority", R.checked(parts).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select c_custkey, cast(('0x' || substr(md5(c_name), 1, 15))::bigint % {R.ADDRESS_SPACE} as bigint) as address from customer""")
def residue_address(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", R.address(F.col("c_name")).alias("address"))


@query(f"""with a as (select ('0x' || substr(md5(c_name), 1, 15))::bigint % {R.ADDRESS_SPACE} as address, c_name from customer union all select ('0x' || substr(md5(p_name), 1, 15))::bigint % {R.ADDRESS_SPACE}, p_name from part)
select cast(names as bigint) as names, count(*) as addresses from (select address, count(distinct c_name) as names from a group by address) group by names""")
def address_collisions(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_name").alias("k")).unionAll(table(spark, d, "part").select("p_name"))
    return keys.groupBy(R.address(F.col("k")).alias("address")).agg(F.countDistinct("k").alias("names")).groupBy("names").agg(F.count(F.lit(1)).alias("addresses"))


@query("""select c_custkey, c_nationkey, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as bigint) as local_id from customer""")
def local_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.numbered(table(spark, d, "customer"), "c_nationkey", F.floor(F.col("c_custkey") / 4096), ["c_custkey"], "local_id")
    return rows.select("c_custkey", "c_nationkey", "local_id")


_BIG = (997, 1009, 1013)
_WB, _MB = R.crt_weights(_BIG)


@query("""select o_orderpriority, count(*) as found, round(sum(o_totalprice), 2) as total from orders group by o_orderpriority""")
def address_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each order is found again by the address that its residues decode to."""
    orders = table(spark, d, "orders")
    keys = orders.select(R.solve_crt(R.residues(F.col("o_orderkey"), _BIG), _BIG).alias("address"))
    return keys.join(orders, F.col("address") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("found"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double"), 2).alias("total"))


@query("""select user_id, arg_max(value, (ts, event_id)) as value from events group by user_id""")
def last_write(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"])


# Phases

_Q = """q as (select vec_id, label, list_transform(embedding, lambda x: cast(case when m > 0 then round_even(cast(x as double) * 127.0 / m, 0) else 0 end as integer)) as q
from (select *, list_max(list_transform(embedding, lambda x: abs(cast(x as double)))) as m from embeddings))"""
_SECTOR = "(case when re >= 0 and im >= 0 then t when im >= 0 then 8 - t when re < 0 then 8 + t else 16 - t end) % 16"
_P = f"""{_Q}, c as (select vec_id, label, unnest(range(32)) as k, q from q), e as (select vec_id, label, k, q[2 * k + 1] as re, q[2 * k + 2] as im from c),
s as (select vec_id, label, k, re, im, {" + ".join(f"(case when abs(im) * 65536 > abs(re) * {t} then 1 else 0 end)" for t in P.TANGENTS)} as t from e),
p as (select vec_id, any_value(label) as label, list({_SECTOR} order by k) as p from s group by vec_id)"""
_C8, _S8 = list(P.C8), list(P.S8)


def _quantized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", P.quantized(F.col("embedding")).alias("q"))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return _quantized(spark, d).select("vec_id", "label", P.paired_marks(F.col("q")).alias("p"))


@query(f"with {_Q} select vec_id, array_to_string(q, ',') as q from q")
def quantized_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _quantized(spark, d).select("vec_id", joined(F.col("q")).alias("q"))


@query(f"with {_P} select vec_id, array_to_string(p, ',') as mark from p")
def sector_marks(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d).select("vec_id", joined(F.col("p")).alias("mark"))


@query(f"""with {_P} select vec_id, array_to_string(list_transform(range(1, 33), lambda i: (p[i] + p[33 - i]) % 16), ',') as bound, array_to_string(p, ',') as back from p""")
def bound_marks(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    both = P.bound(p, F.reverse(p))
    return _marks(spark, d).select("vec_id", joined(both).alias("bound"), joined(P.unbound(both, F.reverse(p))).alias("back"))


@query(f"""with {_P} select vec_id, array_to_string(list_transform(p, lambda x: (cast(round_even(cast(x as double) * 1.5, 0) as integer) % 16)), ',') as powered, array_to_string(list_transform(p, lambda x: (x + 5) % 16), ',') as shifted from p""")
def powered_marks(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d).select("vec_id", joined(P.powered(F.col("p"), 1.5)).alias("powered"), joined(P.shifted(F.col("p"), 5)).alias("shifted"))


@query(f"""with {_P} select vec_id, array_to_string(list_transform(range(0, 16), lambda k: p[2 * k + 1] + 16 * p[2 * k + 2]), ',') as pairs, array_to_string(p, ',') as back,
array_to_string(list_transform(range(0, 32), lambda j: (p || p)[j + 1] + 16 * (p || p)[j + 33]), ',') as blocks from p""")
def packed_marks(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    pairs, twice = P.packed_pairs(p), F.concat(p, p)
    return _marks(spark, d).select("vec_id", joined(pairs).alias("pairs"), joined(P.unpacked_pairs(pairs)).alias("back"), joined(P.packed_blocks(twice)).alias("blocks"))


@query(f"""with {_P} select l.label, cast(sum(x.n) as bigint) as places, cast(sum(x.s) as bigint) as score from (select a.label, 1 as n, list_sum(list_transform(range(1, 33), lambda i: ({_C8})[(a.p[i] - b.p[i] + 16) % 16 + 1])) as s from p a join p b on b.vec_id = a.vec_id + 1) x join (select distinct label from p) l on l.label = x.label group by l.label""")
def neighbour_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each mark and the next one, added up per label."""
    m = _marks(spark, d)
    other = m.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("o"))
    return m.join(other, "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("places"), F.sum(P.similarity(F.col("p"), F.col("o")).cast("long")).alias("score"))


_TRITS = f"""{_Q}, t as (select vec_id, label, list_transform(q, lambda x: case when x >= 32 then 1 when x <= -32 then -1 else 0 end) as t from q),
w as (select vec_id, label, w, cast(list_sum(list_transform(range(0, 32), lambda i: case when t[32 * w + i + 1] <> 0 then 1::bigint << i else 0 end)) as bigint) as active,
cast(list_sum(list_transform(range(0, 32), lambda i: case when t[32 * w + i + 1] < 0 then 1::bigint << i else 0 end)) as bigint) as sign from (select vec_id, label, t, unnest(range(2)) as w from t))"""


@query(f"with {_TRITS} select vec_id, cast(w as bigint) as word, active, sign from w")
def ternary_planes(spark: SparkSession, d: str) -> DataFrame:
    t = _quantized(spark, d).select("vec_id", P.trits(F.col("q"), F.lit(32)).alias("t"))
    words = [F.struct(F.lit(w).cast("long").alias("word"), P.plane(F.col("t"), "active", 32 * w).alias("active"), P.plane(F.col("t"), "sign", 32 * w).alias("sign")) for w in (0, 1)]
    return t.select("vec_id", F.inline(F.array(*words)))


@query(f"""with {_TRITS}, s as (select a.vec_id as qid, b.vec_id as id, cast(sum(bit_count(a.active & b.active) - 2 * bit_count(a.active & b.active & xor(a.sign, b.sign))) as bigint) as score from w a join w b on a.w = b.w and a.vec_id % 100 = 0 and a.vec_id <> b.vec_id group by all),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, score, rank from r where rank <= 5""")
def ternary_nearest(spark: SparkSession, d: str) -> DataFrame:
    t = _quantized(spark, d).select(F.col("vec_id").alias("id"), P.trits(F.col("q"), F.lit(32)).alias("mark"))
    return similarity.top_k(t, t.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5, view="trits")


@query(f"""with {_TRITS}, s as (select a.vec_id as id, cast(sum(bit_count(a.active & b.active) - 2 * bit_count(a.active & b.active & xor(a.sign, b.sign))) as bigint) as dot from w a join w b on a.w = b.w and b.vec_id = a.vec_id + 1 group by a.vec_id) select id, dot from s""")
def ternary_dots(spark: SparkSession, d: str) -> DataFrame:
    """Popcount form: each vector with the next one."""
    t = ternary_planes(spark, d)
    nxt = t.select((F.col("vec_id") - 1).alias("vec_id"), "word", F.col("active").alias("a2"), F.col("sign").alias("s2"))
    return t.join(nxt, ["vec_id", "word"]).groupBy(F.col("vec_id").alias("id")).agg(F.sum(P.ternary_dot(F.col("sign"), F.col("active"), F.col("s2"), F.col("a2")).cast("long")).alias("dot"))


@query("""with a as (select k, w, (k * (w % 7 + 1) * 2) % 16 as simplex, (k * w) % 16 as polygon from (select unnest(range(8)) as k), (select unnest(range(14)) as w))
select cast(a.k as bigint) as i, cast(b.k as bigint) as j, round(avg(cos((a.simplex - b.simplex) * pi() / 8)), 6) as simplex, round(avg(cos((a.polygon - b.polygon) * pi() / 8)), 6) as polygon from a join a b on a.w = b.w and a.k < b.k group by all""")
def solid_gram(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of each two atoms of a simplex (8 atoms, always -1/7) and a polygon."""
    k = F.col("k")
    atoms = spark.range(8).select(F.col("id").alias("k")).select("k", P.simplex(k, 8, 14).alias("s"), P.polygon(k, 14).alias("p"))
    places = atoms.select("k", F.posexplode(F.arrays_zip("s", "p")).alias("w", "x")).select("k", "w", "x.s", "x.p")
    other = places.select(F.col("k").alias("j"), "w", F.col("s").alias("s2"), F.col("p").alias("p2"))
    cosine = lambda a, b: F.round(F.avg(F.cos((F.col(a) - F.col(b)) * F.lit(3.141592653589793 / 8))), 6)
    return places.join(other, "w").where("k < j").groupBy(F.col("k").alias("i"), "j").agg(cosine("s", "s2").alias("simplex"), cosine("p", "p2").alias("polygon"))


@query()
def encoded_marks(spark: SparkSession, d: str) -> DataFrame:
    marks = P.encoded_marks(table(spark, d, "embeddings"), "vec_id", "embedding")
    return marks.select("vec_id", F.size("mark").alias("places"), F.sha2(joined(F.col("mark")), 256).alias("digest"))


# Searches

_PAIRS = f"""{_Q}, s as (select a.vec_id as qid, b.vec_id as id, b.label, cast(list_inner_product(a.q::double[], b.q::double[]) as bigint) as score from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)"""
PERFECT = 64 * 32 * 32  # a typical vector's score with itself


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    marks = _quantized(spark, d).select(F.col("vec_id").alias("id"), F.col("q").alias("mark"), "label")
    return marks, marks.where("id % 100 = 0").select(F.col("id").alias("qid"), "mark")


@query(f"""with {_PAIRS}, r as (select *, rank() over (partition by qid order by score desc) as rk from s), v as (select qid, label, sum(greatest(score, 0)) as vote from r where rk <= 7 group by all),
o as (select *, row_number() over (partition by qid order by vote desc, label) as rn, lead(vote) over (partition by qid order by vote desc, label) as nx, sum(vote) over (partition by qid) as al from v)
select qid, label, cast(vote as bigint) as vote, round(case when al > 0 then cast(vote - coalesce(nx, 0) as double) / al else 0 end, 6) as lead from o where rn = 1""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Labels by the votes of the seven nearest marks, ties included."""
    marks, queries = _searched(spark, d)
    top = similarity.top_k(marks, queries, 7, ties=True)
    return similarity.voted(top, marks.select("id", "label")).withColumn("lead", F.round("lead", 6))


@query(f"with {_PAIRS}, r as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s) select * from r where rank <= 5")
def nearest_stable(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(*_searched(spark, d), 5)


@query(f"with {_PAIRS}, r as (select qid, id, score, rank() over (partition by qid order by score desc) as rank from s) select * from r where rank <= 7")
def nearest_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(*_searched(spark, d), 7, ties=True)


@query(f"""with {_Q}, c as (select a.vec_id as qid, b.vec_id as id, list_inner_product(a.q[1:16]::double[], b.q[1:16]::double[]) as coarse, cast(list_inner_product(a.q::double[], b.q::double[]) as bigint) as score from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
k as (select *, rank() over (partition by qid order by coarse desc) as rk from c), r as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from k where rk <= 64) select * from r where rank <= 5""")
def nearest_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen places prune to 64 survivors with ties, all places rank those."""
    return similarity.cascade(*_searched(spark, d), 5, [(16, 64)])


@query(f"""with {_Q}, c as (select a.vec_id as qid, b.vec_id as id, list_inner_product(a.q[1:8]::double[], b.q[1:8]::double[]) as c1, list_inner_product(a.q[1:24]::double[], b.q[1:24]::double[]) as c2, cast(list_inner_product(a.q::double[], b.q::double[]) as bigint) as score from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
k as (select *, rank() over (partition by qid order by c1 desc) as r1 from c), l as (select *, rank() over (partition by qid order by c2 desc) as r2 from k where r1 <= 128), r as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from l where r2 <= 32) select * from r where rank <= 5""")
def nearest_pyramid(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cascade(*_searched(spark, d), 5, [(8, 128), (24, 32)])


@query(f"with {_PAIRS}, z as (select *, 10.0::double * score / {PERFECT}.0::double as z from s), e as (select qid, id, exp(z - max(z) over (partition by qid)) as e from z) select qid, id, round(e / sum(e) over (partition by qid), 6) as weight from e")
def soft_weights(spark: SparkSession, d: str) -> DataFrame:
    return similarity.soft(similarity.scan(*_searched(spark, d)), 10.0, PERFECT).withColumn("weight", F.round("weight", 6))


@query(f"""with {_PAIRS}, r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s),
t as (select qid, max(case when rank = 1 then id end) as best, max(score) as score, max(case when rank = 2 then score end) as second, cast(sum(case when score >= 0.5 * {PERFECT} then 1 else 0 end) as bigint) as hits from r group by qid)
select qid, best, score, round((score - coalesce(second, 0)) / {PERFECT}.0::double, 6) as margin, hits, case when hits > 0 and (score - coalesce(second, 0)) / {PERFECT}.0::double >= 0.05 then best end as answer from t""")
def answers_or_abstains(spark: SparkSession, d: str) -> DataFrame:
    return similarity.answered(similarity.scan(*_searched(spark, d)), PERFECT, 0.5, 0.05).withColumn("margin", F.round("margin", 6))


@query(f"with {_PAIRS} select qid, round(1 - max(score) / {PERFECT}.0::double, 6) as novelty from s group by qid")
def novelty(spark: SparkSession, d: str) -> DataFrame:
    best = similarity.scan(*_searched(spark, d), k=1).groupBy("qid").agg(F.max("score").alias("score"))
    return best.select("qid", F.round(F.coalesce(1 - F.col("score") / F.lit(float(PERFECT)), F.lit(1.0)), 6).alias("novelty"))


@query(f"""with {_Q}, s as (select a.vec_id as qid, b.vec_id as id, cast(list_sum(list_transform(range(1, 65), lambda i: case when (a.q[i] < 0) <> (b.q[i] < 0) then 1 else 0 end)) as bigint) as differing from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by qid order by differing, id) as rank from s) select * from r where rank <= 5""")
def nearest_by_signs(spark: SparkSession, d: str) -> DataFrame:
    top = similarity.top_k(*_searched(spark, d), 5, view="bits")
    return top.select("qid", "id", ((F.lit(64) - F.col("score")) / 2).cast("long").alias("differing"), "rank")


@query(f"with {_PAIRS}, r as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s where label in (1, 3)) select * from r where rank <= 5")
def nearest_in_region(spark: SparkSession, d: str) -> DataFrame:
    marks, queries = _searched(spark, d)
    return similarity.top_k(marks.where("label in (1, 3)"), queries, 5)


_PHASE_SCORE = f"cast(list_sum(list_transform(range(1, 33), lambda i: ({_C8})[a.p[i] + 1] * ({_C8})[b.p[i] + 1] + ({_S8})[a.p[i] + 1] * ({_S8})[b.p[i] + 1])) as bigint)"


@query(f"""with {_P}, y as (select a.vec_id as qid, b.vec_id as id, {_PHASE_SCORE} as score from p a join p b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by qid order by score desc, id) as rank from y) select * from r where rank <= 5""")
def nearest_by_phases(spark: SparkSession, d: str) -> DataFrame:
    marks = _marks(spark, d).select(F.col("vec_id").alias("id"), F.col("p").alias("mark"))
    return similarity.top_k(marks, marks.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5, view="phases")


@query(f"""with {_P}, y as (select a.vec_id as qid, b.vec_id as id, {_PHASE_SCORE} as score from p a join p b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id where b.label = 1), r as (select *, row_number() over (partition by qid order by score desc, id) as rank from y) select * from r where rank <= 3""")
def program_focus_sift(spark: SparkSession, d: str) -> DataFrame:
    """The program LOAD 0, FOCUS 1, BIND 0, UNBIND 0, SIFT 3."""
    m = _marks(spark, d)
    marks = m.select(F.col("vec_id").alias("id"), F.col("p").alias("mark"))
    tables = program.Tables(marks, [marks.where("id % 100 = 0").withColumnRenamed("id", "qid")], m.select(F.col("vec_id").alias("id"), F.col("label").alias("region")), [F.array(*[F.lit(k % 16) for k in range(32)])])
    return program.compiled([("LOAD", 0), ("FOCUS", 1), ("BIND", 0), ("UNBIND", 0), ("SIFT", 3)], tables)


@query("""with n as (select o_orderkey, list_transform(range(0, 8), lambda k: cast((o_orderkey * 7 + o_custkey * (k + 1)) % 120 as integer)) as n from orders)
select o_orderkey, cast(list_sum(list_transform(range(0, 8), lambda k: (k + 1) * n[k + 1])) % 120 as bigint) as check_1, cast(list_sum(list_transform(range(0, 8), lambda k: ([3, 5, 7, 11, 13, 17, 19, 23])[k + 1] * n[k + 1])) % 103 as bigint) as check_2 from n""")
def program_checks(spark: SparkSession, d: str) -> DataFrame:
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.col("o_orderkey") * 7 + F.col("o_custkey") * (k + 1)) % 120).cast("int"))
    one, two = program.checksums(F.col("n"))
    return table(spark, d, "orders").select("o_orderkey", numbers.alias("n")).select("o_orderkey", one.cast("long").alias("check_1"), two.cast("long").alias("check_2"))


# Bundles, counters, memories

@query(f"""with {_P}, u as (select label, p[k] as x, k - 1 as k from (select label, p, unnest(range(1, 33)) as k from p))
select label, cast(k as bigint) as place, cast(sum(({_C8})[x + 1]) as bigint) as re, cast(sum(({_S8})[x + 1]) as bigint) as im from u group by all""")
def bundles(spark: SparkSession, d: str) -> DataFrame:
    out = folds.bundled(_marks(spark, d), "label", F.col("p"))
    return out.select("label", F.col("place").cast("long").alias("place"), "re", "im")


def _hour() -> Column:
    return F.date_trunc("hour", F.col("ts"))


@query("""select user_id, cast(list_reduce([0] || list(case when value >= 50 then 3 else -2 end order by ts, event_id), lambda a, x: greatest(-8, least(8, a + x))) as bigint) as value from events group by user_id""")
def saturating_counters(spark: SparkSession, d: str) -> DataFrame:
    return folds.saturating(table(spark, d, "events"), "user_id", _hour(), ["ts", "event_id"], F.when(F.col("value") >= 50, 3).otherwise(-2), 8)


@query("""with c as (select user_id, list_reduce([0] || list(case when value >= 50 then 3 else -2 end order by ts, event_id), lambda a, x: greatest(-8, least(8, a + x))) as v, count(*) as n from events group by user_id)
select user_id, cast(trunc(v * 0.5::double) as bigint) as decayed, cast(case when abs(v) >= 4 then sign(v) else 0 end as bigint) as trit, n from c where n >= 3""")
def counters_read(spark: SparkSession, d: str) -> DataFrame:
    """Counters after half has decayed, their trit, rehearsals; those rehearsed fewer than three times are pruned."""
    v = saturating_counters(spark, d).join(table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
    return v.where("n >= 3").select("user_id", folds.decay_counters(F.col("value"), 0.5).alias("decayed"), folds.read_counter(F.col("value"), 4).alias("trit"), "n")


@query("""with e as (select user_id, value, count(*) over (partition by user_id) - row_number() over (partition by user_id order by ts, event_id) as age from events) select user_id, round(sum(value * pow(0.9::double, age)), 4) as value from e group by user_id""")
def decayed_sums(spark: SparkSession, d: str) -> DataFrame:
    return folds.decayed(table(spark, d, "events"), "user_id", _hour(), ["ts", "event_id"], F.col("value"), 0.9).withColumn("value", F.round("value", 4))


@query("""select user_id, count(*) as n, cast(epoch(timestamp '2024-02-01' - max(ts)) as bigint) as age_s from events group by user_id""")
def rehearsals(spark: SparkSession, d: str) -> DataFrame:
    age = F.floor((F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.max(F.col("ts").cast("timestamp"))) + 500_000) / 1_000_000)
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), age.alias("age_s"))


@query("""with e as (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id desc) as r from events) select event_type, event_id, value from e where r <= 20""")
def strongest_marks(spark: SparkSession, d: str) -> DataFrame:
    return folds.strongest(table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "value", "event_id", 20)


@query("""with r as (select event_type as head, value / 100.0::double as m, cast(json_extract_string(props, '$.k') as double) / 100.0::double as v from events)
select head, count(*) as n, round(avg(case when coalesce(m, 1.0) < 0.2 then 1.0 else 0.0 end), 6) as abstain_rate, round(avg(case when coalesce(v, 0.0) >= 0.6 then 1.0 else 0.0 end), 6) as novel_rate from r group by head
having count(*) >= 20 and (avg(case when coalesce(m, 1.0) < 0.2 then 1.0 else 0.0 end) >= 0.3 or avg(case when coalesce(v, 0.0) >= 0.6 then 1.0 else 0.0 end) >= 0.3)""")
def gap_heads(spark: SparkSession, d: str) -> DataFrame:
    news = F.get_json_object("props", "$.k").cast("double") / 100.0
    out = memory.gaps(table(spark, d, "events"), "event_type", F.col("value") / 100.0, news)
    return out.select("head", "n", F.round("abstain_rate", 6).alias("abstain_rate"), F.round("novel_rate", 6).alias("novel_rate"))


@query("""with g as (select cast(unnest(range(21)) as double) * 5 as threshold), s as (select threshold, sum(case when (value >= threshold) = (event_type = 'purchase') then 1 else 0 end) as good from events, g group by threshold) select threshold, cast(good as bigint) as good from s order by good desc, threshold limit 1""")
def calibrated_threshold(spark: SparkSession, d: str) -> DataFrame:
    return memory.calibrated(table(spark, d, "events"), F.col("value"), F.col("event_type") == "purchase", [5.0 * k for k in range(21)])


@query("""with c as (select event_type as bucket, user_id % 3 as arm, 1 + sum(case when value >= 50 then 1.0 else 0.0 end) as alpha, 1 + sum(case when value >= 50 then 0.0 else 1.0 end) as beta from events group by all), m as (select *, alpha / (alpha + beta) as mean from c)
select bucket, arm, cast(alpha as double) as alpha, cast(beta as double) as beta, round(mean, 6) as mean, row_number() over (partition by bucket order by mean desc, arm) = 1 as best from m""")
def bandit_arms(spark: SparkSession, d: str) -> DataFrame:
    out = memory.bandit(table(spark, d, "events"), F.col("event_type"), F.col("user_id") % 3, F.when(F.col("value") >= 50, 1.0).otherwise(0.0))
    return out.withColumn("mean", F.round("mean", 6))


@query(f"""with {_PAIRS}, r as (select *, row_number() over (partition by qid order by score desc, id) as rk from s), v as (select qid, id % 4 as arm, cast(label % 2 as double) as reward, score / {PERFECT}.0::double as sim from r where rk <= 12 and score / {PERFECT}.0::double >= 0.2),
n as (select qid from v group by qid having count(*) >= 3), a as (select qid, arm, sum(sim * reward) / sum(sim) as value from v where qid in (select qid from n) group by all), o as (select *, row_number() over (partition by qid order by round(value, 9) desc, arm) as rn from a) select qid, arm, round(value, 6) as value from o where rn = 1""")
def outcome_memory(spark: SparkSession, d: str) -> DataFrame:
    marks, queries = _searched(spark, d)
    near = similarity.top_k(marks, queries, 12)
    outcomes = marks.select("id", (F.col("id") % 4).alias("arm"), (F.col("label") % 2).cast("double").alias("reward"))
    return memory.outcome(near, outcomes, PERFECT, 0.2).withColumn("value", F.round("value", 6))


@query("""select k - 1 as place, round(avg(cast(embedding[k] as double)), 6) as centre from (select embedding, unnest(range(1, 65)) as k from embeddings) group by k""")
def centre(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("place", "v"))
    return places.groupBy(F.col("place").cast("long").alias("place")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("centre"))


@query("""select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


@query("""select source, count(*) as texts, count(distinct sha256(text)) as different from documents where text is not null group by source""")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    each = docs.groupBy("source", F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("different"))


@query("""with t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}', 0))) as element from documents where text is not null), n as (select count(distinct doc_id) as total from documents where text is not null)
select element, count(distinct doc_id) as documents, round(count(distinct doc_id) / any_value(total)::double, 6) as share from t, n group by element having count(distinct doc_id) / any_value(total)::double >= 0.05""")
def template_elements(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return memory.template(docs, "doc_id", X.tokens(F.col("text")), 0.05).withColumn("share", F.round("share", 6))
