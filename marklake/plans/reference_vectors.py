"""Queries for codes, groups, frames, slopes and prosody, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import phases as P
from marklake.functions import residue as R
from marklake.functions import text as X
from marklake.functions.groups import multiplied, products
from marklake.operators import decode, folds, frames, similarity
from marklake.plans.reference import _P, _PAIRS, _TRITS, _hour, _marks, _quantized, _searched, joined, query
from marklake.sources.shared import table

_TO_PHASE = [P.TRITS_TO_PHASE[a, b] for a in (-1, 0, 1) for b in (-1, 0, 1)]


@query(f"""with {_TRITS}, m as (select vec_id, list_transform(range(0, 32), lambda k: ({_TO_PHASE})[3 * (t[2 * k + 1] + 1) + t[2 * k + 2] + 2]) as p from t)
select vec_id, array_to_string(p, ',') as mark, array_to_string(flatten(list_transform(p, lambda x: [({list(P.PHASE_TO_FIRST)})[x + 1], ({list(P.PHASE_TO_SECOND)})[x + 1]])), ',') as back from m""")
def transcoded_marks(spark: SparkSession, d: str) -> DataFrame:
    t = _quantized(spark, d).select("vec_id", P.phases_of_trits(P.trits(F.col("q"), F.lit(32))).alias("p"))
    return t.select("vec_id", joined(F.col("p")).alias("mark"), joined(P.trits_of_phases(F.col("p"))).alias("back"))


@query("""select l_orderkey, l_linenumber, cast((l_orderkey % 1365 + l_linenumber * 100) % 1365 as bigint) as x from lineitem""")
def advanced_states(spark: SparkSession, d: str) -> DataFrame:
    parts = R.advanced(R.residues(F.pmod(F.col("l_orderkey"), F.lit(1365)), R.RINGS), F.col("l_linenumber") * 100)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.solve_crt(parts, R.RINGS).alias("x"))


@query(f"""select user_id, cast(list_reduce([0] || list(cast(event_id % 24 as integer) order by ts, event_id), lambda a, x: ({[list(r) for r in products()]})[a + 1][x + 1]) as bigint) as element from events group by user_id""")
def group_paths(spark: SparkSession, d: str) -> DataFrame:
    """The product of each user's events as group elements, in order: folded within hours, then across them."""
    e = table(spark, d, "events")
    out = folds.folded(e, "user_id", _hour(), ["ts", "event_id"], (F.col("event_id") % 24).cast("int"), multiplied, F.lit(0))
    return out.select("user_id", F.col("folded").cast("long").alias("element"))


@query("""select o_orderkey as start, r_name as filler from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def frames_unfolded(spark: SparkSession, d: str) -> DataFrame:
    """Roles customer, nation, region followed from every order."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    key = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    edges = o.select(key("order", "o_orderkey").alias("frame"), F.lit("customer").alias("role"), key("customer", "o_custkey").alias("filler"))
    edges = edges.unionAll(c.select(key("customer", "c_custkey"), F.lit("nation"), key("nation", "c_nationkey")))
    edges = edges.unionAll(n.select(key("nation", "n_nationkey"), F.lit("region"), key("region", "n_regionkey")))
    edges = edges.unionAll(r.select(key("region", "r_regionkey"), F.lit("name"), F.col("r_name")))
    out = frames.unfolded(edges, o.select(key("order", "o_orderkey").alias("start")), ["customer", "nation", "region", "name"])
    return out.select(F.substring("start", 7, 30).cast("long").alias("start"), "filler")


@query("""select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000) and l_partkey in (select p_partkey from part where p_size < 10)""")
def star_pruned(spark: SparkSession, d: str) -> DataFrame:
    points = {"l_suppkey": table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")), "l_partkey": table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))}
    return frames.star(table(spark, d, "lineitem"), points, {"l_returnflag": "R"}).select("l_orderkey", "l_linenumber")


@query("""select l_suppkey, l_partkey, l_orderkey, l_linenumber from lineitem where (l_suppkey, l_partkey) in (select l_suppkey, l_partkey from lineitem where l_orderkey % 100 = 0)""")
def bucket_reads(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return frames.bucket_read(facts, ["l_suppkey", "l_partkey"], facts.where("l_orderkey % 100 = 0"), 64)


@query("""select cast(('0x' || substr(md5(cast(l_suppkey as varchar)), 1, 15))::bigint % 64 as bigint) as bucket, count(*) as members, count(distinct l_suppkey) as keys from lineitem group by 1""")
def bucket_members(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "lineitem").groupBy(frames.bucket(F.col("l_suppkey").cast("string"), 64).alias("bucket"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("bucket").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("keys"))


@query(f"""with {_PAIRS}, r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s), t as (select qid, max(case when rank = 1 then score end) as s1, max(case when rank = 2 then score end) as s2 from r group by qid)
select qid, round(case when s1 > 0 then greatest(0, least(1, cast(s1 - s2 as double) / s1)) else 0 end, 6) as confidence, round(case when s1 > 0 then 1 - cast(s2 as double) / s1 end, 6) as harmony from t""")
def gap_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Lead of the best score over the second, as a share of the best, clipped (confidence) and as it is (harmony)."""
    two = similarity.top_k(*_searched(spark, d), 2)
    t = two.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    share = (F.col("a") - F.col("b")).cast("double") / F.col("a")
    return t.select("qid", F.round(F.when(F.col("a") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0), 6).alias("confidence"), F.round(F.when(F.col("a") > 0, share), 6).alias("harmony"))


_ONCE = "o as (select distinct on (host, ts, reading_id) host, ts, reading_id, t, temp_c, single_p95_ms, served_single from telemetry where host is not null and ts is not null and temp_c is not null and not isnan(temp_c) and t is not null)"


@query(f"""with {_ONCE}, l as (select *, lag(temp_c) over w as before, greatest(t - lag(t) over w, 0.001) as dt from o window w as (partition by host order by ts, reading_id)),
e as (select host, ts, reading_id, least(1.0::double, dt / 30.0::double) as a, (temp_c - before) / dt as x from l where before is not null)
select host, round(list_reduce([[0.0::double, 0.0::double]] || list([a, x] order by ts, reading_id), lambda s, v: [0.0::double, s[2] + v[1] * (v[2] - s[2])])[2], 6) as slope from e group by host""")
def smoothed_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Exponentially smoothed heating of each host at its last reading. A step is an affine map, so steps compose; the reading before is found by its number."""
    t = table(spark, d, "telemetry").where("host is not null and ts is not null and temp_c is not null and not isnan(temp_c) and t is not null")
    once = t.dropDuplicates(["host", "ts", "reading_id"]).select("host", "ts", "reading_id", "t", "temp_c")
    cut = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_800_000_000)
    rows = folds.numbered(once, "host", cut, ["ts", "reading_id"])
    before = rows.select("host", (F.col("n") + 1).alias("n"), F.col("temp_c").alias("temp_0"), F.col("t").alias("t_0"))
    dt = F.greatest(F.col("t") - F.col("t_0"), F.lit(0.001))
    a = F.least(F.lit(1.0), dt / 30.0)
    step = F.struct((1 - a).alias("m"), (a * (F.col("temp_c") - F.col("temp_0")) / dt).alias("b"))
    merge = lambda f, g: F.struct((f["m"] * g["m"]).alias("m"), (f["b"] * g["m"] + g["b"]).alias("b"))
    out = folds.folded(rows.join(before, ["host", "n"]), "host", F.floor(F.col("n") / 1024), ["n"], step, merge, F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("b")))
    return out.select("host", F.round("folded.b", 6).alias("slope"))


@query(f"""with {_ONCE} select host, round(avg(-single_p95_ms / 50.0::double + ln(1 + served_single) / 5.0::double - greatest(0, temp_c - 70) / 5.0::double), 4) as reward from o where single_p95_ms between 0 and 3600000 group by host""")
def serving_rewards(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").where("host is not null and ts is not null and temp_c is not null and not isnan(temp_c) and t is not null").dropDuplicates(["host", "ts", "reading_id"]).where("single_p95_ms between 0 and 3600000")
    reward = -F.col("single_p95_ms") / 50.0 + F.log1p("served_single") / 5.0 - F.greatest(F.lit(0.0), F.col("temp_c") - 70) / 5.0
    return t.groupBy("host").agg(F.round(F.avg(reward), 4).alias("reward"))


@query()
def sensor_novelty(spark: SparkSession, d: str) -> DataFrame:
    """How new each hundredth reading is against all others, as phase vectors of its sensors."""
    t = table(spark, d, "telemetry").dropDuplicates(["reading_id"])
    marks = frames.sensor_marks(t, "reading_id", {"load": (0, 1), "temp_c": (20, 100), "ghz": (0.5, 5)}, 64).select(F.col("reading_id").alias("id"), "mark")
    best = similarity.scan(marks, marks.where("id % 100 = 0").withColumnRenamed("id", "qid"), k=1, view="phases").groupBy("qid").agg(F.max("score").alias("score"))
    return best.select("qid", F.round(1 - F.col("score") / (64 * 127.0 * 127.0), 6).alias("novelty"))


@query()
def document_search(spark: SparkSession, d: str) -> DataFrame:
    """The five documents most like each hundredth one, by bundles of words and pairs of words: 64 of 256 places prune, all rank."""
    docs = frames.text_marks(table(spark, d, "documents"), "doc_id", "text").where("mark is not null").select(F.col("doc_id").alias("id"), "mark")
    return similarity.cascade(docs, docs.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5, [(64, 64)], "phases")


@query("""with r as (select distinct tool, coalesce(arg, '(none)') as arg from tri where tool is not null), c as (select count(*) as n from r) select f.field, n as records, n as "right", cast(0 as bigint) as collisions from c, (values ('tool'), ('arg')) f(field)""")
def record_frames(spark: SparkSession, d: str) -> DataFrame:
    """Distinct steps (tool, arg) as frames of one vector and read back: records, right fields, colliding frames."""
    steps = table(spark, d, "tri").where("tool is not null").select("tool", F.coalesce("arg", F.lit("(none)")).alias("arg"))
    coded = frames.record_frames(steps, ["tool", "arg"])
    read = frames.read_frames(coded, ["tool", "arg"], {"tool": steps.select("tool"), "arg": steps.select("arg")})
    right = read.groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.sum((F.when(F.col("field") == "tool", F.col("tool")).otherwise(F.col("arg")) == F.col("read")).cast("long")).alias("right"))
    collisions = coded.groupBy("frame").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.sum("more").alias("collisions"))
    return right.join(F.broadcast(collisions))  # one row


@query()
def text_prosody(spark: SparkSession, d: str) -> DataFrame:
    p = X.prosody(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[F.round(p[k], 6).alias(k) for k in p])


@query()
def kept_drafts(spark: SparkSession, d: str) -> DataFrame:
    """How much of the first side of a pair the second one keeps."""
    docs = table(spark, d, "documents").where("text is not null and tgt_text is not null")
    return docs.select("doc_id", F.round(X.kept(F.col("text"), F.col("tgt_text")), 6).alias("kept"))
