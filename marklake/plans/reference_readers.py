"""Queries for readers of slots, clamping, names, nests, first-in first-out stores and gaps with reasons, beside their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import phases as P
from marklake.operators import decode, memory, readers, triples
from marklake.plans.reference import query
from marklake.sources.shared import table
from marklake.streaming.loop import newest


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("slot"), (F.col("n_nationkey") * 53).cast("long").alias("x"))


def _read(spark: SparkSession, d: str, reader: str) -> DataFrame:
    found = decode.read(decode.slots(_nations(spark, d), "slot", "x"), reader)
    return found.select("slot", F.explode("members").alias("m")).select("slot", F.col("m.x").alias("x"))


_MEMBERS = "select distinct cast(n_regionkey as bigint) as slot, cast(n_nationkey * 53 as bigint) as x from nation"


@query(_MEMBERS)
def region_slots_joint(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region, added up in a slot and read back by joint search."""
    return _read(spark, d, "joint")


@query(_MEMBERS)
def region_slots_auto(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "auto")


@query("select distinct cast(n_regionkey as bigint) as slot, 1.0 as \"right\" from nation")
def region_slots_refined(spark: SparkSession, d: str) -> DataFrame:
    members = _nations(spark, d)
    return readers.refined(decode.slots(members, "slot", "x"), members, "slot", "x").select("slot", "right")


@query("select c_custkey, 'CLAMPED' as status, c_custkey % 1365 as x from customer")
def clamped_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as direct marks with every fourth place a step off, pulled back."""
    numbers = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % decode.STATES).alias("x"))
    known = [(x, m.tolist()) for x, m in enumerate(readers.direct(np.arange(decode.STATES)))]  # the codebook: 1,365 rows
    book = spark.createDataFrame(known, "x long, mark array<int>")
    marks = numbers.join(F.broadcast(book), "x").select("c_custkey", F.transform("mark", lambda p, k: F.pmod(p + F.when(k % 4 == 1, 1).otherwise(0), F.lit(16))).alias("mark"))
    return readers.clamped(marks, "c_custkey", "mark").select("c_custkey", "status", "x")


@query("select c.c_custkey as qid, c.c_nationkey as polygon, c.c_mktsegment as o from customer c join nation n on n.n_nationkey = c.c_nationkey")
def nested_segments(spark: SparkSession, d: str) -> DataFrame:
    """A customer's segment by way of region and nation."""
    groups = table(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("pos"), F.col("n_nationkey").alias("polygon"))
    customers = table(spark, d, "customer")
    facts = customers.select(F.col("c_nationkey").alias("polygon"), F.col("c_custkey").alias("s"), F.lit("segment").alias("r"), F.col("c_mktsegment").alias("o"))
    queries = customers.join(groups, F.col("c_nationkey") == F.col("polygon")).select(F.col("c_custkey").alias("qid"), "grp", "pos", F.col("c_custkey").alias("s"), F.lit("segment").alias("r"))
    return triples.nested_facts(groups, facts, queries)


@query("select event_type as symbol, arg_max(user_id % 1365, (ts, event_id)) as x from events group by 1")
def symbol_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The last number that each kind of event was registered with."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 1365).alias("x"), "ts", "event_id")
    return triples.registered(rows, ["ts", "event_id"], 1365)[0]


@query("select event_id from events order by ts desc, event_id desc limit 100")
def newest_events(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "events"), [F.col("ts"), F.col("event_id")], 100).select("event_id")


@query("""with r as (select event_type as head, event_id, value / 100.0 < 0.2 as a from events), g as (select head, count(*) as n, round(avg(a::int), 6) as abstain_rate from r group by 1 having count(*) >= 20 and avg(a::int) >= 0.15),
e as (select head, cast(event_id as varchar) as item, row_number() over (partition by head order by cast(event_id as varchar)) as k from r where a)
select g.head, n, abstain_rate, (select array_to_string(list(item order by item), ',') from e where e.head = g.head and k <= 10) as examples from g""")
def gap_examples(spark: SparkSession, d: str) -> DataFrame:
    out = memory.gaps(table(spark, d, "events"), "event_type", F.col("value") / 100.0, F.lit(0.0), gate=0.15, item=F.col("event_id"))
    return out.select("head", "n", F.round("abstain_rate", 6).alias("abstain_rate"), F.array_join("examples", ",").alias("examples"))


@query("with z as (select n_nationkey as id, n_regionkey as r from nation) select round(sqrt(2 - 2 * max(c)), 9) as separation from (select a.id, b.id, (select avg(cos((a.id * (w.w % 25 + 1) - b.id * (w.w % 25 + 1)) * pi() / 8)) from range(64) w(w)) as c from z a join z b on a.id < b.id)")
def nation_separation(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "nation").select(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.pmod(F.col("n_nationkey") * (w % 25 + 1), F.lit(16))).alias("m"))
    return P.min_separation(marks, "m").select(F.round("separation", 9).alias("separation"))
