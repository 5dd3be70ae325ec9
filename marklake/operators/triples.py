"""Facts (s, r, o): lookups from any two corners, confirmation, triage, hops, closure, routed lookup.

Everything is an equi-join on the known corners; Catalyst picks the strategy. Pairs that many facts share are counted before the join, so a hot pair is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions.text import tokens, trigrams
from marklake.sources.shared import written

CORNERS = ("s", "r", "o")


def completed(facts: DataFrame, queries: DataFrame, missing: str) -> DataFrame:
    """(known corners, missing, n): the distinct values of the missing corner, with how many facts say so. queries hold the two others."""
    known = [c for c in CORNERS if c != missing]
    held = facts.groupBy(*CORNERS).agg(F.count(F.lit(1)).alias("n"))
    return queries.select(*known).distinct().join(held, known)


def answer_counts(facts: DataFrame, queries: DataFrame) -> DataFrame:
    """queries with the number of different answers for each corner left out: n_s, n_r, n_o. Counted per pair of corners first."""
    distinct = facts.select(*CORNERS).distinct()
    out = queries
    for missing in CORNERS:
        known = [c for c in CORNERS if c != missing]
        counts = distinct.groupBy(*known).agg(F.count(F.lit(1)).alias(f"n_{missing}"))
        out = out.join(counts, known, "left").fillna(0, [f"n_{missing}"])
    return out


def confirmed(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Those answers (s, r, o) that the second path, r from (s, o), gives as well."""
    return answers.join(facts.select(*CORNERS).distinct(), list(CORNERS), "left_semi")


def triage(facts: DataFrame, key: list[str], value: str, least: int = 2) -> DataFrame:
    """(key, verdict): -1 if facts contradict each other (several values), 1 if one value is said at least so often, else 0."""
    said = facts.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    both = said.groupBy(*key).agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
    return both.select(*key, F.when(F.col("values") > 1, -1).when(F.col("n") >= least, 1).otherwise(0).cast("long").alias("verdict"), "n")


def hops(starts: DataFrame, relations: list[DataFrame]) -> DataFrame:
    """(start, node): what is reached from each start over one relation (src, dst) after the other; repeats go after every hop."""
    out = starts.select(F.col("node").alias("start"), "node").distinct()
    for edges in relations:
        out = out.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node").select("start", F.col("dst").alias("node")).distinct()
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, hops): every pair with the least number of hops. Every round doubles the length of the paths: a pair more than h and at most 2h hops apart has, on a shortest way, a node exactly h hops from its begin; so the pairs found
    exactly h apart are joined with all pairs known, and the rounds are as many as the longest way has binary digits. Each pair is written once."""
    rows = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    found, half = written(rows.withColumn("hops", F.lit(1).cast("long")), "closure"), 1
    while True:
        frontier = found.where(F.col("hops") == half).select("src", F.col("dst").alias("mid"))
        step = frontier.join(found.select(F.col("src").alias("mid"), "dst", "hops"), "mid").groupBy("src", "dst").agg((F.min("hops") + half).alias("hops"))
        new = written(step.join(found, ["src", "dst"], "left_anti").select("src", "dst", "hops"), "closure")
        if new.isEmpty():
            return found
        found, half = found.unionByName(new), 2 * half


def all_terms(docs: DataFrame, doc: str, text: Column, queries: DataFrame) -> DataFrame:
    """(qid, doc): documents that have every term of a query. queries: (qid, terms). The postings meet only the terms asked for."""
    terms = queries.select("qid", F.array_distinct("terms").alias("terms")).where("size(terms) > 0")
    wanted = terms.select("qid", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    postings = docs.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(tokens(text))).alias("term")).where("doc is not null")
    hits = postings.join(wanted, "term").groupBy("qid", "need", "doc").agg(F.countDistinct("term").alias("have"))
    return hits.where(F.col("have") == F.col("need")).select("qid", "doc")


def resolved(queries: DataFrame, names: DataFrame, least: float, margin: float) -> DataFrame:
    """(qid, name, similarity, lead): the most similar name by shared character trigrams (Jaccard), none below `least` or with a lead under `margin`.

    queries: (qid, surface), names: (name). Candidates come from shared trigrams only, counted per pair.
    """
    grams = lambda df, key, text: df.select(key, F.array_distinct(trigrams(F.col(text))).alias("g")).select(key, F.size("g").alias(f"{key}_n"), F.explode("g").alias("gram"))
    q, n = grams(queries, "qid", "surface"), grams(names.distinct(), "name", "name")
    shared = q.join(n, "gram").groupBy("qid", "name", "qid_n", "name_n").agg(F.count(F.lit(1)).alias("both"))
    sims = shared.select("qid", "name", (F.col("both") / (F.col("qid_n") + F.col("name_n") - F.col("both"))).alias("similarity"))
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "name")
    two = sims.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("qid").agg(F.max(F.when(F.col("r") == 1, F.col("name"))).alias("name"), F.max("similarity").alias("similarity"), F.max(F.when(F.col("r") == 2, F.col("similarity"))).alias("second"))
    lead = F.col("similarity") - F.coalesce("second", F.lit(0.0))
    return two.select("qid", "name", "similarity", lead.alias("lead")).where((F.col("similarity") >= least) & (F.col("lead") >= margin))


def routed(queries: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """(qid, name, route): exact match, else all words in any order, else the most similar spelling; the first that answers. queries: (qid, surface)."""
    names = names.select("name").where("name is not null").distinct()
    bag = lambda c: F.array_join(F.array_sort(tokens(F.col(c))), " ")
    exact = queries.join(names.withColumn("surface", F.col("name")), "surface").select("qid", "name", F.lit(1).alias("p"), F.lit("exact").alias("route"))
    words = queries.withColumn("bag", bag("surface")).join(names.withColumn("bag", bag("name")), "bag").groupBy("qid").agg(F.min("name").alias("name")).select("qid", "name", F.lit(2).alias("p"), F.lit("words").alias("route"))
    near = resolved(queries, names, least, 0.0).select("qid", "name", F.lit(3).alias("p"), F.lit("spelling").alias("route"))
    every = exact.unionByName(words).unionByName(near)
    return every.groupBy("qid").agg(F.min(F.struct("p", "name", "route")).alias("b")).select("qid", "b.name", "b.route")


def nested_facts(groups: DataFrame, facts: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, polygon, o): a fact found by way of its group, in three lookups: the group's polygon at a position, the polygon's facts, the fact of a subject and relation. groups: (grp, pos, polygon), facts: (polygon, s, r, o), queries: (qid, grp, pos, s, r)."""
    return queries.join(groups, ["grp", "pos"]).join(facts, ["polygon", "s", "r"]).select("qid", "polygon", "o")


def registered(registrations: DataFrame, order: list[str], capacity: int) -> tuple[DataFrame, DataFrame]:
    """(symbol, x) and (x, symbol): both ways of naming numbers. A later registration overwrites the symbol's number and the number's symbol, each by itself; numbers outside 0..capacity-1 raise an error. registrations: (symbol, x)."""
    legal = F.col("x").isNotNull() & F.col("x").between(0, capacity - 1)
    rows = registrations.where("symbol is not null").withColumn("x", F.when(legal, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("out of bounds: "), F.coalesce(F.col("x").cast("string"), F.lit("null"))))))
    last = F.struct(*order)
    return rows.groupBy("symbol").agg(F.max_by("x", last).alias("x")), rows.groupBy("x").agg(F.max_by("symbol", last).alias("symbol"))
