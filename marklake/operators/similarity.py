"""Exhaustive scans of marks for a stated set of queries: top-k with defined ties, cascades, thresholds, votes.

Scores are integers, so ranks and ties are exact. Queries are taken in blocks of bounded size; a block is a matrix on every worker, a batch of marks is
multiplied with it, and of each batch only what can still be among the k best of a query (ties included) goes on to the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions.phases import C8, S8

SCORES = "qid long, id long, score long"


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def as_phases(m: np.ndarray) -> np.ndarray:
    """Phases as table cosines and sines: the inner product is the scan's score."""
    p = np.mod(m, 16)
    return np.concatenate([np.asarray(C8)[p], np.asarray(S8)[p]], axis=1)


def as_bits(m: np.ndarray) -> np.ndarray:
    """Signs as -1 and 1: the inner product falls by two for each differing place."""
    return np.where(m < 0, -1, 1)


VIEWS = {"numbers": lambda m: m, "phases": as_phases, "bits": as_bits, "trits": np.sign}


def _length(asked: DataFrame) -> int | None:
    """The length that most queries have, of equally frequent ones the least."""
    most = asked.groupBy(F.size("mark").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return most.n if most else None


def scan(marks: DataFrame, queries: DataFrame, k: int | None = None, view: str = "numbers", places: int | None = None, dims: int | None = None, block: int = 65_536, cell: int = 4_000_000) -> DataFrame:
    """(qid, id, score) of all marks but the query itself, or of those among a query's k best of their task's marks so far, ties included.

    marks: (id, mark), queries: (qid, mark), integer arrays of one length, `dims` or what most queries have; places: only so many leading places. Rows with null
    ids, marks or values and other lengths take no part. A task holds `block` queries and `cell` scores at a time.
    """
    spark = marks.sparkSession
    asked = queries.where("qid is not null and mark is not null").where(~F.exists("mark", lambda x: x.isNull())).select(F.col("qid").cast("long").alias("qid"), F.col("mark").cast("array<int>").alias("mark"))
    dims = dims or _length(asked.where("size(mark) > 0"))
    if not dims:
        return spark.createDataFrame([], SCORES)
    asked, used = asked.where(F.size("mark") == dims), min(places or dims, dims)
    n_blocks, results = max(1, -(-asked.count() // block)), []
    kept = marks.where("id is not null and mark is not null").where((F.size("mark") == dims) & ~F.exists("mark", lambda x: x.isNull())).select(F.col("id").cast("long").alias("id"), F.col("mark").cast("array<int>").alias("mark"))
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows.column("qid").to_numpy(), VIEWS[view](_numbers(rows.column("mark").combine_chunks(), dims)[:, :used])))

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best = np.full((len(qid), k), -np.inf) if k else None  # the k best scores so far
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    ids = part.column("id").to_numpy()
                    m = VIEWS[view](_numbers(part.column("mark"), dims)[:, :used])
                    exact = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * m.shape[1]
                    kind = np.float32 if exact < 2**24 else np.float64  # whole numbers below these bounds are exact
                    m = np.ascontiguousarray(m.T.astype(kind))
                    size = max(1, cell // len(ids))
                    for a in range(0, len(qid), size):
                        score = q[a : a + size].astype(kind) @ m
                        own = np.isin(qid[a : a + size], ids)
                        if own.any():
                            own = np.flatnonzero(own)
                            i, j = np.nonzero(qid[a + own][:, None] == ids[None])
                            score[own[i], j] = -np.inf
                        if k:
                            hit = np.flatnonzero(score.max(1) >= best[a : a + size, 0])
                            both = np.concatenate([best[a + hit], score[hit]], 1)
                            best[a + hit] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :], axis=1)
                            i, c = np.nonzero((score[hit] >= best[a + hit, :1]) & (score[hit] > -np.inf))
                            r = hit[i]
                        else:
                            r, c = np.nonzero(score > -np.inf)
                        yield pa.RecordBatch.from_arrays([pa.array(qid[a + r]), pa.array(ids[c]), pa.array(np.rint(score[r, c]).astype(np.int64))], ["qid", "id", "score"])

        results.append(kept.mapInArrow(go, SCORES))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], SCORES)


def ranked(scores: DataFrame, k: int, ties: bool = False) -> DataFrame:
    """The k best per query: by score, then id; or, with ties, all that reach the k-th best score."""
    w = Window.partitionBy("qid").orderBy(F.desc("score")) if ties else Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", (F.rank() if ties else F.row_number()).over(w).cast("long")).where(F.col("rank") <= k)


def top_k(marks: DataFrame, queries: DataFrame, k: int, ties: bool = False, **scanned) -> DataFrame:
    return ranked(scan(marks, queries, k, **scanned), k, ties)


def cascade(marks: DataFrame, queries: DataFrame, k: int, stages: list[tuple[int, int]], view: str = "numbers") -> DataFrame:
    """Stages of (places, survivors with ties), each ranking what the one before left, then the k best by all places. Survivors are joined back by id, so later stages read only theirs."""
    alive: DataFrame | None = None
    for places, survivors in [*stages, (None, k)]:
        if alive is None:
            scores = scan(marks, queries, survivors if places else k, view, places)
        else:
            pairs = alive.select("qid", "id")
            q = queries.select(F.col("qid"), F.col("mark").alias("asked"))
            m = pairs.join(marks.select("id", "mark"), "id").join(q, "qid")
            scores = m.select("qid", "id", dot(F.slice("asked", 1, places) if places else F.col("asked"), F.slice("mark", 1, places) if places else F.col("mark"), view).alias("score"))
        alive = ranked(scores, survivors, ties=places is not None)
    return alive


def dot(a: Column, b: Column, view: str = "numbers") -> Column:
    """Integer score of two marks as a column, for pairs that are already together."""
    if view == "phases":
        from marklake.functions.phases import scan_score

        return scan_score(a, b).cast("long")
    if view == "bits":
        a, b = (F.transform(x, lambda v: F.when(v < 0, -1).otherwise(1)) for x in (a, b))
    elif view == "trits":
        a, b = (F.transform(x, lambda v: F.signum(v).cast("int")) for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def soft(scores: DataFrame, beta: float, perfect: float) -> DataFrame:
    """(qid, id, weight): softmax of the scores as shares of a perfect one; each query's weights add up to 1."""
    w = Window.partitionBy("qid")
    z = F.lit(float(beta)) * F.col("score") / F.lit(float(perfect))
    e = scores.withColumn("z", z).withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return e.select("qid", "id", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def answered(scores: DataFrame, perfect: float, least: float, spark: float) -> DataFrame:
    """(qid, best, score, margin, hits, answer): best mark and lead over the second as a share of a perfect score; no answer if nothing reaches `least` or the lead is under `spark`."""
    two = ranked(scores, 2)
    hits = scores.groupBy("qid").agg(F.sum((F.col("score") >= least * perfect).cast("long")).alias("hits"))
    top = two.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("best"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    margin = (F.col("score") - F.coalesce("second", F.lit(0))) / F.lit(float(perfect))
    out = top.join(hits, "qid").withColumn("margin", margin)
    return out.select("qid", "best", "score", "margin", "hits", F.when((F.col("hits") > 0) & (F.col("margin") >= spark), F.col("best")).alias("answer"))


def voted(top: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label, vote, lead): the label with most score among the neighbours, ties to the lesser label, and its lead over the runner-up as a share of all votes. labels: (id, label)."""
    votes = top.join(labels, "id").groupBy("qid", "label").agg(F.sum(F.greatest("score", F.lit(0))).alias("vote"))
    w = Window.partitionBy("qid").orderBy(F.desc("vote"), "label")
    ordered = votes.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("vote").over(w)).withColumn("all", F.sum("vote").over(Window.partitionBy("qid")))
    return ordered.where("place = 1").select("qid", "label", "vote", F.when(F.col("all") > 0, (F.col("vote") - F.coalesce("next", F.lit(0))) / F.col("all")).otherwise(0.0).alias("lead"))
