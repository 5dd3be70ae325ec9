"""Queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.llm.encode_corpus import encode_corpus
from marklake.llm.encodings import repaired
from marklake.llm.leaks import leaked
from marklake.llm.neighbours import nearest_neighbours, pairs
from marklake.llm.oracle import oracle_sql
from marklake.llm.patterns import frequent_patterns
from marklake.llm.repeated_runs import repeated_runs
from marklake.sources.shared import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_patterns(table(spark, sf_dir, "tri")).select("pattern")


def p2_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_patterns(table(spark, sf_dir, "tri"))


def _event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "loop_event"), "event_id", "x", 64)


def _mark_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "vm_lattice"), "mark_id", "lattice", 128, turn=16, per_code=4, probes=32)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {"loop_event": _event_neighbours, "vm_lattice": _mark_neighbours}
    found = [pairs(f(spark, sf_dir)).select(F.lit(name).alias("coll"), "id_a", "id_b") for name, f in both.items()]
    return found[0].unionByName(found[1])


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, marks = _event_neighbours(spark, sf_dir), _mark_neighbours(spark, sf_dir)
    return events.withColumn("coll", F.lit("loop_event")).unionByName(marks.withColumn("coll", F.lit("vm_lattice")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "tri")).select("sess", "first_pos", "last_pos")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "tri"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), paraphrases=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "documents")).where("garbled").select("doc_id", "restored", "layers", "complete")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_support, p3_found, p3_neighbours, p4_found, p4_runs, p7_ids, p8_found, p8_paraphrases, p9_found, p9_restored)}


__all__ = ["oracle_sql", "queries"]
