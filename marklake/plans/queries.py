"""Queries of the core over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marklake.operators.drift import consistent_values, schema_changes
from marklake.operators.nested import catalogue, child_table, linked, merged_schema, shredded
from marklake.operators.spikes import implausible
from marklake.plans import reference, reference_more, reference_readers, reference_vectors
from marklake.plans.problems_sql import P1, P5, P6, P6_SCHEMA
from marklake.sources.shared import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_reasons(spark, sf_dir).select("reading_id", "field").distinct()


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(table(spark, sf_dir, "telemetry"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "results"), table(spark, sf_dir, "result_files")).select("file", "change", "path", "new_path")


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_values(table(spark, sf_dir, "results"), table(spark, sf_dir, "result_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredded(table(spark, sf_dir, "raw_record")).select("record_id", "parent_path", "node_path")


def p6_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_schema(shredded(table(spark, sf_dir, "raw_record")))


def p6_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the objects in the arrays `arms`, with the columns of the merged schema; without rows where no record has such an array."""
    nodes = shredded(table(spark, sf_dir, "raw_record"))
    parent, columns = catalogue(merged_schema(nodes)).get("/arms/[]", ("", {"arm": "string", "nats_1x": "double"}))
    return child_table(nodes, "/arms/[]", columns, parent)


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(shredded(table(spark, sf_dir, "raw_record")))


flagship = reference.flagship
assert reference_more and reference_readers and reference_vectors  # they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference.QUERIES | {f.__name__: f for f in (p1_found, p1_reasons, p5_found, p5_values, p6_found, p6_schema, p6_arms, p6_tables)}


def oracle_sql() -> dict[str, str]:
    return reference.SQL | {"p1_found": P1, "p5_found": P5, "p6_found": P6, "p6_schema": P6_SCHEMA}
