"""Stores: tables with digests and metadata, routing by metadata, last-write lookups, and readers of system texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklake.functions.text import redacted

FORMAT = 1


def row_digest(df: DataFrame) -> Column:
    """A digest of a row's values, whatever the order of the columns; nulls and empty texts differ."""
    parts = [F.coalesce(F.concat(F.lit(f"{c}="), F.to_json(F.struct(F.col(c)))), F.lit(f"{c}:null")) for c in sorted(df.columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest of them that doesn't depend on their order: the sum of 60-bit parts of the rows' digests. One pass, partial sums."""
    r = df.select(F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(38,0)").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s")).collect()[0]
    return r.n, str(r.s or 0)


def save(df: DataFrame, path: str, kind: str, meta: dict[str, str] | None = None, by: list[str] | None = None, label_cols: list[str] | None = None) -> None:
    """A table as Parquet, partitioned by columns, beside one row of metadata with its digest. Labels are freed of secrets first."""
    for c in label_cols or []:
        df = df.withColumn(c, redacted(F.col(c)))
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/rows")
    spark = df.sparkSession
    # The digest is of what was written.
    n, digest = table_digest(spark.read.schema(df.schema).parquet(f"{path}/rows"))
    row = [(kind, FORMAT, n, digest, {k: str(v) for k, v in (meta or {}).items()}, df.schema.json())]
    spark.createDataFrame(row, "kind string, format int, n_rows long, digest string, meta map<string,string>, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


class Damaged(ValueError):
    """A table that isn't what was written."""


def load(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    header = spark.read.parquet(f"{path}/header").collect()[0]
    if header.format != FORMAT:
        raise Damaged(f"{path} has format {header.format}, not {FORMAT}")
    df = spark.read.schema(T.StructType.fromJson(json.loads(header.columns))).parquet(f"{path}/rows")
    if verify and table_digest(df) != (header.n_rows, header.digest):
        raise Damaged(f"{path} differs from its digest")
    return df


def route(spark: SparkSession, root: str, kind: str | None = None, **meta: str) -> DataFrame:
    """(path, kind, meta, n_rows) of the stores under root with this kind and metadata."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/*/header").withColumn("path", F.regexp_extract(F.input_file_name(), r"^(.*)/header/", 1))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    for key, value in meta.items():
        rows = rows.where(F.col("meta")[key] == str(value))
    return rows.select("path", "kind", "meta", "n_rows")


def latest(writes: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value) of the last write of each key; partial maxima before the shuffle."""
    return writes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def history(spark: SparkSession, path: str) -> DataFrame:
    """(line): one command per line, without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(package, section) of stanzas that blank lines end."""
    stanza = spark.read.option("lineSep", "\n\n").text(path)
    field = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(.*)$", 1), F.lit(""))
    return stanza.select(field("Package").alias("package"), field("Section").alias("section")).where("package is not null")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """(unit, text) of exported log lines "unit[pid]: text"."""
    parts = spark.read.text(path).select(F.regexp_extract("value", r"([\w@.\-]+)(?:\[\d+\])?: (.*)$", 1).alias("unit"), redacted(F.regexp_extract("value", r"([\w@.\-]+)(?:\[\d+\])?: (.*)$", 2)).alias("text"))
    return parts.where("unit != ''")


def manual(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of lines "name (section) - description"."""
    parts = spark.read.text(path).select(F.regexp_extract("value", r"^(\S+)\s*\(\d\w*\)\s+-\s+(.*)$", 1).alias("name"), F.regexp_extract("value", r"^(\S+)\s*\(\d\w*\)\s+-\s+(.*)$", 2).alias("text"))
    return parts.where("name != ''")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, folder, name, size, modified) of all files below a folder, version control and caches left out. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = found.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(~F.col("path").rlike(r"/(?:\.git|\.hg|__pycache__|node_modules|\.cache)/"))


def ingested(sources: dict[str, DataFrame], text: dict[str, str]) -> DataFrame:
    """(source, text) of all sources in one table."""
    out = None
    for name, df in sources.items():
        rows = df.select(F.lit(name).alias("source"), F.col(text[name]).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out
