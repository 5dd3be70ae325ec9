"""Ordered and associative folds per key, bundles and numbering, without a whole key in one task.

A key may hold any share of the rows. Rows are first folded within cuts of their key (by time or number), then the cuts' results are folded in order; that needs the
fold to be associative, so each step is written as an element of a monoid: a clipped addition as (add, low, high), a decayed sum as (sum, factor), a product in a
group as an element. Numbering adds prefix sums over the cuts.

Defined results: rows with a null key or order take no part; ties in the order follow the tie-break column. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, cut: Column, order: list[str], name: str = "n") -> DataFrame:
    """df with a dense number from 0 per key in order; cut: grows with the order and bounds what one task holds."""
    placed = df.where(F.col(key).isNotNull()).withColumn("_cut", cut).where(F.col("_cut").isNotNull())
    counts = placed.groupBy(key, "_cut").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(key).orderBy("_cut")) - F.col("_rows")
    offsets = counts.select(F.col(key).alias("_key"), F.col("_cut").alias("_at"), before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_cut").orderBy(*order)) - 1
    out = placed.withColumn("_local", local).join(offsets, (F.col(key) == F.col("_key")) & (F.col("_cut") == F.col("_at")))
    return out.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_key", "_at", "_before", "_local", "_cut")


def carried(df: DataFrame, key: str, cut: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the last known value of the key up to each row in order: within the row's cut, else the last one of an earlier cut."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_cut", cut).where(F.col("_cut").isNotNull())
    local = F.last(value, True).over(Window.partitionBy(key, "_cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where(F.col(value).isNotNull()).groupBy(key, "_cut").agg(F.max_by(value, F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])).alias("_end"))
    every = rows.select(key, "_cut").distinct().join(ends, [key, "_cut"], "left")
    before = F.last("_end", True).over(Window.partitionBy(key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    starts = every.select(F.col(key).alias("_key"), F.col("_cut").alias("_at"), before.alias("_start"))
    out = rows.withColumn("_local", local).join(starts, (F.col(key) == F.col("_key")) & (F.col("_cut") == F.col("_at")))
    return out.withColumn(name, F.coalesce("_local", "_start")).drop("_key", "_at", "_start", "_local", "_cut")


def folded(df: DataFrame, key: str, cut: Column, order: list[str], element: Column, merge, zero: Column) -> DataFrame:
    """(key, folded): the elements of each key merged in order, first within cuts, then across them. merge(a, b): a before b; associative with neutral `zero`."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), cut.alias("_cut"), F.struct(*order).alias("_order"), element.alias("_e"))

    def fold(grouped, by: str, value: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col(value).alias("e"))))
        return F.aggregate(listed, zero, lambda a, x: merge(a, x["e"]))

    parts = rows.groupBy(key, "_cut").agg(fold(rows, "_order", "_e").alias("_part"))
    return parts.groupBy(key).agg(fold(parts, "_cut", "_part").alias("folded"))


def clipped(add: Column) -> Column:
    return F.struct(add.cast("long").alias("add"), F.lit(-(10**15)).cast("long").alias("low"), F.lit(10**15).cast("long").alias("high"))


def clip_step(add: Column, limit: int) -> Column:
    """x becomes x + add, kept within the limit."""
    return F.struct(add.cast("long").alias("add"), F.lit(-limit).cast("long").alias("low"), F.lit(limit).cast("long").alias("high"))


def clip_merge(a: Column, b: Column) -> Column:
    """First a, then b: min(high, max(low, x + add)) is closed under composition."""
    bounded = lambda x: F.least(b["high"], F.greatest(b["low"], x + b["add"]))
    return F.struct((a["add"] + b["add"]).alias("add"), bounded(a["low"]).alias("low"), bounded(a["high"]).alias("high"))


def clip_value(f: Column, start: int = 0) -> Column:
    return F.least(f["high"], F.greatest(f["low"], F.lit(start) + f["add"]))


def saturating(df: DataFrame, key: str, cut: Column, order: list[str], add: Column, limit: int) -> DataFrame:
    """(key, value): a counter that adds in order and stops at the limits at every step."""
    out = folded(df, key, cut, order, clip_step(add, limit), clip_merge, clipped(F.lit(0)))
    return out.select(key, clip_value(F.col("folded")).alias("value"))


def decayed(df: DataFrame, key: str, cut: Column, order: list[str], value: Column, factor: float) -> DataFrame:
    """(key, value): acc = factor * acc + value, in order."""
    step = F.struct(value.cast("double").alias("s"), F.lit(float(factor)).alias("f"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("f"))
    out = folded(df, key, cut, order, step, lambda a, b: F.struct((a["s"] * b["f"] + b["s"]).alias("s"), (a["f"] * b["f"]).alias("f")), zero)
    return out.select(key, F.col("folded.s").alias("value"))


def bundled(df: DataFrame, group: str, mark: Column) -> DataFrame:
    """(group, place, re, im): marks of a group added up place by place with the integer tables. Partial sums before the shuffle."""
    from marklake.functions.phases import C8, S8, table

    places = df.select(group, F.posexplode(mark).alias("place", "p")).where("p is not null")
    p = F.pmod(F.col("p"), F.lit(16)) + 1
    return places.groupBy(group, "place").agg(F.sum(F.element_at(table(C8), p)).alias("re"), F.sum(F.element_at(table(S8), p)).alias("im"))


def decay_counters(value: Column, factor: float) -> Column:
    """Counter times factor, cut off toward zero."""
    return (value * F.lit(float(factor))).cast("long")


def read_counter(value: Column, least: int) -> Column:
    """The sign of a counter that is at least so strong, else 0."""
    return F.when(F.abs(value) >= least, F.signum(value).cast("long")).otherwise(F.lit(0).cast("long"))


def strongest(df: DataFrame, group: str, strength: str, seq: str, cap: int) -> DataFrame:
    """The cap strongest rows per group; of equal ones the older go first."""
    w = Window.partitionBy(group).orderBy(F.desc(strength), F.desc(seq))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")  # limited in each task before the shuffle
