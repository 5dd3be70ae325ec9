"""Values a source never had: impossible readings, stuck stretches and spikes, each against what is normal for that source.

* Impossible: outside the field's range or infinite. A filter.
* Stuck: a run of one value (null and NaN skipped) that is `stuck_times` times as long as the 95th percentile of that source's run lengths, that percentile
  counted as 4 at least. Runs are found piecewise and joined across pieces; run lengths are counted in a histogram per source.
* Spike: at most three readings in a row that leap away from the level before and after. Each piece of a source's series is a profile matrix: a day per row, by the time of day, where the piece holds three days or
  more and readings at a quarter of their times at least, else a row per `width` consecutive readings. Robust principal components (principal component pursuit by augmented Lagrangians; places without a reading are left open) split it into a low-rank part, the source's
  normal behaviour, and sparse residuals. A leap counts if all of its readings lie off the low-rank part by `least` times the source's short-term scatter; what a source does every day is no spike, however steep. Its shape is then tested: beyond both
  neighbouring levels (medians of five readings) by `leap_times` the scatter and beyond the readings beside it by half as much. The scatter comes from quantiles of the differences between consecutive readings. Latencies are compared by their logarithm.

A source may hold any share of the rows: its readings are cut by time, numbered through prefix sums over the cuts and put into pieces of
`piece` readings with the neighbours that the tests need; no window or group spans a whole source except over a row per cut or piece.

Defined results: null, NaN and zero latencies are never wrong; rows with the same source, time and id count once; rows without an id are left out; rows without source or time
are only tested for impossible values. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.sources.shared import written


@dataclass(frozen=True)
class Field:
    """Range of a field; idle: a value that means no measurement; log: compared by logarithm."""

    name: str
    low: float
    high: float
    idle: float | None = None
    log: bool = False


TELEMETRY = (Field("load", 0, 1), Field("temp_c", -50, 140), Field("single_p95_ms", 0, 3_600_000, idle=0.0, log=True))


def possible(field: Field) -> Column:
    return F.col(field.name).between(field.low, field.high)


def _measured(field: Field) -> Column:
    """The value as compared, null where there is none or it is impossible."""
    ok = possible(field) & (F.lit(True) if field.idle is None else F.col(field.name) != field.idle)
    if field.log:
        ok &= F.col(field.name) > 0
    return F.when(ok, F.log(field.name) if field.log else F.col(field.name))


def low_rank(m: np.ndarray, known: np.ndarray | None = None, rounds: int = 40, tolerance: float = 1e-4) -> np.ndarray:
    """The low-rank part of m = low rank + sparse (principal component pursuit, inexact augmented Lagrangian); where nothing is known the low-rank part fills in."""
    if m.shape[1] > m.shape[0]:
        return low_rank(m.T, None if known is None else known.T, rounds, tolerance).T
    norm = np.linalg.norm(m, 2)
    if not norm:
        return m
    weight = 1 / np.sqrt(max(m.shape))
    dual = m / max(norm, np.abs(m).max() / weight)
    sparse, mu = np.zeros_like(m), 1.25 / norm
    for _ in range(rounds):
        x = m - sparse + dual / mu
        squares, v = np.linalg.eigh(x.T @ x)  # singular values by the small side
        s = np.sqrt(np.maximum(squares, 1e-300))
        low = x @ (v * (np.maximum(s - 1 / mu, 0) / s)) @ v.T
        if known is not None:
            m = np.where(known, m, low)
        gap = m - low + dual / mu
        sparse = np.sign(gap) * np.maximum(np.abs(gap) - weight / mu, 0)
        rest = m - low - sparse
        dual += mu * rest
        mu = min(mu * 1.5, 1e7)
        if np.linalg.norm(rest) <= tolerance * np.linalg.norm(m):
            break
    return low


def residuals(x: np.ndarray, us: np.ndarray, width: int, period_us: int) -> np.ndarray:
    """How far the series, in units of its scatter, lies off the low-rank part of its profile matrix."""
    if not len(x):
        return np.zeros(0)
    x = x - np.median(x)
    step = np.median(np.diff(us)) if len(us) > 1 else 0
    slots = int(round(period_us / step)) if step > 0 else 0
    days = int(us[-1] // period_us - us[0] // period_us) + 1
    if slots >= 4 and us[-1] - us[0] >= 3 * period_us and days * slots <= 4 * len(x):  # days that are filled, not bursts far apart
        row, col = np.divmod(us - us[0] // period_us * period_us, period_us)
        col = np.minimum(col * slots // period_us, slots - 1)
    else:
        row, col = np.divmod(np.arange(len(x)), width)
        slots = width
    shape = (int(row[-1]) + 1, slots)
    n, total = np.zeros(shape), np.zeros(shape)
    np.add.at(n, (row, col), 1)
    np.add.at(total, (row, col), x)
    known = n > 0
    m = np.where(known, total / np.maximum(n, 1), 0)
    return np.abs(x - low_rank(m, known)[row, col])


def leaps(x: np.ndarray, sparse: np.ndarray, times: float, around: int = 5, longest: int = 3) -> np.ndarray:
    """Which readings belong to a leap of `longest` at most, all of it sparse."""
    n, out = len(x), np.zeros(len(x), dtype=bool)
    if n < 5:
        return out
    padded = np.concatenate([np.full(around, np.nan), x, np.full(around + longest, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, around)
    known = np.isfinite(windows).sum(1) >= 2
    level = np.full(len(windows), np.nan)
    level[known] = np.nanmedian(windows[known], axis=1)
    for size in range(1, longest + 1):
        at = np.arange(n - size + 1)
        before, after = level[at], level[at + size + around]
        group = np.lib.stride_tricks.sliding_window_view(x, size)
        low, high = group.min(1), group.max(1)
        left, right = padded[at + around - 1], padded[at + size + around]  # the readings beside it: a longer excursion is no leap
        up = (low - np.fmax(before, after) > times) & (low - np.fmax(left, right) > times / 2)
        down = (np.fmin(before, after) - high > times) & (np.fmin(left, right) - high > times / 2)
        both = np.isfinite(before) & np.isfinite(after)
        hit = both & (up | down) & np.lib.stride_tricks.sliding_window_view(sparse, size).all(1)
        for k in range(size):
            out[at[hit] + k] = True
    return out


RESULT = "kind string, source string, piece long, field string, value double, n long, cases long, ids array<long>, opens boolean, closes boolean"


def _piece_test(fields: tuple[Field, ...], width: int, period_us: int, least: float, times: float, keep_run: int):
    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        own = pdf["own"].to_numpy()
        ids, us = pdf["reading"].to_numpy(), pdf["us"].to_numpy()
        out = []
        for f in fields:
            x, scale = pdf[f"x_{f.name}"].to_numpy(dtype=float), pdf[f"s_{f.name}"].to_numpy(dtype=float)
            there = np.flatnonzero(np.isfinite(x))
            if len(there) and np.isfinite(scale[0]):
                z = x[there] / max(scale[0], 1e-9)
                hit = there[leaps(z, residuals(z, us[there], width, period_us) > least, times)]
                hit = hit[own[hit]]
                if len(hit):
                    out.append(("spike", *key, f.name, None, len(hit), 1, ids[hit].tolist(), False, False))
            raw = pdf[f"v_{f.name}"].to_numpy(dtype=float)
            there = np.flatnonzero(own & ~np.isnan(raw))
            if len(there):
                v = raw[there]
                begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                size = np.diff(np.append(begin, len(v)))
                edge = np.zeros(len(begin), dtype=bool)
                edge[[0, -1]] = True
                counted = (v[begin] >= f.low) & (v[begin] <= f.high)
                if f.idle is not None:
                    counted &= v[begin] != f.idle
                lengths, cases = np.unique(size[counted & ~edge], return_counts=True)
                out += [("length", *key, f.name, None, int(a), int(b), None, False, False) for a, b in zip(lengths, cases)]
                out += [("run", *key, f.name, float(v[begin[k]]), int(size[k]), 1, ids[there[begin[k] : begin[k] + size[k]]].tolist(), k == 0, k == len(begin) - 1) for k in np.flatnonzero(edge | (counted & (size >= keep_run)))]
        return pd.DataFrame(out, columns=["kind", "source", "piece", "field", "value", "n", "cases", "ids", "opens", "closes"])

    return test


def implausible(
    df: DataFrame,
    source: str = "host",
    reading: str = "reading_id",
    ts: str = "ts",
    fields: tuple[Field, ...] = TELEMETRY,
    stuck_times: float = 2.75,
    leap_times: float = 3.0,
    width: int = 24,
    period_seconds: int = 86_400,
    least: float = 6.0,
    piece: int = 2048,
    cut_seconds: int = 1800,
    margin: int = 24,
) -> DataFrame:
    """(reading_id, field, reason): every wrong value, once per reason."""
    df = df.where(F.col(reading).isNotNull()).select(
        F.col(source).alias("source"), F.col(reading).cast("long").alias("reading"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), *[F.nanvl(F.col(f.name).cast("double"), F.lit(None)).alias(f.name) for f in fields]
    )
    names = [f.name for f in fields]
    beyond = df.select("reading", F.explode(F.array_compact(F.array(*[F.when(~possible(f), F.lit(f.name)) for f in fields]))).alias("field"), F.lit("impossible").alias("reason"))

    placed = df.where("source is not null and us is not null").withColumn("cut", F.floor(F.col("us") / F.lit(cut_seconds * 1_000_000)))
    once = placed.repartition("source", "cut").groupBy("source", "cut", "us", "reading").agg(*[F.max(n).alias(n) for n in names])
    w = Window.partitionBy("source", "cut").orderBy("us", "reading")
    once = once.select("source", "cut", "us", "reading", *[F.col(n).alias(f"v_{n}") for n in names], *[_measured(f).alias(f"x_{f.name}") for f in fields], F.row_number().over(w).alias("at"), F.count(F.lit(1)).over(Window.partitionBy("source", "cut")).alias("n"))
    once = once.withColumns({f"d_{n}": F.when(F.col(f"x_{n}").isNotNull(), F.abs(F.col(f"x_{n}") - F.last(f"x_{n}", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))) for n in names})
    once = written(once, "readings")

    def scatter(n: str) -> Column:  # quantiles of a normal difference; the greatest, as coarse sensors often repeat a value
        q = F.percentile_approx(f"d_{n}", [0.5, 0.8, 0.95], 10000)
        return (F.greatest(q[0] / 0.6745, q[1] / 1.2816, q[2] / 1.96) / F.lit(2**0.5)).alias(f"s_{n}")

    scales = once.groupBy("source").agg(*[scatter(n) for n in names])
    cuts = once.where("at = 1").select("source", "cut", "n").withColumn("offset", F.sum("n").over(Window.partitionBy("source").orderBy("cut")) - F.col("n"))
    cuts = cuts.withColumn("last", F.greatest(F.floor(F.sum("n").over(Window.partitionBy("source")) / piece) - 1, F.lit(0))).drop("n")  # the last piece takes what remains, so none is short
    cuts = cuts.join(scales, "source")
    ranked = once.join(cuts, ["source", "cut"]).withColumn("rank", F.col("offset") + F.col("at") - 1)
    own = F.least(F.floor(F.col("rank") / piece), F.col("last"))
    rest = F.col("rank") - own * piece
    pieces = ranked.withColumn("home", own).withColumn("piece", F.explode(F.array_compact(F.array(own, F.when((rest < margin) & (own > 0), own - 1), F.when((rest >= piece - margin) & (own < F.col("last")), own + 1)))))
    pieces = pieces.select("source", "piece", "rank", "us", "reading", (F.col("piece") == F.col("home")).alias("own"), *[c for n in names for c in (f"v_{n}", f"x_{n}", f"s_{n}")])
    shortest = int(np.ceil(4 * stuck_times))
    tested = written(pieces.groupBy("source", "piece").applyInPandas(_piece_test(fields, width, period_seconds * 1_000_000, least, leap_times, shortest), RESULT), "tested")

    spikes = tested.where("kind = 'spike'").select(F.explode("ids").alias("reading"), "field", F.lit("spike").alias("reason"))
    edge = F.col("opens") | F.col("closes")
    runs = tested.where("kind = 'run'").withColumn("edge", edge).withColumn("apart", F.when(~edge, F.col("piece")))
    w = Window.partitionBy("source", "field", "edge", "apart").orderBy("piece", F.col("closes"))
    goes_on = F.coalesce(F.col("edge") & F.col("opens") & F.lag("closes").over(w) & (F.lag("value").over(w) == F.col("value")), F.lit(False))
    runs = runs.withColumn("goes_on", goes_on).withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w))
    whole = runs.where("edge").groupBy("source", "field", "run").agg(F.sum("n").alias("whole_n"), F.max("value").alias("value"))
    counted = None
    for f in fields:
        ok = (F.col("field") == f.name) & F.col("value").between(f.low, f.high) & (F.lit(True) if f.idle is None else F.col("value") != f.idle)
        counted = ok if counted is None else counted | ok
    lengths = tested.where("kind = 'length'").select("source", "field", "n", "cases").unionByName(whole.where(counted).select("source", "field", F.col("whole_n").alias("n"), F.lit(1).cast("long").alias("cases")))
    lengths = lengths.groupBy("source", "field", "n").agg(F.sum("cases").alias("cases"))
    up = Window.partitionBy("source", "field").orderBy("n")
    usual = lengths.withColumn("share", F.sum("cases").over(up) / F.sum("cases").over(Window.partitionBy("source", "field"))).where("share >= 0.95").groupBy("source", "field").agg(F.min("n").alias("usual"))
    long = runs.join(whole.select("source", "field", "run", "whole_n", F.lit(True).alias("edge")), ["source", "field", "run", "edge"], "left").withColumn("whole_n", F.coalesce("whole_n", "n"))
    long = long.where(counted).join(usual, ["source", "field"]).where(F.col("whole_n") > F.lit(stuck_times) * F.greatest(F.col("usual"), F.lit(4)))
    stuck = long.select(F.explode("ids").alias("reading"), "field", F.lit("stuck").alias("reason"))
    return beyond.distinct().unionByName(stuck).unionByName(spikes.distinct()).withColumnRenamed("reading", reading)
