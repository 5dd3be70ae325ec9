import datetime as dt
import math
import random

import numpy as np
import pytest

from marklake.operators.spikes import TELEMETRY, Field, implausible, leaps, low_rank, residuals

SCHEMA = "reading_id long, host string, ts timestamp, load double, temp_c double, single_p95_ms double, source string, rank int"
T0 = dt.datetime(2031, 3, 3)


def series(seed, n=700):
    """Readings of two hosts with all three kinds of wrong values, and the lookalikes that aren't wrong."""
    rng = random.Random(seed)
    rows = []
    for h, host in enumerate(("a", "b")):
        step = 1.0 if h else 0.1  # b has a coarse sensor
        level = 50.0
        for k in range(n):
            if k == n // 2:
                level += 15  # a lasting change
            temp = round((level + 5 * math.sin(k / 60) + rng.gauss(0, 0.5 + h)) / step) * step
            load, p95 = 0.4 + 0.1 * math.sin(k / 90) + rng.gauss(0, 0.01), 100 * math.exp(rng.gauss(0, 0.1))
            if k % 97 == 50:
                p95 = 0.0
            if k in (100, 101, 300):
                temp += 30
            if k in (200,):
                temp = 999.9
            if k in (220,):
                temp = rng.choice([None, float("nan")])
            if 400 <= k < 440:
                load = 0.3712
            if k == 500:
                load = rng.choice([-0.1, 7.0, float("inf")])
            if k in (600, 601, 602):
                p95 *= 6
            if k == 650:
                p95 = None
            rows.append((1000 * h + k, host, T0 + dt.timedelta(seconds=k * (2 - h)), load, temp, p95, "clash", 1))
    rows += rows[95:105] + [(5000, None, T0, 3.0, 50.0, 1.0, "", 1), (5001, "a", None, 0.5, 500.0, 1.0, "", 1), (None, "a", T0, 9.0, 1.0, 1.0, "", 1), (5002, "c", T0, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    once = sorted({r[:6] for r in rows if r[0] is not None}, key=lambda r: (r[1] or "", r[2] or T0, r[0]))
    out = set()
    for j, f in enumerate(TELEMETRY, 3):
        for r in once:
            if r[j] is not None and not math.isnan(r[j]) and not f.low <= r[j] <= f.high:
                out.add((r[0], f.name, "impossible"))
        for host in ("a", "b"):
            own = [(r[0], r[j]) for r in once if r[1] == host and r[2] is not None and r[j] is not None and not math.isnan(r[j])]
            counts = lambda v: f.low <= v <= f.high and v != f.idle
            runs, begin = [], 0
            for k in range(1, len(own) + 1):
                if k == len(own) or own[k][1] != own[begin][1]:
                    runs.append(own[begin:k])
                    begin = k
            good = sorted(len(r) for r in runs if counts(r[0][1]))
            usual = good[math.ceil(0.95 * len(good)) - 1]
            out |= {(i, f.name, "stuck") for r in runs if counts(r[0][1]) and len(r) > 2.75 * max(usual, 4) for i, _ in r}
            kept = [(i, math.log(v) if f.log else v) for i, v in own if counts(v)]
            x = np.array([v for _, v in kept])
            q = np.sort(np.abs(np.diff(x)))
            at = lambda p: q[math.ceil(p * len(q)) - 1]
            z = x / (max(at(0.5) / 0.6745, at(0.8) / 1.2816, at(0.95) / 1.96) / math.sqrt(2))
            out |= {(kept[k][0], f.name, "spike") for k in np.flatnonzero(leaps(z, np.ones(len(z), dtype=bool), 6.0))}
    return out


def found(df, **how):
    return {(r.reading_id, r.field, r.reason) for r in implausible(df, **how).collect()}


def test_equal_to_brute_force_whatever_the_pieces(spark):
    rows = series(1)
    want = brute(rows)
    assert {r for _, _, r in want} == {"impossible", "stuck", "spike"} and (100, "temp_c", "spike") in want and (601, "single_p95_ms", "spike") in want and (410, "load", "stuck") in want
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == want
    assert found(df, piece=100, cut_seconds=130) == want


def test_no_rows_and_steady_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()
    rows = [(k, "a", T0 + dt.timedelta(seconds=k), 0.5, 20.0 + k, 0.0, None, None) for k in range(60)]
    assert {r for _, _, r in found(spark.createDataFrame(rows, SCHEMA))} <= {"stuck"}


def test_low_rank_part_leaves_spikes():
    rng = np.random.default_rng(0)
    m = np.outer(np.ones(30), np.sin(np.arange(24) / 4)) * 10 + rng.normal(0, 0.1, (30, 24))
    m[3, 5] += 40
    rest = m - low_rank(m)
    assert rest[3, 5] > 30 and np.abs(np.delete(rest.ravel(), 3 * 24 + 5)).max() < 3
    r = residuals(m.ravel() / 0.1, np.arange(m.size) * 1_000_000, 24, 86_400_000_000)
    assert r[3 * 24 + 5] > 2.5 and not len(residuals(np.zeros(0), np.zeros(0, np.int64), 24, 1))


@pytest.mark.parametrize("size,hit", [(1, True), (3, True), (4, False)])
def test_leaps_are_short(size, hit):
    x = np.zeros(40)
    x[20 : 20 + size] = 9
    assert leaps(x, np.ones(40, dtype=bool), 6.0)[20 : 20 + size].all() == hit and not leaps(x, np.zeros(40, dtype=bool), 6.0).any()


def test_what_every_day_brings_is_no_spike(spark, monkeypatch):
    """Two months of readings, three an hour. A peak at four every morning is normal; the same peak once at three in the afternoon is a spike. Without the low-rank part the mornings would be found as well."""
    from marklake.operators import spikes

    rng, once = np.random.default_rng(7), 30 * 72 + 45
    rows = []
    for k in range(60 * 72):
        value = 50 + 8 * math.sin(k % 72 / 72 * 2 * math.pi) + rng.normal(0, 0.5) + (25 if k % 72 == 12 or k == once else 0)
        if k % 37 != 11:  # lost readings
            rows.append((k, "h", T0 + dt.timedelta(minutes=20 * k), value))
    df = spark.createDataFrame(rows, "reading_id long, host string, ts timestamp, v double")
    found = lambda: sorted(r.reading_id for r in implausible(df, fields=(Field("v", -1000, 1000),)).where("reason = 'spike'").collect())
    assert found() == [once]
    monkeypatch.setattr(spikes, "residuals", lambda x, *_: np.full(len(x), np.inf))
    assert len(found()) > 50


def test_bursts_far_apart_make_no_large_matrix():
    us = np.concatenate([day * 86_400_000_000 + np.arange(50) * 1_000_000 for day in range(0, 4000, 100)])
    assert residuals(np.random.default_rng(0).normal(size=len(us)), us, 24, 86_400_000_000).shape == us.shape
