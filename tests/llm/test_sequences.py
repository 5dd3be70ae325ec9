import random
from collections import defaultdict
from itertools import groupby

import pytest

from marklake.llm.patterns import frequent_patterns
from marklake.llm.repeated_runs import canonical_target, canonical_tool, repeated_runs

SCHEMA = "step_id long, sess string, pos long, tool string, arg string, ts timestamp, stretch string"


def steps(seed, n=900, sessions=12):
    rng = random.Random(seed)
    rows, at = [], defaultdict(int)
    tool, arg = "read", "a_1.py"
    for k in range(n):
        sess = "hot" if rng.random() < 0.4 else f"s{rng.randrange(sessions)}"
        at[sess] += rng.choice([1, 1, 1, 2, 40])
        if rng.random() < 0.5:
            tool, arg = rng.choice(["read", "READ ", "edit", None]), rng.choice(["a_1.py", "A_1.PY", "./a_1.py", "a_1.py #2", '"a_1.py"', "a_2.py", None, "(none)", ""])
        rows.append((k, sess, at[sess], tool, arg, None, "clash"))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rows += [(9001, None, 1, "read", "x", None, ""), (9002, "s1", None, "read", "x", None, "")]
    rng.shuffle(rows)
    return rows


def by_session(rows):
    sessions = defaultdict(list)
    for r in sorted({r[:5] for r in rows if r[1] is not None and r[2] is not None and r[3] is not None}, key=lambda r: (r[1], r[2], r[0])):
        sessions[r[1]].append(r)
    return sessions


@pytest.mark.parametrize("width", [3, 64, 4096])
def test_runs_equal_brute_force(spark, width):
    rows = steps(width)
    want = []
    for sess, own in by_session(rows).items():
        for _, run in groupby(own, key=lambda r: (canonical_tool(r[3]), canonical_target(r[4]))):
            run = list(run)
            if len(run) > 1:
                want.append((sess, run[0][2], run[-1][2], len(run)))
    got = [(r.sess, r.first_pos, r.last_pos, r.n) for r in repeated_runs(spark.createDataFrame(rows, SCHEMA), width=width).collect()]
    assert sorted(got) == sorted(want)


def test_run_crosses_batches(spark):
    rows = [(k, "one", k, "read", "x", None, "") for k in range(5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.first_pos, r.last_pos, r.n, r.duration_s) for r in got] == [(0, 4999, 5000, None)]


def test_durations_and_spelling(spark):
    import datetime as dt

    t = dt.datetime(2031, 3, 3)
    rows = [(k, "s", k, "read", a, None if k == 1 else t + dt.timedelta(seconds=k), "") for k, a in enumerate(["f_1.py", " F_1.Py", '"f_1.py" (retry)', "./f_1.py [attempt 3]", "f_2.py", "f_1.c"])]
    got = repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.first_pos, r.last_pos, r.n, r.duration_s, r.event) for r in got] == [(0, 3, 4, 3.0, "read:f_1.py")]
    assert repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert canonical_target("part-038") != canonical_target("part-039") and canonical_target(None) == canonical_target(" (NONE)")


def brute(rows, longest, gap, min_sessions, share):
    sessions = by_session(rows)
    holds = defaultdict(set)
    for sess, own in sessions.items():
        items = [f"{r[3]}:{r[4] if r[4] is not None else '(none)'}" for r in own]
        level = {((x,), k) for k, x in enumerate(items)}
        for _ in range(longest - 1):
            level = {(p + (items[k + g],), k + g) for p, k in level for g in range(1, gap + 1) if k + g < len(items) and items[k + g] not in p}
            for p, _k in level:
                holds[" > ".join(p)].add(sess)
    return {p: len(s) for p, s in holds.items() if len(s) >= min_sessions and len(s) >= share * len(sessions)}


@pytest.mark.parametrize("width,longest,gap", [(5, 4, 2), (40, 3, 4), (512, 4, 4)])
def test_patterns_equal_brute_force(spark, width, longest, gap):
    rows = [(i, s, pos, None if x == "z" else x, random.Random(-i).choice([None, "(none)"]), ts, c) for i, s, pos, _t, _a, ts, c in steps(width + 1, 260, 9) for x in [random.Random(i).choice("abcdefz")]]
    rows += rows[:9]
    want = brute(rows, longest, gap, 4, 0.5)
    got = {r.pattern: r.sessions for r in frequent_patterns(spark.createDataFrame(rows, SCHEMA), longest=longest, gap=gap, min_share=0.5, width=width).collect()}
    assert want and got == want


def test_no_patterns(spark):
    assert frequent_patterns(spark.createDataFrame([], SCHEMA)).count() == 0
    assert frequent_patterns(spark.createDataFrame([(1, "s", 1, None, None, None, "")], SCHEMA)).count() == 0
