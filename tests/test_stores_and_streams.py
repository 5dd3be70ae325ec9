import pytest
from pyspark.sql import functions as F

from marklake.operators.neural import ternary_weights
from marklake.sources import store
from marklake.streaming.loop import Loop, first_seen, sessions, tail, windows


def test_store_round_trip_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x\ttoken=abc"), (2, None, ""), (2, None, "")], "id long, g string, label string")
    for k in range(3):
        store.save(df, f"{tmp_path}/day{k}", "facts", {"day": str(k)}, by=["g"] if k else None, label_cols=["label"])
    back = store.load(spark, f"{tmp_path}/day0")
    assert sorted((r.id, r.label) for r in back.collect()) == [(1, "x [REDACTED]"), (2, ""), (2, "")]
    assert [r.path.rsplit("/", 1)[1] for r in store.route(spark, f"file://{tmp_path}", "facts", day="1").collect()] == ["day1"]
    spark.createDataFrame([(9, "z", "")], df.schema).write.mode("append").parquet(f"{tmp_path}/day0/rows")
    with pytest.raises(store.Damaged):
        store.load(spark, f"{tmp_path}/day0").count()


def test_text_sources(spark, tmp_path):
    (tmp_path / "h").write_text("ls\n\n# no\n  cd x \n")
    (tmp_path / "p").write_text("Package: a\nSection: s\n\nPackage: b\n")
    (tmp_path / "j").write_text("host ssh[12]: password=x opened\nnothing\n")
    (tmp_path / "m").write_text("ls (1) - list files\n")
    assert [r.line for r in store.history(spark, str(tmp_path / "h")).collect()] == ["ls", "cd x"]
    assert [(r.package, r.section) for r in store.packages(spark, str(tmp_path / "p")).collect()] == [("a", "s"), ("b", None)]
    assert [(r.unit, r.text) for r in store.journal(spark, str(tmp_path / "j")).collect()] == [("ssh", "[REDACTED] opened")]
    both = store.ingested({"man": store.manual(spark, str(tmp_path / "m")), "history": store.history(spark, str(tmp_path / "h"))}, {"man": "text", "history": "line"})
    assert both.count() == 3 and store.files(spark, str(tmp_path), "[hp]").count() == 2


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 3, 2), (None, 4, 9)], "k string, v int, t int")
    assert {r.k: r.v for r in store.latest(df, "k", "v", ["t"]).collect()} == {"a": 2, "b": 3}


EVENTS = "n long, id long, kind string, mark array<int>, label string"


def labelled():
    rows = []
    for k in range(60):
        c = k % 3
        mark = [(7 if j == c else 0) + (k * j) % 2 for j in range(3)]
        rows.append((k, k, "read" if k % 5 == 4 else "write", mark, None if k % 5 == 4 else f"c{c}"))
    return rows


def answers(loop):
    return sorted((r.qid, r.label, r.vote) for r in loop.answers().collect())


def test_stream_and_replay_agree(spark, tmp_path):
    rows = labelled()
    df = spark.createDataFrame(rows, EVENTS)
    replayed = Loop(spark, f"file://{tmp_path}/a", k=3)
    replayed.replay(df, F.col("n"), 20)
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    streamed = Loop(spark, f"file://{tmp_path}/b", k=3)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    streamed.stream(events, f"file://{tmp_path}/ck").awaitTermination()
    got = answers(replayed)
    assert got == answers(streamed) and len(got) == 12 and all(label == f"c{q % 3}" for q, label, _ in got)


def test_failed_check_rolls_back_and_cap_holds(spark, tmp_path):
    df = spark.createDataFrame(labelled(), EVENTS)
    loop = Loop(spark, f"file://{tmp_path}/c", cap=10, fade=0.1, check=lambda marks: marks.where("label = 'c9'").isEmpty())
    loop.tick(df.where("n < 20"), 0)
    kept = sorted(loop.marks().collect())
    loop.tick(spark.createDataFrame([(99, 99, "write", [1, 2, 3], "c9")], EVENTS), 1)
    assert [r.id for r in loop.marks().orderBy("id").collect()] == [r.id for r in kept] and loop.marks().count() == 10
    loop.tick(df.where("n >= 20"), 2)
    assert loop.marks().count() == 10 and loop.marks().where("tick = 2").count() == 10


def test_a_new_loop_goes_on_and_a_repeated_tick_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame(labelled(), EVENTS)
    whole = Loop(spark, f"file://{tmp_path}/whole", k=3, fade=0.1, cap=30, compact=2)
    whole.replay(df, F.col("n"), 10)
    for k in range(6):  # a loop of its own for every tick, every third tick twice
        for _ in range(2 if k % 3 == 1 else 1):
            Loop(spark, f"file://{tmp_path}/parts", k=3, fade=0.1, cap=30, compact=2).tick(df.where(f"n div 10 = {k}"), k)
    parts = Loop(spark, f"file://{tmp_path}/parts", k=3, fade=0.1, cap=30, compact=2)
    assert answers(parts) == answers(whole) and sorted(parts.marks().collect()) == sorted(whole.marks().collect()) and parts.marks().count() == 30
    before = {r.id: r.strength for r in parts.marks().collect()}
    parts.idle(6)
    after = {r.id: r.strength for r in parts.marks().collect()}
    assert after.keys() == before.keys() and all(after[k] == pytest.approx(0.9 * before[k]) for k in before)
    known = Loop(spark, f"file://{tmp_path}/known", once_per_label=True)
    known.replay(df, F.col("n"), 20)
    assert sorted(r.label for r in known.marks().collect()) == ["c0", "c1", "c2"] and sorted(r.id for r in known.marks().collect()) == [0, 1, 2]


def test_tail_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"step":"x"}\n{"step":\n')
    out = []
    tail(spark, str(tmp_path / "t"), "step string").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.step or "", r._corrupt_record is None) for r in out) == [("", False), ("x", True)]


def test_windows(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t + dt.timedelta(minutes=m)) for m in (0, 10, 50, 55)], "u string, ts timestamp")
    assert sorted(r.n for r in sessions(df, "ts", "u", "30 minutes").collect()) == [2, 2]
    assert [r.n for r in windows(df, "ts", ["u"], "1 hour").collect()] == [4]
    assert windows(df, "ts", ["u"], "1 hour", "30 minutes").count() == 3
    assert first_seen(df, F.col("u"), "ts").count() == 1


def test_ternary_weights(spark):
    r = spark.createDataFrame([([1.0, -1.0, 0.1, 0.0],)], "v array<double>").select(ternary_weights(F.col("v")).alias("w")).first()
    assert r.w == [1, -1, 0, 0]
