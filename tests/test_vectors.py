import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklake.functions import phases as P
from marklake.functions import text as X
from marklake.functions.groups import elements, multiplied, products
from marklake.operators import frames


def test_group_is_closed_associative_and_ordered(spark):
    table, g = products(), elements()
    assert sorted(map(sorted, table)) == [list(range(24))] * 24
    for a, b, c in itertools.product(range(24), range(0, 24, 5), range(0, 24, 7)):
        assert table[table[a][b]][c] == table[a][table[b][c]]
    assert table[2][4] == 6 and table[4][2] == 7 and np.allclose(np.linalg.norm(g, axis=1), 1)
    r = spark.createDataFrame([(2, 4), (30, 1), (1, -1)], "a int, b int").select(multiplied(F.col("a"), F.col("b")).alias("c")).collect()
    assert [x.c for x in r] == [6, 0, 0]


def test_transcoding(spark):
    pairs = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    df = spark.createDataFrame([([x for p in pairs for x in p],)], "t array<int>")
    mark = df.select(P.phases_of_trits(F.col("t")).alias("m"))
    back = mark.select(P.trits_of_phases(F.col("m")).alias("t")).first().t
    got = list(zip(back[0::2], back[1::2]))
    assert [g for g, p in zip(got, pairs) if p != (0, 0)] == [p for p in pairs if p != (0, 0)] and got[4] == (1, 0)


def test_solids(spark):
    rows = spark.range(8).select(P.cross_polytope(F.col("id"), 4, 16).alias("p")).collect()
    gram = lambda a, b: np.cos((np.array(rows[a].p) - np.array(rows[b].p)) * np.pi / 8).mean()
    assert gram(0, 4) == pytest.approx(-1) and gram(0, 1) == pytest.approx(0, abs=1e-9) and set(P.hypercube("x", 64)) == {0, 8}
    re, im, scale = P.quantized_slot(np.array([1 + 2j, -2.0]))
    assert (re.tolist(), im.tolist()) == ([64, -127], [127, 0]) and scale == pytest.approx(2 / 127) and P.quantized_slot(np.zeros(2, complex))[2] == 0


def test_frames_unfold_and_buckets(spark):
    edges = spark.createDataFrame([("cause", "obj", "eat"), ("eat", "agt", "mark"), ("eat", "obj", "fish")], "frame string, role string, filler string")
    assert [tuple(r) for r in frames.unfolded(edges, spark.createDataFrame([("cause",)], "start string"), ["obj", "agt"]).collect()] == [("cause", "mark")]
    facts = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "s string, r string, v int")
    assert [r.v for r in frames.bucket_read(facts, ["s", "r"], facts.where("v = 2"), 8).collect()] == [2]
    assert [r.v for r in frames.star(facts, {"r": facts.where("v = 1").select("r")}, {"s": "b"}).collect()] == [3]


def test_records_come_back(spark):
    df = spark.createDataFrame([("read", "a.py"), ("edit", "b.c"), (None, "b.c")], "tool string, arg string")
    coded = frames.record_frames(df, ["tool", "arg"])
    for block in (20_000, 1):
        read = frames.read_frames(coded, ["tool", "arg"], {"tool": df.select("tool").fillna(""), "arg": df.select("arg")}, block=block).collect()
        assert len(read) == 6 and all(r.read == r[r.field] for r in read)


def test_sensors_texts_and_whitening(spark):
    df = spark.createDataFrame([(1, 0.5, 10.0), (2, 0.51, 10.0), (3, 0.9, None), (4, None, float("nan"))], "id int, a double, b double")
    marks = {r.id: r.mark for r in frames.sensor_marks(df, "id", {"a": (0, 1), "b": (0, 100)}, 64).collect()}
    near = lambda x, y: np.cos((np.array(marks[x]) - np.array(marks[y])) * np.pi / 8).mean()
    assert near(1, 2) > 0.9 > near(1, 3) and marks[4] is None
    texts = {r.id: r.mark for r in frames.text_marks(spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "!")], "id int, t string"), "id", "t").collect()}
    assert texts[1] == texts[2] and texts[3] is None and texts[4] is None
    x = np.random.default_rng(0).standard_normal((200, 3)) @ np.array([[1, 2, 0], [0, 1, 0], [0, 0, 3.0]])
    mean, m = frames.whitening(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4), "v", 3)
    assert np.allclose(np.cov((x - mean) @ m, rowvar=False, bias=True), np.eye(3), atol=1e-6)


def test_prosody_and_kept(spark):
    long = "word " * 26
    df = spark.createDataFrame([(f"{long}, and so on, end. Short one here. Apples, pears and plums rather than bread we eat.", "Short one here."), (None, None)], "t string, f string")
    p = X.prosody(F.col("t"))
    r = df.select(*[c.alias(k) for k, c in p.items()], X.kept(F.col("t"), F.col("f")).alias("kept")).collect()
    assert r[0].landing == pytest.approx(0.5) and r[0].rests == 0.5 and r[0].antithesis == pytest.approx(1 / 3) and r[0].triads >= 1 / 3 and 0 < r[0].kept < 1 and r[1].kept == 1.0


def test_long_texts_are_marked_whole(spark):
    words = [f"w{k}" for k in range(9000)]
    z = np.exp(1j * np.pi / 8 * frames.gram_marks([*words, *(f"{a}_{b}" for a, b in zip(words, words[1:]))], 256)).sum(0) * 127
    grams = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
    rows = [(1, " ".join(words)), (2, " ".join(words[:5000])), (3, " ".join(words[:2]))]
    df = spark.createDataFrame(rows, "id int, t string")
    marks = {r.id: r.mark for r in frames.text_marks(df, "id", "t").collect()}
    assert marks[1] == P.sectors(np.rint(z.real), np.rint(z.imag)).tolist()
    assert marks[1] != marks[2] != marks[3]
    assert [r.g for r in df.select(X.grams("t").alias("g")).orderBy("id").collect()] == [grams, [*words[:5000], *grams[9000:13999]], ["w0", "w1", "w0 w1"]]
