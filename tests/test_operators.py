import datetime as dt
import hmac
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklake.functions import text
from marklake.functions.phases import sectors
from marklake.operators import decode, folds, logic, memory, program, similarity, triples
from marklake.operators.shifts import shifts

VECTORS = "id long, mark array<int>"


def vectors(n=200, d=16, low=-3, high=4, seed=0):
    rng = np.random.default_rng(seed)
    return [(k, rng.integers(low, high, d).tolist()) for k in range(n)]


def test_top_k_with_and_without_ties(spark):
    rows = vectors(high=2)
    odd = [(None, rows[0][1]), (900, None), (901, [1]), (902, [None] * 16)]
    marks = spark.createDataFrame(rows + odd, VECTORS).repartition(5)
    queries = marks.where("id % 50 = 0").withColumnRenamed("id", "qid")
    for block in (4096, 2):
        scores = {}
        for r in similarity.scan(marks, queries.where("qid < 900"), block=block).collect():
            scores.setdefault(r.qid, []).append((-r.score, r.id))
        assert set(scores) == {0, 50, 100, 150} and all(len(v) == 199 for v in scores.values())
        exact = {(r.qid, r.id, r.rank) for r in similarity.top_k(marks, queries.where("qid < 900"), 7, block=block).collect()}
        assert exact == {(q, i, k + 1) for q, v in scores.items() for k, (_, i) in enumerate(sorted(v)[:7])}
        tied = {(r.qid, r.id) for r in similarity.top_k(marks, queries.where("qid < 900"), 7, ties=True, block=block).collect()}
        assert tied == {(q, i) for q, v in scores.items() for s, i in v if s <= sorted(v)[6][0]}
    assert similarity.scan(marks.limit(0), queries).count() == 0 and similarity.scan(marks, queries.limit(0)).count() == 0


def test_cascade_is_exact_when_all_survive(spark):
    marks = spark.createDataFrame(vectors(), VECTORS)
    queries = marks.where("id % 50 = 0").withColumnRenamed("id", "qid")
    want = similarity.top_k(marks, queries, 5).select("qid", "id", "score", "rank").collect()
    got = similarity.cascade(marks, queries, 5, [(4, 200), (8, 200)]).select("qid", "id", "score", "rank").collect()
    assert sorted(want) == sorted(got)


def test_folds_don_t_depend_on_cuts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), k, rng.randint(-4, 4)) for k in range(300)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, n long, v int").repartition(7)
    clip, fade = {}, {}
    for k, _, v in rows:
        clip[k] = max(-8, min(8, clip.get(k, 0) + v))
        fade[k] = 0.9 * fade.get(k, 0.0) + v
    for width in (1, 17, 1000):
        cut = F.floor(F.col("n") / width)
        assert {r.k: r.value for r in folds.saturating(df, "k", cut, ["n"], F.col("v"), 8).collect()} == {k: clip[k] for k in "ab"}
        for r in folds.decayed(df, "k", cut, ["n"], F.col("v"), 0.9).collect():
            assert r.value == pytest.approx(fade[r.k])
        numbers = folds.numbered(df, "k", cut, ["n"], "i").where("k = 'a'").orderBy("n").select("i").collect()
        assert [r.i for r in numbers] == list(range(len(numbers)))


def test_carried_over_cuts(spark):
    rows = [("a", k, v) for k, v in enumerate([None, 1, None, None, None, 2, None])] + [("b", 3, None), (None, 1, 9)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    for width in (1, 2, 100):
        got = {(r.k, r.n): r.c for r in folds.carried(df, "k", F.floor(F.col("n") / width), ["n"], "v", "c").collect()}
        assert [got["a", n] for n in range(7)] == [None, 1, 1, 1, 1, 2, 2] and got["b", 3] is None and len(got) == 8


def test_strongest_and_counters(spark):
    df = spark.createDataFrame([("a", float(w), s) for s, w in enumerate([3, 1, 2, 2])], "g string, w double, s int")
    assert sorted(r.s for r in folds.strongest(df, "g", "w", "s", 2).collect()) == [0, 3]
    r = spark.range(1).select(folds.decay_counters(F.lit(-5), 0.5).alias("d"), folds.read_counter(F.lit(-5), 5).alias("t"), folds.read_counter(F.lit(4), 5).alias("z")).first()
    assert (r.d, r.t, r.z) == (-2, -1, 0)


FAMILY = [("parent", ["a", "b"]), ("parent", ["b", "c"]), ("parent", ["c", "d"]), ("child", ["d"])]
RULES = [logic.Rule(("ancestor", "X", "Y"), (("parent", "X", "Y"),)), logic.Rule(("ancestor", "X", "Z"), (("parent", "X", "Y"), ("ancestor", "Y", "Z"))), logic.Rule(("elder", "X"), (("ancestor", "X", "Y"), ("child", "Y")))]


def facts(spark, rows):
    return spark.createDataFrame(rows, logic.SCHEMA)


def test_chaining_depth_proofs_and_goals(spark):
    beliefs, uses = logic.chained(facts(spark, FAMILY + FAMILY[:1] + [(None, ["x"])]), RULES)
    depth = {(r.pred, *r.args): r.depth for r in beliefs.collect()}
    assert depth["ancestor", "a", "d"] == 3 and depth["elder", "a"] == 4 and depth["parent", "a", "b"] == 0 and len(depth) == 13
    steps = logic.proofs(beliefs, uses)
    assert steps.count() == 9 and logic.sound(steps, facts(spark, FAMILY), RULES).where("not holds").isEmpty()
    forged = steps.withColumn("premises", F.when(F.col("pred") == "elder", F.array(F.struct(F.lit("parent").alias("pred"), F.array(F.lit("z")).alias("args")))).otherwise(F.col("premises")))
    assert {r.pred for r in logic.sound(forged, facts(spark, FAMILY), RULES).where("not holds").collect()} == {"elder"}
    goals = facts(spark, [("ancestor", ["a", "c"]), ("ancestor", ["c", "a"]), ("elder", ["d"])])
    assert {(r.pred, *r.args): r.proved for r in logic.proved(goals, facts(spark, FAMILY), RULES).collect()} == {("ancestor", "a", "c"): True, ("ancestor", "c", "a"): False, ("elder", "d"): False}


def test_retraction_equals_rebuilding(spark):
    everything = {(r.pred, *r.args) for r in logic.chained(facts(spark, FAMILY), RULES)[0].collect()}
    for k in range(len(FAMILY)):
        lost = {(r.pred, *r.args) for r in logic.retracted(facts(spark, FAMILY), RULES, facts(spark, [FAMILY[k]])).collect()}
        rebuilt = {(r.pred, *r.args) for r in logic.chained(facts(spark, FAMILY[:k] + FAMILY[k + 1 :]), RULES)[0].collect()}
        assert everything - lost == rebuilt


def test_contradictions_and_bad_rules(spark):
    rows = [("wet", ["a"]), ("not", ["wet", "a"]), ("not", ["wet", "b"])]
    assert [(r.pred, r.args) for r in logic.contradictions(facts(spark, rows)).collect()] == [("wet", ["a"])]
    with pytest.raises(ValueError):
        logic.Rule(("p", "X"), (("q", "Y"),))


def test_triples(spark):
    rows = [("s1", "r", "o1"), ("s1", "r", "o2"), ("s2", "r", "o1"), ("s1", "q", "o1"), ("s1", "r", "o1")]
    df = spark.createDataFrame(rows, "s string, r string, o string")
    answers = triples.completed(df, df.where("s = 's1'"), "o")
    assert {(r.s, r.r, r.o, r.n) for r in answers.collect()} == {("s1", "r", "o1", 2), ("s1", "r", "o2", 1), ("s1", "q", "o1", 1)}
    assert triples.confirmed(answers, df).count() == 3
    assert {(r.s, r.o): r.verdict for r in triples.triage(df, ["s", "o"], "r").collect()} == {("s1", "o1"): -1, ("s1", "o2"): 0, ("s2", "o1"): 0}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 1)], "src int, dst int")
    assert {(r.src, r.dst): r.hops for r in triples.closure(edges).collect()} == {(a, b): (b - a - 1) % 3 + 1 for a in (1, 2, 3) for b in (1, 2, 3)}
    names = spark.createDataFrame([("small ring",), ("red widget",), (None,)], "name string")
    asked = spark.createDataFrame([(1, "red widget"), (2, "Widget  red"), (3, "smal rink"), (4, "zzz")], "qid int, surface string")
    assert {r.qid: (r.name, r.route) for r in triples.routed(asked, names).collect()} == {1: ("red widget", "exact"), 2: ("red widget", "words"), 3: ("small ring", "spelling")}


def test_memories(spark):
    rows = [("h1", 0.1, 0.0)] * 40 + [("h2", 0.9, 0.0)] * 40 + [("h3", 0.1, 0.0)] * 3 + [(None, 0.1, 0.0)] * 40
    df = spark.createDataFrame(rows, "head string, m double, v double")
    assert [r["head"] for r in memory.gaps(df, "head", F.col("m"), F.col("v")).collect()] == ["h1"]
    arms = memory.bandit(spark.createDataFrame([("b", 0, 1.0), ("b", 0, 1.0), ("b", 1, 0.0)], "b string, a int, r double"), F.col("b"), F.col("a"), F.col("r"))
    assert {r.arm: (r.alpha, r.beta, r.best) for r in arms.collect()} == {0: (3.0, 1.0, True), 1: (1.0, 2.0, False)}


def test_programs(spark):
    assert (program.number("SIFT"), program.number("THRESHOLD", 4), program.number("MODE", 1)) == (80, 92, 113)
    assert program.public_checks([49, 83, 0, 0, 0, 0, 0, 0]) == ((49 + 2 * 83) % 120, (3 * 49 + 5 * 83) % 103)
    assert program.keyed_checks([1, 2, 3], b"key") == (int.from_bytes(hmac.new(b"key", bytes([1, 2, 3]), "sha256").digest()[:4], "big") % 120, int.from_bytes(hmac.new(b"key", bytes([1, 2, 3]), "sha256").digest()[4:8], "big") % 103)
    numbers = [program.number("LOAD", 1), program.number("SIFT", 3), 0, 0]
    one, two = program.public_checks(numbers)
    rows = [(0, numbers, one, two)] + [(n, numbers[:k] + [(numbers[k] + e) % 120] + numbers[k + 1 :], one, two) for n, (k, e) in enumerate([(0, 1), (1, 5), (2, 9), (3, 119)], 1)]
    assert [r.id for r in program.accepted(spark.createDataFrame(rows, "id int, numbers array<int>, check_1 int, check_2 int")).collect()] == [0]
    assert program.instruction(program.number("THRESHOLD", 4)) == ("THRESHOLD", 4)
    with pytest.raises(ValueError):
        program.compiled([("NOP", 0)], program.Tables(spark.createDataFrame([], VECTORS), []))


def test_programs_as_vectors():
    whole = [*[program.number(*i) for i in (("LOAD", 0), ("SIFT", 7), ("THRESHOLD", 4))], 0, 0, 0, 0, 0]
    vector = program.as_vector(whole[:3], 512)
    assert program.from_vector(vector) == whole and program.from_vector(vector, b"key") is None
    assert program.from_vector(program.as_vector(whole, 512, b"key"), b"key") == whole
    checks, rng = program.public_checks(whole), random.Random(1)
    for _ in range(300):  # one slot changed under the old checks is refused
        bad, k = list(whole), rng.randrange(8)
        bad[k] = (bad[k] + rng.randrange(1, 120)) % 120
        assert program.public_checks(bad) != checks


def test_program_steps(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.integers(0, 16, 32).tolist()) for k in range(30)]
    marks = spark.createDataFrame(rows, VECTORS)
    queries = [marks.where("id in (3, 5)").withColumnRenamed("id", "qid"), marks.where("id in (7, 9)").select(F.when(F.col("id") == 7, 3).otherwise(5).cast("long").alias("qid"), "mark")]
    tables = program.Tables(marks, queries, perfect=32 * 127.0**2)
    state = program.State(marks)
    for step in (("HOLD", 4), ("BUNDLE", 0), ("BUNDLE", 1), ("FREEZE", 1), ("BUNDLE", 1), ("SHARPEN", 3)):
        state = program.stepped(state, *step, tables)
    got = {r.qid: r.mark for r in state.queries.collect()}
    for qid, other in ((3, 7), (5, 9)):
        v = sum(w * np.exp(2j * np.pi * np.array(rows[k][1]) / 16) for w, k in ((0.5, qid), (1, other)))
        assert got[qid] == sectors(np.rint(v.real * 127), np.rint(v.imag * 127)).tolist()
    assert state.temperature == 2.5 and program.stepped(state, "RELEASE", 0, tables).sum is None
    # The first program leaves both unanswered, as they are not marks of the region; the second answers from all marks.
    tables = program.Tables(marks, [spark.createDataFrame([(100, rows[3][1]), (101, rows[5][1])], "qid long, mark array<int>")], marks.select("id", F.when(F.col("id") == 4, 1).otherwise(0).alias("region")), perfect=32 * 127.0**2)
    out = program.ticked({0: [("FOCUS", 1), ("LOAD", 0), ("SIFT", 1), ("THRESHOLD", 7), ("PROG", 1)], 1: [("LOAD", 0), ("SIFT", 1), ("THRESHOLD", 7)]}, 0, tables, 2).collect()
    assert {(r.tick, r.program, r.qid, r.answer) for r in out} == {(0, 0, 100, None), (0, 0, 101, None), (1, 1, 100, 3), (1, 1, 101, 5)}


def test_slots_come_back(spark):
    rng = random.Random(4)
    members = [(s, x) for s, n in enumerate([1, 5, 20]) for x in rng.sample(range(decode.STATES), n)]
    slots = decode.slots(spark.createDataFrame(members + members[:1], "slot long, x long"), "slot", "x")
    for reader in ("scan", "peel", "ladder"):
        found = {(r.slot, m.x) for r in decode.read(slots, reader).collect() for m in r.members}
        assert found == set(members), reader
    assert {r.slot: r.rung for r in decode.read(slots, "ladder").collect()}[0] == "SIEVE"
    noisy = decode.encoded(np.array([77]))[0] + 0.2 * np.random.default_rng(0).standard_normal(decode.PLACES)
    assert decode.laddered(noisy, decode.PLACES, 0)[1] == "RESONATE" and decode.laddered(noisy, decode.PLACES, 0)[0][0][0] == 77
    learner = decode.Learner()
    for _ in range(60):
        arm = learner.choose("few")
        learner.learn("few", arm, float(arm == "peel"))
    assert learner.best("few") == "peel"
    empty = np.zeros(decode.PLACES, dtype=complex)
    assert decode.laddered(empty, decode.PLACES, 0) == ([], "ABSTAIN")
    assert decode.from_residues([x % m for x, m in zip([77] * 5, (3, 5, 7, 13, 17))]) == (77, "VERIFIED")


def test_a_shift_resets_its_counter(spark):
    rows = [("m", k, float(b), 0.3) for k, b in enumerate([0, 1, 2, 3, 0, 0, 0, 0, 0, 5, 4])]
    out = shifts(spark.createDataFrame(rows, "k string, t long, b double, l double"), "k", F.floor(F.col("t") / 3), ["t"], F.col("b"), F.col("l")).collect()
    assert {(r.n, r.gear, r.shift) for r in out} == {(2, 1, 1), (7, 2, -1)}


def governed(rows, temp):
    """The same, window by window. rows: (backlog, load, waiting, temperature, seconds)."""
    gear, grown, quiet, before, last, out = 1, 0, 0, 0.0, None, []
    for n, (b, load, waits, t, at) in enumerate(rows):
        burning = last is not None and at - last <= 10
        held = temp and burning and not t < 90
        hot = temp and t >= 95 and not burning
        last = None if t < 90 else at if t >= 95 else last
        was = gear
        if hot:
            gear = 0
        elif held:
            pass
        elif gear == 3 and waits:
            gear, grown, quiet = 2, 0, 0
        else:
            locked = load >= 0.92 and b > 0
            grown, quiet = grown + 1 if b > before else 0, quiet + 1 if b == 0 and load < 0.5 else 0
            if (grown >= 2 or locked) and gear < 3:
                if not (gear == 2 and waits):
                    gear, grown = gear + 1, 0
            elif quiet >= 4 and gear > 1:
                gear, quiet = gear - 1, 0
        before = b
        if gear != was:
            out.append((n, was, gear - was))
    return out


@pytest.mark.parametrize("temp", [False, True])
def test_governor_across_pieces_and_groups(spark, monkeypatch, temp):
    from marklake.operators import shifts as module

    monkeypatch.setattr(module, "PIECE", 7)
    monkeypatch.setattr(module, "GROUP", 3)
    rng, rows = random.Random(4), {}
    for host in "ab":
        b, t, own = 0, 80.0, []
        for k in range(150):
            b = max(0, b + rng.choice([-3, -1, 0, 1, 1, 2]))
            t = min(99.0, max(70.0, t + rng.choice([-6.0, 0.0, 5.0])))
            own.append((float(b), rng.choice([0.2, 0.6, 0.95]), rng.choice([0, 0, 0, 2]), t, 2 * k))
        rows[host] = own
    df = spark.createDataFrame([(h, dt.datetime.fromtimestamp(10**9 + r[4]), *r[:4]) for h, own in rows.items() for r in own], "k string, ts timestamp, b double, l double, w int, t double")
    got = shifts(df, "k", F.floor(F.unix_micros("ts") / 50_000_000), ["ts"], F.col("b"), F.col("l"), waiting=F.col("w"), temperature=F.col("t") if temp else None).collect()
    assert sorted((r.key, r.n, r.gear, r["shift"]) for r in got) == sorted((h, *x) for h, own in rows.items() for x in governed(own, temp))


def test_closure_of_ways_and_rings(spark):
    rng = random.Random(9)
    edges = {(k, k + 1) for k in range(37)} | {(rng.randrange(38), rng.randrange(38)) for _ in range(12)} | {(5, 5)}
    want: dict[tuple[int, int], int] = {}
    for a in range(38):
        seen, front, hops = {}, {a}, 0
        while front:
            hops += 1
            front = {d for s, d in edges if s in front} - seen.keys()
            seen |= dict.fromkeys(front, hops)
        want |= {(a, b): h for b, h in seen.items()}
    df = spark.createDataFrame([*edges, (None, 1), (0, 1)], "src long, dst long")
    assert {(r.src, r.dst): r.hops for r in triples.closure(df).collect()} == want
    assert triples.closure(df.limit(0)).count() == 0


def test_gaps_say_why(spark):
    rows = [("strong", f"e{k}", 0.9, 0.1, None) for k in range(40)] + [("weak", f"o{k:02}", 0.1 if k < 20 else 0.5, 0.0, f"fix{k % 2}:12") for k in range(40)] + [("few", "t", 0.0, 0.9, "x:1")] + [("claims", f"d{k}", 0.9, 0.0, None) for k in range(25)]
    df = spark.createDataFrame(rows, "head string, item string, m double, v double, because string")
    found = memory.gaps(df, "head", F.col("m"), F.col("v"), unproved=spark.createDataFrame([("claims", 3)], "head string, unproved long"), item=F.col("item"), because=F.col("because"))
    got = {r["head"]: r for r in found.withColumn("brief", memory.brief(found)).collect()}
    assert set(got) == {"weak", "claims"} and got["claims"].unproved == 3 and got["weak"].abstain_rate == 0.5
    assert got["weak"].examples == [f"o{k:02}" for k in range(10)] and got["weak"].precedents == {"fix0": 10, "fix1": 10}
    assert "weak" in got["weak"].brief and "abstain 50%" in got["weak"].brief and "fix0 10" in got["weak"].brief and "3 unproved" in got["claims"].brief


def test_profiles_recognise(spark):
    table, prose = "# Plan\n| a | b |\n|---|---|\n| 1 | 2 |\n- one\n- two", "The tide answers the moon. It comes and goes, and nobody asks. Short. Then a longer sentence carries the melody home."
    docs = spark.createDataFrame([("t", table)] * 3 + [("p", prose)] * 3, "kind string, text string")
    features, elements = text.document_features(F.col("text")), text.structure(F.col("text"))
    profiles = {}
    for kind in "tp":
        own = docs.where(F.col("kind") == kind).withColumn("doc", F.monotonically_increasing_id())
        wanted = sorted(r.element for r in memory.template(own, "doc", elements, 0.6).collect())
        profiles[kind] = (memory.profile(own, features), wanted)
    assert profiles["t"][1] == ["H1:plan", "T:table"] and profiles["p"][1] == []
    r = docs.select("kind", memory.recognised(features, elements, profiles).alias("found"), memory.fit(features, elements, profiles["t"]).alias("fit"), memory.missing(elements, profiles["t"][1]).alias("missing")).collect()
    assert all(x.kind == x.found for x in r) and all(x.fit > 0.99 and x.missing == [] for x in r if x.kind == "t") and all(x.missing == ["H1:plan", "T:table"] for x in r if x.kind == "p")
