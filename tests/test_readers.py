import random

import numpy as np
import pytest

from marklake.operators import decode, readers, triples

RNG = np.random.default_rng(5)


def slot(members, places=2048):
    return decode.encoded(np.array(members), places).sum(0).astype(complex)


def test_cued_settling_reads_a_few_members():
    assert [x for x, _ in readers.cued(slot([77]), 2048, 0, sweeps=1)] == [77] and readers.cued(np.zeros(2048, complex), 2048, 0) == []
    members = [5, 700, 1300, 901]
    found = {x for x, _ in readers.cued(slot(members), 2048, 0)}
    assert found <= set(members) and len(found) >= 3


def test_joint_search_reads_crowded_slots():
    rng = random.Random(2)
    for n in (1, 12, 24):
        members = rng.sample(range(decode.STATES), n)
        assert {x for x, _ in readers.joint(slot(members), 2048, 0, size=2048)} == set(members)
    assert readers.joint(np.zeros(2048, complex), 2048, 0) == []


@pytest.mark.parametrize("shape", ["CONTIG", "STRIDE", "TRI", "HEX", "RANDOM"])
def test_blocks_vote(shape):
    parts = readers.blocks(shape, 1024)
    assert sorted(np.concatenate(parts).tolist()) == list(range(1024))
    noisy = slot([901], 1024) + 0.5 * (RNG.standard_normal(1024) + 1j * RNG.standard_normal(1024))
    residues, agreement = readers.parted(noisy, 1024, 0, shape)
    assert decode.from_residues(residues) == (901, "VERIFIED") and agreement > 0.5
    with pytest.raises(ValueError):
        readers.blocks("ROUND", 64)


def test_guided_reading_says_how_sure_it_is():
    assert readers.guided(slot([77, 900]), 2048, 0, 77 % 13)[:2] == (77, "VERIFIED")
    data = np.prod([b[77 % m] for m, b in zip((3, 5, 7, 13), decode.books(2048))], axis=0)
    assert readers.guided(data, 2048, 0, 77 % 13, check=False)[:2] == (77, "CONVERGED")
    illegal = readers.codeword(20_000, 2048)
    assert readers.guided(illegal, 2048, 0, 20_000 % 13)[:2] == (None, "REJECTED")
    assert readers.unguided(np.array([3, 77, 1200]), 1024, 0) == 1.0


def test_readers_over_tables(spark):
    rng = random.Random(4)
    members = [(s, x) for s, n in enumerate([1, 4, 9]) for x in rng.sample(range(decode.STATES), n)]
    rows = decode.slots(spark.createDataFrame(members, "slot long, x long"), "slot", "x")
    for reader in ("joint", "auto"):
        assert {(r.slot, m.x) for r in decode.read(rows, reader).collect() for m in r.members} == set(members)
    part = readers.refined(rows, spark.createDataFrame(members, "slot long, x long"), "slot", "x").collect()
    assert [r.right for r in part] == [1.0] * 3


def test_slots_shuffle_numbers_only(spark, small):
    """Codewords of 8 kB are made after the last shuffle, once for each slot, and read once."""
    from marklake.plans import queries as core

    rows = decode.slots(spark.createDataFrame([(s, x) for s in range(50) for x in range(s % 7 + 1)], "slot long, x long"), "slot", "x")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan[plan.index("Exchange") :]
    whole = np.stack([np.frombuffer(r.re, np.float32) + 1j * np.frombuffer(r.im, np.float32) for r in sorted(rows.collect())])
    assert np.abs(whole - [slot(range(s % 7 + 1), decode.PLACES) for s in range(50)]).max() < 1e-4
    assert core.queries()["slots_read"](spark, small)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


def test_strangers_in_crowded_slots_are_taken_off():
    members = [17, 50, 67, 167, 312, 323, 360, 565, 568, 592, 613, 769, 783, 826, 878, 900, 1001, 1291, 1322]
    noisy = slot(members, decode.PLACES) + 0.1 * np.random.default_rng(0).standard_normal(decode.PLACES)
    read, kept, none = decode.scanned(np.stack([slot(members, decode.PLACES), noisy, np.zeros(decode.PLACES, complex)]), decode.PLACES, 0)
    assert sorted(x for x, _ in read[0]) == members and read[1] == "SCAN" and set(members) <= {x for x, _ in kept[0]} and none[0] == []
    rng = random.Random(7)
    for n in (1, 2, 24, 60, 120):
        own = rng.sample(range(decode.STATES), n)
        assert {x for x, _ in decode.exhaustive(slot(own, decode.PLACES), decode.PLACES, 0)} == set(own)


def test_the_ladder_takes_slots_of_several_members_together(monkeypatch):
    """As slot by slot, but the readers for one member are not tried on those of several."""
    rng = random.Random(8)
    rows = [slot(rng.sample(range(decode.STATES), n), decode.PLACES) for n in (2, 1, 9, 3, 24)] + [np.zeros(decode.PLACES, complex), 1.2 * np.exp(2j * np.pi * np.random.default_rng(0).random(decode.PLACES))]
    rows = np.stack(rows).astype(np.complex64)
    one_by_one = [decode.laddered(s, decode.PLACES, 0) for s in rows]
    monkeypatch.setattr(decode, "resonated", None)
    together = decode.READERS["ladder"](rows, decode.PLACES, 0)
    assert [(sorted(x for x, _ in f), rung) for f, rung in together] == [(sorted(x for x, _ in f), rung) for f, rung in one_by_one]
    assert [rung for _, rung in together] == ["SCAN", "SIEVE", "SCAN", "SCAN", "SCAN", "ABSTAIN", one_by_one[-1][1]]


def test_slots_longer_than_a_batch(spark):
    every = [(s, x) for s in (-3, 0, 8) for x in range(decode.STATES)] + [(9, 7), (None, 7), (9, None)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        got = {r.slot: np.frombuffer(r.re, np.float32) + 1j * np.frombuffer(r.im, np.float32) for r in decode.slots(spark.createDataFrame(every, "slot long, x long"), "slot", "x").coalesce(1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == [-3, 0, 8, 9] and np.abs(got[9] - slot([7], decode.PLACES)).max() < 1e-6
    assert all(np.abs(got[s] - slot(range(decode.STATES), decode.PLACES)).max() < 1e-2 for s in (-3, 0, 8))


def test_refinement_lets_members_lead(spark):
    """A slot kept as signs only, in which many members come out below strangers, reads right after refinement."""
    rng = random.Random(3)
    own = sorted(rng.sample(range(decode.STATES), 90))
    total = slot(own, decode.PLACES)
    coarse = np.sign(total.real) + 1j * np.sign(total.imag)
    row = [(0, coarse.real.astype(np.float32).tobytes(), coarse.imag.astype(np.float32).tobytes())]
    df, members = spark.createDataFrame(row, "slot long, re binary, im binary"), spark.createDataFrame([(0, x) for x in own], "slot long, x long")
    before = readers.refined(df, members, "slot", "x", passes=0).first().right
    after = readers.refined(df, members, "slot", "x", passes=20).first().right
    assert before < after and after > 0.98


def test_every_direct_mark_reads_back():
    x = np.arange(decode.STATES)
    residues, _ = readers.probed(np.exp(2j * np.pi * readers.direct(x) / 16), 1024, 0)
    assert [decode.from_residues(r) for r in residues.tolist()] == [(int(k), "VERIFIED") for k in x]


def test_clamping(spark):
    x = np.array([3, 77, 1364])
    marks = readers.direct(x)
    noisy = (marks + np.random.default_rng(1).choice([0, 0, 1, 15], marks.shape)) % 16
    residues = [77 % m for m in (3, 5, 7, 13)] + [(77 % 17 + 1) % 17]
    wrong = np.mod(np.rint(np.angle(sum(b[r] for b, r in zip(readers.direct_books(), residues))) * 8 / np.pi), 16).astype(int)
    rows = [(k, m.tolist()) for k, m in enumerate(noisy)] + [(3, wrong.tolist()), (4, [0] * 1024), (5, None), (6, [1, 2])]
    got = {r.id: r for r in readers.clamped(spark.createDataFrame(rows, "id int, mark array<int>"), "id", "mark").collect()}
    assert [(got[k].status, got[k].x) for k in range(3)] == [("CLAMPED", v) for v in x.tolist()] and got[1].clean == marks[1].tolist()
    assert got[3].status == "SLIP_REJECTED" and got[4].status != "CLAMPED" and got[5].status is None and got[6].status is None


def test_names_and_nests(spark):
    names, numbers = triples.registered(spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("a", 2, 2)], "symbol string, x int, n int"), ["n"], 1365)
    assert {r.symbol: r.x for r in names.collect()} == {"a": 2, "b": 1} and {r.x: r.symbol for r in numbers.collect()} == {1: "b", 2: "a"}
    with pytest.raises(Exception, match="out of bounds"):
        triples.registered(spark.createDataFrame([("a", 1365, 0)], "symbol string, x int, n int"), ["n"], 1365)[0].collect()
    groups, facts = spark.createDataFrame([(0, 0, 10), (0, 1, 11)], "grp int, pos int, polygon int"), spark.createDataFrame([(10, "s", "r", "o"), (11, "s", "r", "p")], "polygon int, s string, r string, o string")
    queries = spark.createDataFrame([(1, 0, 1, "s", "r"), (2, 0, 0, "s", "x")], "qid int, grp int, pos int, s string, r string")
    assert [tuple(r) for r in triples.nested_facts(groups, facts, queries).collect()] == [(1, 11, "p")]
