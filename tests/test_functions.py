import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklake.functions import phases as P
from marklake.functions import residue as R
from marklake.functions import text as X


def test_known_hash_values():
    assert P.fnv1a64(b"ab") == 620445648566982762
    assert int(P.splitmix64(np.zeros(1, dtype=np.uint64))[0]) == 0xE220A8397B1DCDAF
    mark = P.codeword("golden-0", 5120)
    assert mark.min() == 0 and mark.max() == 15
    c, s = np.array(P.C8), np.array(P.S8)
    assert int((c[mark] ** 2 + s[mark] ** 2).sum()) == 82_567_974


def test_sectors_agree_with_angles(spark):
    rng = np.random.default_rng(3)
    re, im = rng.integers(-1000, 1000, (2, 4000))
    want = np.mod(np.rint(np.arctan2(im, re) * 8 / np.pi), 16)
    far = np.abs(np.mod(np.arctan2(im, re) * 8 / np.pi, 1) - 0.5) > 0.01
    assert (P.sectors(re, im)[far] == want[far]).all() and P.sectors(np.zeros(1), np.zeros(1))[0] == 0
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(re[:300], im[:300])], "re int, im int")
    got = [r.p for r in rows.select(P.sector16(F.col("re"), F.col("im")).alias("p")).collect()]
    assert got == P.sectors(re[:300], im[:300]).tolist()


def test_packing_and_binding_come_back(spark):
    m = F.col("m")
    df = spark.createDataFrame([(P.codeword(f"x{k}", 128).astype(int).tolist(), P.codeword(f"y{k}", 128).astype(int).tolist()) for k in range(20)], "m array<int>, k array<int>")
    r = df.select("m", P.unpacked_pairs(P.packed_pairs(m)).alias("a"), P.unpacked_blocks(P.packed_blocks(m)).alias("b"), P.unbound(P.bound(m, F.col("k")), F.col("k")).alias("c"), P.similarity(m, m).alias("s"), P.shifted(P.shifted(m, 5), 11).alias("d")).collect()
    assert all(x.m == x.a == x.b == x.c == x.d and x.s == 127 * 128 for x in r)


def test_residues_detect_every_single_error(spark):
    x = spark.range(1365).select(F.col("id"))
    parts = R.residues(F.col("id"))
    assert x.where((R.solve_crt(parts, (*R.RINGS, R.CHECK)) != F.col("id")) | (R.checked(parts) != "VERIFIED")).count() == 0
    with pytest.raises(ValueError):
        R.solve_crt(parts, R.RINGS)
    assert spark.range(1).select(R.checked([F.lit(None).cast("int")] * 5).alias("s")).first().s == "ABSTAIN"


def test_encoded_marks_keep_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3, 64))
    rows = [(0, x[0].tolist()), (1, (x[0] + 0.05 * x[1]).tolist()), (2, x[2].tolist()), (3, None), (4, []), (5, [0.0] * 64)]
    marks = {r.id: r.mark for r in P.encoded_marks(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 256).collect()}
    score = lambda a, b: np.cos((np.array(marks[a]) - np.array(marks[b])) * np.pi / 8).mean()
    assert score(0, 1) > 0.9 > 0.3 > score(0, 2) and marks[3] is None and marks[4] is None and set(marks[5]) == {0}


def test_texts(spark):
    df = spark.createDataFrame([("# Plan\n\n**Owner:** me\n| a | b |\n- one\nShort one. And a longer sentence here!",), ("",), (None,)], "t string")
    t = F.col("t")
    r = df.select(X.structure(t).alias("s"), X.style(t)["sent_mean"].alias("m"), X.style(t)["list_density"].alias("l"), X.trigrams(t).alias("g"), X.grams(t).alias("w")).collect()
    assert set(r[0].s) == {"H1:plan", "L:owner", "T:table"} and r[0].l == pytest.approx(2 / 5) and r[1].m == 0.0 and r[2].s is None
    assert r[0].w[:3] == ["plan", "owner", "me"] and "plan owner" in r[0].w
    secret = spark.createDataFrame([("a\tapi_key=abc123 sk-abcdefghijklmnopqrstu b",)], "t string").select(X.redacted(F.col("t")).alias("t")).first().t
    assert "abc123" not in secret and "sk-abc" not in secret and "\t" not in secret


def digest(a):
    return hashlib.sha256(np.ascontiguousarray(a).tobytes()).hexdigest()[:32]


def test_pinned_digests():
    """Codewords, projections, encodings and scores are those of the published conformance set."""
    labels = [*[f"golden-{k}" for k in range(16)], "", "ümlaut", "E:Paris", "R:P36"]
    book = np.stack([P.codeword(x, 5120) for x in labels])
    assert digest(book) == "af6fbd74d882c2caf52239403ee8637f"
    re, im = (P.ternary_rows(f"golden:{part}", 64, 256) for part in ("re", "im"))
    assert digest(re) == "dd92ff342538fbd8535fab3961f627db" and digest(im) == "7a990828c5df333a4c45680d426489cb"
    x = np.stack([(P.nibbles(f"GX:{k}", 64).astype(np.float32) - 7.5) / np.float32(7.5) for k in range(16)])
    q = np.rint(x * (np.float32(127) / np.abs(x).max(1, keepdims=True))).astype(np.int64)
    assert digest(P.sectors(q @ re.astype(np.int64), q @ im.astype(np.int64))) == "4230398b9e2f2ee59e5eec8203cf9577"
    c, s = np.array(P.C8, np.int32)[book], np.array(P.S8, np.int32)[book]
    assert digest((c[:4] @ c.T + s[:4] @ s.T).astype(np.int32)) == "d484194445ab404b90ca68a85ef55cc7"


def test_complex_and_ternary_binding(spark):
    rng = np.random.default_rng(8)
    a, b = np.exp(2j * np.pi * rng.random((2, 12)))
    pairs = lambda v: [(float(x.real), float(x.imag)) for x in v]
    df = spark.createDataFrame([(pairs(a), pairs(b))], "a array<struct<re: double, im: double>>, b array<struct<re: double, im: double>>")
    r = df.select(P.complex_bound(F.col("a"), F.col("b")).alias("c")).first().c
    assert np.allclose([x.re + 1j * x.im for x in r], a * b)
    back = df.select(P.complex_unbound(P.complex_bound(F.col("a"), F.col("b")), F.col("b")).alias("c")).first().c
    assert np.allclose([x.re + 1j * x.im for x in back], a)
    t, u = rng.integers(-1, 2, (2, 60))
    words = lambda v: ([sum(1 << k for k in range(60) if v[k] < 0)], [sum(1 << k for k in range(60) if v[k])])
    df = spark.createDataFrame([(*words(t), *words(u))], "sa array<bigint>, aa array<bigint>, sb array<bigint>, ab array<bigint>")
    sign, active = P.ternary_bound(F.col("sa"), F.col("aa"), F.col("sb"), F.col("ab"))
    r = df.select(sign.alias("s"), active.alias("a")).first()
    assert (r.s, r.a) == words(t * u)


def test_frames_of_atoms(spark):
    axes = spark.range(16).select("id", P.orthogonal(F.col("id"), 16, 64).alias("m"))
    assert P.min_separation(axes, "m").first().separation == pytest.approx(2**0.5)
    assert P.min_separation(axes.limit(1), "m").first().separation is None
    corners = spark.range(4).select("id", P.simplex(F.col("id"), 4, 63).alias("m"))
    assert P.min_separation(corners, "m").first().separation == pytest.approx((2 + 2 / 3) ** 0.5)
    assert spark.range(1).select(P.rectified(F.array(F.lit(-1.5), F.lit(2.0))).alias("v")).first().v == [0.0, 2.0]


def test_secrets_go(spark):
    texts = ["key sk-abcdefghijklmnopqrstuvwxyz123", "api_key=hunter2", "plain title\twith tab", "AIza" + "x" * 32, "ghs_" + "a" * 24, "xoxa-1234567890", "a" * 40, "Password : x y", "a" * 39]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.redacted(F.col("t")).alias("t")).collect()]
    gone = "[REDACTED]"
    assert got == [f"key {gone}", gone, "plain title with tab", gone, gone, gone, gone, f"{gone} y", "a" * 39]


def test_form_keeps_order_and_repeats(spark):
    doc = "## Plan — later 2024-01-02\n**Owner:** me **Owner:** you\n| a |\n| b |\n# Plan\n**12:** x"
    r = spark.createDataFrame([(doc,)], "t string").select(X.structure(F.col("t")).alias("s"), *[c.alias(k) for k, c in X.document_features(F.col("t")).items()]).first()
    assert r.s == ["H2:plan", "L:owner", "L:owner", "T:table", "T:table", "H1:plan"]
    assert (r.headings_per_line, r.labels_per_line, r.table_rows_per_line) == (2 / 6, 3 / 6, 2 / 6)


def test_rhythm_of_prose(spark):
    t = "Evening water climbs the patient shore through a long hour of gathering light, gathering weight, rising over stones that remember every earlier tide and every quiet return. Then it falls back. The water does not rest; it returns, rather than ending, to the patient shore where evening water began."
    p = X.prosody(F.col("t"))
    r = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(*[c.alias(k) for k, c in p.items()], X.style(F.col("t"))["para_cv"].alias("para_cv")).collect()
    assert r[0].rests == 0.5 and r[0].antithesis == pytest.approx(1 / 3) and r[0].ring > 0 and 0 <= r[0].landing <= 1 and r[0].para_cv == 0 and r[1].breath_median == 0
    words = [len(re.findall("[A-Za-z']+", x)) for s in re.split(r"(?<=[.!?])\s+", t) for x in re.split(r"[,;:—()]|\s-\s|--", s)]
    assert r[0].breath_median == np.median(words) and r[0].breath_spread == pytest.approx(np.percentile(words, 90) - np.percentile(words, 10))
    paragraphs = spark.createDataFrame([("one two three\n\none",)], "t string").select(X.style(F.col("t"))["para_cv"].alias("v")).first().v
    assert paragraphs == pytest.approx(0.5)
    kept = spark.createDataFrame([("abcdef", "abcxyz", True), ("abc", None, False)], "d string, f string, q boolean").select(X.kept(F.col("d"), F.col("f"), F.col("q")).alias("r")).collect()
    assert kept[0].r < 0.5 and kept[1].r == 1.0
