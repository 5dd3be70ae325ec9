import pytest

from marklake.llm.encodings import LEGACY, ONE_BYTE, Pairs, bytes_of, decoded, judged, letter_pairs, repaired

CLEAN = ["SÃO PAULO", "Ã or ã?", "ÀÉÎÕÜ Ålund Østvik", "20 °C, ±3 µm", "©2031 Name™ £40 / €35", "«СССР» и «НАТО»", "x² + y³ Δφ ≈ π/8", "三角形のテスト 🙂🚀", "a‍b​c", "“été” — l’été… «été»", "хлёлёны ЁЛСТАЦАДОМТО", "é̈", "", " ", None, "plain", "ныйпри. ‘умшу’ … “умшу” — «умшу»", "été…» où…» 東京 7"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs = Pairs(letter_pairs(docs))
    clean = {d: t for d, t in texts.items() if t and not t.isascii() and len(t) > 60 and not judged(t, pairs, 14.0, 1.0)[0]}
    return pairs, clean


def garbled(text, wrong, meant="utf-8"):
    back = {b: c for c, b in bytes_of(wrong).items()}
    return "".join(back[b] if b > 127 else chr(b) for b in text.encode(meant))


@pytest.mark.parametrize("wrong", ["cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman"])
@pytest.mark.parametrize("nested", [False, True])
def test_layers_of_utf8_come_back(corpus, wrong, nested):
    pairs, clean = corpus
    n = found = whole = 0
    for text in list(clean.values())[:200]:
        if sum(c > "\x7f" for c in text) < 6 or not all(ord(c) < 0x460 for c in text):
            continue
        made = garbled(text, wrong)
        if nested:
            made = garbled(made, "cp1252")
        got = judged(made, pairs, 14.0, 1.0)
        n, found, whole = n + 1, found + got[0], whole + (got[1] == text)
    assert n > 100 and found >= 0.99 * n
    assert whole >= (0.85 * n if not nested else 0.5 * n if wrong == "cp1252" else 0)


@pytest.mark.parametrize("wrong,meant,least", [("cp1251", "koi8_r", 0.95), ("cp1252", "cp1251", 0.95), ("koi8_r", "cp1251", 0.95), ("cp1252", "cp1250", 0.9), ("cp1252", "iso8859_2", 0.9)])
def test_one_byte_encodings_come_back(corpus, wrong, meant, least):
    pairs, clean = corpus
    n = found = whole = 0
    for text in clean.values():
        foreign = [c for c in text if c > "\x7f"]
        try:
            made = garbled(text, wrong, meant)
        except (UnicodeEncodeError, KeyError):
            continue
        if len(foreign) < 12 or made == text or (meant in ("cp1250", "iso8859_2")) != any(c in "ąęśłżź" for c in text):
            continue
        got = judged(made, pairs, 14.0, 1.0)
        n, found, whole = n + 1, found + got[0], whole + (got[1] == text)
    assert n > 10 and found >= least * n and whole >= 0.8 * n


def test_clean_texts_and_lost_ones(spark, corpus):
    pairs, clean = corpus
    rows = [(k, t, "clash") for k, t in enumerate(CLEAN)] + [(100, "caf� au", ""), (101, "caf� nÃ©e", ""), (None, "une nÃ©eau", ""), (102, "une nÃ©eau", ""), (102, "une nÃ©eau", ""), (103, "ici æ\x9d±äº¬ 7", ""), (104, "brinmorcor. ≡ƒÖé≡ƒÜÇ", ""), (105, "nur ‚Ç¨35", ""), (106, "a. ‚Äôtis so", "")]
    rows += [(1000 + k, t, "") for k, t in enumerate(clean.values())]
    got = repaired(spark.createDataFrame(rows, "doc_id long, text string, garbled string")).collect()
    assert len(got) == len(rows)
    bad = {(r.doc_id, r.restored, r.complete) for r in got if r.garbled}
    assert bad == {(100, "caf� au", False), (101, "caf� née", False), (None, "une néeau", True), (102, "une néeau", True), (103, "ici 東京 7", True), (104, "brinmorcor. 🙂🚀", True), (105, "nur €35", True), (106, "a. ’tis so", True)}
    assert repaired(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_strict_decoding():
    assert decoded("cp1252", "Ã©") == "é" and decoded("cp1252", "Ã ") is None and decoded("cp1252", "ÃÃ") is None


@pytest.mark.parametrize("wrong,meant,letters", [("cp1252", "cp1250", "ąęł"), ("cp1252", "cp1251", "ыие"), ("koi8_r", "cp1251", "ыие")])
def test_wholly_garbled_language(spark, corpus, wrong, meant, letters):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    made = {}
    for d, text in corpus[1].items():
        if sum(c in letters for c in text) >= 6:
            try:
                made[d] = garbled(text, wrong, meant)
            except (UnicodeEncodeError, KeyError):
                docs[d] = None  # none of the language stays readable
    rows = [(d, made.get(d, t)) for d, t in docs.items()]
    got = {r.doc_id: r for r in repaired(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id in made}
    assert len(made) > 40 and sum(r.garbled for r in got.values()) >= 0.98 * len(made)
    assert sum(got[d].restored == corpus[1][d] for d in made) >= 0.9 * len(made)


def test_words_with_other_signs_count_for_what_is_hoped(corpus):
    word = garbled("łąść×źdźwę", "cp1252", "cp1250")
    assert ("cp1252", "cp1250") in [ONE_BYTE[k] for k, _ in corpus[0].gains(word)]
