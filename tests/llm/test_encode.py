import random

import numpy as np

from marklake.llm.encode_corpus import VOCABULARY, Piece, encode_corpus, encoder, tree

ALPHABETS = ["ab", "aA 'sre", "abcdefgh ", " \n\t x", "é漢🙂a ", "0123 .,!?'ll", "=-#_*"]


def test_joined_pieces_equal_the_whole():
    enc = encoder(VOCABULARY)
    rng = random.Random(7)
    for n in range(400):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) * rng.choice([1, 1, 1, 7]) for _ in range(rng.randint(1, 300)))
        if n % 4 == 0:
            text = "".join(rng.choice("abcdeé") for _ in range(2500)) + text
        size = rng.choice([1, 2, 5, 40, 333])
        pieces = [Piece.of(p, np.asarray(enc.ids(p)), enc) for p in (text[i : i + size] for i in range(0, len(text), size))]
        assert tree(pieces, enc).ids() == enc.ids(text)


def test_nulls_copies_and_long_texts(spark):
    enc = encoder(VOCABULARY)
    long = "word' s  \n naïve 漢字" * 40 + "x" * 700
    rows = [(1, None, 0), (2, "", 1), (3, " ", 2), (4, long, 3), (4, long, 3), (None, "null id", 4), (5, "<|endoftext|>", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for fan in (64, 4, 1 << 20):  # joined in place, over several levels of tasks, in place again
        got = sorted(((r.doc_id or -1), r.ids) for r in encode_corpus(df, piece_chars=50, fan=fan).collect())
        assert got == sorted(((i or -1), enc.ids(t or "")) for i, t, _ in rows)
    assert encode_corpus(df.limit(0)).count() == 0


def test_same_ids_as_the_other_library(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_corpus(docs).collect():
        assert r.ids == t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_texts_of_megabytes(spark):
    """A text of words, one of a single word and one of blanks, each of a million characters and more, with the parameters of the query."""
    enc, rng = encoder(VOCABULARY), random.Random(2)
    words = [f"{rng.choice(['naïve', 'foo', '漢字', 'x' * 40, '12345'])}{rng.choice([' ', chr(10), ', ', '   '])}" for _ in range(150_000)]
    texts = {1: "".join(words), 2: "ab" * 600_000, 3: "word" + " " * 1_000_000 + "end", 4: "short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert len(texts[1]) > 1_000_000
    for k, text in texts.items():
        if k == 3:  # the library's pattern search overflows its stack on so many blanks
            assert got[k] == [*enc.ids("word"), *enc.word(b" " * 999_999), *enc.ids(" end")]
        else:
            assert got[k] == enc.ids(text)
