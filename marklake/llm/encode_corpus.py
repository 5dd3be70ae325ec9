"""Token ids of every text by a public byte-level BPE vocabulary.

A text is cut into pieces of `piece_chars` characters, each piece is encoded, and the encoded pieces are joined pairwise, in a tree. Around each cut the window
that is encoded again grows until it agrees with what the left and the right side already have, so the ids equal those of the uncut text. Texts of up to `fan` pieces are cut and joined where they lie, without a shuffle. The pieces
of longer texts are spread over all tasks, and a task joins at most `fan` neighbours of a text: at each of `LEVELS` levels that many become one, which is enough for the longest text that a row can hold.

* Words (the vocabulary's pre-tokens) are found by a pattern that only looks forward, so from a position where both the window and the right side
  begin a word, everything that follows is the same.
* Inside one word that a cut runs through (it may be megabytes long), a sequence of tokens is the word's encoding exactly if every two neighbouring
  tokens are the encoding of the bytes they cover. The token window therefore grows until its first tokens are those of the left side
  and its last ones those of the right side.

Empty and null texts give an empty list. Repeated rows give repeated rows; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to the vocabulary.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """The vocabulary with what joining needs: words, single words' ids and the bytes of each id."""

    def __init__(self, vocabulary: str) -> None:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(WORDS)
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def ids(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def word(self, data: bytes) -> list[int]:
        return self.bpe._encode_single_piece(data)

    def starts(self, text: str, begin: int = 0, end: int | None = None) -> list[int]:
        return [m.start() for m in self.words.finditer(text[begin:end])]


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class Piece:
    """A text with its words' starts (in characters) and, for each word, the ids."""

    def __init__(self, text: str, starts: list[int], ids: list[list[int]]) -> None:
        self.text, self.starts, self.words = text, starts, ids

    @classmethod
    def of(cls, text: str, ids: np.ndarray, enc: Encoder) -> Piece:
        starts = enc.starts(text)
        sizes = [len(text[a:b].encode()) for a, b in zip(starts, [*starts[1:], len(text)])]
        at = np.searchsorted(np.concatenate([[0], np.cumsum(enc.width[ids])]), np.concatenate([[0], np.cumsum(sizes)]))
        return cls(text, starts, [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])])

    def ids(self) -> list[int]:
        return [i for word in self.words for i in word]


def agreed(left: list[int], right: list[int], enc: Encoder, first: int = 8) -> list[int]:
    """The ids of one word from the ids of its two parts."""
    data = {}

    def text(ids: list[int]) -> bytes:
        return b"".join(data[i] if i in data else data.setdefault(i, enc.bpe.decode_single_token_bytes(i)) for i in ids)

    k = first
    while True:
        a, b = left[-k:], right[:k]
        window = enc.word(text(a) + text(b))
        left_ok = len(a) == len(left) or window[:2] == a[:2]
        right_ok = len(b) == len(right) or window[-2:] == b[-2:]
        if left_ok and right_ok:
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 4


def joined(left: Piece, right: Piece, enc: Encoder, first: int = 64) -> Piece:
    """The piece of both texts one after the other."""
    if not left.text or not right.text:
        return left if left.text else right
    text, cut, width = left.text + right.text, len(left.text), first
    there = {cut + s: k for k, s in enumerate(right.starts)}
    while True:
        k = bisect_right(left.starts, cut - width) - 1  # the last certain start of a word
        a = left.starts[k] if k >= 0 else 0
        k = max(k, 0)
        b = min(len(text), cut + width)
        starts = [a + s for s in enc.starts(text, a, b)]
        whole = b == len(text)
        meet = next((s for s in starts if s >= cut and s in there and (whole or s <= b - 4)), len(text) if whole else None)
        if meet is not None:
            break
        width *= 4
    starts = starts[: bisect_left(starts, meet)]
    ids = []
    for s, e in zip(starts, [*starts[1:], meet]):
        if s < cut < e and e - s > 256:
            j, i = bisect_left(left.starts, s), e - cut
            if j < len(left.starts) and left.starts[j] == s and j == len(left.starts) - 1 and right.starts[:1] == [0] and (right.starts[1] if len(right.starts) > 1 else len(right.text)) == i:
                ids.append(agreed(left.words[j], right.words[0], enc))
                continue
        ids.append(enc.word(text[s:e].encode()))
    n = there.get(meet, len(right.starts))
    return Piece(text, left.starts[:k] + starts + [cut + s for s in right.starts[n:]], left.words[:k] + ids + right.words[n:])


def tree(pieces: list[Piece], enc: Encoder) -> Piece:
    while len(pieces) > 1:
        pieces = [joined(*pieces[i : i + 2], enc) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


LEVELS = 4  # 64 ** 4 pieces of 2,048 characters are more than a row of 2 GB has


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encoded(text: str, enc: Encoder, piece_chars: int) -> list[int]:
    """The ids of a text by the tree."""
    if len(text) <= piece_chars:
        return enc.ids(text)
    parts = [text[k : k + piece_chars] for k in range(0, len(text), piece_chars)]
    return tree([Piece.of(t, np.array(enc.ids(t), dtype=np.int64), enc) for t in parts], enc).ids()


def _in_place(docs: DataFrame, kind: T.DataType, vocabulary: str, piece_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = _lists([encoded(x, enc, piece_chars) if x else [] for x in batch.column("body").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    return docs.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _spread(docs: DataFrame, kind: T.DataType, vocabulary: str, piece_chars: int, fan: int) -> DataFrame:
    """The same for texts of more pieces than a task should join. Equal rows are joined once and counted."""
    pieces = (
        docs.groupBy("id", "body")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("id", F.sha2("body", 256).alias("digest"), "copies", F.posexplode(F.expr(f"regexp_extract_all(body, '(?s).{{1,{int(piece_chars)}}}', 0)")).alias("piece", "text"))
        .repartition(F.col("digest"), F.col("piece"))
    )
    rest = T.StructType([T.StructField("id", kind), *[T.StructField(n, t) for n, t in (("digest", T.StringType()), ("copies", T.LongType()), ("piece", T.IntegerType()), ("text", T.StringType()), ("ids", T.ArrayType(T.IntegerType())))]])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists([enc.ids(x) for x in batch.column("text").to_pylist()])], [*batch.schema.names, "ids"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(vocabulary)
        pdf = pdf.sort_values("piece")
        one = tree([Piece.of(t, np.asarray(i, dtype=np.int64), enc) for t, i in zip(pdf["text"], pdf["ids"])], enc)
        head = pdf.iloc[0]
        return pd.DataFrame({"id": [head["id"]], "digest": [head["digest"]], "copies": [head["copies"]], "piece": [head["piece"] // fan], "text": [one.text], "ids": [one.ids()]})

    level = pieces.mapInArrow(first, rest)
    for _ in range(LEVELS):
        level = level.groupBy("id", "digest", F.floor(F.col("piece") / fan)).applyInPandas(join, rest)
    return level.select("id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "ids")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, piece_chars: int = 2_048, fan: int = 64) -> DataFrame:
    """(id, ids) of every row; see the module's text for long texts, nulls and repeated rows."""
    kind = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    long = F.coalesce(F.length("body") > piece_chars * fan, F.lit(False))
    out = _in_place(docs.where(~long), kind, vocabulary, piece_chars).unionByName(_spread(docs.where(long), kind, vocabulary, piece_chars, fan))
    return out.withColumnRenamed("id", id_col)
