"""Passages of held-out evaluation items in training documents.

Latent semantic retrieval. Words are runs of letters and digits, composed, without case. Documents are reduced to what can match at all: stretches of words that
all occur in items. Passages of twelve words become TF-IDF vectors (document frequencies over all documents). A randomised SVD of the
matrix of all passages, corpus and items, gives the latent space: each power iteration is one pass in which every task adds up its share of A'(A Q), a table of words by rank, and the
shares are added by blocks of words, in a tree. Every word so has a latent vector, a piece of text the sum of its words'.

* Leaks. Each `run` words in a row of a document are held against all item passages (24 words, every 15th word, so that every run of an item lies whole in one) by cosine, a matrix product per block. Which
  cosine makes a candidate is known for every passage: a run that the passage contains has one of its runs' vectors, so its cosine is not below the least that these have. No true pair falls below. Candidates are checked:
  the passage must hold the rarest word of the run (its answer), then all of the run as a subsequence, then without gaps.
* Paraphrases, if asked for. Windows of 24 words, words that no item has bridged, are candidates of a passage above `paraphrase_cosine`. The window must hold at least half of the passage's `rare` rarest words (its answer), and the
  longest common subsequence must be at least `least_share` of the shorter side.

The items are the stated query set. They are taken in blocks of at most `block` items and `block_chars` characters, so what goes to all workers (their words by rank, their passages) stays bounded whatever
their number; documents are never collected, paired with each other or grouped.

Defined results: null texts and ids are left out, items or documents with fewer than `run` words have no leaks, repeated rows and items count once, other columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.sources.shared import written

_WORD = re.compile(r"[^\W_]+")
BLOCK = 64  # words whose shares travel together


sliding = np.lib.stride_tricks.sliding_window_view


def words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()))


def stretches(ids: np.ndarray, least: int, bridge: int = 0, other: int = -1) -> list[np.ndarray]:
    """The parts without -1 of at least so many words; gaps of up to `bridge` words inside a part are kept as `other`."""
    kept = ids >= 0
    for size in range(1, bridge + 1):
        for k in range(1, len(ids) - size):
            if kept[k - 1] and kept[k + size] and not (ids[k : k + size] >= 0).any():
                kept[k : k + size] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kept, [0]]).astype(np.int8)))
    filled = np.where(ids >= 0, ids, other)
    return [filled[a:b] for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def passages(part: np.ndarray, width: int, step: int, pad: int) -> np.ndarray:
    """Every `step`-th passage of `width` words, to the end of the part; short ones padded."""
    n = max(0, -(-(len(part) - width) // step)) + 1
    padded = np.concatenate([part, np.full(width + step, pad, dtype=part.dtype)])
    return sliding(padded, width)[: n * step : step]


class Space:
    """Words' weights and, once fitted, their latent vectors."""

    def __init__(self, weights: np.ndarray, basis: np.ndarray) -> None:
        self.weights = np.append(weights, 0).astype(np.float32)  # the last one is the padding
        self.basis = np.vstack([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)

    def rows(self, m: np.ndarray) -> np.ndarray:
        """Weights of the words of each passage, scaled to a TF-IDF vector of length 1."""
        w = self.weights[m]
        times = (m[:, :, None] == m[:, None, :]).sum(2)
        return w / (np.sqrt((w * w * times).sum(1, keepdims=True)) + 1e-9)

    def times_basis(self, m: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(m), self.basis.shape[1]), dtype=np.float32)
        for j in range(m.shape[1]):
            out += self.basis[m[:, j]] * w[:, j, None]
        return out

    def back(self, m: np.ndarray, w: np.ndarray, y: np.ndarray, into: np.ndarray) -> None:
        """Adds A'y for the passages."""
        flat, order = m.ravel(), np.argsort(m.ravel(), kind="stable")
        begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
        into[flat[order][begin]] += np.add.reduceat(y[order // m.shape[1]] * w.ravel()[order, None], begin, axis=0)

    def vectors(self) -> np.ndarray:
        return self.weights[:, None] * self.basis


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def sums(vectors: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """The sum of the vectors of every `width` words in a row."""
    x = vectors[words]
    out = x[: len(x) - width + 1].copy()
    for j in range(1, width):
        out += x[j : len(x) - width + 1 + j]
    return out


def common_run(a: np.ndarray, b: np.ndarray) -> int:
    """Longest run of words that both have."""
    best, before = 0, np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        now = np.zeros(len(b) + 1, dtype=np.int64)
        hit = np.flatnonzero(b == x)
        now[hit + 1] = before[hit] + 1
        best, before = max(best, int(now.max())), now
    return best


def common_subsequences(a: np.ndarray, b: np.ndarray, pad: int) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of a and b; padding is common to nothing."""
    row = np.zeros((b.shape[1] + 1, len(b)), dtype=np.int8)
    for j in range(a.shape[1]):
        hit = (b == a[:, j, None]) & (a[:, j, None] != pad)
        diagonal = row[:-1] + hit.T
        new = np.zeros_like(row)
        for k in range(b.shape[1]):
            np.maximum(np.maximum(row[k + 1], diagonal[k]), new[k], out=new[k + 1])
        row = new
    return row[-1]


def _read_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        lists = batch.column("ids")
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        flat_at = at - at[0]
        yield batch, [flat[a:b] for a, b in zip(flat_at[:-1], flat_at[1:])]


def _tokenised(docs: DataFrame, vocabulary: dict[str, int], run: int, bridge: int, kind: str) -> DataFrame:
    """Rows with an id: the document's stretches of item words. Rows without: how many documents of a batch have a word."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, ids, seen = [], [], np.zeros(len(known), dtype=np.int32)
            for k, text in enumerate(batch.column("body").to_pylist()):
                own = np.fromiter((known.get(w, -1) for w in words(text)), dtype=np.int32)
                seen[np.unique(own[own >= 0])] += 1
                for part in stretches(own, run, bridge, len(known)):
                    rows.append(k)
                    ids.append(part)
            there = np.flatnonzero(seen).astype(np.int32)
            lists = [*ids, there]
            flat = pa.array(np.concatenate(lists).astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            counts = pa.array([None] * len(ids) + [seen[there].tolist()], pa.list_(pa.int32()))
            id_type = batch.schema.field("id").type
            keys = pa.concat_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.nulls(1, id_type)])
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, flat), counts], ["id", "ids", "n"])

    return docs.mapInArrow(go, f"id {kind}, ids array<int>, n array<int>")


def _summed(parts: DataFrame, n_blocks: int, size: int, fan: int = 32) -> np.ndarray:
    """Blocks of float32 values added up, block by block, in a tree: a group holds at most `fan` parts of a block. parts: (block, task, part), a row per task and block."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(x, dtype=np.float32) for x in pdf["part"]))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "task": [pdf["task"].iloc[0] // fan], "part": [total.astype(np.float32).tobytes()]})

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan)
        parts = parts.groupBy("block", F.floor(F.col("task") / fan)).applyInPandas(add, "block int, task int, part binary")
    out = np.zeros((n_blocks, size), dtype=np.float32)
    for r in parts.collect():
        out[r.block] += np.frombuffer(r.part, dtype=np.float32)
    return out


def _pass(corpus: DataFrame, items: list[np.ndarray], space: Space, width: int, gram: bool) -> np.ndarray:
    """A'(A Q), or (A Q)'(A Q), over the passages of the corpus and of the items, each word in one passage."""
    shared = corpus.sparkSession.sparkContext.broadcast(space)
    n_words, rank = space.basis.shape
    n_blocks = 1 if gram else -(-n_words // BLOCK)
    size = rank * (rank if gram else BLOCK)

    def add(space: Space, parts: list[np.ndarray], into: np.ndarray) -> None:
        for k in range(0, len(parts), 2000):
            m = np.concatenate([passages(p, width, width, n_words - 1) for p in parts[k : k + 2000]])
            for j in range(0, len(m), 4000):
                w = space.rows(m[j : j + 4000])
                y = space.times_basis(m[j : j + 4000], w)
                if gram:
                    into[:rank] += y.T @ y
                else:
                    space.back(m[j : j + 4000], w, y, into)

    def fresh() -> np.ndarray:
        return np.zeros((rank if gram else n_blocks * BLOCK, rank), dtype=np.float32)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = fresh()
        for _, parts in _read_stretches(batches):
            add(shared.value, parts, into)
        into = into.reshape(n_blocks, size)
        used = np.flatnonzero(into.any(1))
        task = np.full(len(used), TaskContext.get().partitionId(), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(task), pa.array([into[k].tobytes() for k in used], pa.binary())], ["block", "task", "part"])

    own = fresh()
    add(space, items, own)
    out = _summed(corpus.mapInArrow(go, "block int, task int, part binary"), n_blocks, size).reshape(-1, rank) + own
    return out[: rank if gram else n_words]


def orthonormal(q: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, by their inner products, in place of a factorisation of the whole table; twice, since the first time loses digits."""
    for _ in range(2):
        gram = sum(q[k : k + 4096].astype(np.float64).T @ q[k : k + 4096].astype(np.float64) for k in range(0, len(q), 4096))
        values, vectors = np.linalg.eigh(gram)
        kept = values > 1e-10 * values.max(initial=0)
        q = q @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    return q


def latent_space(corpus: DataFrame, items: list[np.ndarray], weights: np.ndarray, rank: int, width: int, rounds: int = 2, spare: int = 16, seed: int = 7) -> Space:
    """Randomised SVD of the TF-IDF passages: the leading right singular vectors, each divided by its damped singular value."""
    n = len(weights)
    rank = max(1, min(rank, n))
    q = np.random.default_rng(seed).standard_normal((n, min(rank + spare, n)), dtype=np.float32)
    for _ in range(rounds):
        q = orthonormal(_pass(corpus, items, Space(weights, q), width, False)[:n])
    values, vectors = np.linalg.eigh(_pass(corpus, items, Space(weights, q), width, True).astype(np.float64))
    keep = [k for k in np.argsort(-values)[:rank] if values[k] > 1e-6 * values.max()]
    damped = np.sqrt(values[keep] + np.median(values[keep]))  # so that directions with hardly any weight don't decide
    return Space(weights, (q @ vectors[:, keep]) / damped)


class Query:
    """The items of a block: passages, their directions, and for each the least cosine of a run that it contains."""

    def __init__(self, ids: list, texts: list[np.ndarray], space: Space, width: int, step: int, run: int, rare: int) -> None:
        self.pad = len(space.weights) - 1
        parts = [passages(t, width, step, self.pad) for t in texts]
        self.ids, self.texts = ids, texts
        self.item = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
        self.words = np.concatenate(parts)
        vectors = space.vectors()
        sized = (self.words != self.pad).sum(1)
        self.direction = np.zeros((len(self.words), vectors.shape[1]), dtype=np.float32)
        self.least = np.ones(len(self.words), dtype=np.float32)
        for k in range(0, len(self.words), 2000):
            m = self.words[k : k + 2000]
            x = vectors[m]
            self.direction[k : k + 2000] = unit(x.sum(1))
            for at in range(width - run + 1):
                cosine = (unit(x[:, at : at + run].sum(1)) * self.direction[k : k + 2000]).sum(1)
                there = sized[k : k + 2000] >= at + run
                self.least[k : k + 2000] = np.where(there, np.minimum(self.least[k : k + 2000], cosine), self.least[k : k + 2000])
        self.least -= 1e-4  # rounding
        order = np.argsort(-space.weights[self.words], axis=1, kind="stable")[:, :rare]
        self.rare = np.take_along_axis(self.words, order, 1)


_PAIRS = "doc {}, item {}, longest_run int, cosine double, subsequence_share double, kind string"


def _searched(corpus: DataFrame, query: Query, space: Space, run: int, paraphrase_cosine: float | None, least_share: float, kind: str, item_kind: str) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast((query, space))

    def above(x: np.ndarray, least: np.ndarray | float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, passage, cosine) of what reaches `least`, in blocks."""
        query = shared.value[0]
        size = max(16, 20_000_000 // max(1, len(query.item)))
        for a in range(0, len(x), size):
            cosine = x[a : a + size] @ query.direction.T
            hits = np.flatnonzero(cosine >= least)
            for j in range(0, len(hits), 400_000):
                r, c = np.divmod(hits[j : j + 400_000], cosine.shape[1])
                yield a + r, c, cosine.ravel()[hits[j : j + 400_000]]

    def leaks(parts: list[np.ndarray], vectors: np.ndarray, weights: np.ndarray) -> dict[tuple[int, int], tuple[float, float]]:
        query, found = shared.value[0], {}
        flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        whole = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat)) >= run  # where a run of the same stretch begins
        whole = whole[: max(0, len(flat) - run + 1)]
        whole &= (sliding(flat == query.pad, run).sum(1) == 0) if len(whole) else whole
        of = np.repeat(np.arange(len(parts)), sizes)[: len(whole)][whole]
        if not len(of):
            return found
        runs, x = sliding(flat, run)[whole], unit(sums(vectors, flat, run)[whole])
        answer = np.take_along_axis(runs, weights[runs].argmax(1)[:, None], 1)
        for r, c, cosine in above(x, query.least):
            fits = (query.words[c] == answer[r]).any(1)
            r, c, cosine = r[fits], c[fits], cosine[fits]
            fits = common_subsequences(runs[r], query.words[c], query.pad) >= run
            r, c, cosine = r[fits], c[fits], cosine[fits]
            fits = np.zeros(len(r), dtype=bool)
            for at in range(query.words.shape[1] - run + 1):
                fits |= (query.words[c, at : at + run] == runs[r]).all(1)
            for k, i, v in zip(of[r[fits]].tolist(), query.item[c[fits]].tolist(), cosine[fits].tolist()):
                found[k, i] = max(found.get((k, i), (0.0, 1.0)), (v, 1.0))
        return found

    def near(parts: list[np.ndarray], vectors: np.ndarray) -> dict[tuple[int, int], tuple[float, float]]:
        query, found = shared.value[0], {}
        width = query.words.shape[1]
        windows = [passages(p, width, width // 3, query.pad) for p in parts]
        of, m = np.repeat(np.arange(len(parts)), [len(w) for w in windows]), np.concatenate(windows)
        x = unit(np.concatenate([vectors[m[k : k + 2000]].sum(1) for k in range(0, len(m), 2000)]))
        for r, c, cosine in above(x, paraphrase_cosine):
            asked = query.rare[c]
            there = np.zeros(len(r))
            for j in range(asked.shape[1]):
                there += ((m[r] == asked[:, j, None]) & (asked[:, j, None] != query.pad)).any(1)
            fits = there >= 0.5 * (asked != query.pad).sum(1)
            r, c, cosine = r[fits], c[fits], cosine[fits]
            shorter = np.minimum((m[r] != query.pad).sum(1), (query.words[c] != query.pad).sum(1))
            share = common_subsequences(m[r], query.words[c], query.pad) / np.maximum(shorter, 1)
            fits = (share >= least_share) & (shorter >= run)
            for k, i, v, s in zip(of[r[fits]].tolist(), query.item[c[fits]].tolist(), cosine[fits].tolist(), share[fits].tolist()):
                found[k, i] = max(found.get((k, i), (0.0, 0.0)), (v, s))
        return found

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, space = shared.value
        vectors = space.vectors()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, parts = next(_read_stretches([whole.slice(at, 500)]))
                found = leaks(parts, vectors, space.weights)
                out = [(k, i, common_run(parts[k], query.texts[i]), cos, share, "passage") for (k, i), (cos, share) in found.items()]
                if paraphrase_cosine is not None:
                    out += [(k, i, common_run(parts[k], query.texts[i]), cos, share, "paraphrase") for (k, i), (cos, share) in near(parts, vectors).items() if (k, i) not in found]
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(cols[0], pa.int64())), pa.array([query.ids[i] for i in cols[1]], item_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.string())],
                    ["doc", "item", "longest_run", "cosine", "subsequence_share", "kind"],
                )

    item_type = pa.int64() if item_kind == "bigint" else pa.string()
    return corpus.mapInArrow(go, _PAIRS.format(kind, item_kind))


def leaked(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    run: int = 10,
    rank: int = 128,
    paraphrases: bool = False,
    paraphrase_cosine: float = 0.6,
    least_share: float = 0.6,
    rare: int = 6,
    block: int = 5_000,
    block_chars: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, kind, longest_run, cosine, subsequence_share), a row per leaking pair; kind passage or, if asked for, paraphrase."""
    width, item_width, item_step = run + 2, run + 14, 15  # every run of an item lies whole in one of its passages
    spark = df.sparkSession
    kind, item_kind = df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_kind = "bigint" if item_kind in ("tinyint", "smallint", "int", "bigint") else "string"
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("id is not null and body is not null")
    wanted = items.select(F.col(item_col).cast(item_kind).alias("id"), F.col(item_text_col).alias("body")).where("id is not null and body is not null").distinct()
    sizes = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("body").cast("long")), F.lit(0)).alias("chars")).first()
    n_blocks = max(1, -(-sizes.n // block), -(-sizes.chars // block_chars))
    n_docs = docs.count()
    results = []
    for b in range(n_blocks):
        rows = wanted.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id", "body").collect()
        texts = [(r.id, w) for r in rows if len(w := words(r.body)) >= run]
        if not texts:
            continue
        vocabulary: dict[str, int] = {}
        for _, text in texts:
            for w in text:
                vocabulary.setdefault(w, len(vocabulary))
        coded = [np.array([vocabulary[w] for w in text], dtype=np.int32) for _, text in texts]
        table = written(_tokenised(docs, vocabulary, run, 2 if paraphrases else 0, kind), "item-words")
        counts = table.where("id is null").select(F.explode(F.arrays_zip("ids", "n")).alias("c")).groupBy("c.ids").agg(F.sum("c.n").alias("n")).collect()
        seen = np.zeros(len(vocabulary))
        for r in counts:
            seen[r.ids] = r.n
        for text in coded:
            seen[np.unique(text)] += 1
        weights = np.log((n_docs + len(coded) + 1) / (seen + 1)) + 1e-3
        corpus = table.where("id is not null").select("id", "ids")
        space = latent_space(corpus, coded, weights, rank, width)
        query = Query([i for i, _ in texts], coded, space, item_width, item_step, run, rare)
        results.append(_searched(corpus, query, space, run, paraphrase_cosine if paraphrases else None, least_share, kind, item_kind))
    if not results:
        results = [spark.createDataFrame([], _PAIRS.format(kind, item_kind))]
    every = reduce(DataFrame.unionByName, results)
    best = every.groupBy("doc", "item").agg(F.max(F.struct("longest_run", "cosine", "subsequence_share")).alias("b"))
    best = best.select("doc", "item", F.when(F.col("b.longest_run") >= run, "passage").otherwise("paraphrase").alias("kind"), "b.longest_run", "b.cosine", "b.subsequence_share")
    return best.withColumnsRenamed({"doc": id_col, "item": item_col})
