"""Frames as edges, star joins, hash-bucketed reads, and records, texts and sensors as phase vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions.phases import bundled_phases, codeword, sectors
from marklake.sources.shared import summed

TOKENS = r"[a-z0-9]{2,}"


def unfolded(edges: DataFrame, starts: DataFrame, path: list[str]) -> DataFrame:
    """(start, filler): what a path of roles leads to from each frame. edges: (frame, role, filler), starts: (start). Each role filters its own edges before the join."""
    out = starts.select("start", F.col("start").alias("filler"))
    for role in path:
        step = edges.where(F.col("role") == role).select(F.col("frame"), F.col("filler").alias("next"))
        out = out.join(step, F.col("filler") == F.col("frame")).select("start", F.col("next").alias("filler"))
    return out


def star(facts: DataFrame, points: dict[str, DataFrame], known: dict[str, object] | None = None) -> DataFrame:
    """Facts all of whose corners pass: each dimension is filtered by its own candidates (a one-column table of the corner's name) or pinned to a known value, before anything is combined."""
    for corner, value in (known or {}).items():
        facts = facts.where(F.col(corner) == F.lit(value))
    for corner, candidates in points.items():
        if corner not in (known or {}):
            facts = facts.join(candidates.select(corner).distinct(), corner, "left_semi")
    return facts


def bucket(key: Column, n: int) -> Column:
    """Which of n buckets a key's facts lie in, by a digest."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), F.lit(n))


def bucket_read(facts: DataFrame, keys: list[str], asked: DataFrame, n: int) -> DataFrame:
    """Facts of the asked keys; the bucket of the first key part prunes before the other parts are compared."""
    held = facts.withColumn("bucket", bucket(F.col(keys[0]).cast("string"), n))
    wanted = asked.select(*keys).distinct().withColumn("bucket", bucket(F.col(keys[0]).cast("string"), n))
    return held.join(wanted, ["bucket", *keys]).drop("bucket")


# How two words join to a gram, the constants that mix a gram's digest with a place (of a public 32-bit finaliser), and the labels of a sensor's rates and roles.
PAIR = "_"
PLACE_STEP, PLACE_SHIFT, MIX_1, MIX_2 = 2654435761, 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
RATE_LABEL, ROLE_LABEL = "TEL:", "R:"


def gram_marks(grams: list[str], places: int) -> np.ndarray:
    """(grams, places): a phase per gram and place, the top four bits of a mixed digest."""
    digests = np.frombuffer(b"".join(blake2b(g.encode(), digest_size=4).digest() for g in grams), dtype=">u4").astype(np.uint32)
    place = np.arange(places, dtype=np.uint64) * np.uint64(PLACE_STEP) + np.uint64(PLACE_SHIFT)
    x = digests[:, None] ^ place.astype(np.uint32)  # all in 32 bits, what overflows is lost
    for shift, factor in ((0, MIX_1), (13, MIX_2)):
        x = (x ^ x >> np.uint32(shift) if shift else x) * np.uint32(factor)
    return ((x ^ x >> np.uint32(16)) >> np.uint32(28)).astype(np.uint8)


def text_grams(text: str, kind: str = "words") -> list[str]:
    """The different words, then pairs of neighbouring words, of the whole text; or its character trigrams, repeated ones kept."""
    if kind == "trigrams":
        framed = f"#{text.lower()}#"
        return [framed[k : k + 3] for k in range(max(1, len(framed) - 2))]
    found = re.findall(TOKENS, text.lower())
    return [*dict.fromkeys(found), *dict.fromkeys(PAIR.join(pair) for pair in zip(found, found[1:]))]


def text_marks(df: DataFrame, id_col: str, text_col: str, places: int = 256, grams: str = "words", block: int = 2000) -> DataFrame:
    """(id, mark): the phases of the sum of all of a text's grams, added up in blocks. No grams give a null mark."""
    turn = np.arange(16) * (np.pi / 8)

    def mark(text: str | None) -> list[int] | None:
        own = text_grams(text, grams) if text else []
        total = np.zeros((2, places))
        for k in range(0, len(own), block):
            phases = gram_marks(own[k : k + block], places)
            total += np.stack([np.cos(turn)[phases].sum(0), np.sin(turn)[phases].sum(0)])
        return sectors(*np.rint(total * 127)).astype(np.int8).tolist() if own else None

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mark(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int8()))], ["id", "mark"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(go, f"id {kind}, mark array<tinyint>").withColumnRenamed("id", id_col)


def sensor_marks(df: DataFrame, id_col: str, fields: dict[str, tuple[float, float]], places: int = 256, spread: float = 2.0) -> DataFrame:
    """(id, mark): named scalars within their ranges as one phase vector. Each field has a start angle and a rate per place, of at most `spread` turns over its range, and adds a unit vector turned by its
    value. A null or NaN contributes nothing; none at all gives a null mark."""
    names, (low, high) = list(fields), np.array(list(fields.values()), dtype=float).T

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.stack([codeword(ROLE_LABEL + n, places) for n in names]) * (np.pi / 8)
        rate = np.stack([codeword(RATE_LABEL + n, places) / 7.5 - 1 for n in names]) * (2 * np.pi * spread)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                x = np.stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names], 1)
                there = ~np.isnan(x)
                share = np.clip((np.where(there, x, low) - low) / (high - low), 0, 1)
                angle = start[None] + rate[None] * share[:, :, None]
                real, imaginary = (np.einsum("rf,rfp->rp", there, f(angle)) for f in (np.cos, np.sin))
                marks = np.rint(np.arctan2(imaginary, real) * (8 / np.pi)).astype(np.int8) % 16
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([m.tolist() if t else None for m, t in zip(marks, there.any(1))], pa.list_(pa.int8()))], ["id", "mark"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), *[F.col(n).cast("double").alias(n) for n in names])
    return rows.mapInArrow(go, f"id {kind}, mark array<tinyint>").withColumnRenamed("id", id_col)


def record_frames(df: DataFrame, fields: list[str], places: int = 1024) -> DataFrame:
    """(fields, frame): each record of text fields as one packed phase vector, two phases a byte; nulls count as empty texts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        role = {f: codeword(f"ROLE:{f}", places).astype(np.int64) for f in fields}
        for batch in batches:
            columns = [[x or "" for x in batch.column(f).to_pylist()] for f in fields]
            frames = []
            for values in zip(*columns):
                p = bundled_phases(np.stack([(role[f] + codeword(f"{f}:{v}", places)) % 16 for f, v in zip(fields, values)]))
                frames.append((p[0::2] | p[1::2] << 4).tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(frames, pa.binary())], [*fields, "frame"])

    return df.select(*[F.col(f).cast("string").alias(f) for f in fields]).distinct().mapInArrow(go, ", ".join(f"{f} string" for f in fields) + ", frame binary")


def read_frames(frames: DataFrame, fields: list[str], vocabulary: dict[str, DataFrame], places: int = 1024, block: int = 20_000) -> DataFrame:
    """(fields, field, read): for each frame and field the value whose codeword the frame holds most under the field's role, ties to the lesser value.

    vocabulary: per field a table with one text column of that name. It is taken in blocks, so the workers' codebooks stay bounded; the best of all blocks counts.
    """
    spark, parts = frames.sparkSession, []
    for f in fields:
        words = vocabulary[f].select(F.col(f).alias("v")).where("v is not null").distinct()
        n_blocks = max(1, -(-words.count() // block))
        for b in range(n_blocks):
            values = sorted(r.v for r in words.where(F.pmod(F.xxhash64("v"), F.lit(n_blocks)) == b).collect())
            if not values:
                continue
            shared = spark.sparkContext.broadcast(values)

            def go(batches: Iterator[pa.RecordBatch], f=f, shared=shared) -> Iterator[pa.RecordBatch]:
                turn = np.exp(2j * np.pi * np.arange(16) / 16).astype(np.complex64)
                book = turn[np.stack([codeword(f"{f}:{v}", places) for v in shared.value])].conj().T
                role = codeword(f"ROLE:{f}", places)
                for whole in batches:
                    for k in range(0, whole.num_rows, 500):
                        batch = whole.slice(k, 500)
                        data = np.frombuffer(b"".join(batch.column("frame").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        p = np.stack([data & 15, data >> 4], 2).reshape(batch.num_rows, -1).astype(np.int64)
                        score = (turn[(p - role) % 16] @ book).real
                        best = score.argmax(1)
                        read = [pa.array([f] * len(best)), pa.array([shared.value[j] for j in best], pa.string()), pa.array(np.round(score[np.arange(len(best)), best].astype(np.float64), 3))]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), *read], [*fields, "field", "value", "score"])

            parts.append(frames.mapInArrow(go, ", ".join(f"{c} string" for c in fields) + ", field string, value string, score double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*fields, "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "value"))["value"].alias("read"))


def whitening(df: DataFrame, vector_col: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) such that (x - mean) @ matrix has uncorrelated unit columns. One pass: every task adds up its own products."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            own = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(0)), dims))
            x = own.column(0).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = x[np.isfinite(x).all(1)]
            x1 = np.hstack([x, np.ones((len(x), 1))])
            total += x1.T @ x1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    size = dims + 1
    total = summed(df.select(vector_col).mapInArrow(go, "part binary"), size * size).reshape(size, size)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    values, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return mean, vectors / np.sqrt(np.maximum(values, 1e-12))
