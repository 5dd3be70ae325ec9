"""Phase vectors (16 steps of a turn), their integer tables, codes and hashes.

Vectors are array columns. Functions on columns stay in the JVM; hashes and dense encodings, which need 64-bit wrap-around arithmetic or
matrix products, work on NumPy arrays inside Arrow functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cosine and sine of the 16 phases times 127, rounded to even; tangents of 11.25, 33.75, 56.25 and 78.75 degrees times 2^16, cut off.
C8 = (127, 117, 90, 49, 0, -49, -90, -117, -127, -117, -90, -49, 0, 49, 90, 117)
S8 = (0, 49, 90, 117, 127, 117, 90, 49, 0, -49, -90, -117, -127, -117, -90, -49)
TANGENTS = (13035, 43789, 98081, 329471)
# Fixed values of the public hash functions FNV-1a and splitmix64.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def quantized(vector: Column) -> Column:
    """Each value as a share of the greatest absolute one, in 127ths, rounded half to even; zeros stay zeros."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scaled = lambda t: F.transform(vector, lambda x: F.when(t > 0, F.rint(x.cast("double") * 127.0 / t)).otherwise(0.0).cast("int"))
    return let(top, scaled)


def sector16(re: Column, im: Column) -> Column:
    """Phase of an integer pair by integer comparisons; 0 for (0, 0)."""
    x, y = F.abs(re.cast("bigint")), F.abs(im.cast("bigint"))
    steps = sum(((y * 65536) > (x * t)).cast("int") for t in TANGENTS)
    turned = F.when((re >= 0) & (im >= 0), steps).when(im >= 0, 8 - steps).when(re < 0, 8 + steps).otherwise(16 - steps)
    return F.pmod(turned, F.lit(16))


def paired_marks(q: Column) -> Column:
    """Phases of neighbouring values (2k, 2k + 1) of an integer vector."""
    return let(q, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda k: sector16(F.element_at(v, 2 * k + 1), F.element_at(v, 2 * k + 2))))


def bound(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(16)))


def unbound(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(16)))


def complex_bound(a: Column, b: Column) -> Column:
    """Products, place by place, of complex vectors given as arrays of (re, im)."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["re"] * y["re"] - x["im"] * y["im"]).alias("re"), (x["re"] * y["im"] + x["im"] * y["re"]).alias("im")))


def complex_unbound(a: Column, b: Column) -> Column:
    """Products with the conjugates: undoes complex_bound where b has modulus 1."""
    return complex_bound(a, F.transform(b, lambda y: F.struct(y["re"].alias("re"), (-y["im"]).alias("im"))))


def ternary_bound(sign_a: Column, active_a: Column, sign_b: Column, active_b: Column) -> tuple[Column, Column]:
    """(sign, active) of the product of trits, word by word: active where both are, negative where one is."""
    active = F.zip_with(active_a, active_b, lambda x, y: x.bitwiseAND(y))
    sign = F.zip_with(F.zip_with(sign_a, sign_b, lambda x, y: x.bitwiseXOR(y)), active, lambda x, y: x.bitwiseAND(y))
    return sign, active


def shifted(mark: Column, by: Column | int) -> Column:
    """Every phase turned by the same step, as when all members of a bundle get another time or role."""
    by = F.lit(by) if isinstance(by, int) else by
    return F.transform(mark, lambda x: F.pmod(x + by, F.lit(16)))


def powered(mark: Column, t: float) -> Column:
    """Fractional power: each phase times t, rounded half to even."""
    return F.transform(mark, lambda x: F.pmod(F.rint(x * F.lit(float(t))).cast("int"), F.lit(16)))


def similarity(a: Column, b: Column) -> Column:
    """Integer score of two marks, 127 per place for equal ones."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.element_at(table(C8), F.pmod(x - y, F.lit(16)) + 1)), F.lit(0), lambda s, x: s + x)


def scan_score(a: Column, b: Column) -> Column:
    """Integer score of two marks by the scan's tables, cosines and sines multiplied."""
    c, s = table(C8), table(S8)
    parts = F.zip_with(a, b, lambda x, y: F.element_at(c, x + 1) * F.element_at(c, y + 1) + F.element_at(s, x + 1) * F.element_at(s, y + 1))
    return F.aggregate(parts, F.lit(0), lambda t, x: t + x)


def packed_pairs(mark: Column) -> Column:
    """Two phases a byte, the even place in the low half."""
    return let(mark, lambda m: F.transform(F.sequence(F.lit(1), F.size(m), F.lit(2)), lambda k: F.element_at(m, k) + 16 * F.element_at(m, k + 1)))


def unpacked_pairs(data: Column) -> Column:
    return F.flatten(F.transform(data, lambda b: F.array(F.pmod(b, F.lit(16)), F.floor(b / 16).cast("int"))))


def packed_blocks(mark: Column) -> Column:
    """Two phases a byte in blocks of 64: place k of a block low, place k + 32 high."""

    def byte(m: Column, j: Column) -> Column:
        first = 64 * F.floor(j / 32).cast("int") + j % 32 + 1
        return F.element_at(m, first) + 16 * F.element_at(m, first + 32)

    return let(mark, lambda m: F.transform(F.sequence(F.lit(0), (F.size(m) / 2).cast("int") - 1), lambda j: byte(m, j)))


def unpacked_blocks(data: Column) -> Column:
    def place(m: Column, i: Column) -> Column:
        byte = F.element_at(m, 32 * F.floor(i / 64).cast("int") + i % 32 + 1)
        return F.when(i % 64 < 32, F.pmod(byte, F.lit(16))).otherwise(F.floor(byte / 16).cast("int"))

    return let(data, lambda m: F.transform(F.sequence(F.lit(0), 2 * F.size(m) - 1), lambda i: place(m, i)))


def trits(q: Column, cut: Column) -> Column:
    """-1, 0 or 1 by a threshold on the absolute value."""
    return F.transform(q, lambda x: F.when(x >= cut, 1).when(x <= -cut, -1).otherwise(0))


def plane(values: Column, test: str, first: int, size: int = 32) -> Column:
    """Bits of `size` places from `first` on as one number; test: active (not zero) or sign (negative)."""
    part = F.slice(values, first + 1, size)
    bits = F.transform(part, lambda x, k: F.when((x != 0) if test == "active" else (x < 0), F.pow(F.lit(2.0), k).cast("bigint")).otherwise(0))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s + x)


def ternary_dot(sign_a: Column, active_a: Column, sign_b: Column, active_b: Column) -> Column:
    """Agreements less disagreements where both are active, of one word."""
    both = active_a.bitwiseAND(active_b)
    return F.bit_count(both) - 2 * F.bit_count(both.bitwiseAND(sign_a.bitwiseXOR(sign_b)))


def rms_normed(vector: Column, eps: float = 1e-6) -> Column:
    mean = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(vector)
    return let(mean, lambda m: F.transform(vector, lambda x: x.cast("double") / F.sqrt(m + eps)))


def rectified(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(x, F.lit(0).cast("double")))


def polygon(k: Column, places: int, turns: int = 1) -> Column:
    """Phases k * w mod 16 over the places w: atom k of a regular polygon."""
    return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda w: F.pmod(k * w * turns, F.lit(16)))


def simplex(k: Column, n: int, places: int) -> Column:
    """Atom k of n whose pairs have mean cosine -1 / (n - 1); n divides 16 and n - 1 the places."""
    return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda w: F.pmod(k * (w % (n - 1) + 1) * (16 // n), F.lit(16)))


def orthogonal(k: Column, n: int, places: int) -> Column:
    """Atom k of n axes of a harmonic frame, whose pairs have mean cosine 0; n divides 16 and the places."""
    return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda w: F.pmod(k * (w % n) * (16 // n), F.lit(16)))


def cross_polytope(k: Column, n: int, places: int) -> Column:
    """Atom k of 2n: the n axes of a harmonic frame, then their opposites."""
    axis = orthogonal(k % n, n, places)
    return F.when(k < n, axis).otherwise(shifted(axis, 8))


def min_separation(atoms: DataFrame, mark_col: str) -> DataFrame:
    """(separation): the least distance on the unit sphere, sqrt(2 - 2 cos), of two atoms of a codebook (a few thousand, held in one task); null for fewer than two."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0)[0].as_py()
            z = np.exp(2j * np.pi * np.array(marks) / 16) if len(marks) > 1 else np.zeros((0, 1))
            closest = max((float((z[k : k + 1] @ z[k + 1 :].conj().T).real.max()) / z.shape[1] for k in range(len(z) - 1)), default=None)
            yield pa.RecordBatch.from_arrays([pa.array([None if closest is None else max(0.0, 2 - 2 * closest) ** 0.5], pa.float64())], ["separation"])

    return atoms.agg(F.collect_list(mark_col).alias("m")).mapInArrow(go, "separation double")


def hypercube(label: str, places: int) -> np.ndarray:
    """A corner of the cube: every phase 0 or 8, by a hash bit."""
    return ((nibbles(f"HC:{label}", places) & 1) * 8).astype(np.uint8)


# The phase of each pair of trits, (0, 0) included, and the pair of each phase.
TRITS_TO_PHASE = {(1, 0): 0, (1, 1): 2, (0, 1): 4, (-1, 1): 6, (-1, 0): 8, (-1, -1): 10, (0, -1): 12, (1, -1): 14, (0, 0): 0}
PHASE_TO_FIRST = (1, 1, 1, 0, 0, 0, -1, -1, -1, -1, -1, 0, 0, 0, 1, 1)
PHASE_TO_SECOND = (0, 1, 1, 1, 1, 1, 1, 0, 0, -1, -1, -1, -1, -1, -1, 0)


def phases_of_trits(trits_: Column) -> Column:
    """A phase per pair of trits. Pairs of zeros become 0, which doesn't come back."""
    by_pair = table(tuple(TRITS_TO_PHASE[a, b] for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return let(trits_, lambda t: F.transform(F.sequence(F.lit(1), F.size(t), F.lit(2)), lambda k: F.element_at(by_pair, 3 * (F.element_at(t, k) + 1) + F.element_at(t, k + 1) + 2)))


def trits_of_phases(mark: Column) -> Column:
    first, second = table(PHASE_TO_FIRST), table(PHASE_TO_SECOND)
    return F.flatten(F.transform(mark, lambda p: F.array(F.element_at(first, p + 1), F.element_at(second, p + 1))))


def harmonics(position: Column, moduli: tuple[int, ...], highest: int) -> list[Column]:
    """Cosine and sine of each harmonic of a position on each ring."""
    turn = lambda h, m: F.lit(2 * np.pi * h / m) * F.pmod(position, F.lit(m))
    return [f(turn(h, m)) for m in moduli for h in range(1, highest + 1) for f in (F.cos, F.sin)]


def nearest_phases(v: np.ndarray) -> np.ndarray:
    """The nearest of 16 phases of complex numbers."""
    return np.mod(np.rint(np.angle(v) * 8 / np.pi), 16).astype(np.uint8)


def quantized_slot(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A complex slot as int8 parts under one scale, rounded half to even; scale 0 for an empty one."""
    top = max(np.abs(v.real).max(initial=0), np.abs(v.imag).max(initial=0))
    scale = float(top) / 127
    parts = [np.rint(x / scale).astype(np.int8) if scale else np.zeros(len(v), np.int8) for x in (v.real, v.imag)]
    return parts[0], parts[1], scale


def bundled_phases(marks: np.ndarray) -> np.ndarray:
    """Phases of the sum of marks (rows)."""
    c, s = np.asarray(C8, dtype=np.int64), np.asarray(S8, dtype=np.int64)
    return sectors(c[marks].sum(0), s[marks].sum(0))


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % 2**64
    return h


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def nibbles(label: str, places: int, seed: int = 0) -> np.ndarray:
    """Four-bit values of a label: 16 from each mixed counter, low ones first."""
    key = fnv1a64(label.encode()) ^ seed * GOLDEN % 2**64
    with np.errstate(over="ignore"):
        words = splitmix64(np.uint64(key) + np.arange(-(-places // 16), dtype=np.uint64))
    return (words[:, None] >> (4 * np.arange(16, dtype=np.uint64)) & np.uint64(15)).astype(np.uint8).ravel()[:places]


def codeword(label: str, places: int, seed: int = 0) -> np.ndarray:
    return nibbles(f"CW:{label}", places, seed)


def ternary_rows(name: str, rows: int, places: int, seed: int = 0) -> np.ndarray:
    n = np.stack([nibbles(f"TP:{name}:{r}", places, seed) for r in range(rows)]).astype(np.int8)
    return (n >= 12).astype(np.int8) - (n < 4).astype(np.int8)


def sectors(re: np.ndarray, im: np.ndarray) -> np.ndarray:
    """sector16 on integer arrays."""
    x, y = np.abs(re.astype(np.int64)), np.abs(im.astype(np.int64))
    steps = sum((y * 65536 > x * t).astype(np.int64) for t in TANGENTS)
    turned = np.where(re >= 0, np.where(im >= 0, steps, 16 - steps), np.where(im >= 0, 8 - steps, 8 + steps))
    return (turned % 16).astype(np.uint8)


def encoded_marks(df: DataFrame, id_col: str, vector_col: str, places: int = 256, name: str = "enc", seed: int = 0) -> DataFrame:
    """(id, mark): vectors to int8, exact sums of a ternary projection, phases. Null or empty vectors give a null mark; all vectors have one length."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            marks: list = []
            for v in batch.column(1).to_pylist():
                if not v or any(e is None for e in v):
                    marks.append(None)
                    continue
                x = np.asarray(v, dtype=np.float32)
                if len(x) not in maps:
                    maps[len(x)] = tuple(ternary_rows(f"{name}:{part}", len(x), places, seed).astype(np.int64) for part in ("re", "im"))
                top = np.abs(x).max()
                q = np.rint(x * (np.float32(127) / top)).astype(np.int64) if top > 0 else np.zeros(len(x), dtype=np.int64)
                re, im = maps[len(x)]
                marks.append(sectors(q @ re, q @ im).astype(np.int8).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.list_(pa.int8()))], ["id", "mark"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(go, f"id {kind}, mark array<tinyint>").withColumnRenamed("id", id_col)
