"""From a superposed slot back to its members: exhaustive reading, explaining away, resonance, a ladder of readers.

Slots are rows with the real and imaginary sums of their members' codewords; each is read by itself inside an Arrow batch with the codebook on every worker
(1,365 codewords, a constant size). A reader reports its confidence and abstains instead of guessing; residues are checked by the fifth ring.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.functions.phases import nibbles
from marklake.functions.residue import CHECK, RINGS, crt_weights

STATES = prod(RINGS)
PLACES = 1024
EXPLAINED = 1e-3  # the most that single precision leaves of a slot whose members are all taken off


@lru_cache(maxsize=4)
def ring_bases(places: int = PLACES, seed: int = 0) -> list[np.ndarray]:
    """A random step per place for each ring, in m-ths of a turn: residue r stands at r times the step."""
    out = []
    for m in (*RINGS, CHECK):
        raw = nibbles(f"ring:{m}", 2 * places, seed).astype(np.int64)
        out.append((raw[:places] * 16 + raw[places:]) % (m - 1) + 1)
    return out


def turns(m: int, steps: np.ndarray) -> np.ndarray:
    return np.exp(2j * np.pi * (steps % m) / m)


@lru_cache(maxsize=4)
def books(places: int = PLACES, seed: int = 0) -> list[np.ndarray]:
    """For each ring the codewords of its residues."""
    return [turns(m, np.arange(m)[:, None] * base[None]) for m, base in zip((*RINGS, CHECK), ring_bases(places, seed))]


@lru_cache(maxsize=2)
def lattice(places: int = PLACES, seed: int = 0) -> np.ndarray:
    """The codeword of every legal number: the product of its residues' codewords."""
    x = np.arange(STATES)
    return np.prod([book[x % m] for m, book in zip((*RINGS, CHECK), books(places, seed))], axis=0).astype(np.complex64)


def encoded(numbers: np.ndarray, places: int = PLACES, seed: int = 0) -> np.ndarray:
    if ((numbers < 0) | (numbers >= STATES)).any():
        raise ValueError(f"only 0..{STATES - 1} are legal")
    return lattice(places, seed)[numbers]


def exhaustive(slot: np.ndarray, places: int, seed: int, least: float = 0.5) -> list[tuple[int, float]]:
    """Numbers whose codewords the slot holds at `least` or more, strongest first; none of an empty slot."""
    return scanned(slot[None], places, seed, least)[0][0]


def peeled(slot: np.ndarray, places: int, seed: int, least: float = 0.5) -> list[tuple[int, float]]:
    """The strongest member is read and subtracted, again and again, until none is strong enough or one comes twice."""
    rest, out = slot.copy(), []
    while True:
        score = (lattice(places, seed).conj() @ rest).real / places
        k = int(score.argmax())
        if score[k] < least or any(k == o for o, _ in out):
            break
        out.append((k, float(score[k])))
        rest = rest - lattice(places, seed)[k]
    return out


def resonated(slot: np.ndarray, places: int, seed: int, rounds: int = 60, starts: int = 8) -> tuple[list[int], float]:
    """Residues of a slot with one member by a soft resonator: every ring's estimate is cleaned against its book with the others unbound; confidence is the least lead of the best residue.

    The residues of a ring cancel out in an even mixture, so it starts from uneven ones, drawn anew until a start converges to a legal number.
    """
    all_books = books(places, seed)
    best: tuple[list[int], float] = ([0] * len(all_books), 0.0)
    for start in range(starts):
        rng = np.random.default_rng(start)
        estimates = [rng.random(len(b)) @ b for b in all_books]
        weights: list[np.ndarray] = []
        for _ in range(rounds):
            before, weights = weights, []
            for k, book in enumerate(all_books):
                others = np.prod([e / np.maximum(np.abs(e), 1e-9) for j, e in enumerate(estimates) if j != k], axis=0)
                w = (np.abs(book.conj() @ (slot * others.conj())) / places) ** 2
                weights.append(w / max(w.max(), 1e-12))
                estimates[k] = weights[-1] @ book
            if before and max(np.abs(a - b).max() for a, b in zip(weights, before)) < 1e-5:
                break
        confidence = float(np.clip(min(1 - np.sort(w)[-2] for w in weights), 0, 1))
        parts = [int(w.argmax()) for w in weights]
        if confidence > best[1]:
            best = (parts, confidence)
        if confidence >= 0.5 and from_residues(parts)[1] == "VERIFIED":
            break
    return best


def from_residues(parts: list[int]) -> tuple[int, str]:
    weights, whole = crt_weights((*RINGS, CHECK))
    x = sum(w * p for w, p in zip(weights, parts)) % whole
    return x, "VERIFIED" if x < STATES else "REJECTED"


def sieved(slot: np.ndarray, places: int, seed: int) -> tuple[int, str] | None:
    """The number of a clean slot: raised to the product of the other rings, every place keeps one ring's turn only."""
    if not np.allclose(np.abs(slot), 1, atol=1e-3):
        return None
    rings, parts = (*RINGS, CHECK), []
    for k, m in enumerate(rings):
        power = prod(rings) // m
        r = int((books(places, seed)[k].conj() @ (slot / np.abs(slot)) ** power).real.argmax())
        parts.append(r * pow(power, -1, m) % m)
    return from_residues(parts)


class Learner:
    """Which reader to try first, learned per kind of slot: Beta posteriors, sampled with a fixed seed, one reward per slot."""

    def __init__(self, arms: tuple[str, ...] = ("scan", "peel", "ladder"), seed: int = 0) -> None:
        self.arms, self.rng = arms, np.random.default_rng(seed)
        self.wins: dict[tuple[str, str], list[float]] = {}

    @staticmethod
    def kind(slot: np.ndarray) -> str:
        size = float(np.abs(slot).mean())
        return "empty" if size < 1e-9 else "clean" if size < 1.05 else "few" if size < 4 else "crowded"

    def choose(self, kind: str) -> str:
        draws = [self.rng.beta(*self.wins.setdefault((kind, a), [1.0, 1.0])) for a in self.arms]
        return self.arms[int(np.argmax(draws))]

    def learn(self, kind: str, arm: str, reward: float) -> None:
        post = self.wins.setdefault((kind, arm), [1.0, 1.0])
        post[0] += reward
        post[1] += 1 - reward

    def best(self, kind: str) -> str:
        return max(self.arms, key=lambda a: self.wins.get((kind, a), [1.0, 1.0])[0] / sum(self.wins.get((kind, a), [1.0, 1.0])))


def laddered(slot: np.ndarray, places: int, seed: int) -> tuple[list[tuple[int, float]], str]:
    """Readers from cheap to dear: the sieve for a clean member, resonance for a noisy one, then the whole lattice, then explaining away; which one answered, or ABSTAIN."""
    size = np.abs(slot).mean()
    if not size > 1e-9:
        return [], "ABSTAIN"
    clean = sieved(slot, places, seed)
    if clean and clean[1] == "VERIFIED" and (lattice(places, seed)[clean[0]].conj() @ slot).real / places >= 0.9:
        return [(clean[0], 1.0)], "SIEVE"
    if size < 1.1:
        parts, confidence = resonated(slot, places, seed)
        x, status = from_residues(parts)
        if status == "VERIFIED" and confidence >= 0.5 and (lattice(places, seed)[x].conj() @ slot).real / places >= 0.9:
            return [(x, confidence)], "RESONATE"
        from marklake.operators.readers import parted

        parts, agreement = parted(slot, places, seed)
        x, status = from_residues(parts)
        if status == "VERIFIED" and agreement >= 0.5 and (lattice(places, seed)[x].conj() @ slot).real / places >= 0.9:
            return [(x, agreement)], "PART"
    found = exhaustive(slot, places, seed)
    if found:
        return found, "SCAN"
    found = peeled(slot, places, seed, 0.4)
    return (found, "PEEL") if found else ([], "ABSTAIN")


def scanned(rows: np.ndarray, places: int, seed: int, least: float = 0.5) -> list[tuple[list[tuple[int, float]], str]]:
    """exhaustive() for many slots by one matrix product, of which only the real part is formed. In a crowded slot a stranger may come out above the bar or a member below it; then the hits leave a rest, in which those stand out, and
    the hits are corrected if that explains the whole slot."""
    rows = np.ascontiguousarray(rows, dtype=np.complex64)
    book, flat = lattice(places, seed).view(np.float32), rows.view(np.float32)
    score = flat @ book.T / places
    score[~(np.abs(rows).mean(1) > 1e-9)] = -1
    hits, rest = score >= least, rows.copy()
    row, x = np.nonzero(hits)
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    if len(row):
        rest[row[begin]] -= _added(x, begin, places, seed)
    off = np.flatnonzero(np.abs(rest).mean(1) > EXPLAINED)
    left = rest[off].view(np.float32) @ book.T / places
    other = (hits[off] & (left > -0.5)) | (left >= 0.5)
    whole = np.abs((flat[off] - other.astype(np.float32) @ book).view(np.complex64)).mean(1) <= EXPLAINED
    hits[off[whole]] = other[whole]
    row, x = np.nonzero(hits)
    held = score[row, x]
    order = np.lexsort((x, -held, row))
    hits, cut = list(zip(x[order].tolist(), held[order].tolist())), np.searchsorted(row, np.arange(len(rows) + 1))
    return [(hits[a:b], "SCAN") for a, b in zip(cut[:-1], cut[1:])]


def climbed(rows: np.ndarray, places: int, seed: int) -> list[tuple[list[tuple[int, float]], str]]:
    """laddered() for many slots: those of several members, which the readers for one can't answer, go to the whole lattice together."""
    several = np.flatnonzero(np.abs(rows).mean(1) >= 1.1)
    found = dict(zip(several.tolist(), scanned(rows[several], places, seed)))
    return [found[k] if k in found and found[k][0] else laddered(s, places, seed) for k, s in enumerate(rows)]


READERS = {
    "scan": scanned,
    "peel": lambda rows, p, e: [(peeled(s, p, e), "PEEL") for s in rows],
    "ladder": climbed,
}


def slots(members: DataFrame, slot: str, number: str, places: int = PLACES, seed: int = 0) -> DataFrame:
    """(slot, re, im): members' codewords added up. Numbers are shuffled, never codewords; a slot has at most 1,365 different ones."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None  # the last slot of a part may go on in the next
        for whole in batches:
            for k in range(0, whole.num_rows, 5000):
                batch = whole.slice(k, 5000)
                names = batch.column("slot").to_numpy()
                begin = np.flatnonzero(np.diff(names, prepend=names[0] - 1))
                names, total = names[begin], _added(batch.column("x").to_numpy(), begin, places, seed)
                if held and held[0][0] == names[0]:
                    total[0] += held[1][0]
                elif held:
                    yield _slot_rows(*held)
                if len(names) > 1:
                    yield _slot_rows(names[:-1], total[:-1])
                held = names[-1:], total[-1:].copy()
        if held:
            yield _slot_rows(*held)

    rows = members.select(F.col(slot).cast("long").alias("slot"), F.col(number).cast("long").alias("x")).dropna().distinct()
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as there are: by the bytes of its numbers, a slot's work would be taken for none
    return rows.repartition(parts, "slot").sortWithinPartitions("slot", "x").mapInArrow(add, "slot long, re binary, im binary")


def _added(x: np.ndarray, begin: np.ndarray, places: int, seed: int) -> np.ndarray:
    """The sums of the numbers' codewords from each beginning to the next: the first of all, the second of all that have two, and so on."""
    n = np.diff(begin, append=len(x))
    order = np.argsort(-n, kind="stable")
    total = encoded(x[begin[order]], places, seed)
    for k in range(1, n.max()):
        more = order[: int((n > k).sum())]
        total[: len(more)] += encoded(x[begin[more] + k], places, seed)
    return total[np.argsort(order)]


def _slot_rows(names: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    ends = pa.py_buffer(np.arange(len(names) + 1, dtype=np.int32) * (4 * total.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(names)] + [pa.Array.from_buffers(pa.binary(), len(names), [None, ends, pa.py_buffer(np.ascontiguousarray(part))]) for part in (total.real, total.imag)], ["slot", "re", "im"])


def read(slot_rows: DataFrame, reader: str = "scan", places: int = PLACES, seed: int = 0) -> DataFrame:
    """(slot, rung, members array<struct<x, confidence>>) of every slot."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                re, im = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(-1, places) for c in ("re", "im"))
                found = READERS[reader](re + 1j * im, places, seed)
                hits = [h for f, _ in found for h in f]
                ends = np.cumsum([0] + [len(f) for f, _ in found], dtype=np.int32)
                held = pa.StructArray.from_arrays([pa.array([x for x, _ in hits], pa.int64()), pa.array([c for _, c in hits], pa.float64())], ["x", "confidence"])
                yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array([r for _, r in found], pa.string()), pa.ListArray.from_arrays(pa.array(ends), held)], ["slot", "rung", "members"])

    return slot_rows.mapInArrow(go, "slot long, rung string, members array<struct<x: bigint, confidence: double>>")
