"""More readers of superposed slots: guided settling, joint search, block votes, clamping to the nearest legal mark, refinement by errors.

As in decode.py every slot is read by itself with constant codebooks, and a reader abstains or rejects instead of guessing. Functions on one slot take complex vectors of `places`; `read` of decode.py runs
them over a table by the names in `READERS`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.functions.phases import codeword as phases
from marklake.functions.phases import nearest_phases
from marklake.functions.residue import CHECK, RINGS
from marklake.operators.decode import PLACES, READERS, STATES, books, from_residues, lattice, scanned

ALL = (*RINGS, CHECK)
CUE = ALL.index(13)
NULL, CONFIDENT, PROJECTS = 1e-9, 0.5, 0.5  # nothing left in a slot; the least lead of a settled ring; the least share of a mark that a candidate explains
ScoredNumbers = list[tuple[int, float]]


def codeword(x: int, places: int = PLACES, seed: int = 0) -> np.ndarray:
    """Of any residues' number, legal or not."""
    return np.prod([book[x % m] for m, book in zip(ALL, books(places, seed))], axis=0)


def settled(slot: np.ndarray, places: int, seed: int, cue: int, ring: int = CUE, rounds: int = 30, rings: int = len(ALL), starts: int = 4) -> tuple[list[int], list[float], bool]:
    """(residues, leads of the rings, converged) of a member whose residue on one ring is known: that ring stays as it is, the others clean each other up. Of several uneven starts the most confident one counts."""
    own, best = books(places, seed)[:rings], None
    for start in range(starts):
        rng = np.random.default_rng(start)
        estimate = [book[cue] if k == ring else rng.random(len(book)) @ book for k, book in enumerate(own)]
        shares, converged = [np.zeros(len(book)) for book in own], False
        for _ in range(rounds):
            before = [s.copy() for s in shares]
            for k, book in enumerate(own):
                if k == ring:
                    shares[k] = (np.arange(len(book)) == cue).astype(float)
                    continue
                rest = slot * np.conj(np.prod([estimate[j] / np.maximum(np.abs(estimate[j]), 1e-9) for j in range(rings) if j != k], axis=0))
                held = np.maximum((book.conj() @ rest).real / places, 0) ** 2
                shares[k] = held / max(held.max(), 1e-12)
                estimate[k] = shares[k] @ book
            if max(np.abs(a - b).max() for a, b in zip(before, shares)) < 1e-5:
                converged = True
                break
        leads = [float(1 - np.sort(s)[-2]) for s in shares]
        if best is None or min(leads) > min(best[1]):
            best = ([int(s.argmax()) for s in shares], leads, converged)
    return best


def cued(slot: np.ndarray, places: int, seed: int, ring: int = CUE, sweeps: int = 2) -> ScoredNumbers:
    """Every value of one ring is tried as a cue; what settles to a legal number with confidence on all other rings is a member and explained away. Again, until nothing is left or the sweeps are over."""
    rest, found = slot.copy(), {}
    for _ in range(sweeps):
        if np.abs(rest).mean() < NULL:
            break
        for cue in range(ALL[ring]):
            residues, leads, _ = settled(rest, places, seed, cue, ring)
            confidence = min(c for k, c in enumerate(leads) if k != ring)
            x, status = from_residues(residues)
            if status == "VERIFIED" and confidence >= CONFIDENT and x not in found and (codeword(x, places, seed).conj() @ rest).real / places >= PROJECTS:
                found[x] = confidence
                rest = rest - codeword(x, places, seed)
    return list(found.items())


@lru_cache(maxsize=4)
def _products(places: int, seed: int, left_out: int | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(residues, conjugated codewords over the first `size` places) of all combinations of the rings but one."""
    rings = [k for k in range(len(ALL)) if k != left_out]
    residues = np.stack(np.meshgrid(*[np.arange(ALL[k]) for k in rings], indexing="ij"), -1).reshape(-1, len(rings))
    words = np.prod([books(places, seed)[k][:, :size][residues[:, j]] for j, k in enumerate(rings)], axis=0)
    return residues, words.conj().astype(np.complex64)


def joint(slot: np.ndarray, places: int, seed: int, ring: int = CUE, size: int = 1024, most: int | None = None) -> ScoredNumbers:
    """All combinations of the other rings are held against the first `size` places under every value of one ring; the best is a member if it is legal, new and explains half a mark, and is explained away. It ends with the first
    that is not."""
    rest, found, size = slot.copy(), {}, min(size, places)
    residues, words = _products(places, seed, ring, size)
    while most is None or len(found) < most:
        score = (words @ (rest[:size, None] * books(places, seed)[ring][:, :size].T.conj()).astype(np.complex64)).real
        row, value = np.unravel_index(int(score.argmax()), score.shape)
        parts = residues[row].tolist()
        parts.insert(ring, int(value))
        x, status = from_residues(parts)
        share = float((codeword(x, places, seed).conj() @ rest).real / places)
        if share < PROJECTS or status != "VERIFIED" or x in found:
            break
        found[x] = share
        rest = rest - codeword(x, places, seed)
    return list(found.items())


def blocks(shape: str, places: int, n: int = 32, seed: int = 0) -> list[np.ndarray]:
    """The places in parts: CONTIG neighbours, STRIDE every n-th, TRI by remainders of 3 and 5 in two halves, HEX cells of a honeycomb over a square, RANDOM."""
    at = np.arange(places)
    if shape == "CONTIG":
        return np.array_split(at, n)
    if shape == "STRIDE":
        return [at[k::n] for k in range(n)]
    if shape == "RANDOM":
        return np.array_split(np.random.default_rng(seed).permutation(places), n)
    if shape == "TRI":
        name = at % 15 + 15 * (at * 2 // places)  # remainders of 3 and 5 are those of 15
    elif shape == "HEX":
        side, radius = isqrt(places), max(1, isqrt(places // n // 3))
        across = (at % side) / (1.5 * radius)
        down = (at // side - np.floor(across) % 2 * 0.87 * radius) / (1.73 * radius)
        name = np.floor(across) * places + np.floor(down)
    else:
        raise ValueError(f"unknown shape {shape}")
    return [at[name == k] for k in np.unique(name)]


def parted(slot: np.ndarray, places: int, seed: int, shape: str = "CONTIG", n: int = 32, first: int = 2, rounds: int = 3) -> tuple[list[int], float]:
    """(residues, agreement) of the strongest member: all combinations of residues are tried on the first blocks, then every block votes for each ring's residue with the other rings unbound, some rounds long."""
    own, parts = books(places, seed), [b for b in blocks(shape, places, n, seed) if len(b)]
    votes = [np.zeros(m) for m in ALL]
    residues, _ = _products(places, seed, None, 1)
    for block in parts[:first]:
        words = np.ones((len(residues), len(block)), dtype=np.complex64)
        for k in range(len(ALL)):
            words *= own[k][:, block][residues[:, k]]
        best = residues[(words.conj() @ slot[block]).real.argmax()]
        for k, r in enumerate(best):
            votes[k][r] += 1
    estimate, agreement = [int(v.argmax()) for v in votes], 0.0
    for _ in range(rounds):
        shares = []
        for k, book in enumerate(own):
            rest = slot * np.conj(np.prod([own[j][estimate[j]] for j in range(len(own)) if j != k], axis=0))
            ballot = np.bincount([int((book[:, b].conj() @ rest[b]).real.argmax()) for b in parts], minlength=len(book))
            shares.append(ballot / len(parts))
        estimate, agreement = [int(s.argmax()) for s in shares], float(np.mean([s.max() for s in shares]))
    return estimate, agreement


def guided(slot: np.ndarray, places: int, seed: int, cue: int, ring: int = CUE, check: bool = True) -> tuple[int | None, str, float]:
    """(number, status, confidence) of the member with a known residue on one ring. With the check ring VERIFIED, REJECTED (converged to no legal number) or ABSTAIN (not converged); without it, on the data rings alone, CONVERGED, of
    which nothing vouches for the number, or ABSTAIN."""
    rings = len(ALL) if check else len(RINGS)
    residues, leads, converged = settled(slot, places, seed, cue, ring, rings=rings)
    confidence = float(np.mean(leads))
    if not converged:
        return None, "ABSTAIN", confidence
    if not check:
        whole = prod(RINGS)
        return sum(r * (whole // m) * pow(whole // m, -1, m) for r, m in zip(residues, RINGS)) % whole, "CONVERGED", confidence
    x, status = from_residues(residues)
    return (x, status, confidence) if status == "VERIFIED" else (None, status, 0.0)


def auto(rows: np.ndarray, places: int, seed: int, bytes_: int = 512 << 20) -> list[tuple[ScoredNumbers, str]]:
    """The whole lattice where it fits into so many bytes, else joint search, which needs none."""
    if STATES * places <= bytes_:
        return scanned(rows, places, seed)
    return [(joint(s, places, seed), "JOINT") for s in rows]


def unguided(numbers: np.ndarray, places: int, seed: int) -> float:
    """The share of clean marks that resonate to themselves without a cue."""
    from marklake.operators.decode import resonated

    return float(np.mean([from_residues(resonated(codeword(int(x), places, seed), places, seed)[0])[0] == x for x in numbers]))


# Marks that hold a number directly: the sum, not the product, of its residues' codewords, so every ring can be probed by itself.


@lru_cache(maxsize=4)
def direct_books(places: int = PLACES, seed: int = 0) -> list[np.ndarray]:
    """For each ring a codeword of its own for every residue: in a sum, the rings' parts must not look alike."""
    return [np.exp(2j * np.pi / 16 * np.stack([phases(f"DIRECT:{m}:{r}", places, seed) for r in range(m)])) for m in ALL]


def direct(x: np.ndarray, places: int = PLACES, seed: int = 0) -> np.ndarray:
    """Phases of numbers."""
    return nearest_phases(sum(book[x % m] for m, book in zip(ALL, direct_books(places, seed))))


def probed(v: np.ndarray, places: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(residues, leads) of vectors (rows) by 45 probes: the best residue of each ring and its lead over the second as a share of it."""
    parts, leads = [], []
    for book in direct_books(places, seed):
        score = (v @ book.conj().T).real
        second, first = np.sort(score, axis=1)[:, -2:].T
        parts.append(score.argmax(1))
        leads.append(np.clip((first - second) / (np.abs(first) + 1e-9), 0, 1))
    return np.stack(parts, 1), np.stack(leads, 1)


@dataclass(frozen=True)
class Clamp:
    places: int = PLACES
    seed: int = 0
    least: float = 0.05


def clamped(df: DataFrame, id_col: str, mark_col: str, clamp: Clamp = Clamp()) -> DataFrame:
    """(id, status, x, confidence, clean): a noisy direct mark pulled to the nearest legal one. AMBIGUOUS where the rings' mean lead is under `least`, SLIP_REJECTED where the residues are of no legal number, else CLAMPED with the number
    and its clean mark. Null marks and marks of another length give a null status."""
    kind = df.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                marks = [m if m is not None and len(m) == clamp.places and None not in m else None for m in batch.column("mark").to_pylist()]
                there = [j for j, m in enumerate(marks) if m is not None]
                status, x, confidence, clean = ([None] * len(marks) for _ in range(4))
                if there:
                    residues, leads = probed(np.exp(2j * np.pi * np.array([marks[j] for j in there]) / 16), clamp.places, clamp.seed)
                    for j, parts, lead in zip(there, residues.tolist(), leads.mean(1).tolist()):
                        number, legal = from_residues(parts)
                        confidence[j] = lead
                        status[j] = "AMBIGUOUS" if lead < clamp.least else "CLAMPED" if legal == "VERIFIED" else "SLIP_REJECTED"
                        if status[j] == "CLAMPED":
                            x[j], clean[j] = number, direct(np.array([number]), clamp.places, clamp.seed)[0].tolist()
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(status, pa.string()), pa.array(x, pa.int64()), pa.array(confidence, pa.float64()), pa.array(clean, pa.list_(pa.int32()))], ["id", "status", "x", "confidence", "clean"])

    rows = df.select(F.col(id_col).alias("id"), F.col(mark_col).cast("array<int>").alias("mark"))
    return rows.mapInArrow(go, f"id {kind}, status string, x long, confidence double, clean array<int>").withColumnRenamed("id", id_col)


def refined(slot_rows: DataFrame, members: DataFrame, slot: str, number: str, passes: int = 10, margin: float = 0.1, step: float = 0.5, places: int = PLACES, seed: int = 0) -> DataFrame:
    """(slot, re, im, right): slots made surer by their errors. In every pass, each member that leads the strongest other number by less than `margin` is added again by `step`, and that number taken off. right: the share of members
    that lead at the end. A slot's members go together; there are 1,365 at most."""
    known = members.select(F.col(slot).cast("long").alias("slot"), F.col(number).cast("long").alias("x")).dropna().distinct().groupBy("slot").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = lattice(places, seed)
        for batch in batches:
            re, im = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(-1, places).copy() for c in ("re", "im"))
            right = []
            for k, own in enumerate(batch.column("xs").to_pylist()):
                own = np.array(own)
                for n in range(passes + 1):
                    score = (book.conj() @ (re[k] + 1j * im[k])).real / places
                    rival = score.copy()
                    rival[own] = -np.inf
                    best = int(rival.argmax())
                    lead = score[own] - rival[best]
                    weak = own[lead < margin]
                    if n == passes or not len(weak):
                        break
                    change = step * (book[weak].sum(0) - book[best])
                    re[k] += change.real
                    im[k] += change.imag
                right.append(float((lead > 0).mean()))
            yield pa.RecordBatch.from_arrays([batch.column("slot"), *(pa.array([r.tobytes() for r in part], pa.binary()) for part in (re, im)), pa.array(right)], ["slot", "re", "im", "right"])

    return slot_rows.join(known, "slot").select("slot", "re", "im", "xs").mapInArrow(go, "slot long, re binary, im binary, right double")


READERS |= {
    "cued": lambda rows, p, e: [(cued(s, p, e), "CUED") for s in rows],
    "joint": lambda rows, p, e: [(joint(s, p, e), "JOINT") for s in rows],
    "auto": auto,
}
