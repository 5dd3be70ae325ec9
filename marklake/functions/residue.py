"""Residue numbers: rings, Chinese remainders, the check ring, addresses."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = (3, 5, 7, 13)
CHECK = 17
ADDRESS_SPACE = 113 * 127 * 131


def modular_inverse(a: int, m: int) -> int:
    return pow(a, -1, m)


def crt_weights(moduli: tuple[int, ...]) -> tuple[list[int], int]:
    """Factors w with x = sum(w * residue) mod M."""
    whole = prod(moduli)
    return [whole // m * modular_inverse(whole // m, m) for m in moduli], whole


def residues(x: Column, moduli: tuple[int, ...] = (*RINGS, CHECK)) -> list[Column]:
    return [F.pmod(x, F.lit(m)) for m in moduli]


def solve_crt(parts: list[Column], moduli: tuple[int, ...]) -> Column:
    """The one number below the moduli's product with these residues; null if a residue is null."""
    if len(parts) != len(moduli):
        raise ValueError("as many residues as moduli")
    weights, whole = crt_weights(moduli)
    total = sum((p.cast("bigint") * F.lit(w).cast("bigint") for p, w in zip(parts, weights)), F.lit(0).cast("bigint"))
    return F.pmod(total, F.lit(whole))


def checked(parts: list[Column]) -> Column:
    """VERIFIED if the five residues are those of a legal number, else REJECTED. It detects any single wrong ring and corrects none."""
    x = solve_crt(parts, (*RINGS, CHECK))
    return F.when(x.isNull(), "ABSTAIN").when(x < prod(RINGS), "VERIFIED").otherwise("REJECTED")


def address(key: Column, space: int = ADDRESS_SPACE) -> Column:
    """Address of a key by a digest's first 60 bits."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), F.lit(space))


def advanced(parts: list[Column], steps: Column, moduli: tuple[int, ...] = RINGS) -> list[Column]:
    """Residues some ticks on. Four rings come round after 1,365; with the check ring a number beyond is illegal."""
    return [F.pmod(p + steps, F.lit(m)) for p, m in zip(parts, moduli)]
