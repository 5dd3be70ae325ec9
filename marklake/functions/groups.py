"""The 24 unit quaternions of the binary tetrahedral group, and paths through it."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def elements() -> np.ndarray:
    """1, -1, i, -i, j, -j, k, -k, then all halves of +-1 +-i +-j +-k, plus signs first."""
    units = [s * e for e in np.eye(4) for s in (1.0, -1.0)]
    return np.array(units + [np.array(s) / 2 for s in product((1.0, -1.0), repeat=4)])


@lru_cache(maxsize=1)
def products() -> tuple[tuple[int, ...], ...]:
    """The 24 by 24 table of products, from the quaternions."""
    g = elements()
    w, v = g[:, 0], g[:, 1:]
    real = np.outer(w, w) - v @ v.T
    imaginary = w[:, None, None] * v[None] + w[None, :, None] * v[:, None] + np.cross(v[:, None], v[None])
    p = np.concatenate([real[:, :, None], imaginary], 2)
    return tuple(map(tuple, np.abs(p[:, :, None] - g[None, None]).sum(3).argmin(2).tolist()))


def multiplied(a: Column, b: Column) -> Column:
    """a times b; 0 if either is no element. Not commutative."""
    flat = F.array(*[F.lit(x) for row in products() for x in row])
    ok = a.between(0, 23) & b.between(0, 23)
    return F.when(ok, F.element_at(flat, (24 * a + b + 1).cast("int"))).otherwise(0)
