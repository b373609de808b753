"""Array functions: norms, rotary embedding, gated units, Sinkhorn, mixes (survey F14-F21, K11, K18)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    """X over the root of its mean square."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    return F.transform(x, lambda v: v / F.sqrt(mean + eps))


def frequencies(dims: int, base: float = 10000.0, factor: float = 1.0, low: float = 0.0, high: float = 1.0) -> list[float]:
    """rotary frequencies of dims / 2 pairs; between the shares low and high of the pairs they blend into those divided by factor."""
    half = dims // 2
    out = []
    for j in range(half):
        f = base ** (-2 * j / dims)
        ramp = min(1.0, max(0.0, (j / max(half - 1, 1) - low) / max(high - low, 1e-9))) if factor != 1 else 0.0
        out.append(f * (1 - ramp) + f / factor * ramp)
    return out


def rope(x: Column, pos: Column, dims: int, size: int, inverse: bool = False) -> Column:
    """the last dims of size entries rotated in neighbouring pairs by pos times each pair's frequency."""
    freq = F.array(*(F.lit(f) for f in frequencies(dims)))
    start, sign = size - dims, -1.0 if inverse else 1.0

    def turn(v: Column, i: Column) -> Column:
        pair = ((i - start) / 2).cast("int")
        angle = pos * freq[F.greatest(pair, F.lit(0))] * sign
        even = (i - start) % 2 == 0
        other = x[F.when(even, i + 1).otherwise(F.greatest(i - 1, F.lit(0)))]
        return F.when(i < start, v).otherwise(F.when(even, v * F.cos(angle) - other * F.sin(angle)).otherwise(v * F.cos(angle) + other * F.sin(angle)))

    return F.transform(x, turn)


def swiglu(gate: Column, up: Column, limit: float) -> Column:
    """silu of the gate (at most limit) times up (within limits)."""
    g = lambda v: F.least(v, F.lit(limit))
    u = lambda v: F.greatest(F.least(v, F.lit(limit)), F.lit(-limit))
    return F.zip_with(gate, up, lambda a, b: g(a) / (1 + F.exp(-g(a))) * u(b))


def signed_root_gate(d: Column) -> Column:
    """F16: sigmoid of the signed root of d."""
    root = F.sqrt(F.greatest(F.abs(d), F.lit(1e-6)))
    return 1 / (1 + F.exp(-F.when(d < 0, -root).otherwise(root)))


def sinkhorn(column: Column, rounds: int = 20) -> Column:
    """exp of a flat 4 x 4 array, its rows and columns scaled in turn; a fixed number of rounds.

    A null array, one of another size and one that holds a null or NaN give null.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        good = np.array([v is not None and len(v) == 16 and not any(e is None or e != e for e in v) for v in x], bool)
        out = pd.Series([None] * len(x), dtype=object)
        if not good.any():
            return out
        m = np.exp(np.stack(x[good].to_list()).astype(np.float64).reshape(-1, 4, 4))
        for _ in range(rounds):
            m = m / m.sum(2, keepdims=True)
            m = m / m.sum(1, keepdims=True)
        out[good] = pd.Series(list(m.reshape(-1, 16)), index=out.index[good])
        return out

    return run(column)


def mix(rows: Column, weights: Column) -> Column:
    """weighted sum of an array of arrays."""
    zero = F.transform(rows[0], lambda v: F.lit(0.0))
    return F.aggregate(F.arrays_zip(rows.alias("r"), weights.alias("w")), zero, lambda a, e: F.zip_with(a, e["r"], lambda p, q: p + e["w"] * q))
