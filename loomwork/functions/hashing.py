"""Rolling n-gram hashes: multipliers, primes, offsets and the hash itself (survey H1-H5)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: a layer's seed is its number times this.
LAYER_SEED = 10007


def is_prime(n: int) -> bool:
    if n < 4:
        return n > 1
    return n % 2 == 1 and all(n % d for d in range(3, int(n**0.5) + 1, 2))


def distinct_primes(above: int, count: int) -> list[int]:
    """H3: the next count primes above a number, each larger than the one before."""
    out, n = [], above
    while len(out) < count:
        n += 1
        if is_prime(n):
            out.append(n)
    return out


def multipliers(count: int, seed: int, vocabulary: int) -> list[int]:
    """H2: seeded odd multipliers, small enough that no product with a token id leaves 63 bits."""
    top = max(1, (2**63 - 1) // vocabulary // 2)
    return [int(v) * 2 + 1 for v in np.random.default_rng(seed).integers(0, top, count)]


def exclusive_sums(sizes: list[int]) -> list[int]:
    """Start of each of some consecutive ranges."""
    return [int(v) for v in np.cumsum([0, *sizes[:-1]])]


@dataclass(frozen=True)
class NgramHash:
    """Hash tables of all n-gram lengths 2 to n and heads; ids of different tables never meet."""

    n: int
    heads: int
    multipliers: tuple[int, ...]
    primes: tuple[tuple[int, ...], ...]
    offsets: tuple[tuple[int, ...], ...]

    @classmethod
    def layers(cls, layers: list[int], n: int, heads: int, size: int, vocabulary: int) -> dict[int, "NgramHash"]:
        """One scheme a layer: multipliers by the layer's seed, table sizes that no layer shares, offsets within the layer."""
        per = (n - 1) * heads
        sizes = distinct_primes(size - 1, per * len(layers))
        cut = lambda x: tuple(tuple(x[i * heads : (i + 1) * heads]) for i in range(n - 1))
        out = {}
        for k, layer in enumerate(layers):
            own = sizes[k * per : (k + 1) * per]
            out[layer] = cls(n, heads, tuple(multipliers(n, LAYER_SEED * layer, vocabulary)), cut(own), cut(exclusive_sums(own)))
        return out

    @classmethod
    def make(cls, n: int, heads: int, size: int, vocabulary: int, layer: int = 0) -> "NgramHash":
        return cls.layers([layer], n, heads, size, vocabulary)[layer]

    def columns(self, history: list[Column]) -> list[Column]:
        """H1: ids for history = the token and the n - 1 before it."""
        rolled, out = history[0] * F.lit(self.multipliers[0]), []
        for i in range(1, self.n):
            rolled = rolled.bitwiseXOR(history[i] * F.lit(self.multipliers[i]))
            out += [F.pmod(rolled, F.lit(p)) + F.lit(o) for p, o in zip(self.primes[i - 1], self.offsets[i - 1])]
        return out

    def sql(self, history: list[str]) -> list[str]:
        """columns() for DuckDB."""
        rolled, out = f"({history[0]} * {self.multipliers[0]})", []
        for i in range(1, self.n):
            rolled = f"xor({rolled}, {history[i]} * {self.multipliers[i]})"
            out += [f"({rolled} % {p} + {o})" for p, o in zip(self.primes[i - 1], self.offsets[i - 1])]
        return out


def build_tag(source: str, length: int = 12) -> Column:
    """Content-addressed tag, the first hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(source), 1, length)
