"""Vectorised word arrays over Arrow string buffers.

Words are maximal runs of bytes other than space and TAB..CR.  All delimiters
are ASCII, so UTF-8 bytes can be scanned without decoding.  Word hashes are
64-bit polynomial sums over a random byte table, finished by a mixing step.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C13)  # = 3 mod 8, so powers differ by few factors of two
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX = tuple(np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1))

_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 1 << 24:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as empty."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 18):
    """Row ranges whose bytes stay under limit, but for a single longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """The words of some texts that lie one behind the other in a byte array.

    apart: which bytes stand between words.  starts, ends: byte ranges.  first: index of each text's first word, with
    the word count at its end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, apart: np.ndarray = _IS_SPACE):
        self._split(~apart[data], offsets)
        self.letters = (_LOWER[data] if lower else data, _TABLE)

    @classmethod
    def of(cls, letters: np.ndarray, solid: np.ndarray, offsets: np.ndarray) -> "Words":
        """Words of texts given by a 64-bit number for each letter, and which letters are a word's."""
        out = cls.__new__(cls)
        out._split(solid, offsets)
        out.letters = (slice(None), letters)
        return out

    def _split(self, inside: np.ndarray, offsets: np.ndarray) -> None:
        self.offsets, n = offsets, len(inside)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = inside
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.size = n
        self.starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        n = self.size
        total = np.zeros(n + 1, np.uint64)
        at, numbers = self.letters
        np.cumsum(numbers[at] * _power("p", _P, n), out=total[1:])
        own = (total[self.ends] - total[self.starts]) * _power("inv", _P_INV, n)[self.starts] if n else np.zeros(0, np.uint64)
        return mix(own + (self.ends - self.starts).astype(np.uint64) * _MIX[0])


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; k-1 fewer entries than words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64) * _MIX[15]
    for i in range(k):
        out += mix(hashes[i : i + n] * _MIX[1 + i % 13] + np.uint64(i))
    return mix(out)
