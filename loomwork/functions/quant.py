"""Block formats: FP8 (E4M3), FP4 (E2M1), INT8 and power-of-two scales over arrays (survey F1-F13, A15, J20).

A format is the grid of its magnitudes; a value becomes the nearest grid
value, of two equally near ones that of the even code.  Rounding works on all
values of an Arrow batch at once, in float32; blocks and rows are offsets into
them.  Decoding and packing are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

#: The magnitudes that E2M1 has, by code.
E2M1 = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
#: The magnitudes that E4M3 has, by code: three bits of mantissa, exponents from -6, subnormals below.
E4M3 = tuple((m if e == 0 else 8 + m) * 2.0 ** (max(e, 1) - 10) for e in range(16) for m in range(8))[:127]
FP8_MAX, FP4_MAX = E4M3[-1], E2M1[-1]


# ---- rounding of float32 arrays


def nearest_code(grid: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    """Code of the grid value that is nearest to each magnitude; ties go to the even code, what is larger to the last."""
    levels = np.array(grid, np.float64)
    middles = (levels[1:] + levels[:-1]) / 2
    a = np.abs(x).astype(np.float64)
    low, high = np.searchsorted(middles, a, "left"), np.searchsorted(middles, a, "right")
    return np.where(low % 2 == 0, low, high).astype(np.int32)


def on_grid(grid: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    return np.copysign(np.array(grid, np.float32)[nearest_code(grid, x)], x).astype(np.float32)


def round_e4m3(x: np.ndarray) -> np.ndarray:
    """nearest E4M3 value, ties to even, clamped."""
    return on_grid(E4M3, x)


def round_e2m1(x: np.ndarray) -> np.ndarray:
    """nearest E2M1 value, ties to even, clamped."""
    return on_grid(E2M1, x)


def ceil_log2(x: np.ndarray) -> np.ndarray:
    """exponent of the least power of two that is not below x (normal float32), read off its bits."""
    bits = np.ascontiguousarray(x, np.float32).view(np.int32)
    return (bits >> 23 & 0xFF) - 127 + ((bits & 0x7FFFFF) != 0)


def round_bf16(x: np.ndarray) -> np.ndarray:
    """nearest bfloat16, ties to even."""
    b = np.ascontiguousarray(x, np.float32).view(np.uint32)
    b = b + np.uint32(0x7FFF) + ((b >> np.uint32(16)) & np.uint32(1))
    return (b & np.uint32(0xFFFF0000)).view(np.float32)


class Blocks:
    """Blocks of at most size values of rows that lie one behind the other; offsets: where rows begin, with the end."""

    def __init__(self, offsets: np.ndarray, size: int):
        length = np.diff(offsets)
        self.per_row = -(-length // size)
        first = np.cumsum(self.per_row) - self.per_row
        row = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]
        self.of = first[row] + place // size  # the block of each value
        self.count = int(self.per_row.sum())

    def amax(self, x: np.ndarray) -> np.ndarray:
        """Largest magnitude of each block."""
        starts = np.flatnonzero(np.diff(self.of, prepend=-1))
        return np.maximum.reduceat(np.abs(x), starts) if len(x) else np.zeros(0, np.float32)


def block_scales(amax: np.ndarray, top: float, least: float, kind: str) -> np.ndarray:
    """scales that bring blocks under top; kind: "pow2" (the least power of two), "e4m3" (nearest E4M3 value) or "exact"."""
    want = (np.maximum(amax, np.float32(least)) / np.float32(top)).astype(np.float32)
    if kind == "pow2":
        return np.ldexp(np.float32(1), ceil_log2(want)).astype(np.float32)
    return round_e4m3(want) if kind == "e4m3" else want


#: Fixed values of each block format: values a block, largest magnitude of the grid, least block maximum, kind of scale.
_BLOCKED = {
    "fp8": (32, FP8_MAX, 1e-4, "pow2"),
    "fp4": (32, FP4_MAX, FP4_MAX * 2.0**-126, "pow2"),
    "fp4_e4m3": (16, FP4_MAX, FP4_MAX * 2.0**-9, "e4m3"),
    "int8": (32, 127.0, 0.0, "exact"),
}
_ROUND: dict[str, Callable[[np.ndarray], np.ndarray]] = {"fp8": round_e4m3, "fp4": round_e2m1, "fp4_e4m3": round_e2m1, "int8": np.rint}
KINDS = (*_BLOCKED, "bf16")


def fake(x: np.ndarray, offsets: np.ndarray, kind: str) -> np.ndarray:
    """The rows' values as they come back from a format; a block of zeros stays zero."""
    x = np.ascontiguousarray(x, np.float32)
    if kind == "bf16":
        return round_bf16(x)
    size, top, least, scale = _BLOCKED[kind]
    blocks = Blocks(offsets, size)
    s = block_scales(blocks.amax(x), top, least, scale)[blocks.of]
    return (_ROUND[kind](x / np.where(s == 0, np.float32(1), s)) * s).astype(np.float32)


def fake_row(x: np.ndarray, kind: str) -> np.ndarray:
    """fake() of one row."""
    return fake(x, np.array([0, len(x)]), kind)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as float32, offsets, which are null) of an array column; a null row is empty."""
    column = column.cast(pa.list_(pa.float32()))
    flat = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    return flat.fill_null(0).to_numpy(zero_copy_only=False), offsets, missing


def _rows(values: pa.Array, offsets: np.ndarray, column: pa.Array) -> pa.Array:
    """Values as arrays by offsets, null where column is."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=column.is_null())


def fake_quant(df: DataFrame, column: str, kind: str, name: str) -> DataFrame:
    """df with the array column as it comes back from a format; null rows and entries stay null."""
    if kind not in KINDS:
        raise ValueError(kind)
    schema, at = StructType([*df.schema.fields, StructField(name, ArrayType(FloatType()))]), df.columns.index(column)

    def run(batches):
        for batch in batches:
            x, offsets, missing = _flat(batch.column(at))
            y = pa.array(fake(x, offsets, kind), pa.float32(), mask=missing)
            yield pa.RecordBatch.from_arrays([*batch.columns, _rows(y, offsets, batch.column(at))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


# ---- codes


def e8m0(code: Column) -> Column:
    """2 ** (code - 127) for codes 0 to 254; 255 is null."""
    return F.when(code < 255, F.pow(F.lit(2.0), code - 127))


def decode_e4m3(code: Column) -> Column:
    """Value of an E4M3 byte (0 to 255); the two NaN codes are null."""
    e, m = F.shiftright(code.bitwiseAND(F.lit(127)), 3), code.bitwiseAND(F.lit(7))
    size = F.when(e == 0, m * 2.0**-9).otherwise((1 + m / 8) * F.pow(F.lit(2.0), e - 7))
    return F.when(code.bitwiseAND(F.lit(127)) != 127, F.when(code >= 128, -size).otherwise(size))


def decode_e2m1(code: Column) -> Column:
    """Value of an E2M1 code (0 to 15)."""
    size = F.element_at(F.array(*(F.lit(v) for v in E2M1)), code.bitwiseAND(F.lit(7)) + 1)
    return F.when(code >= 8, -size).otherwise(size)


def pack_nibbles(codes: Column) -> Column:
    """array of codes (0 to 15) as array of bytes, the low half first; the last high half of an odd number is 0."""
    half = F.sequence(F.lit(0), F.ceil(F.size(codes) / 2).cast("int") - 1)
    high = lambda i: F.coalesce(F.get(codes, i * 2 + 1), F.lit(0))
    return F.when(F.size(codes) > 0, F.transform(half, lambda i: F.get(codes, i * 2).bitwiseOR(F.shiftleft(high(i), 4)))).otherwise(F.when(codes.isNotNull(), F.array().cast("array<int>")))


def unpack_nibbles(packed: Column, count: Column | None = None) -> Column:
    """the codes of pack_nibbles(), the first count of them."""
    codes = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4))))
    return codes if count is None else F.slice(codes, F.lit(1), count)


def tile(x: Column, rows: int, cols: int, tile_rows: int, tile_cols: int) -> Column:
    """a row-major rows x cols array in tiles, each row-major."""
    per = cols // tile_cols
    size = tile_rows * tile_cols
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: x[(F.floor(i / size / per) * tile_rows + F.floor(i % size / tile_cols)).cast("int") * cols + (F.floor(i / size) % per * tile_cols + i % tile_cols).cast("int")])


def untile(x: Column, rows: int, cols: int, tile_rows: int, tile_cols: int) -> Column:
    """the inverse of tile()."""
    per, size = cols // tile_cols, tile_rows * tile_cols

    def at(i: Column) -> Column:
        r, c = F.floor(i / cols), i % cols
        return ((F.floor(r / tile_rows) * per + F.floor(c / tile_cols)) * size + r % tile_rows * tile_cols + c % tile_cols).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: x[at(i)])


def dequantize(codes: Column, scales: Column, block: int) -> Column:
    """E4M3 codes times the E8M0 scale of their block; both arrays of one row."""
    return F.transform(codes, lambda c, k: decode_e4m3(c) * e8m0(scales[(k / block).cast("int")]))


def quantize_fp8(x: np.ndarray, offsets: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """E4M3 codes of the rows' values, E8M0 scale codes of their blocks, and each row's number of blocks."""
    x = np.ascontiguousarray(x, np.float32)
    blocks = Blocks(offsets, block)
    _, top, least, scale = _BLOCKED["fp8"]
    s = block_scales(blocks.amax(x), top, least, scale)
    v = x / s[blocks.of]
    return nearest_code(E4M3, v) + 128 * np.signbit(v), ceil_log2(s) + 127, blocks.per_row


def encode_fp8(df: DataFrame, column: str) -> DataFrame:
    """df with codes and scales of the array column (F7); a null row has null ones, a null entry a null code."""
    schema = StructType([*df.schema.fields, StructField("codes", ArrayType(IntegerType())), StructField("scales", ArrayType(IntegerType()))])
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            own = batch.column(at)
            x, offsets, missing = _flat(own)
            codes, scales, per_row = quantize_fp8(x, offsets)
            ends = np.concatenate([[0], np.cumsum(per_row)])
            both = [_rows(pa.array(codes, pa.int32(), mask=missing), offsets, own), _rows(pa.array(scales, pa.int32()), ends, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], names=[*batch.schema.names, "codes", "scales"])

    return df.mapInArrow(run, schema)
