"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents.  Its matrix keeps one bit-plane
per bit of an id, highest first; each plane lists the bits in the order that
the planes above have sorted the ids into, zeros before ones.  Cumulative
counts per block of 512 bits give rank, and a search in them gives select, so
one shard answers access, counting and occurrence lookup without unpacking.

File format: Parquet, one row per shard: part, seq (place of the shard),
doc_ids, sizes (documents and their numbers of ids, in order), n_ids, matrix
(binary).  matrix: magic ``WVM1``, then little-endian unsigned 32-bit number
of planes, 64-bit number of ids, 64-bit zeros of each plane, then per plane
its counts before each block (unsigned 32-bit) and its packed bits.  Spark
writes and reads the files, so any store that Spark knows can hold them.

Defined results: a null text is empty; documents of one doc_id stay together
in no set order; a null doc_id sorts first.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import pretoken, worker
from loomwork.llm import words as W
from loomwork.plans import storage

MAGIC = b"WVM1"
BLOCK = 512
SHARD_IDS = 1 << 21
CACHE_ENTRIES = 2_000_000  # about 20 bytes each, and 2 or 4 an id


class WaveletMatrix:
    """Access, rank and select over a sequence of ids below 2 ** planes."""

    def __init__(self, n: int, zeros: np.ndarray, counts: list[np.ndarray], bits: list[np.ndarray]):
        self.n, self.zeros, self.counts, self.bits = n, zeros, counts, bits
        self.planes = len(bits)

    @classmethod
    def build(cls, ids: np.ndarray, planes: int) -> "WaveletMatrix":
        x = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        zeros, counts, bits = np.zeros(planes, np.int64), [], []
        for level in range(planes):
            one = (x & x.dtype.type(1 << (planes - 1 - level))).astype(bool)
            packed = np.packbits(one, bitorder="little")
            bits.append(packed)
            counts.append(cls._blocks(packed))
            # taking by index is several times faster than by mask
            low = np.flatnonzero(~one)
            zeros[level] = z = len(low)
            y = np.empty_like(x)
            np.take(x, low, out=y[:z], mode="clip")
            np.take(x, np.flatnonzero(one), out=y[z:], mode="clip")
            x = y
        return cls(len(ids), zeros, counts, bits)

    @staticmethod
    def _blocks(packed: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(packed)
        ones = np.pad(ones, (0, -len(ones) % (BLOCK // 8))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def tobytes(self) -> bytes:
        head = MAGIC + np.array([self.planes], "<u4").tobytes() + np.array([self.n], "<u8").tobytes() + self.zeros.astype("<u8").tobytes()
        return b"".join([head, *(x for c, b in zip(self.counts, self.bits) for x in (c.astype("<u4").tobytes(), b.tobytes()))])

    @classmethod
    def frombytes(cls, raw) -> "WaveletMatrix":
        raw = memoryview(raw)
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        planes, n = int(np.frombuffer(raw, "<u4", 1, 4)[0]), int(np.frombuffer(raw, "<u8", 1, 8)[0])
        zeros, at = np.frombuffer(raw, "<u8", planes, 16).astype(np.int64), 16 + 8 * planes
        size = (n + 7) // 8
        blocks = -(-size // (BLOCK // 8)) + 1
        counts, bits = [], []
        for _ in range(planes):
            counts.append(np.frombuffer(raw, "<u4", blocks, at))
            at += 4 * blocks
            bits.append(np.frombuffer(raw, np.uint8, size, at))
            at += size
        return cls(n, zeros, counts, bits)

    def _bit(self, level: int, i: int) -> int:
        return int(self.bits[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before i."""
        block = i // BLOCK
        total = int(self.counts[level][block])
        a, b = block * (BLOCK // 8), i >> 3
        total += int(np.bitwise_count(self.bits[level][a:b]).sum())
        if i & 7:
            total += (int(self.bits[level][b]) & ((1 << (i & 7)) - 1)).bit_count()
        return total

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        ones = self.counts[level].astype(np.int64)
        have = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(have, k, "right")) - 1
        part = np.unpackbits(self.bits[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(have[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for level in range(self.planes):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return out

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for level in range(self.planes):
            oa, ob = self._ones(level, a), self._ones(level, b)
            if symbol >> (self.planes - 1 - level) & 1:
                a, b = int(self.zeros[level]) + oa, int(self.zeros[level]) + ob
            else:
                a, b = a - oa, b - ob
        return a, b

    def rank(self, symbol: int, end: int | None = None) -> int:
        """How often symbol stands before position end."""
        a, b = self._range(symbol, self.n if end is None else end)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of symbol."""
        a, b = self._range(symbol, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.planes)):
            if symbol >> (self.planes - 1 - level) & 1:
                i = self._select(level, 1, i - int(self.zeros[level]))
            else:
                i = self._select(level, 0, i)
        return i

    def ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane upwards."""
        x = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for level in reversed(range(self.planes)):
            one = np.unpackbits(self.bits[level], count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            z = int(self.zeros[level])
            y[np.flatnonzero(~one)] = x[:z]
            y[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << (self.planes - 1 - level))
            x = y
        return x


class LibraryEncoder:
    """The tokenizers library's ids, asked once per distinct pre-token while it is cached.

    Pre-tokens are told apart by 64-bit hashes of their code points, found for
    all of a batch at once; the cache is a sorted array of hashes with places
    in one array of ids.  A text with one of the vocabulary's special strings
    goes to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.planes = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.uint16 if self.planes <= 16 else np.uint32
        self.table = W.mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: entry k has the ids from bounds[k] to bounds[k + 1] of the pool
        self.bounds, self.entries = np.zeros(1 << 16, np.int64), 0
        self.pool = np.zeros(1 << 20, self.kind)

    def _learn(self, at: np.ndarray, keys: np.ndarray, pieces: list[str]) -> None:
        """Put the library's ids of some pieces in the cache; their hashes are ascending and belong at places at."""
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        k, n, used = self.entries, len(found), int(self.bounds[self.entries])
        total = int(size.sum())
        if used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[:used], np.zeros(max(len(self.pool), total), self.kind)])
        if k + n + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds[: k + 1], np.zeros(max(len(self.bounds), n), np.int64)])
        self.pool[used : used + total] = np.fromiter(chain.from_iterable(found), self.kind, total)
        self.bounds[k + 1 : k + n + 1] = used + np.cumsum(size)
        self.entries = k + n
        place = at + np.arange(n)
        old = np.ones(len(self.keys) + n, bool)
        old[place] = False
        old = np.flatnonzero(old)
        for name, fresh in (("keys", keys), ("entry", np.arange(k, k + n, dtype=np.int32))):
            held = getattr(self, name)
            both = np.empty(len(held) + n, held.dtype)
            both[old], both[place] = held, fresh
            setattr(self, name, both)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one behind the other, and each text's first place in them with the count at the end."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=edges[1:])
        at = pretoken.boundaries(codes, edges[:-1])
        n = len(codes)
        if not n:
            return np.zeros(0, self.kind), edges
        ends = np.append(at[1:], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[codes] * W._power("p", W._P, n), out=total[1:])
        key = W.mix((total[ends] - total[at]) * W._power("inv", W._P_INV, n)[at] + (ends - at).astype(np.uint64) * W._MIX[0])
        order = np.argsort(key)
        sorted_ = key[order]
        head = np.append(True, sorted_[1:] != sorted_[:-1])
        own, first = sorted_[head], order[head]
        inverse = np.empty(len(key), np.int64)
        inverse[order] = np.cumsum(head) - 1
        if len(self.keys) > CACHE_ENTRIES:
            self._forget()
        place = np.searchsorted(self.keys, own)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == own[known]
        new = np.flatnonzero(~known)
        if len(new):
            s, e = at[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(place[new], own[new], [joined[a:b] for a, b in zip(s, e)])
            place = np.searchsorted(self.keys, own)
        entry = self.entry[place]
        start = self.bounds[entry]
        size = (self.bounds[entry + 1] - start)[inverse]
        after = np.cumsum(size)
        flat = np.repeat(start[inverse] - after + size, size)
        flat += np.arange(len(flat))
        return self.pool[flat], np.append(0, after)[np.searchsorted(at, edges)]

    def encode(self, texts: list[str]):
        """The ids of each text."""
        for i, j in pretoken.batches_of(texts, 1 << 21):
            whole = {r: np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind) for r, t in enumerate(texts[i:j]) if any(s in t for s in self.special)}
            ids, first = self._ids(["" if r in whole else t for r, t in enumerate(texts[i:j])])
            for r in range(j - i):
                yield whole[r] if r in whole else ids[first[r] : first[r + 1]]


def encoder(path: str) -> LibraryEncoder:
    """This worker's encoder of that file."""
    kept = worker.cache("wavelet")
    if path not in kept:
        kept[path] = LibraryEncoder(path)
    return kept[path]


SHARD_SCHEMA = "part int, seq int, doc_ids array<long>, sizes array<long>, n_ids long, matrix binary"


def write(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order, end_id behind each, as wavelet shards at path."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    worker.small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        own, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0
        end = np.array([end_id], own.kind)

        def shard():
            flat = np.concatenate([x for y in ids for x in (y, end)])
            matrix = WaveletMatrix.build(flat, own.planes).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(x) + 1 for x in ids]], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64()), pa.array([matrix], pa.binary())], names=["part", "seq", "doc_ids", "sizes", "n_ids", "matrix"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                piece = batch.slice(i, 1000)
                texts = ["" if t is None else t for t in piece.column(1).to_pylist()]
                for d, x in zip(piece.column(0).to_pylist(), own.encode(texts)):
                    doc_ids.append(d)
                    ids.append(x)
                    held += len(x) + 1
                    if held >= SHARD_IDS:
                        yield shard()
                        doc_ids, ids, held, seq = [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    dealt.mapInArrow(run, SHARD_SCHEMA).write.option("parquet.block.size", str(8 << 20)).option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The shards at path."""
    df = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the shards at path."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                part, seq, doc_ids, sizes, _, matrix = (batch.column(c)[r] for c in range(6))
                ids = WaveletMatrix.frombytes(matrix.as_buffer()).ids()
                n = sizes.values.to_numpy()
                at = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=at[1:])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), doc_ids.values, pa.array(at[:-1]), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    # sums over the shards of each part, and over parts (one row for each task that wrote)
    shards = read(spark, path, ["part", "seq", "n_ids"])
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = shards.withColumn("within", within).join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("within")).alias("before"))
    rows = read(spark, path).mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(starts) if storage.small_enough(starts, SHARDS_TO_SEND) else starts
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


#: At most so many shards have their starts broadcast (16 bytes each); more are joined.
SHARDS_TO_SEND = 100_000
