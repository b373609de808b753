"""Byte-level BPE encoding and decoding by ranks.

Pre-tokens found by class scans feed a pair merging whose results are cached
per pre-token in each Python worker; the cache is emptied at a fixed number of
entries, which changes speed, never results.  Ids and the byte offset of each
id are kept, so any range of ids decodes to its part of the text.

Defined results: a null text is empty and has no ids; repeated rows and rows
without doc_id stay rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm import pretoken, worker

#: Entries of a worker's cache, and characters of a pre-token that it holds.
CACHE_ENTRIES, CACHED_CHARS = 100_000, 64


class Vocabulary:
    """Ranks of byte strings, the pairs that merge, and a cache of encoded pre-tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = r
        self.cache = _Encoded(self)

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        """This worker's vocabulary of that file."""
        kept = worker.cache("byte_bpe")
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
        own, pairs = self.bytes, self.pairs
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ids = [own[b] for b in piece]
        if len(ids) > 48:
            return _merge_long(ids, pairs)
        none = 1 << 40
        rank = [pairs.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while rank:
            low = min(rank)
            if low == none:
                break
            i = rank.index(low)
            ids[i] = low
            del ids[i + 1], rank[i]
            if i < len(rank):
                rank[i] = pairs.get(low << 20 | ids[i + 1], none)
            if i:
                rank[i - 1] = pairs.get(ids[i - 1] << 20 | low, none)
        return ids

    def encode(self, texts: list[str]):
        """(ids, texts' first id and the count): of many texts at once."""
        for i, j in pretoken.batches_of(texts):
            pieces, first = pretoken.pretokens(texts[i:j])
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            codes = list(map(self.cache.__getitem__, pieces))
            for r in range(j - i):
                yield b"".join(codes[first[r] : first[r + 1]])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id in the text, with the text's length at the end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=out[1:])
        return out


class _Encoded(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.vocabulary.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            self[piece] = out
        return out


def _merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """merge() of long pre-tokens with a heap over a linked list."""
    n = len(ids)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or pairs.get(ids[i] << 20 | ids[j]) != r:
            continue
        ids[i], gone[j] = r, 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := pairs.get(r << 20 | ids[k])) is not None:
                heapq.heappush(heap, (q, i))
        if (p := before[i]) >= 0 and (q := pairs.get(ids[p] << 20 | r)) is not None:
            heapq.heappush(heap, (q, p))
    return [x for x, g in zip(ids, gone) if not g]


def _texts(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), ends (byte offset behind each id) of every row of docs (doc_id, text)."""

    worker.small_batches(docs.sparkSession)

    def run(batches):
        own = Vocabulary.of(path)
        for batch in batches:
            for part in _parts(batch):
                ids = [np.frombuffer(x, "<u4") for x in own.encode(_texts(part.column(1)))]
                sizes = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=sizes[1:])
                flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
                ends = np.concatenate([*(own.offsets(x)[1:] for x in ids), np.zeros(0, np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(ends))], names=["doc_id", "ids", "ends"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, ends array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of encoded (doc_id, ids)."""

    def run(batches):
        own = Vocabulary.of(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: encodes every text and decodes its ids again."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    worker.small_batches(docs.sparkSession)

    def run(batches):
        own = Vocabulary.of(path)
        for batch in batches:
            for part in _parts(batch):
                n, of_ids, of_text, all_ids = [], [], [], []
                for raw in own.encode(_texts(part.column(1))):
                    if with_ids:
                        all_ids.append(np.frombuffer(raw, "<i4"))
                    n.append(len(raw) // 4)
                    of_ids.append(hashlib.sha256(raw).hexdigest())
                    of_text.append(hashlib.sha256(own.decode(np.frombuffer(raw, "<u4"))).hexdigest())
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)]))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _parts(batch, rows: int = 500):
    """A batch in smaller ones, so that few texts are Python objects at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
