"""Token counts of a byte-level BPE vocabulary without emitting identifiers.

Each pre-token is a linked list of byte symbols; a heap gives the adjacent
pair of lowest rank again and again.  The count is the number of symbols minus
the number of merges.  Counts are cached per pre-token in each Python worker.

Defined results: a null text is empty and has no tokens; the vocabulary's
added special strings count as one token each where they stand in a text;
repeated rows and rows without doc_id stay rows.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm import pretoken, worker

#: Entries of a worker's cache, and characters of a pre-token that it holds.
CACHE_ENTRIES, CACHED_CHARS = 600_000, 64


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest counts up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Merge ranks of a tokenizer file, and a cache of counts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        names = byte_symbols()
        self.start = [vocab[names[b]] for b in range(256)]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 24 | vocab[b], (rank, vocab[a + b]))
        self.cache = _Counts(self)

    @classmethod
    def of(cls, path: str) -> "Counter":
        kept = worker.cache("token_count")
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def count(self, piece: bytes) -> int:
        """Symbols minus merges of one pre-token."""
        n = len(piece)
        if n == 1:
            return 1
        pairs = self.pairs
        symbol = list(map(self.start.__getitem__, piece))
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank: list[int] = [-1] * n  # of the pair that starts here, at present
        heap = []
        for i in range(n - 1):
            if (found := pairs.get(symbol[i] << 24 | symbol[i + 1])) is not None:
                rank[i] = found[0]
                heap.append(found[0] << 32 | i)
        heapq.heapify(heap)
        merges = 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            if rank[i] != top >> 32:
                continue  # one of its symbols went into another merge
            j = after[i]
            symbol[i] = own = pairs[symbol[i] << 24 | symbol[j]][1]
            merges += 1
            rank[j] = -1
            after[i] = k = after[j]
            rank[i] = -1
            if k >= 0:
                before[k] = i
                if (found := pairs.get(own << 24 | symbol[k])) is not None:
                    rank[i] = found[0]
                    push(heap, found[0] << 32 | i)
            if (p := before[i]) >= 0:
                if (found := pairs.get(symbol[p] << 24 | own)) is not None:
                    rank[p] = found[0]
                    push(heap, found[0] << 32 | p)
                else:
                    rank[p] = -1
        return n - merges

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        plain, owner, extra = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            parts = [t]
            for s in self.special:
                if s in t:
                    parts = [x for p in parts for x in p.split(s)]
            extra[i] = len(parts) - 1
            plain += parts
            owner += [i] * len(parts)
        out = np.array(extra, np.int64)
        for i, j in pretoken.batches_of(plain):
            pieces, first = pretoken.pretokens(plain[i:j])
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            total = np.zeros(len(pieces) + 1, np.int64)
            np.cumsum(np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces)), out=total[1:])
            np.add.at(out, owner[i:j], total[first[1:]] - total[first[:-1]])
        return out.tolist()


class _Counts(dict):
    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        out = self.counter.count(piece.encode())
        if len(piece) <= CACHED_CHARS:
            self[piece] = out
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text)."""

    worker.small_batches(docs.sparkSession)

    def run(batches):
        own = Counter.of(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                n = own.counts(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
