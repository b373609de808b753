"""Benchmark decontamination by a BM25 index of test items with block-max pruning.

Test items, cut into units of at most UNIT words, form an inverted index whose
impacts are divided by each unit's score against itself.  Every training text
is cut into passages that overlap by half; each passage queries the index for
all units above a threshold.  The common terms of each unit, up to a fixed
share of its score, cannot lift it over the threshold alone.  So as in WAND, a
passage is skipped whose terms' list maxima stay below the rest together; of
the others, every block of units is skipped whose block maxima do; and only
units of the remaining blocks are scored.  The work is done for many passages
at once, so blocks are tested by sums instead of by moving a pivot.

A hit is confirmed on the text around it: enough of the item's question must
come in sequences of words, and enough words of its answer.  An item's answer
is what follows a line like "Answer:", or else its last third.  An item of
fewer than SHORT_ITEM words must come whole, as shares of so few say little.

Words are runs of letters, digits and marks by Unicode's classes, composed
(NFC) and without regard to case.

Items are sent to all tasks in blocks of at most ITEMS_TO_SEND items and about
BYTES_TO_SEND bytes (a longer item goes alone).

Defined results: a null or empty text matches nothing; an item without words
matches nothing; an item without item_id matches like any other, its item_id is
null in the result; repeated rows stay rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import words as W
from loomwork.llm import worker

UNIT, STRIDE = 64, 64  # a passage is two strides long
BLOCK = 8
K1, B = 1.2, 0.75
#: Share of its own score at which a unit is retrieved; share of it that common terms may hold.
THRESHOLD, COMMON = 0.5, 0.25
GRAM = 3
#: Share of the question's word sequences and of the answer's words that confirm a hit; items of fewer words must come whole.
QUESTION, ANSWER, SHORT_ITEM = 0.4, 0.5, 8
ITEMS_TO_SEND, BYTES_TO_SEND = 100_000, 32 << 20
_ANSWER = re.compile(r"\n\s*(?:answer|a|réponse|antwort|respuesta)\s*[:.)]", re.IGNORECASE)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: the number of its folded form, and whether it is a word's."""
    if not _classes:
        every = [chr(i) for i in range(sys.maxunicode + 1)]
        fold = np.arange(len(every), dtype=np.uint64)
        for i, c in enumerate(every):
            if c.isupper() or c.islower() or c.istitle():
                f = c.casefold()
                fold[i] = ord(f) if len(f) == 1 else ord(c.lower()[0])
        inside = np.array([c.isalnum() or unicodedata.category(c)[0] == "M" for c in every])
        _classes.extend((W.mix(fold + np.uint64(0x632BE59BD9B4E019)), inside))
    return _classes[0], _classes[1]


_classes: list[np.ndarray] = []


def _split(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """The words of texts in UTF-8."""
    numbers, inside = _tables()
    if len(data) and data.max() >= 128:
        raw = data.tobytes()
        text = raw.decode("utf-8", "replace")
        if not unicodedata.is_normalized("NFC", text):
            composed = [unicodedata.normalize("NFC", raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in composed])]).astype(np.int64)
            text = "".join(composed)
        else:
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            offsets = heads[offsets]
        data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return W.Words.of(numbers[data], inside[data], offsets)


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    w = _split(np.frombuffer(b"".join(raw), np.uint8), offsets)
    h = w.hashes()
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item; the answer is "" where none is marked."""
    m = _ANSWER.search(text)
    return (text[: m.start()], text[m.end() :]) if m else (text, "")


class Index:
    """An inverted index of items' units with block maxima."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        split = [parts(t or "") for _, t in items]
        questions, answers = hashed_words([q for q, _ in split]), hashed_words([a for _, a in split])
        self.question: list[np.ndarray] = []
        self.gram: list[int] = []  # words of each of the question's sequences
        self.answer: list[np.ndarray] = []
        units, owner = [], []
        for k, (q, a) in enumerate(zip(questions, answers)):
            whole = np.concatenate([q, a])
            if not len(a):
                cut = len(q) - len(q) // 3
                a = q[cut:]
            g = min(GRAM, max(len(q), 1))
            self.gram.append(g)
            self.question.append(np.unique(W.windows(q, g)))
            self.answer.append(np.unique(a))
            for i in range(0, len(whole), UNIT):
                units.append(whole[i : i + UNIT])
                owner.append(k)
        self.owner = np.array(owner, np.int64)
        self.words = np.array([len(q) + len(a) for q, a in zip(questions, answers)], np.int64)
        n = len(units)
        self.vocabulary = np.unique(np.concatenate([*units, np.zeros(0, np.uint64)]))
        term = np.searchsorted(self.vocabulary, np.concatenate([*units, np.zeros(0, np.uint64)]))
        unit = np.repeat(np.arange(n), [len(u) for u in units]) if n else np.zeros(0, np.int64)
        v = max(len(self.vocabulary), 1)
        key, tf = np.unique(term * max(n, 1) + unit, return_counts=True)
        t, u = key // max(n, 1), key % max(n, 1)
        df = np.bincount(t, minlength=v)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        size = np.array([len(x) for x in units], np.float64)
        norm = K1 * (1 - B + B * size / size.mean()) if n else size
        impact = idf[t] * tf * (K1 + 1) / (tf + norm[u])
        own = np.bincount(u, impact, minlength=n)
        impact = impact / own[u]
        # each unit's most common terms, until they hold COMMON of its score
        order = np.lexsort((-df[t], u))
        run = np.cumsum(impact[order])
        before = np.concatenate([[0.0], run])[np.searchsorted(u[order], u[order])]
        common = np.zeros(len(t), bool)
        common[order] = run - before <= COMMON
        self.rest = np.bincount(u[common], impact[common], minlength=n)  # what common terms can add
        self.all = _Lists(t, u, impact, v)
        self.rare = _Lists(t[~common], u[~common], impact[~common], v)
        block = self.rare.unit // BLOCK
        self.blocks = -(-n // BLOCK) or 1
        pair, first = np.unique(np.repeat(np.arange(v), np.diff(self.rare.first)) * self.blocks + block, return_index=True)
        top = np.maximum.reduceat(self.rare.impact, first) if len(first) else np.zeros(0)
        self.maxima = _Lists(pair // self.blocks, pair % self.blocks, top, v)
        self.top = np.zeros(v)
        np.maximum.at(self.top, t[~common], impact[~common])
        # least that rare terms must reach in a block
        need = THRESHOLD - self.rest
        self.need = np.array([need[i : i + BLOCK].min() for i in range(0, n, BLOCK)]) if n else np.ones(1)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int | None, float, float, float]]:
        """(text, item id, score, question overlap, answer overlap) of all confirmed hits."""
        if not len(self.owner):
            return
        for i, j in W.chunks(offsets):
            base = offsets[i]
            w = _split(data[base : offsets[j]], offsets[i : j + 1] - base)
            for hit in self._search(w.hashes(), w.first):
                yield (i + hit[0], *hit[1:])

    def _search(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int | None, float, float, float]]:
        count = np.diff(first)
        cells = -(-count // STRIDE)
        start = np.concatenate([[0], np.cumsum(cells)])
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        if not len(known):
            return
        term = at[known]
        text = np.searchsorted(first, known, "right") - 1
        cell = start[text] + (known - first[text]) // STRIDE
        # a passage is a cell and the next one of the same text
        back = cell > start[text]
        passage, terms = np.concatenate([cell, cell[back] - 1]), np.concatenate([term, term[back]])
        useful = self.rare.counts[terms] > 0
        v = len(self.vocabulary)
        key = np.unique(passage[useful] * v + terms[useful])
        p, t = key // v, key % v
        # list maxima: which passages can hold one at all
        live = np.bincount(p, self.top[t], minlength=start[-1])[p] >= self.need.min() - 1e-9
        p, t = p[live], t[live]
        if not len(p):
            return
        # block maxima: which blocks can hold a unit above the threshold
        row, entry = self.maxima.expand(t)
        bound, which = _sums(p[row] * self.blocks + self.maxima.unit[entry], self.maxima.impact[entry])
        which = which[bound >= self.need[which % self.blocks] - 1e-9]
        if not len(which):
            return
        # score of the units of these blocks by rare terms, then by all
        live = np.isin(p, which // self.blocks)
        p, t = p[live], t[live]
        row, entry = self.rare.expand(t)
        good = np.isin(p[row] * self.blocks + self.rare.unit[entry] // BLOCK, which)
        n = len(self.owner)
        score, pair = _sums(p[row][good] * n + self.rare.unit[entry][good], self.rare.impact[entry][good])
        pair = pair[score >= THRESHOLD - self.rest[pair % n] - 1e-9]
        live = np.isin(passage, pair // n)
        key = np.unique(passage[live] * v + terms[live])
        p, t = key // v, key % v
        row, entry = self.all.expand(t)
        good = np.isin(p[row] * n + self.all.unit[entry], pair)
        score, pair = _sums(p[row][good] * n + self.all.unit[entry][good], self.all.impact[entry][good])
        keep = score >= THRESHOLD - 1e-9
        score, pair = score[keep], pair[keep]
        # by text and item
        where = pair // n
        text = np.searchsorted(start, where, "right") - 1
        item = self.owner[pair % n]
        found: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for x, k, s, c in zip(text.tolist(), item.tolist(), score.tolist(), (where - start[text]).tolist()):
            found.setdefault((x, k), []).append((s, c))
        for (x, k), hits in sorted(found.items()):
            c = [c for _, c in hits]
            a, b = first[x] + max(0, min(c) - 1) * STRIDE, min(first[x + 1], first[x] + (max(c) + 3) * STRIDE)
            seen = h[a:b]
            grams = self.question[k]
            q = float(np.isin(grams, W.windows(seen, self.gram[k])).mean()) if len(grams) else 1.0
            r = float(np.isin(self.answer[k], seen).mean()) if len(self.answer[k]) else 1.0
            least = 1.0 if self.words[k] < SHORT_ITEM else QUESTION
            if q >= least and r >= (1.0 if self.words[k] < SHORT_ITEM else ANSWER):
                yield x, self.ids[k], max(s for s, _ in hits), q, r


class _Lists:
    """Lists of (unit, impact) by term, one behind the other."""

    def __init__(self, term: np.ndarray, unit: np.ndarray, impact: np.ndarray, v: int):
        order = np.lexsort((unit, term))
        self.unit, self.impact = unit[order], impact[order]
        self.counts = np.bincount(term, minlength=v)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def expand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all entries of the terms' lists: the index of the term, and the entry."""
        n = self.counts[terms]
        row = np.repeat(np.arange(len(terms)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[terms][row]


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value by key, and the keys in order."""
    keys, inverse = np.unique(key, return_inverse=True)
    return np.bincount(inverse, value, minlength=len(keys)), keys


def _blocks(benchmark: DataFrame):
    """Broadcast items (item_id, text), in blocks of about ITEMS_TO_SEND."""
    spark, items = benchmark.sparkSession, benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-rows // ITEMS_TO_SEND), -(-size // BYTES_TO_SEND))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()  # bounded: ITEMS_TO_SEND and BYTES_TO_SEND expected; an item that comes again says nothing new
        yield spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def _index(sent, key: str) -> Index:
    """This worker's index of some items."""
    kept = worker.cache("decontaminate")
    if key not in kept:
        kept.clear()
        kept[key] = Index(sent.value)
    return kept[key]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every text and item that overlap; docs: doc_id, text."""
    import uuid

    worker.small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for sent in _blocks(benchmark):
        key = uuid.uuid4().hex

        def run(batches, sent=sent, key=key):
            index = _index(sent, key)
            for batch in batches:
                hits = list(index.search(*W.string_buffers(batch.column(1))))
                row, item, *more = zip(*hits) if hits else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), *(pa.array(m, pa.float64()) for m in more)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (any columns, text among them) that overlap with no item."""
    import uuid

    worker.small_batches(docs.sparkSession)
    out = docs
    for sent in _blocks(benchmark):
        key = uuid.uuid4().hex
        at = out.columns.index("text")

        def run(batches, sent=sent, key=key, at=at):
            index = _index(sent, key)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in index.search(*W.string_buffers(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
