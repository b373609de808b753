"""Keyed state over event streams: pooling, speculation, hot caches (survey ST1-ST6, ST9-ST12, W10, W12, T9, T10).

One event is one step.  A stateful operator is a plain class with step() and
a JSON form; process() runs one per key with transformWithStateInPandas, so
the same class serves tests and batch twins.  State survives restarts in the
checkpoint; rows of one micro-batch are put in order by their order columns,
a bounded number of them in memory.  Arrays go to Python as JSON: pyarrow
crashes on some batches of nested lists that the JVM sends.
"""

from __future__ import annotations

import heapq
import json
import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType

from loomwork.plans import storage
from loomwork.registry import query
from loomwork.session import TOKEN_IDS


class Pool:
    """ST3 W10: softmax-gated mean of every ratio rows; leftovers wait for more."""

    def __init__(self, ratio: int = 4):
        self.ratio, self.count, self.rows = ratio, 0, []

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        import math

        self.rows.append([row["x"], row["v"]])
        self.count += 1
        if len(self.rows) < self.ratio:
            return []
        top = max(x for x, _ in self.rows)
        w = [math.exp(x - top) for x, _ in self.rows]
        out = {"grp": self.count // self.ratio - 1, "v": sum(a * v for a, (_, v) in zip(w, self.rows)) / sum(w)}
        self.rows = []
        return [out]


class Speculation:
    """ST1 ST2 ST5: a draft of block tokens is written ahead of each position; what the next tokens confirm is accepted, the rest is retracted.

    Retracted rows stay in the ring until they are overwritten, and are
    invisible by the limit of what was confirmed.
    """

    def __init__(self, block: int = 3, window: int = 8):
        self.block, self.window = block, window
        self.pos, self.draft, self.run, self.written = -1, [], 0, -1
        self.ring: dict[str, list[int]] = {}

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        tok = row["tok"]
        self.pos += 1
        hit = bool(self.draft) and self.draft[0] == tok
        self.run = self.run + 1 if hit else 0
        self.draft = self.draft[1:] if hit else []
        last = self.draft[-1] if self.draft else tok
        while len(self.draft) < self.block:
            last = last % len(TOKEN_IDS) + 1
            self.draft.append(last)
        for i, t in enumerate([tok, *self.draft]):
            self.ring[str((self.pos + i) % self.window)] = [self.pos + i, t]
        self.written = self.pos + self.block
        seen = sum(1 for p, _ in self.ring.values() if p <= self.pos)
        return [{"pos": self.pos, "hit": hit, "run": self.run, "visible": seen}]


class HotCache:
    """ST6 W12 T9 T10 P11: slots for the experts that are used most, by decayed usage.

    A step, in order: copies that have landed become usable; usage decays and
    grows for the step's ids; hits are counted with the present map; then, for
    cold ids by usage, the least used free-standing resident is unmapped where
    the cold one leads by a margin, within the step's budget, and its slot is
    pending until the next step.
    """

    def __init__(self, slots: int = 8, decay: float = 0.97, margin: float = 2.0, budget: int = 2):
        self.slots, self.decay, self.margin, self.budget = slots, decay, margin, budget
        self.usage: dict[str, float] = {}
        self.slot: dict[str, int] = {str(i): i for i in range(slots)}
        self.pending: list[list[int]] = []
        self.steps = self.hits = self.seen = 0

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        slot, decay = self.slot, self.decay
        for expert, at in self.pending:
            slot[str(expert)] = at
        self.pending = []
        ids = sorted({int(i) for i in row["ids"] if i is not None})
        names = [str(e) for e in ids]
        self.usage = usage = {e: u * decay for e, u in self.usage.items()}
        for e in names:
            usage[e] = usage.get(e, 0.0) + 1
        cold = [e for e in names if e not in slot]
        hits = len(ids) - len(cold)
        self.steps, self.hits, self.seen = self.steps + 1, self.hits + hits, self.seen + len(ids)
        swaps = 0
        if cold and self.budget > 0:
            cold.sort(key=lambda e: (-usage[e], int(e)))
            free = slot.keys() - names
            for e in cold:
                if swaps >= self.budget or not free or usage[e] < min([usage.get(v, 0.0) for v in free]) + self.margin:
                    break
                victim = min(free, key=lambda v: (usage.get(v, 0.0), int(v)))
                free.discard(victim)
                self.pending.append([int(e), slot.pop(victim)])
                swaps += 1
        return [{"step": self.steps - 1, "hits": hits, "swaps": swaps, "rate": self.hits / max(self.seen, 1)}]


class LayeredHotCache:
    """ST6: one HotCache a layer, whose swaps come out of one budget for each token; layers are served in order.

    A row's layers is an array with the ids of each layer.
    """

    def __init__(self, slots: int = 8, decay: float = 0.97, margin: float = 2.0, budget: int = 2):
        self.slots, self.decay, self.margin, self.budget = slots, decay, margin, budget
        self.layers: list[dict[str, Any]] = []

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        left, hits, swaps = self.budget, 0, 0
        for k, ids in enumerate(row["layers"]):
            if k == len(self.layers):
                self.layers.append(HotCache(self.slots, self.decay, self.margin).__dict__)
            one = HotCache.__new__(HotCache)
            one.__dict__ = self.layers[k]
            one.budget = left
            (out,) = one.step({"ids": ids})
            left -= out["swaps"]
            hits, swaps = hits + out["hits"], swaps + out["swaps"]
        seen = sum(x["seen"] for x in self.layers)
        return [{"step": self.layers[0]["steps"] - 1 if self.layers else 0, "hits": hits, "swaps": swaps, "rate": sum(x["hits"] for x in self.layers) / max(seen, 1)}]


class History:
    """ST4: the last n - 1 tokens of a sequence; a stop token hides what came before it."""

    def __init__(self, n: int = 3, stop: int = 2, pad: int = 0):
        self.n, self.stop, self.pad, self.pos, self.last = n, stop, pad, -1, []

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        self.pos += 1
        seen = []
        for t in reversed(self.last):
            if t == self.stop:
                break
            seen.append(t)
        seen += [self.pad] * (self.n - 1 - len(seen))
        self.last = [*self.last, row["tok"]][1 - self.n :]
        return [{"pos": self.pos, **{f"t{i + 1}": t for i, t in enumerate(seen)}}]


def copied(machine: Any) -> Any:
    """ST7: a machine in the same state for another key, which shares nothing with the first."""
    return load(type(machine), dump(machine))


def dump(machine: Any) -> str:
    return json.dumps(machine.__dict__)


def load(kind: Callable[[], Any], text: str) -> Any:
    machine = kind()
    machine.__dict__.update(json.loads(text))
    return machine


#: Rows of a key that are sorted in memory at a time; more are merged from files, at most so many at once.
RUN_ROWS, RUNS = 250_000, 64
#: Rows of a frame given out, and of a piece of a file.
OUT_ROWS, PIECE_ROWS = 10_000, 1000


def ordered(frames: Iterator[pd.DataFrame], order: list[str]) -> Iterator[dict[str, Any]]:
    """The rows of frames in order, nulls last, equal ones as they came.

    Up to RUN_ROWS are sorted in memory.  Of more, each RUN_ROWS are a sorted
    run in a temporary file of this task; runs are merged, RUNS at a time.
    """
    held, n, runs, names = [], 0, [], []

    def rank(row):
        return [(True, 0) if row[i] is None or row[i] != row[i] else (False, row[i]) for i in at]

    def spilled(rows):
        file = tempfile.TemporaryFile()  # no name: gone when it is closed, whatever happens
        piece = []
        for row in rows:
            piece.append(row)
            if len(piece) == PIECE_ROWS:
                pickle.dump(piece, file, 5)
                piece = []
        pickle.dump(piece, file, 5)
        file.seek(0)
        return file

    def read(file):
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def run():
        return pd.concat(held).sort_values(order, kind="stable").itertuples(index=False, name=None)

    for frame in frames:
        if not names:
            names = list(frame.columns)
            at = [names.index(c) for c in order]
        held.append(frame)
        n += len(frame)
        if n >= RUN_ROWS:
            runs.append((0, spilled(run())))
            held, n = [], 0
            # runs of one level become one of the next, so each row is written a logarithmic number of times
            while len(runs) >= RUNS and runs[-RUNS][0] == runs[-1][0]:
                level, last = runs[-1][0], [f for _, f in runs[-RUNS:]]
                runs[-RUNS:] = [(level + 1, spilled(heapq.merge(*map(read, last), key=rank)))]
    parts = [read(f) for _, f in runs] + ([run()] if held else [])
    for row in parts[0] if len(parts) == 1 else heapq.merge(*parts, key=rank):
        yield dict(zip(names, row))


class _Processor(StatefulProcessor):
    def __init__(self, kind: Callable[[], Any], columns: list[str], order: list[str], arrays: list[str]):
        self.kind, self.columns, self.order, self.arrays = kind, columns, order, arrays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        machine = load(self.kind, self.state.get()[0]) if self.state.exists() else self.kind()
        out = []
        for row in ordered(rows, self.order):  # one key's rows of one micro-batch
            for c in self.arrays:
                row[c] = json.loads(row[c]) if isinstance(row[c], str) else []
            out += ({"key": key[0], **x} for x in machine.step(row))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        self.state.update((dump(machine),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def process(rows: DataFrame, key: str, kind: Callable[[], Any], schema: str, order: list[str]) -> DataFrame:
    """What each key's machine gives out; rows: a stream. schema starts with the key, named ``key``. Arrays reach the machine as lists (of whole numbers or strings), null ones as empty lists."""
    columns = [part.split()[0] for part in schema.split(", ")]
    arrays = [f.name for f in rows.schema if isinstance(f.dataType, ArrayType)]
    rows = rows.withColumns({c: F.to_json(c) for c in arrays})
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithStateInPandas(_Processor(kind, columns, order, arrays), schema, "Append", "None")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream, whether the table is one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(schema)
    return stream.parquet(f"{sf_dir}/events.parquet") if folder else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives out for the input that is there now, in the shared folder."""
    spark = stream.sparkSession
    path = storage.new_path(spark, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _tok() -> Any:
    return F.create_map(*(F.lit(x) for kv in TOKEN_IDS.items() for x in kv))[F.col("event_type")].cast("long")


@query("""WITH t AS (SELECT user_id AS key, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS grp, value, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS tok FROM events)
SELECT key, grp, round(sum(exp(value / 40) * tok) / sum(exp(value / 40)), 6) AS v FROM t GROUP BY 1, 2 HAVING count(*) = 4""")
def stream_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3 ST11: tumbling windows by count over a stream; equal to the batch pooling."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("value") / 40).alias("x"), _tok().cast("double").alias("v"))
    return drained(process(rows, "key", Pool, "key bigint, grp bigint, v double", ["ts", "event_id"]), "pooled").withColumn("v", F.round("v", 6))


@query("""WITH t AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS tok FROM events),
h AS (SELECT *, coalesce(tok = lag(tok) OVER (PARTITION BY key ORDER BY pos) % 5 + 1, false) AS hit FROM t), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos) AS g FROM h)
SELECT key, pos, hit, count(*) OVER (PARTITION BY key, g ORDER BY pos) - 1 AS run, least(pos + 1, 5) AS visible FROM g""")
def stream_decode_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 ST2 ST5: drafts verified token by token; of a ring of 8 slots three hold drafts that are not visible."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", _tok().alias("tok"))
    return drained(process(rows, "key", Speculation, "key bigint, pos bigint, hit boolean, run bigint, visible bigint", ["ts", "event_id"]), "decoded")


@query("""WITH t AS (SELECT user_id AS key, row_number() OVER w - 1 AS pos, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END::BIGINT AS tok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, coalesce(lag(tok, 1) OVER w, 0) AS b1, coalesce(lag(tok, 2) OVER w, 0) AS b2 FROM t WINDOW w AS (PARTITION BY key ORDER BY pos)) SELECT key, pos, CASE WHEN b1 = 2 THEN 0 ELSE b1 END AS t1, CASE WHEN b1 = 2 OR b2 = 2 THEN 0 ELSE b2 END AS t2 FROM l""")
def stream_ngram_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 W1: histories over a stream; equal to the batch windows."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", _tok().alias("tok"))
    return drained(process(rows, "key", History, "key bigint, pos bigint, t1 bigint, t2 bigint", ["ts", "event_id"]), "histories")


@query()
def stream_hot_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: hit rate of each layer's slots, step by step; sequential, so tested against the same rules in Python."""
    ids = F.array(*(F.pmod(F.pmod(F.col("user_id"), F.lit(40)) * m, F.lit(40)) for m in (1, 7, 11)))
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("key"), "ts", "event_id", ids.alias("ids"))
    return drained(process(rows, "key", HotCache, "key string, step bigint, hits bigint, swaps bigint, rate double", ["ts", "event_id"]), "cached")


@query()
def stream_hot_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6 T9 T10: three layers' slots with one budget of swaps a token, for eight streams; sequential, so tested against the same rules in Python."""
    layers = F.array(*(F.array(*(F.pmod(F.pmod(F.col("user_id"), F.lit(40)) * m + layer, F.lit(40)) for m in (1, 7, 11))) for layer in range(3)))
    rows = event_stream(spark, sf_dir).select((F.col("user_id") % 8).alias("key"), "ts", "event_id", layers.alias("layers"))
    return drained(process(rows, "key", LayeredHotCache, "key bigint, step bigint, hits bigint, swaps bigint, rate double", ["ts", "event_id"]), "layered")
