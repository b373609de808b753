"""What Python workers keep between tasks.

A worker process serves one operator after another.  Each operator's caches
are dropped when another one starts, so that a worker holds those of one only.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of texts that go to a Python worker at a time; a longer text goes alone.
BATCH_BYTES = 1 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_kept: dict[str, dict] = {}


def cache(operator: str) -> dict:
    """The operator's own cache in this worker; those of others are dropped."""
    others = [name for name in _kept if name != operator]
    for name in others:
        _kept.pop(name).clear()
    if others:
        gc.collect()
        release()
    return _kept.setdefault(operator, {})


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, where they aren't bounded more tightly: texts may be long, and rows say little about size."""
    now = spark.conf.get(_SETTING, str(1 << 30))
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system, where it can be."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # not a GNU system; memory goes back when the worker ends
