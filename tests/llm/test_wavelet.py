import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomwork.llm import wavelet
from loomwork.plans import storage
from tokenizers import Tokenizer

JSON = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.integers(6, 17))
def test_matrix(ids, planes):
    x = np.array(ids, np.int64)
    m = wavelet.WaveletMatrix.frombytes(wavelet.WaveletMatrix.build(x, planes).tobytes())
    assert m.ids().tolist() == ids
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]
    for s in set(ids[:5]) | {41}:
        at = [i for i, v in enumerate(ids) if v == s]
        assert m.rank(s) == len(at) and m.rank(s, len(ids) // 2) == sum(i < len(ids) // 2 for i in at)
        assert [m.select(s, k) for k in range(min(4, len(at)))] == at[:4]


ROWS = [(7, "Hello world", 1), (None, "without id", 6), (-3, None, 2), (2, "", 3), (9, "a<|endoftext|>b " * 3, 4), (9, "a<|endoftext|>b " * 3, 4), (11, "long text, " * 20_000, 5)]


@pytest.mark.parametrize("shard", [10, 1 << 21])
def test_write_and_read(spark, monkeypatch, shard):
    monkeypatch.setattr(wavelet, "SHARD_IDS", shard)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start int")
    path = storage.new_path(spark, "test")
    wavelet.write(docs, JSON, 0, path)
    lib, at, want = Tokenizer.from_file(JSON), 0, []
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])  # noqa: E731  rows without doc_id come first
    for d, t, _ in sorted(ROWS, key=lambda r: order(r)[:2]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, wavelet.documents(spark, path).collect()), key=order) == want


def test_empty(spark):
    path = storage.new_path(spark, "test")
    wavelet.write(spark.createDataFrame([], "doc_id long, text string"), JSON, 0, path)
    assert wavelet.documents(spark, path).collect() == []
