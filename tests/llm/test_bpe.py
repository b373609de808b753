import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from loomwork.llm import byte_bpe, pretoken, token_count
from tokenizers import Tokenizer

ODD = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "٣", "!", "’", "中", " ", "　", "😀", "'S", "\x1c", "<|endoftext|>"]
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def texts():
    r = random.Random(3)
    out = ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    return [*out, "", " ", "\n\n", "ab" * 40_000, "é" * 1000, "don't we'll I'd " * 300, " " * 5000 + "x"]


def test_boundaries_are_the_patterns():
    t, pattern = texts(), regex.compile(P.PATTERN)
    pieces, first = pretoken.pretokens(t)
    for i, x in enumerate(t):
        assert pieces[first[i] : first[i + 1]] == pattern.findall(x)


def test_ids_offsets_and_round_trip():
    own = byte_bpe.Vocabulary(RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t, raw in zip(texts(), own.encode(texts()), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == theirs.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
        if len(ids) > 2:
            at = own.offsets(ids)
            assert own.decode(ids[1:-1]) == t.encode()[at[1] : at[-2]]


def test_counts_are_the_librarys():
    lib = Tokenizer.from_file(JSON)
    assert token_count.Counter(JSON).counts(texts()) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts()]


ROWS = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "y"), (3, "Hello world", "y"), (4, "word " * 30_000, None), (None, "null id", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")


def test_count_table(spark, docs):
    lib = Tokenizer.from_file(JSON)
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, _ in ROWS]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, token_count.token_counts(docs, JSON).collect()), key=key) == sorted(want, key=key)
    assert token_count.token_counts(docs.limit(0), JSON).collect() == []


def test_bpe_table(spark, docs):
    own = byte_bpe.Vocabulary(RANKS)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = byte_bpe.round_trip(docs, RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((d or 0, len(raw) // 4, sha(raw), sha((t or "").encode())) for (d, t, _), raw in zip(ROWS, own.encode([t or "" for _, t, _ in ROWS]), strict=True))
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((d or 0, t or "") for d, t, _ in ROWS)
    assert byte_bpe.round_trip(docs.limit(0), RANKS).collect() == []
