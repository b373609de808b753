"""Functions and plan helpers against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomwork.functions import hashing, quant, text
from loomwork.operators import placement, retrieval
from loomwork.plans import ranks, storage
from pyspark.sql import functions as F


def e4m3_values():
    out = [m * 2.0**-9 for m in range(8)] + [(1 + m / 8) * 2.0 ** (e - 7) for e in range(1, 16) for m in range(8) if (e, m) != (15, 7)]
    return np.array(sorted({s * v for v in out for s in (1, -1)}))


def test_round_e4m3_is_nearest():
    grid, x = e4m3_values(), np.random.default_rng(0).normal(0, 100, 4000).astype(np.float32)
    x[:2000] *= 1e-4
    near = np.abs(grid[None] - x[:, None].astype(np.float64)).min(1)
    assert np.allclose(np.abs(quant.round_e4m3(x) - x), near, rtol=0, atol=1e-6 * 448) and set(quant.round_e4m3(x).tolist()) <= set(grid.tolist())
    assert quant.round_e4m3(np.array([1e9, -1e9])).tolist() == [448, -448]


def test_grid_points_and_ties():
    grid = np.array([s * v for v in quant.E2M1 for s in (1, -1)])
    assert (quant.round_e2m1(grid) == grid).all()
    ties = {0.25: 0, 0.75: 1, 1.25: 1, 1.75: 2, 2.5: 2, 3.5: 4, 5: 4, 7: 6}
    assert quant.round_e2m1(np.array(list(ties))).tolist() == list(ties.values())
    assert quant.ceil_log2(2.0 ** np.arange(-40, 61)).tolist() == list(range(-40, 61))
    assert quant.ceil_log2(np.array([1.5, 2.0001, 0.3])).tolist() == [1, 2, -1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4, width=32), min_size=1, max_size=80))
def test_formats_keep_their_error(x):
    x = np.array(x, np.float32)
    for kind, most in (("fp8", 1 / 16), ("int8", 1 / 254 + 1e-6), ("fp4", 0.26)):
        y = quant.fake_row(x, kind)
        for i in range(0, len(x), 32):
            b, amax = x[i : i + 32], np.abs(x[i : i + 32]).max()
            if amax > 1e-3:
                assert np.abs(y[i : i + 32] - b).max() <= most * amax * 1.01
    assert np.abs(quant.round_bf16(x) - x).max() <= np.abs(x).max() / 256


def test_codes(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("c")).select("c", quant.decode_e4m3(F.col("c")).alias("v"), quant.e8m0(F.col("c")).alias("s"))
    rows = {r.c: r for r in df.collect()}
    assert sorted({r.v for r in rows.values() if r.v is not None}) == sorted(set(e4m3_values().tolist())) and rows[127].v is None and rows[255].v is None
    assert rows[0].s == 2.0**-127 and rows[254].s == 2.0**127 and rows[255].s is None


def test_hash_parts():
    assert hashing.distinct_primes(10, 4) == [11, 13, 17, 19] and hashing.exclusive_sums([3, 4, 5]) == [0, 3, 7]
    h = hashing.NgramHash.make(4, 3, 100, 1 << 17)
    flat = [p for row in h.primes for p in row]
    assert len(set(flat)) == 9 and all(m % 2 and m * (1 << 17) < 2**63 for m in h.multipliers)


def test_text(spark):
    assert text.normalise(" Ｆｏｏ\t\nBÀR ") == "foo bar" and text.normalise(" ") == " " and text.normalise("\t") == " "
    one = spark.createDataFrame([("a:1,b:2", "3, 4,", "0-2,8", "x/y.tar", -0.25)], "s string, l string, c string, p string, x double")
    r = one.select(text.spec(F.col("s")), text.int_list(F.col("l")), text.cpu_list(F.col("c")), text.base_name(F.col("p")), text.tenths(F.col("x")), text.tenths(F.lit(-0.01)), text.tenths(F.lit(12.0))).first()
    assert tuple(r) == ({"a": 1, "b": 2}, [3, 4], [0, 1, 2, 8], "y", "-0.3", "0.0", "12.0")


def test_replies(spark):
    call = '<tool_call>{"name": "f", "arguments": {"a":1}}</tool_call>'
    cases = [("<think>why</think> because", ("because", "why", [])), ("only text", ("only text", None, [])), (f"do {call}", ("do", None, [("f", '{"a":1}')])), ("<think>open", ("<think>open", None, [])), ("x <tool_call>no json</tool_call>", ("x <tool_call>no json</tool_call>", None, [])), ("", ("", None, [])), (None, (None, None, []))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", text.parse_reply(F.col("t")).alias("r"))
    for row in df.collect():
        want = cases[row.i][1]
        assert (row.r.content, row.r.reasoning, [tuple(c) for c in row.r.tool_calls]) == want, row


def test_emitted(spark):
    raw = "é日x𝄞 end".encode()
    rows = [(n, [raw[i : i + n] for i in range(0, len(raw), n)]) for n in (1, 2, 3, 20)] + [(30, []), (31, None), (32, [b"ok", b"\xff"])]
    for row in spark.createDataFrame(rows, "n int, p array<binary>").select("n", "p", text.emitted(F.col("p")).alias("out")).collect():
        if row.n < 30:
            assert "".join(row.out) == raw.decode() and len(row.out) == len(row.p)
            assert all((b"".join(row.p[: k + 1]).decode(errors="ignore").encode() == b"".join(row.p[: k + 1])) == (t != "") for k, t in enumerate(row.out))
        else:
            assert row.out == {30: [], 31: None, 32: ["ok", ""]}[row.n]


def test_global_index_and_nearest_rank(spark):
    r = random.Random(5)
    rows = [(r.choice("aaaaab"), r.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    got = {x["id"]: x["index"] for x in ranks.global_index(df, ["g", "v", "id"]).collect()}
    assert got == {x[2]: i for i, x in enumerate(sorted(rows))}
    shares = {"low": 0.0, "mid": 0.5, "p99": 0.99, "top": 1.0}
    for x in ranks.nearest_rank(df, "g", "v", shares).collect():
        v = sorted(b for a, b, _ in rows if a == x.g)
        assert x.n == len(v) and [x[k] for k in shares] == [v[min(int(len(v) * s), len(v) - 1)] for s in shares.values()]


def test_lags_over_buckets(spark):
    r = random.Random(7)
    rows = [(r.choice([1, 1, 1, 1, 2, None]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    by = {}
    for k, t, v in rows:
        by.setdefault(k, []).append((t, v))
    want = {t: (i, *(s[i - j][1] if i >= j else None for j in (1, 2, 3))) for s in by.values() for i, (t, _) in enumerate(s)}
    for size in (7, 100, 10_000):
        got = ranks.lags(df, "k", ["t"], "v", 3, size).collect()
        assert {x.t: (x["_pos"], x["_lag1"], x["_lag2"], x["_lag3"]) for x in got} == want and ranks.hottest(df, "k") == max(map(len, by.values()))


def test_asof(spark):
    r = random.Random(6)
    left = [(r.randint(0, 3), r.randint(0, 400), i) for i in range(500)]
    right = [(r.randint(0, 2), r.randint(0, 400), i) for i in range(200)]
    got = retrieval.asof(spark.createDataFrame(left, "k int, t int, id int"), spark.createDataFrame(right, "k int, t int, v int").withColumn("o", F.col("v")), "k", "t", "v", ["o"], F.expr("t div 50")).collect()
    want = {i: max(((u, v) for j, u, v in right if j == k and u <= t), default=(0, None))[1] for k, t, i in left}
    assert {x.id: x.v for x in got} == want


def test_placement():
    assert placement.shard_sizes(10, 3, 1) == [4, 4, 2] and placement.shard_sizes(5, 1) == [5]
    with pytest.raises(ValueError):
        placement.shard_sizes(3, 3, 5)


def test_storage(spark):
    t = storage.written(spark.range(5).toDF("x"), "t")
    assert t.count() == 5 and storage.small_enough(t, 5) and not storage.small_enough(t, 4)
    storage.drop(t)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t._loomwork_path)


def test_ngrams_of_hot_sequences(spark, monkeypatch):
    from loomwork.operators import ngram
    from loomwork.session import coded

    df = coded(spark, "/root/testdata/sf0.001")
    plain = sorted(map(tuple, ngram.ngram_ids(df).collect()))
    monkeypatch.setattr(ranks, "HOT_KEY_ROWS", 1)
    assert sorted(map(tuple, ngram.ngram_ids(df).collect())) == plain


def test_arrays_of_any_shape(spark):
    rows = [(1, [1.0, -2.5, None, 300.0] + [0.1] * 40), (2, None), (3, []), (4, [0.0] * 33), (5, [7.0]), (6, [2.0**-8] * 16)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    for kind in quant.KINDS:
        got = {r.id: r.y for r in quant.fake_quant(df, "x", kind, "y").collect()}
        assert got[2] is None and got[3] == [] and got[4] == [0.0] * 33 and got[1][2] is None
        for i, x in rows:
            if x and None not in x:
                assert got[i] == quant.fake_row(np.array(x, np.float32), kind).tolist()
    coded = quant.encode_fp8(df, "x").withColumn("back", quant.dequantize(F.col("codes"), F.col("scales"), 32)).collect()
    fake = {r.id: r.y for r in quant.fake_quant(df, "x", "fp8", "y").collect()}
    for r in coded:
        assert r.back == fake[r.id] and (r.scales is None if r.id == 2 else len(r.scales) == -(-len(r.x) // 32))
    with pytest.raises(ValueError):
        quant.fake_quant(df, "x", "fp9", "y")


def test_nibbles(spark):
    rows = [(i, [(3 * i + k) % 16 for k in range(i)]) for i in range(6)] + [(9, None)]
    df = spark.createDataFrame(rows, "n int, c array<int>").withColumn("p", quant.pack_nibbles(F.col("c")))
    for r in df.withColumn("u", quant.unpack_nibbles(F.col("p"), F.col("n"))).collect():
        assert (r.p, r.u) == (None, None) if r.c is None else (len(r.p), r.u) == (-(-r.n // 2), r.c)


def test_sinkhorn(spark):
    from loomwork.functions import vectors

    r = random.Random(3)
    rows = [(1, [r.random() for _ in range(16)]), (2, None), (3, []), (4, [1.0] * 15 + [None]), (5, [r.random() for _ in range(16)])]
    got = {x.id: x.m for x in spark.createDataFrame(rows, "id int, x array<double>").select("id", vectors.sinkhorn(F.col("x")).alias("m")).collect()}
    assert got[2] is got[3] is got[4] is None
    for i in (1, 5):
        m = np.array(got[i]).reshape(4, 4)
        assert np.allclose(m.sum(0), 1) and np.allclose(m.sum(1), 1)
    assert spark.createDataFrame(rows[1:2], "id int, x array<double>").select(vectors.sinkhorn(F.col("x")).alias("m")).first().m is None


def test_layered_hashes():
    own = hashing.NgramHash.layers([2, 5], 4, 3, 100, 1 << 17)
    sizes = [p for s in own.values() for row in s.primes for p in row]
    assert sizes == hashing.distinct_primes(99, 18) and own[2].offsets[0][0] == own[5].offsets[0][0] == 0
    for layer, s in own.items():
        bound = (2**63 - 1) // (1 << 17) // 2
        want = np.random.default_rng(10007 * layer).integers(0, bound, 4) * 2 + 1
        assert list(s.multipliers) == want.tolist() and max(s.multipliers) * ((1 << 17) - 1) < 2**63


def test_tokens_of_hot_sequences(spark, monkeypatch):
    from loomwork import session

    plain = sorted(map(tuple, session.tokens(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(ranks, "HOT_KEY_ROWS", 1)
    assert sorted(map(tuple, session.tokens(spark, "/root/testdata/sf0.001").collect())) == plain


def test_streamed_text_encodes_a_text_once(spark):
    from loomwork.operators import files

    out = files.streamed_text(spark, "/root/testdata/sf0.001")
    # a second one is within the loop over pieces, each of which would encode the whole text
    assert out._jdf.queryExecution().optimizedPlan().toString().count("encode(") == 1
