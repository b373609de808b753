import pandas as pd
from loomwork.streaming import state


def test_state_survives_json_and_restarts():
    rows = [{"ids": [i % 13, (i * 7) % 20, i % 3]} for i in range(200)]
    whole = state.HotCache()
    want = [whole.step(r) for r in rows]
    text, got = state.dump(state.HotCache()), []
    for r in rows:
        machine = state.load(state.HotCache, text)
        got.append(machine.step(r))
        text = state.dump(machine)
    assert got == want and 0.3 < want[-1][0]["rate"] < 1


def test_hot_cache_rules():
    c = state.HotCache(slots=2, margin=2.0, budget=1)
    assert c.step({"ids": [5, 6]})[0]["swaps"] == 0  # 1 use doesn't lead by 2
    assert c.step({"ids": [5]})[0]["swaps"] == 0  # .97 + 1 is less than 2
    out = c.step({"ids": [5]})[0]
    assert out["swaps"] == 1 and out["hits"] == 0 and "0" not in c.slot and c.pending == [[5, 0]]
    assert c.step({"ids": [5]})[0]["hits"] == 1 and c.slot["5"] == 0


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    half = events.selectExpr("max(event_id) div 2").first()[0]
    folder = f"{tmp_path}/events.parquet"
    # two files, read one after the other: state goes over micro-batches
    events.where(f"event_id <= {half}").coalesce(1).write.parquet(folder)
    events.where(f"event_id > {half}").coalesce(1).write.mode("append").parquet(folder)
    for name in ("stream_hot_cache", "stream_decode_state", "stream_compress"):
        one = getattr(state, name)(spark, "/root/testdata/sf0.001").toPandas()
        two = getattr(state, name)(spark, str(tmp_path)).toPandas()
        order = list(one.columns)
        pd.testing.assert_frame_equal(one.sort_values(order).reset_index(drop=True), two.sort_values(order).reset_index(drop=True))
    rows = events.toPandas().sort_values(["ts", "event_id"])
    got = state.stream_hot_cache(spark, "/root/testdata/sf0.001").toPandas()
    for kind, part in rows.groupby("event_type"):
        c = state.HotCache()
        want = [c.step({"ids": [int(u) * m % 40 for m in (1, 7, 11)]})[0] for u in part.user_id]
        mine = got[got.key == kind].sort_values("step")
        assert mine.hits.tolist() == [w["hits"] for w in want] and mine.swaps.tolist() == [w["swaps"] for w in want]


def test_copies_share_nothing():
    a = state.HotCache()
    for i in range(20):
        a.step({"ids": [i % 5, 30]})
    b = state.copied(a)
    assert state.dump(a) == state.dump(b)
    b.step({"ids": [1]})
    assert state.dump(a) != state.dump(b)


def test_layers_share_a_budget():
    c = state.LayeredHotCache(slots=2, margin=2.0, budget=1)
    for _ in range(2):
        assert c.step({"layers": [[5, 6], [7, 8]]})[0]["swaps"] == 0
    out = [c.step({"layers": [[5, 6], [7, 8]]})[0] for _ in range(4)]
    assert [x["swaps"] for x in out] == [1, 1, 1, 1]  # the first layer's two ids go first, then the second's
    assert c.step({"layers": [[5, 6], [7, 8]]})[0]["hits"] == 4
    text = state.dump(c)
    assert state.load(state.LayeredHotCache, text).step({"layers": [[5], [9]]}) == c.step({"layers": [[5], [9]]})
    one, alone = state.LayeredHotCache(), state.HotCache()
    rows = [[i % 13, (i * 7) % 20, i % 3] for i in range(200)]
    assert [one.step({"layers": [r]}) for r in rows] == [alone.step({"ids": r}) for r in rows]


def test_rows_beyond_memory_are_merged(monkeypatch):
    import random

    monkeypatch.setattr(state, "RUN_ROWS", 10)
    monkeypatch.setattr(state, "RUNS", 3)
    monkeypatch.setattr(state, "PIECE_ROWS", 4)
    r = random.Random(1)
    rows = pd.DataFrame([{"ts": r.choice([pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-02"), pd.NaT]), "event_id": r.choice([None, *range(50)]), "v": i} for i in range(503)])
    for step in (5, 7, 600):
        got = list(state.ordered((rows[i : i + step] for i in range(0, len(rows), step)), ["ts", "event_id"]))
        assert [x["v"] for x in got] == rows.sort_values(["ts", "event_id"], kind="stable").v.tolist()
    assert list(state.ordered(iter([]), ["ts"])) == []


def test_state_with_swaps_under_way_is_kept():
    import numpy as np

    c = state.HotCache(slots=2, budget=1)
    for _ in range(3):
        c.step({"ids": np.array([5, 5])})  # what Arrow makes of an array
    assert c.pending and state.load(state.HotCache, state.dump(c)).pending == [[5, 0]]
    assert c.step({"ids": [None, 5]})[0]["hits"] == 1


def test_arrays_reach_python_without_arrow_lists(spark, monkeypatch, tmp_path):
    from pyspark.sql.types import ArrayType

    seen = []
    monkeypatch.setattr(state, "drained", lambda stream, name: seen.append(stream))
    state.stream_hot_cache(spark, "/root/testdata/sf0.001")
    state.stream_hot_layers(spark, "/root/testdata/sf0.001")
    for stream in seen:  # pyarrow crashes on some batches of nested lists
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert plan.count("to_json") >= 1 and not any(isinstance(f.dataType, ArrayType) for f in stream.schema)


def test_layers_over_many_rows_of_few_keys(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "ts", "user_id * 8 as user_id", "event_type", "value", "props")
    events.selectExpr("*", "explode(sequence(0, 24)) i").selectExpr("event_id + i * 100000 as event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = state.stream_hot_layers(spark, str(tmp_path)).toPandas().sort_values("step")
    rows = spark.read.parquet(f"{tmp_path}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    c = state.LayeredHotCache()
    want = [c.step({"layers": [[(int(u) * m + layer) % 40 for m in (1, 7, 11)] for layer in range(3)]})[0] for u in rows.user_id]
    assert len(got) == 25 * 1000 and set(got.key) == {0}
    assert got.hits.tolist() == [w["hits"] for w in want] and got.swaps.tolist() == [w["swaps"] for w in want]
