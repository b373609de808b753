import json

import numpy as np
import pytest
from loomwork.sources import files, safetensors


@pytest.fixture()
def model(tmp_path):
    a = {"layers.0.w.weight": np.arange(12, dtype=np.float32).reshape(4, 3), "layers.0.w.scale": np.array([1, 2], np.uint8), "head": np.ones((2, 2), np.float32)}
    b = {"layers.1.w.weight": np.arange(6, dtype=np.float32).reshape(2, 3) + 100}
    safetensors.write_file(f"{tmp_path}/a.safetensors", a)
    safetensors.write_file(f"{tmp_path}/b.safetensors", b)
    (tmp_path / "index.json").write_text(json.dumps({"weight_map": {n: f for f, t in (("a.safetensors", a), ("b.safetensors", b)) for n in t}}))
    return str(tmp_path), a | b


def test_tensors(spark, model):
    path, want = model
    rows = {r.name: r for r in safetensors.floats(safetensors.tensors(spark, path).where("dtype = 'F32'")).collect()}
    assert set(rows) == {n for n, x in want.items() if x.dtype == np.float32}
    for n, r in rows.items():
        assert r.shape == list(want[n].shape) and r["values"] == want[n].ravel().tolist()
    heads = safetensors.tensors(spark, path, data=False).where("name like 'layers.0.%'").collect()
    assert {(r.name, r.data) for r in heads} == {("layers.0.w.weight", None), ("layers.0.w.scale", None)}


def test_rows_and_filters(spark, model):
    path, want = model
    got = safetensors.floats(safetensors.tensors(spark, path, rows="1:3").where("name = 'layers.0.w.weight'")).collect()
    assert sorted((r.row, r["values"]) for r in got) == [(i, want["layers.0.w.weight"][i].tolist()) for i in (1, 2)]
    reader = safetensors.Reader({"path": path})
    left = list(reader.pushFilters([safetensors.StringStartsWith(("name",), "layers.1"), safetensors.EqualTo(("dtype",), "F32")]))
    assert len(left) == 1 and [[x.name for x in p.pieces] for p in reader.partitions()] == [["layers.1.w.weight"]]
    assert safetensors.tensors(spark, path).where("name = 'none'").collect() == []
    assert {(r.name, r.file) for r in safetensors.catalog(spark, f"{path}/index.json").collect()} == {(n, "b.safetensors" if "1" in n else "a.safetensors") for n in want}


def test_prompts(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" one \n\n  \ntwo\nthree\n")
    take = lambda *a, **k: [r.prompt for r in files.prompts(spark, f"{tmp_path}/p.txt", *a, **k).orderBy("row").collect()]
    assert take(2) == ["one", "two"] and take(5, cycle=True) == ["one", "two", "three", "one", "two"]
    with pytest.raises(ValueError):
        take(4)


def test_trace_logs_timings(spark, tmp_path):
    e = [{"cat": "cpu_op", "name": "outer", "ts": 1.0, "args": {"External id": "7", "Input Dims": "[1]"}}, {"cat": "cpu_op", "name": "inner", "ts": 2.0, "args": {"External id": "7"}}, {"cat": "kernel", "name": "k1", "ts": 10.0, "dur": 3.0, "args": {"External id": "7"}}, {"cat": "kernel", "name": "k2", "ts": 12.5, "dur": 1.0, "args": {"External id": "9"}}]
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": e}))
    k = files.kernel_trace(files.trace_events(spark, f"{tmp_path}/t.json"))
    assert sorted((r.at, r.name, r.op) for r in k.collect()) == [(0.0, "k1", "outer"), (2.5, "k2", "?")]
    assert files.trace_text(k).first().value.startswith("      0.0     3.0  k1")
    (tmp_path / "x.log").write_text("Throughput: 1\nnoise\nError ignored\nThroughput: 2\nThroughput: 3\n")
    kept = files.log_lines(files.numbered_lines(spark, f"{tmp_path}/x.log"), "Throughput|Error", "IGNORED", 2)
    assert sorted(r.n for r in kept.collect()) == [4, 5]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"timings": {"predicted_n": 10, "predicted_ms": 500.0, "draft_n": 8, "draft_n_accepted": 6}}) for _ in range(3)))
    t = files.timings(spark, f"{tmp_path}/r.jsonl").first()
    assert (t.requests, t.tokens, t.per_second, t.accepted_percent) == (3, 30, 20.0, 75.0)


def test_sinks(spark, tmp_path):
    counts = spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "layer int, expert int, hits int")
    files.write_stats(counts, f"{tmp_path}/stats")
    assert spark.read.parquet(f"{tmp_path}/stats").where("layer = 1").first().hits == 6
    body = files.event_stream(spark.createDataFrame([("r", 1, "b"), ("r", 0, 'a"')], "request string, i int, text string")).first().body
    lines = [x for x in body.split("\n\n") if x]
    assert [json.loads(x[6:])["text"] for x in lines[:2]] == ['a"', "b"] and lines[2] == "data: [DONE]"


def test_written_tensors(spark, tmp_path, monkeypatch):
    big = np.arange(40, dtype=np.float32).reshape(10, 4)
    rows = [(f"t{i}", "F32", [10, 4], (big + i).tobytes()) for i in range(5)] + [("scalar", "F64", [], np.float64(3).tobytes()), ("empty", "F32", [0, 4], b"")]
    df = spark.createDataFrame(rows, "name string, dtype string, shape array<bigint>, data binary").repartition(3)
    path = f"file://{tmp_path}/model"
    safetensors.write(df, path)
    got = {r.name: r for r in safetensors.tensors(spark, path).collect()}
    assert {(n, bytes(r.data), tuple(r.shape), r.dtype) for n, r in got.items()} == {(n, d, tuple(s), t) for n, t, s, d in rows}
    assert {(r.name, r.file) for r in safetensors.catalog(spark, f"{path}/{safetensors.INDEX}").collect()} == {(n, r.file) for n, r in got.items()}
    safetensors.write(df.where("name = 't1'").withColumn("name", safetensors.F.lit("more")), path)
    assert safetensors.catalog(spark, f"{path}/{safetensors.INDEX}").count() == 8 and safetensors.tensors(spark, path, data=False).count() == 8
    safetensors.write(df.where("name = 't1'"), path, overwrite=True)
    assert [r.name for r in safetensors.tensors(spark, path).collect()] == ["t1"] and safetensors.catalog(spark, f"{path}/{safetensors.INDEX}").count() == 1
    monkeypatch.setattr(safetensors, "SPLIT_BYTES", 40)
    parts = safetensors.Reader({"path": path, "rows": "1:9"}).partitions()
    assert [x.rows for p in parts for x in p.pieces] == [(1, 3), (3, 5), (5, 7), (7, 9)] and all(len(p.pieces) == 1 for p in parts)
    monkeypatch.setattr(safetensors, "ROW_BYTES", 40)
    with pytest.raises(ValueError):
        safetensors.Reader({"path": path}).partitions()
