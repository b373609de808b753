"""Every registered query of the library against its DuckDB equivalent, on two sizes."""

import math

import duckdb
import pytest
from loomwork import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def size(request):
    sf = f"/root/testdata/sf{request.param}"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sf, db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, size, name):
    sf, db = size
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    assert rows
    if name not in catalog.oracle_sql():
        return
    cols = sorted(df.columns)
    found = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == want


def test_plans(spark):
    """Whole-table plans have no cartesian product of two tables and no Python where built-ins serve."""
    for name in ("telemetry_coverage", "ngram_hash", "gate_topk", "causal_score_join", "owner_asof", "window_visible", "sink_softmax_partial_final"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan, name


def test_top_n_is_limited_before_the_shuffle(spark):
    for name in ("telemetry_coverage", "kernel_rollup_topn", "hot_expert_choice"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_pushdown(spark):
    plan = catalog.queries()["stop_string_cut"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
