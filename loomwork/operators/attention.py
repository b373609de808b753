"""Softmax aggregation with a sink, partial and final, and pooling (survey A11-A14, A16, A17, A34, J8, U1, ST3, P13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.registry import query
from loomwork.session import TOKENS_SQL, table, tokens

SINK = 0.5


def partial(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(m, l, acc) of each group: largest logit, sum of weights and weighted sum relative to it; rows: keys, x, v.

    Logits are first binned so that one pass with partial aggregation is
    enough: within a bin of width 32 exp cannot overflow, and bins are merged.
    """
    b = F.floor(F.col("x") / 32)
    w = F.exp(F.col("x") - b * 32)
    return rows.groupBy(*keys, b.alias("_bin")).agg(F.sum(w).alias("l"), F.sum(w * F.col("v")).alias("acc"), F.max("x").alias("m")).transform(lambda t: merge(t.withColumns({"at": F.col("_bin") * 32.0}), keys))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts (at, m, l, acc: sums relative to at) of the same keys as one, relative to the largest logit."""
    top = parts.groupBy(*keys).agg(F.max("m").alias("m"), F.collect_list(F.struct("at", "l", "acc")).alias("p"))  # one entry a split
    scale = lambda p: F.exp(p["at"] - F.col("m"))
    return top.select(*keys, F.col("m"), F.aggregate("p", F.lit(0.0), lambda a, p: a + p["l"] * scale(p)).alias("l"), F.aggregate("p", F.lit(0.0), lambda a, p: a + p["acc"] * scale(p)).alias("acc"))


def with_sink(m: DataFrame, sink: Column) -> Column:
    """The attended value when a sink joins the denominator."""
    top = F.greatest(F.col("m"), sink)
    return F.col("acc") * F.exp(F.col("m") - top) / (F.col("l") * F.exp(F.col("m") - top) + F.exp(sink - top))


_ROWS = "(SELECT user_id AS k, event_id % 4 AS split, value / 40 AS x, (event_id % 17)::DOUBLE AS v FROM events)"
_SINGLE = f"WITH r AS {_ROWS}, m AS (SELECT k, greatest(max(x), {SINK}) AS m FROM r GROUP BY 1) SELECT r.k, round(sum(exp(x - m) * v) / (sum(exp(x - m)) + exp({SINK} - max(m))), 6) AS y FROM r JOIN m ON m.k = r.k GROUP BY 1"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 4).alias("split"), (F.col("value") / 40).alias("x"), (F.col("event_id") % 17).cast("double").alias("v"))


@query(_SINGLE)
def sink_softmax_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over all rows of a key."""
    m = partial(_rows(spark, sf_dir), ["k"])
    return m.select("k", F.round(with_sink(m, F.lit(SINK)), 6).alias("y"))


@query(_SINGLE)
def sink_softmax_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of a key first, then their merge; equal to the single pass."""
    m = merge(partial(_rows(spark, sf_dir), ["k", "split"]).withColumn("at", F.col("m")), ["k"])
    return m.select("k", F.round(with_sink(m, F.lit(SINK)), 6).alias("y"))


def pool(rows: DataFrame, ratio: int) -> DataFrame:
    """Softmax-gated mean of each full group of ratio positions; an incomplete group gives nothing. rows: seq, pos, x (gate), v."""
    g = rows.groupBy("seq", F.expr(f"pos div {ratio}").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("m"), F.collect_list(F.struct("pos", "x", "v")).alias("r")).where(F.col("n") == ratio)  # ratio rows a group
    e = F.aggregate(F.array_sort("r"), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, p: F.struct((s["a"] + F.exp(p["x"] - F.col("m")) * p["v"]).alias("a"), (s["b"] + F.exp(p["x"] - F.col("m"))).alias("b")))
    return g.select("seq", "grp", e.alias("e")).select("seq", "grp", (F.col("e.a") / F.col("e.b")).alias("v"))


_POOL = "SELECT {r}::BIGINT AS ratio, seq, pos // {r} AS grp, round(sum(exp(value / 40) * tok) / sum(exp(value / 40)), 6) AS v FROM t GROUP BY 2, 3 HAVING count(*) = {r}"


@query(f"WITH t AS {TOKENS_SQL} {_POOL.format(r=2)} UNION ALL {_POOL.format(r=4)}")
def compress_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 ST3 W10: ratios 2 and 4."""
    rows = tokens(spark, sf_dir).select("seq", "pos", (F.col("value") / 40).alias("x"), F.col("tok").cast("double").alias("v"))
    one = lambda r: pool(rows, r).select(F.lit(r).cast("long").alias("ratio"), "seq", "grp", F.round("v", 6).alias("v"))
    return one(2).unionByName(one(4))


@query(f"""WITH t AS {TOKENS_SQL}, m AS (SELECT *, max(pos) OVER (PARTITION BY seq) AS pmax FROM t),
u AS (SELECT seq, 'window' AS src, value / 40 AS x, tok::DOUBLE AS v FROM m WHERE pos > pmax - 8 UNION ALL
SELECT seq, 'compressed', max(value) / 40, sum(exp(value / 40) * tok) / sum(exp(value / 40)) FROM m GROUP BY seq, pmax, pos // 4 HAVING count(*) = 4),
s AS (SELECT seq, greatest(max(x), {SINK}) AS top FROM u GROUP BY 1)
SELECT u.seq, count(*) AS rows_seen, count(*) FILTER (WHERE src = 'window') AS in_window, round(sum(exp(x - top) * v) / (sum(exp(x - top)) + exp({SINK} - max(top))), 6) AS y FROM u JOIN s ON s.seq = u.seq GROUP BY 1""")
def window_union_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last position's attention over its window and the pooled groups, one bag with a source tag."""
    m = tokens(spark, sf_dir).withColumn("pmax", F.max("pos").over(Window.partitionBy("seq"))).withColumns({"x": F.col("value") / 40, "v": F.col("tok").cast("double")})
    window = m.where("pos > pmax - 8").select("seq", F.lit("window").alias("src"), "x", "v")
    gates = m.groupBy("seq", F.expr("pos div 4").alias("grp")).agg(F.max("x").alias("x"))
    pooled = pool(m.select("seq", "pos", "x", "v"), 4).join(gates, ["seq", "grp"]).select("seq", F.lit("compressed").alias("src"), "x", "v")
    both = window.unionByName(pooled)
    y = partial(both, ["seq"])
    counts = both.groupBy("seq").agg(F.count(F.lit(1)).alias("rows_seen"), F.count(F.when(F.col("src") == "window", 1)).alias("in_window"))
    return y.join(counts, "seq").select("seq", "rows_seen", "in_window", F.round(with_sink(y, F.lit(SINK)), 6).alias("y"))


@query("""WITH c AS (SELECT vec_id, copy, i, x * (1 + copy * 0.25) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), range(4) r(copy)),
m AS (SELECT vec_id, i, avg(x) AS x FROM c GROUP BY 1, 2) SELECT vec_id, count(*) AS dims, round(sum(x), 6) AS total, round(sqrt(avg(x * x)), 6) AS rms FROM m GROUP BY 1""")
def copies_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row in four scaled copies, their mean, and its root mean square; within the row."""
    copies = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform("embedding", lambda x: x.cast("double") * (1 + k * 0.25)))
    mean = F.transform(F.aggregate(F.slice(F.col("c"), 2, 3), F.col("c")[0], lambda a, r: F.zip_with(a, r, lambda x, y: x + y)), lambda x: x / 4)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", copies.alias("c")).select("vec_id", mean.alias("m"))
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda a, x: a + f(x))
    return rows.select("vec_id", F.size("m").cast("long").alias("dims"), F.round(total(lambda x: x), 6).alias("total"), F.round(F.sqrt(total(lambda x: x * x) / F.size("m")), 6).alias("rms"))
