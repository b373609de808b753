"""Score-based top-k routing and capped dispatch (survey T1, T5, P7, P10, P11, P14, W5-W8, A1, A2, A8-A10, A18-A20, J6, K21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.plans import ranks
from loomwork.registry import query
from loomwork.session import table

EXPERTS, TOP, SCALE, GMAX = 32, 6, 2.5, 16
#: At most so many experts' vectors go along with each row.
MAX_EXPERTS = 4096


def transform(score: Column, kind: str) -> Column:
    """the gate's score functions of single scores; "softmax" goes over a token's scores, in gate()."""
    if kind == "sigmoid":
        return 1 / (1 + F.exp(-score))
    if kind == "sqrtsoftplus":
        return F.sqrt(F.when(score > 20, score).otherwise(F.log1p(F.exp(score))))
    if kind == "exp":
        return F.exp(score)
    raise ValueError(kind)


def expert_matrix(experts: DataFrame) -> DataFrame:
    """One row: experts, an array of (id, vector, bias) in id order; experts: id, vector, bias."""
    few = experts.limit(MAX_EXPERTS + 1).agg(F.array_sort(F.collect_list(F.struct("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), "bias"))).alias("experts"))
    return few.select(F.when(F.size("experts") > MAX_EXPERTS, F.raise_error(F.lit(f"more than {MAX_EXPERTS} experts"))).otherwise(F.col("experts")).alias("experts"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gate(rows: DataFrame, experts: DataFrame, top: int, kind: str = "sqrtsoftplus", scale: float = 1.0, normalise: bool = True, temperature: float = 1.0) -> DataFrame:
    """(tok, slot, expert, weight). rows: tok, vector.

    An expert is chosen by score + bias (ties: lowest id) and weighted by its
    score alone.  All of a token's scores lie in one array of its row, so
    routing takes no shuffle; the experts are one row that every task gets.
    """
    held = rows.select("tok", F.transform("vector", lambda x: x.cast("double")).alias("x")).crossJoin(F.broadcast(expert_matrix(experts)))
    raw = lambda e: dot(F.col("x"), e["vector"]) / temperature
    one = lambda e: F.struct(e["id"].alias("id"), (raw(e) if kind == "softmax" else transform(raw(e), kind)).alias("s"), e["bias"].alias("b"))
    scored = held.select("tok", F.transform("experts", one).alias("scores"))
    if kind == "softmax":
        # the largest score is taken off before exp, so nothing overflows
        high = scored.withColumn("high", F.array_max(F.transform("scores", lambda v: v["s"])))
        powers = high.select("tok", F.transform("scores", lambda v: F.struct(v["id"].alias("id"), F.exp(v["s"] - F.col("high")).alias("s"), v["b"].alias("b"))).alias("scores"))
        whole = powers.withColumn("whole", F.aggregate("scores", F.lit(0.0), lambda a, v: a + v["s"]))
        scored = whole.select("tok", F.transform("scores", lambda v: F.struct(v["id"].alias("id"), (v["s"] / F.col("whole")).alias("s"), v["b"].alias("b"))).alias("scores"))
    ordered = F.array_sort(F.transform("scores", lambda v: F.struct((-F.round(v["s"] + v["b"], 6)).alias("k"), v["id"].alias("id"), v["s"].alias("s"))))
    best = scored.select("tok", F.slice(ordered, 1, top).alias("best"))
    total = F.aggregate("best", F.lit(0.0), lambda a, v: a + v["s"]) + 1e-20
    weights = F.transform("best", lambda v: F.struct(v["id"].alias("expert"), F.round(v["s"] / (total if normalise else F.lit(1.0)) * scale, 6).alias("weight")))
    return best.select("tok", F.posexplode(weights).alias("slot", "w")).select("tok", F.col("slot").cast("long").alias("slot"), "w.expert", "w.weight")


def _split(spark: SparkSession, sf_dir: str, bias: Column) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.where(F.col("vec_id") >= EXPERTS).select(F.col("vec_id").alias("tok"), F.col("embedding").alias("vector")), vectors.where(F.col("vec_id") < EXPERTS).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), bias.alias("bias"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(*_split(spark, sf_dir, F.lit(0.0)), TOP, scale=SCALE)


def _gate_sql(bias: str) -> str:
    return f"""(WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT t.vec_id AS tok, e.vec_id AS expert, sqrt(ln(1 + exp(list_inner_product(t.x, e.x)))) AS s, {bias} AS b FROM v t JOIN v e ON t.vec_id >= {EXPERTS} AND e.vec_id < {EXPERTS}),
r AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY round(s + b, 6) DESC, expert) - 1 AS slot FROM s)
SELECT tok, slot, expert, round(s / (sum(s) OVER (PARTITION BY tok) + 1e-20) * {SCALE}, 6) AS weight FROM r WHERE slot < {TOP})"""


@query(f"SELECT * FROM {_gate_sql('0.0')}")
def gate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 F15 P14."""
    return routed(spark, sf_dir)


@query(f"SELECT * FROM {_gate_sql('e.label * 0.01')}")
def gate_topk_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biased choice, unbiased weight."""
    return gate(*_split(spark, sf_dir, F.col("label") * 0.01), TOP, scale=SCALE)


@query(f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT t.vec_id AS tok, e.vec_id AS expert, list_inner_product(t.x, e.x) / 0.5 AS d, e.label * 0.002 AS b FROM v t JOIN v e ON t.vec_id >= {EXPERTS} AND e.vec_id < {EXPERTS}),
p AS (SELECT *, exp(d - max(d) OVER (PARTITION BY tok)) AS p FROM d), s AS (SELECT tok, expert, b, p / sum(p) OVER (PARTITION BY tok) AS s FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY round(s + b, 6) DESC, expert) - 1 AS slot FROM s) SELECT tok, slot, expert, round(s * {SCALE}, 6) AS weight FROM r WHERE slot < {TOP}""")
def gate_topk_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over a token's experts at a temperature, biased choice, weights as they are."""
    return gate(*_split(spark, sf_dir, F.col("label") * 0.002), TOP, "softmax", SCALE, normalise=False, temperature=0.5)


def dispatch(pairs: DataFrame, experts: DataFrame, gmax: int) -> DataFrame:
    """Each pair's place in expert order and its group of at most gmax pairs.

    pairs: pair, expert.  experts: expert.  Places come from ranges of
    (expert, pair), so an expert with most pairs is spread over tasks; starts
    are sums over experts.
    """
    counts = ranks.zero_filled(pairs.groupBy("expert").agg(F.count(F.lit(1)).alias("n")), experts, ["expert"], "n")
    starts = counts.select("expert", "n", (F.sum("n").over(Window.orderBy("expert")) - F.col("n")).alias("start"))
    placed = ranks.global_index(pairs, ["expert", "pair"], "place")
    return placed.join(starts, "expert").select("pair", "expert", "place", "start", "n", F.expr(f"(place - start) div {gmax}").alias("grp"))


_PAIRS = f"(SELECT tok * {TOP} + slot AS pair, expert FROM {_gate_sql('0.0')})"


@query(f"""WITH p AS {_PAIRS}, c AS (SELECT e.vec_id AS expert, count(p.pair) AS n FROM embeddings e LEFT JOIN p ON p.expert = e.vec_id WHERE e.vec_id < {EXPERTS} GROUP BY 1),
s AS (SELECT expert, n, (sum(n) OVER (ORDER BY expert) - n)::BIGINT AS start FROM c)
SELECT p.pair, p.expert, row_number() OVER (ORDER BY p.expert, p.pair) - 1 AS place, s.start, s.n, (row_number() OVER (PARTITION BY p.expert ORDER BY p.pair) - 1) // {GMAX} AS grp FROM p JOIN s ON s.expert = p.expert""")
def moe_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 W6 W7 W8 K21 A10 T5."""
    pairs = routed(spark, sf_dir).select((F.col("tok") * TOP + F.col("slot")).alias("pair"), "expert")
    return dispatch(pairs, table(spark, sf_dir, "embeddings").where(F.col("vec_id") < EXPERTS).select(F.col("vec_id").alias("expert")), GMAX)


@query(f"""WITH d AS (SELECT expert, count(*) AS n FROM {_PAIRS} GROUP BY 1) SELECT expert, n, (n + {GMAX - 1}) // {GMAX} AS grps, n BETWEEN 17 AND 96 AS runs FROM d""")
def dispatch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 P10: pairs and groups of each expert, and whether its size is in the range that a kernel takes."""
    d = routed(spark, sf_dir).groupBy("expert").agg(F.count(F.lit(1)).alias("n"))
    return d.select("expert", "n", F.expr(f"(n + {GMAX - 1}) div {GMAX}").alias("grps"), F.col("n").between(17, 96).alias("runs"))


def combine(pairs: DataFrame, experts: DataFrame) -> DataFrame:
    """Per token, the weighted sum of its experts' vectors in slot order; pairs: tok, slot, expert, weight."""
    vectors = experts.select(F.col("id").alias("expert"), F.transform("vector", lambda x: x.cast("double")).alias("v"))
    rows = pairs.join(vectors, "expert").groupBy("tok").agg(F.array_sort(F.collect_list(F.struct("slot", "weight", "v"))).alias("rows"))  # top-k rows a token
    zero = F.transform(F.col("rows")[0]["v"], lambda x: F.lit(0.0))
    return rows.select("tok", F.aggregate("rows", zero, lambda a, r: F.zip_with(a, r["v"], lambda x, y: x + r["weight"] * y)).alias("y"))


@query(f"""WITH g AS (SELECT * FROM {_gate_sql('0.0')}), x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
y AS (SELECT tok, i, sum(weight * x) AS y FROM g JOIN x ON x.vec_id = g.expert GROUP BY 1, 2)
SELECT tok, round(max(CASE WHEN i = 1 THEN y END), 6) AS y0, round(max(CASE WHEN i = 64 THEN y END), 6) AS y63, round(sum(y), 6) AS total, round(sum(y * y), 6) AS square FROM y GROUP BY 1""")
def moe_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 A2 J6 K3 K4."""
    tok, experts = _split(spark, sf_dir, F.lit(0.0))
    y = combine(gate(tok, experts, TOP, scale=SCALE), experts)
    return y.select("tok", F.round(F.col("y")[0], 6).alias("y0"), F.round(F.col("y")[63], 6).alias("y63"), F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


@query("""WITH p AS (SELECT l_returnflag AS tok, least(l_partkey * 4 // (SELECT max(p_partkey) + 1 FROM part), 3) AS shard, sum(l_quantity) AS part FROM lineitem GROUP BY 1, 2)
SELECT tok, count(*) AS shards, round(max(part), 6) AS largest, round(sum(part) + (SELECT sum(s_acctbal) FROM supplier), 6) AS total FROM p GROUP BY 1""")
def shard_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums of range shards, their sum, and a shared term."""
    bound = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("bound"))
    shared = table(spark, sf_dir, "supplier").agg(F.sum("s_acctbal").alias("shared"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tok"), "l_partkey", "l_quantity").crossJoin(F.broadcast(bound))
    p = rows.groupBy("tok", F.least(F.expr("l_partkey * 4 div bound"), F.lit(3)).alias("shard")).agg(F.sum("l_quantity").alias("part"))
    return p.groupBy("tok").agg(F.count(F.lit(1)).alias("shards"), F.round(F.max("part"), 6).alias("largest"), F.sum("part").alias("all")).crossJoin(F.broadcast(shared)).select("tok", "shards", "largest", F.round(F.col("all") + F.col("shared"), 6).alias("total"))


HOT = 20


@query(f"""WITH c AS (SELECT l_linenumber::BIGINT AS layer, l_partkey AS expert, count(*) AS hits FROM lineitem GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY hits DESC, expert) - 1 AS slot FROM c)
SELECT c.layer, count(*) AS experts, sum(c.hits)::BIGINT AS hits, sum(CASE WHEN h.slot < {HOT} THEN c.hits ELSE 0 END)::BIGINT AS hot_hits, count(*) FILTER (WHERE h.slot >= {HOT}) AS cold_experts, sum(CASE WHEN h.slot < {HOT} THEN h.slot ELSE {HOT} END)::BIGINT AS slots FROM c JOIN h USING (layer, expert) GROUP BY 1""")
def hot_expert_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hottest experts of each layer get slots; pairs of the others get the dummy slot with weight 0."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("layer"), F.col("l_partkey").alias("expert"))
    c = rows.groupBy("layer", "expert").agg(F.count(F.lit(1)).alias("hits"))
    hot = c.withColumn("rk", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("hits").desc(), "expert"))).where(F.col("rk") <= HOT).select("layer", "expert", (F.col("rk") - 1).alias("slot"))
    placed = c.join(hot, ["layer", "expert"], "left")
    return placed.groupBy("layer").agg(F.count(F.lit(1)).alias("experts"), F.sum("hits").alias("hits"), F.sum(F.when(F.col("slot").isNotNull(), F.col("hits")).otherwise(0)).alias("hot_hits"), F.count(F.when(F.col("slot").isNull(), 1)).alias("cold_experts"), F.sum(F.coalesce("slot", F.lit(HOT))).cast("long").alias("slots"))
