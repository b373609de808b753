"""Two-level retrieval, windows and as-of lookups (survey J4, J5, J7-J9, P4-P6, P8, P9, T2-T4, W2, W3, A21, A30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.registry import query
from loomwork.session import TOKENS_SQL, table, tokens

RATIO = 4
#: Two heads' weights on query and key.
HEADS = ((4, 2), (-3, 5))


def causal_scores(rows: DataFrame, ratio: int, heads: tuple[tuple[int, int], ...]) -> DataFrame:
    """Per position, the number of complete groups before it and the sum over them of its head-weighted relu scores.

    relu(q k) is relu(q) relu(k) + relu(-q) relu(-k), so the sum over all
    visible groups is a running sum of each sign: no pairs are formed, and a
    sequence's cost grows with its length, not its square.  rows: seq, pos, x.
    """
    zero = F.lit(0).cast("long")  # integers: sums in any order are equal
    keys = rows.groupBy("seq", F.expr(f"pos div {ratio}").alias("grp")).agg(F.sum("x").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("n") == ratio)
    run = Window.partitionBy("seq").orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = keys.select("seq", (F.col("grp") + 1).alias("bound"), F.sum(F.greatest("k", zero)).over(run).alias("up"), F.sum(F.greatest(-F.col("k"), zero)).over(run).alias("down"))
    seen = rows.withColumn("bound", F.expr(f"(pos + 1) div {ratio}")).join(sums, ["seq", "bound"], "left")
    score = zero
    for weight, head in heads:
        q = F.col("x") * head
        score = score + weight * (F.greatest(q, zero) * F.coalesce("up", zero) + F.greatest(-q, zero) * F.coalesce("down", zero))
    return seen.select("seq", "pos", "bound", score.alias("score"))


_X = f"(SELECT seq, pos, round(value * 100)::BIGINT - 2000 * tok AS x FROM {TOKENS_SQL})"


@query(f"""WITH x AS {_X}, k AS (SELECT seq, pos // {RATIO} AS grp, sum(x) AS k FROM x GROUP BY 1, 2 HAVING count(*) = {RATIO})
SELECT q.seq, q.pos, (q.pos + 1) // {RATIO} AS bound, coalesce(sum({' + '.join(f'{w} * greatest(q.x * {h} * k.k, 0)' for w, h in HEADS)}), 0)::BIGINT AS score
FROM x q LEFT JOIN k ON k.seq = q.seq AND k.grp < (q.pos + 1) // {RATIO} GROUP BY 1, 2, 3""")
def causal_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle joins all pairs, this doesn't."""
    rows = tokens(spark, sf_dir).select("seq", "pos", (F.round(F.col("value") * 100).cast("long") - 2000 * F.col("tok")).alias("x"))
    return causal_scores(rows, RATIO, HEADS)


def candidate_blocks(rows: DataFrame, block: int, top: int) -> DataFrame:
    """The blocks of each sequence with the largest maxima, its last block always among them; rows: seq, pos, score."""
    best = rows.groupBy("seq", F.expr(f"pos div {block}").alias("blk")).agg(F.max("score").alias("best"))
    last = F.max("blk").over(Window.partitionBy("seq"))
    order = Window.partitionBy("seq").orderBy(F.col("is_last").desc(), F.round("best", 6).desc(), "blk")
    return best.withColumn("is_last", F.col("blk") == last).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top).select("seq", "blk")


_CANDIDATES = """WITH t AS {rows}, b AS (SELECT seq, pos // {block} AS blk, max(score) AS best FROM t GROUP BY 1, 2), l AS (SELECT *, blk = max(blk) OVER (PARTITION BY seq) AS is_last FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY is_last DESC, round(best, 6) DESC, blk) AS rk FROM l), c AS (SELECT seq, blk FROM r WHERE rk <= {top})"""


@query(_CANDIDATES.format(rows=f"(SELECT seq, pos, value AS score FROM {TOKENS_SQL})", block=8, top=3) + " SELECT t.seq, t.pos, round(t.score, 6) AS score FROM t SEMI JOIN c ON c.seq = t.seq AND c.blk = t.pos // 8")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 J7 P8."""
    rows = tokens(spark, sf_dir).select("seq", "pos", F.col("value").alias("score"), F.expr("pos div 8").alias("blk"))
    return rows.join(candidate_blocks(rows, 8, 3), ["seq", "blk"], "left_semi").select("seq", "pos", F.round("score", 6).alias("score"))


#: Queries of one pass over all rows.
QUERY_BLOCK = 1024


def nearest(vectors: DataFrame, queries: DataFrame, top: int, keep: DataFrame | None = None) -> DataFrame:
    """For each query the top rows by dot product, ties by id; q, id, score.

    A stated query set against all rows, QUERY_BLOCK queries a pass: a pass's
    queries go to every task, which keeps its own best top of each before
    anything is shuffled.  keep: pairs (q, blk) that restrict the rows.
    """
    n = -(-queries.count() // QUERY_BLOCK)
    out = None
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows = vectors.select("id", double("vector").alias("v"), *(["blk"] if keep is not None else []))
    for k in range(n):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == k).select("q", double("vector").alias("x"))
        # with pairs to keep, only these are formed
        met = rows.crossJoin(F.broadcast(some)) if keep is None else rows.join(keep.join(some, "q"), "blk")
        score = F.round(F.aggregate(F.zip_with("v", "x", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
        best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
        part = met.select("q", "id", score.alias("score")).withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= top)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "q long, id long, score double, rk int")


def head_scores(keys: DataFrame, queries: DataFrame, weights: list[float], top: int) -> DataFrame:
    """Q, id, score, rk of each query's best visible keys; the score is the weighted sum over heads of relu(head . key).

    keys: id, vector.  queries: q, bound (keys with smaller ids are visible),
    heads (an array of vectors, one for each weight).  A stated query set
    against all keys, QUERY_BLOCK queries a pass; each task keeps its own best
    of each query before anything is shuffled.
    """
    n = -(-queries.count() // QUERY_BLOCK)
    out = None
    rows = keys.select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    dot = lambda h: F.aggregate(F.zip_with("v", h, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    for k in range(n):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == k).select("q", "bound", F.transform("heads", lambda h: F.transform(h, lambda x: x.cast("double"))).alias("heads"))
        score = sum((w * F.greatest(dot(F.col("heads")[i]), F.lit(0.0)) for i, w in enumerate(weights)), F.lit(0.0))
        met = rows.join(F.broadcast(some), F.col("id") < F.col("bound")).select("q", "id", F.round(score, 6).alias("score"))
        best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
        part = met.withColumn("rk", F.row_number().over(best).cast("long")).where(F.col("rk") <= top)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else keys.sparkSession.createDataFrame([], "q long, id long, score double, rk long")


#: heads' weights.
HEAD_WEIGHTS = [1.0, -0.25, 0.5]


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT vec_id // {RATIO} AS id, list(x ORDER BY vec_id) AS xs FROM v GROUP BY 1 HAVING count(*) = {RATIO}),
g AS (SELECT id, [xs[1][i] + xs[2][i] + xs[3][i] + xs[4][i] for i in range(1, 65)] AS y FROM k),
s AS (SELECT v.vec_id AS q, g.id, round({HEAD_WEIGHTS[0]} * greatest(list_inner_product(v.x, g.y), 0) + {HEAD_WEIGHTS[1]} * greatest(list_inner_product(list_reverse(v.x), g.y), 0) + {HEAD_WEIGHTS[2]} * greatest(list_inner_product([-a for a in v.x], g.y), 0), 6) AS score
FROM v JOIN g ON g.id < (v.vec_id + 1) // {RATIO} WHERE v.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rk FROM s) SELECT q, id, score, rk FROM r WHERE rk <= 8""")
def vector_causal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 entries; keys are sums of complete groups, and every hundredth row asks all groups before it."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    held = v.groupBy(F.expr(f"vec_id div {RATIO}").alias("id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("r")).where(F.size("r") == RATIO)  # RATIO rows a group
    keys = held.select("id", F.aggregate(F.slice("r", 2, RATIO - 1), F.col("r")[0]["x"], lambda a, e: F.zip_with(a, e["x"], lambda p, q: p + q)).alias("vector"))
    ask = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.expr(f"(vec_id + 1) div {RATIO}").alias("bound"), F.array("x", F.reverse("x"), F.transform("x", lambda a: -a)).alias("heads"))
    return head_scores(keys, ask, HEAD_WEIGHTS, 8)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.expr("vec_id div 16").alias("blk")), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))


_SCORES = "(SELECT q.vec_id AS q, k.vec_id AS id, k.vec_id // 16 AS blk, round(list_inner_product(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings k WHERE q.vec_id % 100 = 0)"


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rk FROM {_SCORES}) SELECT q, row_number() OVER (PARTITION BY q ORDER BY id) - 1 AS place, id FROM r WHERE rk <= 16")
def index_topk_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of each query, in the order of their ids."""
    rows, queries = _vectors(spark, sf_dir)
    best = nearest(rows, queries, 16).groupBy("q").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most 16 each
    return best.select("q", F.posexplode("ids").alias("place", "id")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH s AS {_SCORES}, b AS (SELECT q, blk, max(score) AS best FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY best DESC, blk) AS rk FROM b),
w AS (SELECT s.*, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, s.id) AS rk FROM s JOIN r ON r.q = s.q AND r.blk = s.blk AND r.rk <= 4) SELECT q, id, blk, score, rk FROM w WHERE rk <= 8""")
def retrieval_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best blocks by their maxima, then the best rows of these; scored once."""
    rows, queries = _vectors(spark, sf_dir)
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    out = None
    n = -(-queries.count() // QUERY_BLOCK)
    for k in range(n):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == k).select("q", double("vector").alias("x"))
        score = F.round(F.aggregate(F.zip_with("v", "x", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
        met = rows.select("id", "blk", double("vector").alias("v")).crossJoin(F.broadcast(some)).select("q", "id", "blk", score.alias("score"))
        # a block's best rows are all that two levels can return
        inner = met.withColumn("r", F.row_number().over(Window.partitionBy("q", "blk").orderBy(F.col("score").desc(), "id"))).where("r <= 8")
        top = inner.where("r = 1").withColumn("b", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "blk"))).where("b <= 4").select("q", "blk")
        part = inner.join(top, ["q", "blk"], "left_semi").withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id")).cast("long")).where("rk <= 8").select("q", "id", "blk", "score", "rk")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "q long, id long, blk long, score double, rk long")


WIN = 8


@query(f"""WITH t AS {TOKENS_SQL}, m AS (SELECT *, max(pos) OVER (PARTITION BY seq) AS pmax FROM t)
SELECT seq, pos, count(*) OVER w AS visible, round(sum(value) OVER w, 6) AS total, pos % {WIN} AS slot, pmax - (pmax - pos % {WIN}) % {WIN} AS held, greatest(0, pos - {WIN} + 1) AS oldest FROM m WINDOW w AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN {WIN - 1} PRECEDING AND CURRENT ROW)""")
def window_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 P6 W2 W3 F22 ST2: what a ring of WIN slots shows at each position, and which position each slot holds at the end."""
    seq = Window.partitionBy("seq")
    last = seq.orderBy("pos").rowsBetween(1 - WIN, Window.currentRow)
    m = tokens(spark, sf_dir).withColumn("pmax", F.max("pos").over(seq))
    slot = F.pmod("pos", F.lit(WIN))
    return m.select("seq", "pos", F.count(F.lit(1)).over(last).alias("visible"), F.round(F.sum("value").over(last), 6).alias("total"), slot.alias("slot"), (F.col("pmax") - F.pmod(F.col("pmax") - slot, F.lit(WIN))).alias("held"), F.greatest(F.lit(0), F.col("pos") - WIN + 1).alias("oldest"))


def asof(left: DataFrame, right: DataFrame, on: str, time: str, value: str, order: list[str], bucket: Column) -> DataFrame:
    """Left with the last value of right at or before its time, by key.

    Keys are cut by time buckets, so a hot key spreads over tasks; what a
    bucket inherits from the ones before is one row a key and bucket.
    bucket: expression over the time column of either side.
    """
    l = left.withColumn("_b", bucket)  # noqa: E741
    r = right.select(on, time, value, *order).withColumn("_b", bucket)
    end = r.groupBy(on, "_b").agg(F.max_by(value, F.struct(time, *order)).alias("_end"))
    keys = l.select(on, "_b").unionByName(r.select(on, "_b")).distinct().join(end, [on, "_b"], "left")
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carry = keys.select(on, "_b", carried.alias("_carry"))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (on, time)]
    both = l.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType), **{f"_o{i}": F.lit(None).cast(right.schema[c].dataType) for i, c in enumerate(order)}}).unionByName(
        r.select(on, time, *blank, "_b", F.lit(0).alias("_side"), F.col(value).alias("_value"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    )
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(on, "_b").orderBy(time, "_side", *(f"_o{i}" for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_found", inside).where("_side = 1")
    return found.join(carry, [on, "_b"], "left").withColumn(value, F.coalesce("_found", "_carry")).select(*left.columns, value)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_suppkey % 100 AS k, l_shipdate AS t FROM lineitem), o AS (SELECT o_custkey % 100 AS k, o_orderdate AS t, o_orderkey FROM orders),
d AS (SELECT k, t, max(o_orderkey) AS owner FROM o GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, d.owner FROM l ASOF LEFT JOIN d ON l.k = d.k AND l.t >= d.t""")
def owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of the key at or before each ship date; of one date's orders the largest key."""
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_suppkey") % 100).alias("k"), F.col("l_shipdate").alias("t"))
    right = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("owner"), F.col("o_orderkey").alias("tie"))
    return asof(left, right, "k", "t", "owner", ["tie"], F.trunc(F.col("t"), "quarter")).drop("k", "t")


@query("WITH s AS (SELECT event_type AS kind, user_id AS id, round(sum(value), 6) AS score FROM events GROUP BY 1, 2) SELECT kind, arg_max(id, (score, -id)) AS id, max(score) AS score FROM s GROUP BY 1")
def greedy_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best id of each kind; the lowest id among equals."""
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.col("user_id").alias("id")).agg(F.round(F.sum("value"), 6).alias("score"))
    return s.groupBy("kind").agg(F.max_by("id", F.struct(F.col("score"), -F.col("id"))).alias("id"), F.max("score").alias("score"))
