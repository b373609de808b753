"""Placement and budgets (survey T10-T14, W5, P12, P18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.registry import query
from loomwork.session import table


@query("""WITH c AS (SELECT s_suppkey AS device, greatest(floor((s_acctbal - 1000) / 700), 0)::BIGINT AS room FROM supplier), b AS (SELECT device, room, (sum(room) OVER (ORDER BY device) - room)::BIGINT AS start FROM c)
SELECT l.layer, b.device FROM range(200) l(layer) JOIN b ON l.layer >= b.start AND l.layer < b.start + b.room""")
def placement_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers placed on devices in order, as many as each has room for; a device's range is expanded, not joined by comparison."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device"), F.greatest(F.floor((F.col("s_acctbal") - 1000) / 700), F.lit(0)).alias("room"))
    b = c.withColumn("start", F.sum("room").over(Window.orderBy("device")) - F.col("room")).where("room > 0 and start < 200")  # devices are few
    return b.select("device", F.explode(F.sequence("start", F.least(F.col("start") + F.col("room"), F.lit(200)) - 1)).alias("layer")).select("layer", "device")


def shard_sizes(n: int, shards: int, lighter: int = 0) -> list[int]:
    """N items over shards, the last one with lighter fewer than an even share; what is left over goes to the first."""
    last = n // shards - lighter if shards > 1 else n
    base, more = divmod(n - last, max(shards - 1, 1))
    sizes = [base + (i < more) for i in range(shards - 1)] + [last]
    if min(sizes) < 0 or sum(sizes) != n:
        raise ValueError(f"cannot cut {n} into {shards}")
    return sizes


@query("""WITH n AS (SELECT count(*) AS n FROM part), s AS (SELECT i AS shard, CASE WHEN i = 6 THEN n // 7 - 3 ELSE (n - (n // 7 - 3)) // 6 + CASE WHEN i < (n - (n // 7 - 3)) % 6 THEN 1 ELSE 0 END END AS size FROM range(7) r(i), n)
SELECT shard, size, (sum(size) OVER (ORDER BY shard) - size)::BIGINT AS start, shard * 3 // 7 AS device FROM s""")
def shard_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and starts of seven shards, and an even placement on three devices."""
    n = table(spark, sf_dir, "part").count()
    sizes = shard_sizes(n, 7, 3)
    s = spark.createDataFrame([(i, v) for i, v in enumerate(sizes)], "shard long, size long")
    return s.select("shard", "size", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("start"), F.expr("least(shard * 3 div 7, 2)").alias("device"))


BUDGET = 100


def greedy_fill(items: DataFrame, group: str, budget: int) -> DataFrame:
    """Items of each group, largest first, taken while they fit; one that doesn't fit is skipped, later ones may. items: group, id, size.

    The choice is sequential by nature; each group's (size, id) pairs are
    folded in one row, so a group must be a list that a task can hold.
    """
    lists = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "id"))).alias("l"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("took"))
    step = lambda a, x: F.when(-x["k"] <= a["left"], F.struct((a["left"] + x["k"]).alias("left"), F.concat(a["took"], F.array(x["id"])).alias("took"))).otherwise(a)
    return lists.select(group, F.aggregate("l", start, step).alias("r")).select(group, F.col("r.left").alias("left"), F.explode("r.took").alias("id"))


@query(f"""WITH RECURSIVE p AS (SELECT p_brand AS brand, p_partkey AS id, p_size::BIGINT AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS i FROM part),
r(brand, i, room, took, id) AS (SELECT DISTINCT brand, 0::BIGINT, {BUDGET}::BIGINT, false, NULL::BIGINT FROM p UNION ALL SELECT r.brand, p.i, CASE WHEN p.size <= r.room THEN r.room - p.size ELSE r.room END, p.size <= r.room, p.id FROM r JOIN p ON p.brand = r.brand AND p.i = r.i + 1)
SELECT r.brand, r.id, min(r2.room) AS left FROM r JOIN r r2 ON r2.brand = r.brand WHERE r.took GROUP BY 1, 2""".replace("AS left FROM", 'AS "left" FROM'))
def greedy_fill_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11."""
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    return greedy_fill(items, "brand", BUDGET)


@query("SELECT p_partkey // 64 AS chunk, count(*) AS experts, count(l.n) AS used, coalesce(sum(l.n), 0)::BIGINT AS hits FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_partkey = p_partkey GROUP BY 1")
def expert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts in chunks of 64 with the hits that each chunk's pass would serve."""
    hits = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, sf_dir, "part").select("p_partkey").join(hits, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy(F.expr("p_partkey div 64").alias("chunk")).agg(F.count(F.lit(1)).alias("experts"), F.count("n").alias("used"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
