"""Lookups by index, assembly, sharded products, rings and odds and ends (survey J3, J4, J11, P9, P16, U2-U4, A35, H6, S30, S31, ST8, K5-K16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions import vectors
from loomwork.operators import routing
from loomwork.plans import storage
from loomwork.registry import query
from loomwork.session import table


def gather(picks: DataFrame, rows: DataFrame) -> DataFrame:
    """Q, slot, id, value for each pick (q, ids) and slot; a null or negative id is an empty slot with value 0, and joins nothing."""
    one = picks.select("q", F.posexplode("ids").alias("slot", "id")).withColumn("id", F.when(F.col("id") >= 0, F.col("id")))
    return one.join(rows, "id", "left").select("q", F.col("slot").cast("long").alias("slot"), "id", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("""WITH p AS (SELECT o_orderkey AS q, unnest([o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey + 1 END, NULL]) AS id, generate_subscripts([1, 2, 3], 1) - 1 AS slot FROM orders)
SELECT p.q, p.slot, CASE WHEN p.id >= 0 THEN p.id END AS id, coalesce(c.c_acctbal, 0) AS value FROM p LEFT JOIN customer c ON c.c_custkey = p.id""")
def gather_empty_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows picked by index lists with empty slots."""
    ids = F.array(F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey") + 1), F.lit(None).cast("long"))
    return gather(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), ids.alias("ids")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")))


@query("""WITH m AS (SELECT user_id % 37 AS key, min((ts, event_id)) AS seen FROM events GROUP BY 1), d AS (SELECT key, row_number() OVER (ORDER BY seen) - 1 AS id FROM m)
SELECT d.id, d.key, count(*) AS uses, count(DISTINCT e.user_id) AS tokens FROM events e JOIN d ON d.key = e.user_id % 37 GROUP BY 1, 2""")
def token_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens mapped to compressed ids in first-seen order; the map is small and checked."""
    e = table(spark, sf_dir, "events").withColumn("key", F.col("user_id") % 37)
    m = e.groupBy("key").agg(F.min(F.struct("ts", "event_id")).alias("seen"))
    d = m.select("key", (F.row_number().over(Window.orderBy("seen")) - 1).cast("long").alias("id"))  # one row a key, 37 at most
    d = F.broadcast(d) if storage.small_enough(d, 100_000) else d
    return e.join(d, "key").groupBy("id", "key").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("user_id").alias("tokens"))


@query("""WITH a AS (SELECT vec_id // 2 AS expert, embedding::DOUBLE[] AS w1 FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id // 2 AS expert, embedding::DOUBLE[] AS w3 FROM embeddings WHERE vec_id % 2 = 1)
SELECT a.expert, len(list_concat(w1, w3)) AS rows_, round(list_sum(list_concat(w1, w3)), 6) AS total, round(list_concat(w1, w3)[70], 6) AS x69 FROM a JOIN b ON a.expert = b.expert""")
def expert_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of each expert put together."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 2").alias("expert"), vectors.doubles(F.col("embedding")).alias("w"))
    half = lambda k, name: v.where(F.col("vec_id") % 2 == k).select("expert", F.col("w").alias(name))
    w = half(0, "w1").join(half(1, "w3"), "expert").select("expert", F.concat("w1", "w3").alias("w"))
    return w.select("expert", F.size("w").cast("long").alias("rows_"), F.round(vectors.total(F.col("w")), 6).alias("total"), F.round(F.col("w")[69], 6).alias("x69"))


def _sharded_sql() -> str:
    return f"""WITH g AS (SELECT * FROM {routing._gate_sql('0.0')}), x AS (SELECT vec_id, list_sum(embedding::DOUBLE[]) AS s FROM embeddings), p AS (SELECT g.tok, least(g.expert * 4 // {routing.EXPERTS}, 3) AS shard, sum(g.weight * x.s) AS part FROM g JOIN x ON x.vec_id = g.expert GROUP BY 1, 2)
SELECT tok, count(*) AS shards, round(sum(part), 6) AS total, round(max(part), 6) AS largest FROM p GROUP BY 1"""


@query(_sharded_sql())
def expert_shard_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each range shard of experts sums its own pairs; tokens sum the shards.

    Pairs are routed without a shuffle, so a task adds up all shards' parts of
    a token before anything moves.
    """
    tok, experts = routing._split(spark, sf_dir, F.lit(0.0))
    pairs = routing.gate(tok, experts, routing.TOP, scale=routing.SCALE)
    own = experts.select(F.col("id").alias("expert"), vectors.total(vectors.doubles(F.col("vector"))).alias("s"))
    p = pairs.join(own, "expert").groupBy("tok", F.least(F.expr(f"expert * 4 div {routing.EXPERTS}"), F.lit(3)).alias("shard")).agg(F.sum(F.col("weight") * F.col("s")).alias("part"))
    return p.groupBy("tok").agg(F.count(F.lit(1)).alias("shards"), F.round(F.sum("part"), 6).alias("total"), F.round(F.max("part"), 6).alias("largest"))


@query("""WITH n AS (SELECT vec_id, label::BIGINT AS seq, [v / sqrt(list_sum([u * u for u in x]) / len(x) + 1e-6) for v in x] AS y FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)), p AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY seq) AS n FROM n)
SELECT seq, pos % 8 AS slot, pos, vec_id, round(list_sum(y), 6) AS total FROM p WHERE pos >= n - 8""")
def ring_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12 K13 ST2: normalised rows written to a ring of 8 slots a sequence; what each slot holds at the end."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("seq"), vectors.rms_norm(vectors.doubles(F.col("embedding"))).alias("y"))
    p = v.withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("vec_id")).cast("long") - 1)
    last = p.groupBy("seq", F.pmod("pos", F.lit(8)).alias("slot")).agg(F.max_by(F.struct("pos", "vec_id", "y"), "pos").alias("r"))
    return last.select("seq", "slot", "r.pos", "r.vec_id", F.round(vectors.total(F.col("r.y")), 6).alias("total"))


@query("""WITH o AS (SELECT o_custkey % 200 AS seq, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS pos FROM orders), g AS (SELECT seq, pos // 8 AS grp, count(*) AS n FROM o GROUP BY 1, 2)
SELECT seq, count(*) FILTER (WHERE n = 8) AS complete, sum(CASE WHEN n < 8 THEN n ELSE 0 END)::BIGINT AS waiting FROM g GROUP BY 1""")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16 ST3: groups of eight that are complete, and rows that wait; incomplete ones are filtered, no dummy rows."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("seq"), "o_orderkey")
    n = o.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))  # places follow from counts: no order is needed
    return n.select("seq", F.expr("n div 8").alias("complete"), F.expr("n % 8").alias("waiting"))


@query("SELECT o_orderpriority AS bench, max(per) AS best, count(*) AS runs FROM (SELECT o_orderpriority, o_custkey % 5 AS run, round(sum(o_totalprice) / count(*), 4) AS per FROM orders GROUP BY 1, 2) GROUP BY 1")
def best_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several runs of each benchmark."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bench"), (F.col("o_custkey") % 5).alias("run")).agg(F.round(F.sum("o_totalprice") / F.count(F.lit(1)), 4).alias("per"))
    return runs.groupBy("bench").agg(F.max("per").alias("best"), F.count(F.lit(1)).alias("runs"))


def by_node(experts: DataFrame, nodes: int) -> DataFrame:
    """Experts dealt by ranges to nodes."""
    return experts.repartitionByRange(nodes, "expert").withColumn("node", F.spark_partition_id())


def load_by_node(experts: DataFrame, nodes: int) -> DataFrame:
    """by_node(), kept in memory there until the caller's unpersist()."""
    return by_node(experts, nodes).persist()


@query("SELECT count(*) AS experts, least(count(DISTINCT p_partkey), 4) AS nodes, round(sum(p_retailprice), 4) AS price, min(p_partkey) AS lo, max(p_partkey) AS hi, count(*) - count(DISTINCT p_partkey) AS overlaps FROM part")
def node_partitioned_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expert is loaded once, and nodes hold ascending ranges that don't overlap."""
    held = by_node(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expert"), "p_retailprice"), 4)
    n = held.groupBy("node").agg(F.min("expert").alias("lo"), F.max("expert").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("price"))
    before = F.lag("hi").over(Window.orderBy("node"))  # a row for each node
    return n.withColumn("over", F.coalesce(before, F.col("lo") - 1) >= F.col("lo")).agg(F.sum("n").alias("experts"), F.count(F.lit(1)).alias("nodes"), F.round(F.sum("price"), 4).alias("price"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("over").cast("long")).alias("overlaps"))


@query()
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random request id for each conversation; not reproducible by nature."""
    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return convs.select("conv_id", F.concat(F.lit("cmpl-"), F.left(F.regexp_replace(F.uuid(), "-", ""), F.lit(24))).alias("id"))


def epochs(stream: DataFrame, path: str) -> None:
    """ST8: each micro-batch written under its own number once all its rows are there; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("epoch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()


@query("SELECT 0::BIGINT AS epoch, count(*) AS rows_, count(DISTINCT user_id) AS seqs FROM events")
def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8 ST10: the batch number as a barrier; one file is one epoch."""
    from loomwork.streaming.state import event_stream

    path = storage.new_path(spark, "epochs")
    epochs(event_stream(spark, sf_dir), path)
    rows = spark.read.parquet(f"{path}/batch=*")
    return rows.groupBy("epoch").agg(F.count(F.lit(1)).alias("rows_"), F.count_distinct("user_id").alias("seqs"))
