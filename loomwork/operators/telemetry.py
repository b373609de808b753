"""Routing telemetry: mass, coverage, divergence, rollups, latencies, traces (survey 2.4, J12-J14, T7, T16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.plans import ranks
from loomwork.registry import query
from loomwork.session import table

NS = [8, 16, 32, 64]


def facts(events: DataFrame) -> DataFrame:
    """events as routing facts: task, expert, weight."""
    return events.select(F.col("event_type").alias("task"), F.col("user_id").alias("expert"), F.abs("value").alias("weight"))


def mass(routed: DataFrame) -> DataFrame:
    """A4: mass and hits of each task and expert."""
    return routed.groupBy("task", "expert").agg(F.sum("weight").alias("mass"), F.count(F.lit(1)).alias("hits"))


def top(m: DataFrame, n: int) -> DataFrame:
    """Each task's n largest experts with their rank rk, ties by id; every task of the cluster keeps its own n first, so nothing is ranked whole."""
    return m.withColumn("rk", F.row_number().over(Window.partitionBy("task").orderBy(F.round("mass", 6).desc(), "expert"))).where(F.col("rk") <= n)


def totals(m: DataFrame) -> DataFrame:
    """task, total, experts."""
    return m.groupBy("task").agg(F.sum("mass").alias("total"), F.count(F.lit(1)).alias("experts"))


def coverage(m: DataFrame, ns: list[int]) -> DataFrame:
    """A5: share of a task's mass in its n largest experts."""
    r = top(m, max(ns)).withColumn("n", F.explode(F.array(*(F.lit(n).cast("long") for n in ns))))
    held = r.groupBy("task", "n").agg(F.sum(F.when(F.col("rk") <= F.col("n"), F.col("mass")).otherwise(0.0)).alias("held"))
    return held.join(totals(m), "task").select("task", "n", F.round(F.col("held") / F.col("total"), 6).alias("coverage"), "experts")


_MASS = "SELECT event_type AS task, user_id AS expert, sum(abs(value)) AS mass, count(*) AS hits FROM events GROUP BY 1, 2"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(mass, 6) DESC, expert) AS rk, sum(mass) OVER (PARTITION BY task) AS total FROM ({_MASS})"


@query(f"SELECT task, n::BIGINT AS n, round(sum(CASE WHEN rk <= n THEN mass ELSE 0 END) / max(total), 6) AS coverage, count(*) AS experts FROM ({_RANKED}), (VALUES (8), (16), (32), (64)) t(n) GROUP BY task, n")
def telemetry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship."""
    return coverage(mass(facts(table(spark, sf_dir, "events"))), NS)


def cross_coverage(m: DataFrame, n: int) -> DataFrame:
    """Share of task u's mass on the n largest experts of task t; a left join on the expert, never task by task loops."""
    best = top(m, n).select(F.col("task").alias("t"), "expert")
    shared = best.join(m.select(F.col("task").alias("u"), "expert", "mass"), "expert").groupBy("t", "u").agg(F.sum("mass").alias("held"))
    return shared.join(totals(m).withColumnRenamed("task", "u"), "u").select("t", "u", F.round(F.col("held") / F.col("total"), 6).alias("coverage"))


@query(f"WITH m AS ({_MASS}), r AS ({_RANKED}), w AS (SELECT task AS u, sum(mass) AS total FROM m GROUP BY 1) SELECT r.task AS t, m.task AS u, round(sum(m.mass) / max(w.total), 6) AS coverage FROM r JOIN m ON r.expert = m.expert JOIN w ON w.u = m.task WHERE r.rk <= 80 GROUP BY 1, 2")
def telemetry_cross_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 J13."""
    return cross_coverage(mass(facts(table(spark, sf_dir, "events"))), 80)


def js_divergence(m: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits of all pairs of tasks, shares floored at 1e-12.

    Per expert the tasks' shares lie in one map, so pairs of tasks (a small
    square) are formed within a row and experts are never joined to each other.
    """
    p = m.join(totals(m), "task").withColumn("p", F.col("mass") / F.col("total"))
    tasks = p.select(F.lit(0).alias("one"), "task").groupBy("one").agg(F.array_sort(F.collect_set("task")).alias("tasks")).drop("one")
    rows = p.groupBy("expert").agg(F.map_from_entries(F.collect_list(F.struct("task", "p"))).alias("shares")).crossJoin(F.broadcast(tasks))
    share = lambda t: F.greatest(F.coalesce(F.col("shares")[t], F.lit(0.0)), F.lit(1e-12))
    pairs = rows.withColumn("t", F.explode("tasks")).withColumn("u", F.explode("tasks")).select("t", "u", share(F.col("t")).alias("a"), share(F.col("u")).alias("b"))
    mid = (F.col("a") + F.col("b")) / 2
    return pairs.groupBy("t", "u").agg(F.round(F.sum(F.col("a") * F.log(F.col("a") / mid) + F.col("b") * F.log(F.col("b") / mid)) / (2 * F.log(F.lit(2.0))), 6).alias("js"))


@query(f"""WITH m AS ({_MASS}), p AS (SELECT task, expert, mass / sum(mass) OVER (PARTITION BY task) AS p FROM m),
d AS (SELECT t.task, e.expert, greatest(coalesce(p.p, 0), 1e-12) AS p FROM (SELECT DISTINCT task FROM m) t CROSS JOIN (SELECT DISTINCT expert FROM m) e LEFT JOIN p ON p.task = t.task AND p.expert = e.expert)
SELECT a.task AS t, b.task AS u, round(sum(a.p * ln(a.p / ((a.p + b.p) / 2)) + b.p * ln(b.p / ((a.p + b.p) / 2))) / (2 * ln(2.0)), 6) AS js FROM d a JOIN d b ON a.expert = b.expert GROUP BY 1, 2""")
def telemetry_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 J13."""
    return js_divergence(mass(facts(table(spark, sf_dir, "events"))))


@query("""WITH d AS (SELECT l_linenumber AS layer, least(l_partkey * 4 // (SELECT max(p_partkey) + 1 FROM part), 3) AS shard, count(DISTINCT l_partkey) AS experts FROM lineitem GROUP BY 1, 2)
SELECT (SELECT round(avg(n), 6) FROM (SELECT layer, sum(experts) AS n FROM d GROUP BY 1)) AS mean_experts, (SELECT round(max(m), 6) FROM (SELECT shard, avg(experts) AS m FROM d GROUP BY 1)) AS busiest_shard""")
def telemetry_unique_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct experts a layer, and the busiest range shard's mean."""
    bound = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("bound"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("layer"), "l_partkey").distinct().crossJoin(F.broadcast(bound))
    d = rows.groupBy("layer", F.least(F.expr("l_partkey * 4 div bound"), F.lit(3)).alias("shard")).agg(F.count(F.lit(1)).alias("experts"))
    layers = d.groupBy("layer").agg(F.sum("experts").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_experts"))
    shards = d.groupBy("shard").agg(F.avg("experts").alias("m")).agg(F.round(F.max("m"), 6).alias("busiest_shard"))
    return layers.crossJoin(F.broadcast(shards))


@query("SELECT p_partkey AS expert, count(l_partkey) AS hits FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def telemetry_hist_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: hits of every expert, 0 included; counted before the join."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("expert")).agg(F.count(F.lit(1)).alias("hits"))
    return ranks.zero_filled(counts, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expert")), ["expert"], "hits")


@query("""WITH k AS (SELECT event_type AS device, user_id AS kernel, round(sum(value), 6) AS total, count(*) AS calls FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY total DESC, kernel) AS rk, sum(total) OVER (PARTITION BY device) AS whole FROM k)
SELECT device, kernel, total, calls, rk, round(total / calls, 6) AS per_call, round(100 * total / whole, 6) AS percent FROM r WHERE rk <= 22""")
def kernel_rollup_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 kernels that take most of each device's time, with percent of its total."""
    k = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("device"), F.col("user_id").alias("kernel")).agg(F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("calls"))
    best = k.withColumn("rk", F.row_number().over(Window.partitionBy("device").orderBy(F.col("total").desc(), "kernel"))).where("rk <= 22").withColumn("rk", F.col("rk").cast("long"))
    r = best.join(k.groupBy("device").agg(F.sum("total").alias("whole")), "device")
    return r.select("device", "kernel", "total", "calls", "rk", F.round(F.col("total") / F.col("calls"), 6).alias("per_call"), F.round(100 * F.col("total") / F.col("whole"), 6).alias("percent"))


@query("""WITH r AS (SELECT o_orderpriority AS stage, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT stage, max(n) AS n, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN v END) AS median, max(CASE WHEN i = least(floor(n * 0.9), n - 1) THEN v END) AS p90,
max(CASE WHEN i = least(floor(n * 0.99), n - 1) THEN v END) AS p99, max(CASE WHEN i = n - 1 THEN v END) AS top FROM r GROUP BY stage""")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of each stage."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("v"))
    return ranks.nearest_rank(rows, "stage", "v", {"median": 0.5, "p90": 0.9, "p99": 0.99, "top": 1.0})


@query("""WITH g AS (SELECT user_id AS peer, event_type AS stage, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events),
p AS (SELECT stage, peer, avg(gap) AS m FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT stage, count(*) AS peers, round(max(m) / 1e6, 6) AS slowest, round(avg(m) / 1e6, 6) AS mean FROM p GROUP BY stage""")
def timeline_stage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the peer's last event by stage; the slowest peer's mean and the peers' mean, in seconds."""
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = table(spark, sf_dir, "events").withColumn("last", last).where("last is not null").select(F.col("user_id").alias("peer"), F.col("event_type").alias("stage"), F.expr("timestampdiff(MICROSECOND, last, ts)").alias("gap"))
    p = g.groupBy("stage", "peer").agg(F.avg("gap").alias("m"))
    return p.groupBy("stage").agg(F.count(F.lit(1)).alias("peers"), F.round(F.max("m") / 1e6, 6).alias("slowest"), F.round(F.avg("m") / 1e6, 6).alias("mean"))


def outermost(kernels: DataFrame, ops: DataFrame, on: str) -> DataFrame:
    """Each kernel event with the earliest op of its key, "?" where there is none; ops are reduced before the join."""
    first = ops.groupBy(on).agg(F.min_by("op", F.struct("ts", "event_id")).alias("op"))
    return kernels.join(first, on, "left").withColumn("op", F.coalesce("op", F.lit("?")))


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), o AS (SELECT k, arg_min(user_id, (ts, event_id)) AS op FROM e WHERE event_type = 'signup' GROUP BY k),
c AS (SELECT e.event_id, e.k, e.ts, coalesce(CAST(o.op AS VARCHAR), '?') AS op FROM e LEFT JOIN o ON e.k = o.k WHERE e.event_type = 'click')
SELECT event_id, k, op, date_diff('microsecond', min(ts) OVER (PARTITION BY op), ts) AS since FROM c""")
def trace_op_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel events with their outermost op, times rebased to the op's first event."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    ops = e.where("event_type = 'signup'").select("k", "ts", "event_id", F.col("user_id").cast("string").alias("op"))
    c = outermost(e.where("event_type = 'click'").select("event_id", "k", "ts"), ops, "k")
    start = c.groupBy("op").agg(F.min("ts").alias("start"))
    return c.join(start, "op").select("event_id", "k", "op", F.expr("timestampdiff(MICROSECOND, start, ts)").alias("since"))


@query("SELECT l_linenumber::BIGINT AS step, count(DISTINCT l_returnflag) = 1 AS same, count(DISTINCT l_returnflag) AS ord FROM lineitem GROUP BY 1")
def all_equal_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31 ST12: whether all rows of a step agree."""
    kinds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("step")).agg(F.count_distinct("l_returnflag").alias("ord"))
    return kinds.select("step", (F.col("ord") == 1).alias("same"), "ord")


@query("SELECT count(*) AS n, round(max(abs(a.v - b.v)), 6) AS max_abs, round(max(abs(a.v - b.v)) / max(abs(b.v)), 6) AS max_rel, round(sqrt(sum((a.v - b.v) * (a.v - b.v)) / sum(b.v * b.v)), 6) AS norm FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v FROM lineitem) a JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS v FROM lineitem) b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors between two results that are joined by step."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem")
    return compare(rows.select(*keys, F.col("l_extendedprice").alias("v")), rows.select(*keys, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")), keys, "v")


def compare(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Largest absolute and relative error and the relative norm of the difference of a against b."""
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    d = F.col("_a") - F.col("_b")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(d)), 6).alias("max_abs"), F.round(F.max(F.abs(d)) / F.max(F.abs("_b")), 6).alias("max_rel"), F.round(F.sqrt(F.sum(d * d) / F.sum(F.col("_b") * F.col("_b"))), 6).alias("norm"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 6) AS seconds, round(count(*) / greatest(sum(value), 1e-9), 6) AS per_second, round(avg(CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM events GROUP BY 1")
def throughput_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded ratios and a hit rate."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("seconds"), F.round(F.count(F.lit(1)) / F.greatest(F.sum("value"), F.lit(1e-9)), 6).alias("per_second"), F.round(F.avg(F.when(F.col("user_id") % 7 == 0, 1.0).otherwise(0.0)), 6).alias("hit_rate")
    )
