"""Sampling, speculation, decay and visibility over sequences (survey W4, W12-W14, T8, A26, J18, ST5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.plans import storage
from loomwork.registry import query
from loomwork.session import TOKENS_SQL, numbers, table, tokens

TOP_P, BLOCK, DECAY = 0.7, 5, 0.97


def nucleus(rows: DataFrame, key: str, item: str, p: str, top_p: float) -> DataFrame:
    """Items of each key, most probable first, while the mass before them is under top_p."""
    w = Window.partitionBy(key).orderBy(F.col(p).desc(), item)
    before = F.round(F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(p), 6)
    return rows.withColumn("before", before).withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("before") < top_p)


@query(f"""WITH m AS (SELECT event_type AS task, user_id AS item, sum(value) AS m FROM events GROUP BY 1, 2), p AS (SELECT task, item, round(m / sum(m) OVER (PARTITION BY task), 9) AS p FROM m),
c AS (SELECT *, round(sum(p) OVER w - p, 6) AS before, row_number() OVER w AS rk FROM p WINDOW w AS (PARTITION BY task ORDER BY p DESC, item ROWS UNBOUNDED PRECEDING)) SELECT task, item, round(p, 6) AS p, before, rk FROM c WHERE before < {TOP_P}""")
def top_p_nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 T8."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), F.col("user_id").alias("item")).agg(F.sum("value").alias("m"))
    p = m.select("task", "item", F.round(F.col("m") / F.sum("m").over(Window.partitionBy("task")), 9).alias("p"))
    return nucleus(p, "task", "item", "p", TOP_P).select("task", "item", F.round("p", 6).alias("p"), "before", "rk")


def bigram_best(rows: DataFrame) -> DataFrame:
    """tok, nxt: the most frequent successor of each token, the lowest id among equals."""
    nxt = F.lead("tok").over(Window.partitionBy("seq").orderBy("pos"))
    counts = rows.withColumn("nxt", nxt).where("nxt is not null").groupBy("tok", "nxt").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("tok").agg(F.max_by("nxt", F.struct(F.col("n"), -F.col("nxt"))).alias("nxt"))


_BEST = f"""t AS {TOKENS_SQL}, n AS (SELECT tok, lead(tok) OVER (PARTITION BY seq ORDER BY pos) AS nxt FROM t), c AS (SELECT tok, nxt, count(*) AS n FROM n WHERE nxt IS NOT NULL GROUP BY 1, 2),
b AS (SELECT tok, arg_max(nxt, (n, -nxt)) AS nxt FROM c GROUP BY 1)"""


def accepted(rows: DataFrame, guess: DataFrame, block: int) -> DataFrame:
    """Seq, pos, acc: how many of block drafted tokens (the guess, chained) are what follows; positions with a short tail are left out."""
    w = Window.partitionBy("seq").orderBy("pos")
    actual = rows.select("seq", "pos", "tok", *(F.lead("tok", i).over(w).alias(f"a{i}") for i in range(1, block + 1))).where(f"a{block} is not null")
    chain = guess.select(F.col("tok").alias("_t0"), F.col("nxt").alias("d1"))
    for i in range(2, block + 1):
        chain = chain.join(guess.select(F.col("tok").alias(f"d{i - 1}"), F.col("nxt").alias(f"d{i}")), f"d{i - 1}")
    both = actual.join(chain.withColumnRenamed("_t0", "tok"), "tok")
    acc = F.lit(0)
    for i in range(block, 0, -1):
        acc = F.when(F.col(f"a{i}") == F.col(f"d{i}"), acc + 1).otherwise(F.lit(0))
    return both.select("seq", "pos", acc.cast("long").alias("acc"))


@query(f"""WITH {_BEST}, a AS (SELECT tok, {', '.join(f'lead(tok, {i}) OVER w AS a{i}' for i in range(1, BLOCK + 1))} FROM t WINDOW w AS (PARTITION BY seq ORDER BY pos)),
d AS (SELECT b1.tok, b1.nxt AS d1, b2.nxt AS d2, b3.nxt AS d3, b4.nxt AS d4, b5.nxt AS d5 FROM b b1 JOIN b b2 ON b2.tok = b1.nxt JOIN b b3 ON b3.tok = b2.nxt JOIN b b4 ON b4.tok = b3.nxt JOIN b b5 ON b5.tok = b4.nxt),
h AS (SELECT CASE WHEN a1 <> d1 THEN 0 WHEN a2 <> d2 THEN 1 WHEN a3 <> d3 THEN 2 WHEN a4 <> d4 THEN 3 WHEN a5 <> d5 THEN 4 ELSE 5 END AS acc FROM a JOIN d ON d.tok = a.tok WHERE a5 IS NOT NULL)
SELECT r.acc, (SELECT count(*) FROM h WHERE h.acc = r.acc) AS n, (SELECT round(avg(CASE WHEN h.acc >= r.acc THEN 1.0 ELSE 0.0 END), 6) FROM h) AS reached, (SELECT round(avg(h.acc), 6) FROM h) AS mean FROM range(6) r(acc)""")
def spec_accept_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18 A26 A29 W14 ST5: histogram of accepted prefixes, zero-filled, with the share that got at least so far and the mean."""
    rows = tokens(spark, sf_dir)
    counts = accepted(rows, storage.written(bigram_best(rows), "bigrams"), BLOCK).groupBy("acc").agg(F.count(F.lit(1)).alias("n"))
    full = numbers(spark, list(range(BLOCK + 1)), "acc").join(F.broadcast(counts), "acc", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    every = Window.orderBy(F.col("acc").desc())  # six rows
    whole = Window.partitionBy()
    return full.select("acc", "n", F.round(F.sum("n").over(every) / F.sum("n").over(whole), 6).alias("reached"), F.round(F.sum(F.col("acc") * F.col("n")).over(whole) / F.sum("n").over(whole), 6).alias("mean"))


@query(f"WITH RECURSIVE {_BEST}, r(start, step, tok) AS (SELECT tok, 0::BIGINT, tok FROM b UNION ALL SELECT r.start, r.step + 1, b.nxt FROM r JOIN b ON b.tok = r.tok WHERE r.step < 5) SELECT start, step, tok FROM r")
def spec_markov_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five draft steps from every token, each depending on the one before."""
    best = storage.written(bigram_best(tokens(spark, sf_dir)), "bigrams")
    now = best.select(F.col("tok").alias("start"), F.lit(0).cast("long").alias("step"), "tok")
    out = now
    for k in range(1, 6):
        now = now.join(best, "tok").select("start", F.lit(k).cast("long").alias("step"), F.col("nxt").alias("tok"))
        out = out.unionByName(now)
    return out


@query(f"""WITH t AS {TOKENS_SQL}, v AS (SELECT seq, pos - pos % 3 AS slot, pos AS ver, tok FROM t), l AS (SELECT seq, (max(pos) * 2) // 3 AS plim FROM t GROUP BY 1)
SELECT v.seq, v.slot, max(v.ver) AS ver, arg_max(v.tok, v.ver) AS tok FROM v JOIN l ON l.seq = v.seq AND v.ver <= l.plim GROUP BY 1, 2""")
def spec_visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 W3: of each slot's versions the last one at or before the sequence's limit; rejected rows behind it stay stored but unseen."""
    t = tokens(spark, sf_dir)
    plim = F.expr("(max(pos) over (partition by seq) * 2) div 3")
    v = t.select("seq", (F.col("pos") - F.pmod("pos", F.lit(3))).alias("slot"), F.col("pos").alias("ver"), "tok", "pos").withColumn("plim", plim).where("ver <= plim")
    return v.groupBy("seq", "slot").agg(F.max("ver").alias("ver"), F.max_by("tok", "ver").alias("tok"))


@query(f"WITH t AS {TOKENS_SQL}, m AS (SELECT seq, tok, max(pos) OVER (PARTITION BY seq) - pos AS age FROM t) SELECT seq, tok, count(*) AS uses, round(sum(power({DECAY}, age)), 6) AS usage FROM m GROUP BY 1, 2")
def ema_usage_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed usage in closed form."""
    age = F.max("pos").over(Window.partitionBy("seq")) - F.col("pos")
    return tokens(spark, sf_dir).select("seq", "tok", age.alias("age")).groupBy("seq", "tok").agg(F.count(F.lit(1)).alias("uses"), F.round(F.sum(F.pow(F.lit(DECAY), "age")), 6).alias("usage"))
