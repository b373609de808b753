"""Ranks over whole tables and exact percentiles, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.plans import storage


def global_index(df: DataFrame, order: list[str | Column], name: str = "index") -> DataFrame:
    """df with each row's place (from 0) in the given order.

    Rows are dealt by ranges, numbered within each range, and shifted by the
    sizes of the ranges before; a hot key spreads over ranges where the order
    has more columns.  Only the ranges' sizes meet in one task.
    """
    spread = storage.written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return spread.withColumn("_own", own).join(before, "_range").withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_range", "_own", "_before")


#: A key with more rows than this is spread over tasks by lags().
HOT_KEY_ROWS = 2_000_000
BUCKET_ROWS = 1 << 20


def hottest(df: DataFrame, key: str) -> int:
    """Rows of the most common key."""
    return df.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def lags(df: DataFrame, key: str, order: list[str], column: str, n: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with _pos (each row's place in its key, from 0) and _lag1 to _lagn (column so many rows before, within the key), whatever the skew.

    Rows are numbered over the whole table and cut into buckets of equal size;
    each bucket also gets the last n rows of the one before it.  So no window
    holds more than a bucket, and a hot key spans buckets.
    """
    placed = storage.written(global_index(df, [key, *order], "_i"), "placed")
    starts = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_i").alias("_start"))
    b = F.expr(f"_i div {bucket_rows}")
    own = F.when(F.col("_i") % bucket_rows >= bucket_rows - n, F.array(b, b + 1)).otherwise(F.array(b))
    w = Window.partitionBy("_b").orderBy("_i")
    out = placed.withColumn("_b", F.explode(own))
    for k in range(1, n + 1):
        back = F.lag(F.struct(F.col(key).alias("k"), F.col(column).alias("v")), k).over(w)
        out = out.withColumn(f"_lag{k}", back).withColumn(f"_lag{k}", F.when(F.col(f"_lag{k}.k").eqNullSafe(F.col(key)) & F.col(f"_lag{k}").isNotNull(), F.col(f"_lag{k}.v")))
    out = out.where(F.col("_b") == b)
    return out.join(starts, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_pos", F.col("_i") - F.col("_start")).drop("_i", "_b", "_key", "_start")


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, n and the values at index min(int(n * share), n - 1) of each group's sorted values (from 0).

    Approximate percentiles bracket each wanted value; one pass counts what
    lies below the bracket, and only rows within it are sorted.  No group is
    gathered in one task.
    """
    slack = 0.005
    bounds = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.percentile_approx(value, [max(0.0, s - slack), min(1.0, s + slack)], 2000).alias(f"_b{i}") for i, s in enumerate(shares.values())),
    )
    want = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * s), F.col("n") - 1).alias("at"), F.when(F.lit(s <= slack), F.lit(None)).otherwise(F.col(f"_b{i}")[0]).alias("lo"), F.when(F.lit(s >= 1 - slack), F.lit(None)).otherwise(F.col(f"_b{i}")[1]).alias("hi")) for i, (name, s) in enumerate(shares.items()))))
    wanted = storage.written(bounds.select(group, "n", want.alias("w")).select(group, "n", "w.*"), "bounds")
    met = df.where(F.col(value).isNotNull()).select(group, value).join(F.broadcast(wanted) if storage.small_enough(wanted, 100_000) else wanted, group)
    under = F.col("lo").isNotNull() & (F.col(value) < F.col("lo"))
    inside = ~under & (F.col("hi").isNull() | (F.col(value) <= F.col("hi")))
    below = met.groupBy(group, "name").agg(F.count(F.when(under, 1)).alias("below"))
    held = met.where(inside).groupBy(group, "name", "at", value).agg(F.count(F.lit(1)).alias("times"))
    up_to = F.sum("times").over(Window.partitionBy(group, "name").orderBy(value))
    found = held.withColumn("up_to", up_to).join(below, [group, "name"]).where((F.col("below") + F.col("up_to") > F.col("at")) & (F.col("below") + F.col("up_to") - F.col("times") <= F.col("at")))
    sizes = wanted.groupBy(group).agg(F.max("n").alias("n"))
    out = found.groupBy(group).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in shares))
    return sizes.join(out, group)


def zero_filled(counts: DataFrame, domain: DataFrame, on: list[str], value: str) -> DataFrame:
    """domain with value from counts, 0 where a key has none."""
    return domain.join(counts, on, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))
