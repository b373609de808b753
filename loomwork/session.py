"""Session settings and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Settings that suit all queries at any size; the cluster's own values win where they are set.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS and the given ones ("_" stands for ".")."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbers(spark: SparkSession, values: list[int], name: str) -> DataFrame:
    """A small table of literal numbers."""
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


#: The event types' token ids.
TOKEN_IDS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tokens of sequences: seq, tok, value, event_id, ts."""
    tok = F.create_map(*(F.lit(x) for kv in TOKEN_IDS.items() for x in kv))[F.col("event_type")].cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), tok.alias("tok"), "value", "event_id", "ts")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coded() with pos, from 0 by ts and event_id.

    A sequence is one window's partition, or, where one is too long for a task,
    places come from ranges over all rows.
    """
    from loomwork.plans import ranks

    rows = coded(spark, sf_dir)
    if ranks.hottest(rows, "seq") <= ranks.HOT_KEY_ROWS:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("ts", "event_id")).cast("long") - 1)
    placed = ranks.global_index(rows, ["seq", "ts", "event_id"], "_place")
    first = placed.groupBy(F.col("seq").alias("_seq")).agg(F.min("_place").alias("_first"))
    return placed.join(first, F.col("seq").eqNullSafe(F.col("_seq"))).select(*rows.columns, (F.col("_place") - F.col("_first")).alias("pos"))


#: tokens() for DuckDB.
TOKENS_SQL = """(SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END::BIGINT AS tok,
  value, event_id, ts FROM events)"""
