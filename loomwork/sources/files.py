"""Prompt files, traces, logs, timings, telemetry tables and event streams (survey S9, S10, S13, S17-S25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.plans import ranks


def numbered_lines(spark: SparkSession, path: str, name: str = r"([^/]*)$") -> DataFrame:
    """file, n (from 1), line of text files: each file is split within its row, so lines keep their order. name: what of a path names the file."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), name, 1).alias("file"), "value")
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n", -1)
    return raw.select("file", F.posexplode(lines).alias("i", "line")).select("file", (F.col("i") + 1).alias("n"), "line")


def prompts(spark: SparkSession, path: str, wanted: int, cycle: bool = False) -> DataFrame:
    """Row, prompt: the first wanted lines that are not blank, trimmed; with cycle they repeat. Fails where there are too few."""
    lines = numbered_lines(spark, path).select("file", "n", F.trim("line").alias("prompt")).where("prompt <> ''")
    rows = ranks.global_index(lines, ["file", "n"], "row").select("row", "prompt")
    have = rows.count()
    if have < (1 if cycle else wanted):
        raise ValueError(f"{have} prompts, {wanted} wanted")
    if not cycle:
        return rows.where(F.col("row") < wanted)
    return spark.range(wanted).withColumnRenamed("id", "want").join(rows, F.col("want") % have == F.col("row")).select(F.col("want").alias("row"), "prompt")


#: Fixed value: fields of chrome-trace events that are used.
TRACE = "traceEvents array<struct<cat:string,name:string,ts:double,dur:double,args:map<string,string>>>"


def trace_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cat, name, ts, dur, external (the External id), dims of chrome-trace files, each one trace; with lines, each line is one."""
    raw = spark.read.schema(TRACE).json(path, multiLine=not lines)
    e = raw.select(F.explode("traceEvents").alias("e"))
    return e.select("e.cat", "e.name", "e.ts", "e.dur", F.col("e.args")["External id"].alias("external"), F.col("e.args")["Input Dims"].alias("dims"))


def kernel_trace(events: DataFrame) -> DataFrame:
    """Kernels in order with their outermost op ("?" where none), times from the first one."""
    ops = events.where("cat = 'cpu_op'").groupBy("external").agg(F.min_by(F.struct("name", "dims"), F.struct("ts", "name")).alias("op"))
    k = events.where("cat = 'kernel'").join(ops, "external", "left")
    first = events.where("cat = 'kernel'").agg(F.min("ts").alias("t0"))
    return k.crossJoin(F.broadcast(first)).select((F.col("ts") - F.col("t0")).alias("at"), "dur", "name", F.coalesce("op.name", F.lit("?")).alias("op"), F.col("op.dims").alias("dims"))


def trace_text(kernels: DataFrame) -> DataFrame:
    """The kernels as fixed-width lines, in order."""
    return kernels.orderBy("at").select(F.concat(F.format_string("%9.1f %7.1f  ", "at", "dur"), F.rpad(F.left("name", F.lit(60)), 62, " "), "op").alias("value"))


def log_lines(lines: DataFrame, keep: str, drop: str, last: int) -> DataFrame:
    """Of each file the last lines that match keep and not drop (in any case)."""
    k = lines.where(F.col("line").rlike(keep) & ~F.col("line").rlike(f"(?i){drop}"))
    return k.withColumn("back", F.row_number().over(Window.partitionBy("file").orderBy(F.col("n").desc()))).where(F.col("back") <= last).drop("back")


#: Fixed value: fields of a server's timings.
TIMINGS = "timings struct<predicted_n:bigint,predicted_ms:double,predicted_per_second:double,draft_n:bigint,draft_n_accepted:bigint>"


def timings(spark: SparkSession, path: str) -> DataFrame:
    """Totals of per-request timing lines (JSON)."""
    t = spark.read.schema(TIMINGS).json(path).select("timings.*")
    return t.agg(F.count(F.lit(1)).alias("requests"), F.sum("predicted_n").alias("tokens"), (F.sum("predicted_n") * 1000 / F.greatest(F.sum("predicted_ms"), F.lit(1e-9))).alias("per_second"), (100 * F.sum("draft_n_accepted") / F.greatest(F.sum("draft_n"), F.lit(1))).alias("accepted_percent"))


#: Fixed value: fields of a latency run's output.
LATENCY = "avg_latency double, latencies array<double>, percentiles map<string,double>"


def latencies(spark: SparkSession, path: str) -> DataFrame:
    """avg_latency, runs, p50 and p99 of latency outputs (JSON, one a line)."""
    return spark.read.schema(LATENCY).json(path).select("avg_latency", F.size("latencies").cast("long").alias("runs"), F.col("percentiles")["50"].alias("p50"), F.col("percentiles")["99"].alias("p99"))


def write_stats(counts: DataFrame, path: str) -> None:
    """Telemetry counts as Parquet by layer, so that a layer is read alone."""
    counts.repartition("layer").write.partitionBy("layer").parquet(path)


def read_stats(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """What write_stats() wrote; of the given layers only their folders are read."""
    stats = spark.read.parquet(path)
    return stats if layers is None else stats.where(F.col("layer").isin(layers))


def event_stream(chunks: DataFrame) -> DataFrame:
    """Request, body: each request's chunks (request, i, text) as server-sent events, with a trailer."""
    line = lambda c: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("chat.completion.chunk").alias("object"), c["i"].alias("index"), c["text"].alias("text"))), F.lit("\n\n"))
    parts = chunks.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("c"))  # one request's pieces
    return parts.select("request", F.concat(F.array_join(F.transform("c", line), ""), F.lit("data: [DONE]\n\n")).alias("body"))
