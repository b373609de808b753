"""Prompts, conversations, stop strings, logs, tensor names and corpora (survey S9-S16, S20, S22-S29, P1-P3, J10, J11, U3-U5, G1-G10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions import hashing, text
from loomwork.plans import ranks
from loomwork.registry import query
from loomwork.session import table


@query("""WITH p AS (SELECT conv_id, turn, string_split(trim(text), ' ') AS w FROM conversations WHERE role = 'user' AND trim(text) <> ''), m AS (SELECT min(len(w)) AS n FROM p)
SELECT conv_id, turn, array_to_string(w[1:n], ' ') AS prompt, n::BIGINT AS n FROM p, m""")
def prompts_truncate_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that are not blank, cut to the length of the shortest."""
    p = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("t", F.trim("text")).where("t <> ''").select("conv_id", "turn", F.split("t", " ").alias("w"))
    n = p.agg(F.min(F.size("w")).alias("n"))
    return p.crossJoin(F.broadcast(n)).select("conv_id", "turn", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("prompt"), F.col("n").cast("long").alias("n"))


@query("""WITH p AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark WHERE trim(text) <> '') SELECT r.row, p.item_id, length(p.text) AS chars FROM range(500) r(row) JOIN p ON p.i = r.row % p.n""")
def prompts_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts in order, repeated until there are 500 rows."""
    p = ranks.global_index(table(spark, sf_dir, "benchmark").where("trim(text) <> ''"), ["item_id"], "i")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    rows = spark.range(500).withColumnRenamed("id", "row").crossJoin(F.broadcast(n)).withColumn("i", F.col("row") % F.col("n"))
    return rows.join(p, "i").select("row", "item_id", F.length("text").cast("long").alias("chars"))


#: Stop strings of a query.
STOPS = ["the end", "\n", "###", " de "]


@query("""WITH s AS (SELECT doc_id, text, list_min(list_filter([strpos(text, 'the end'), strpos(text, chr(10)), strpos(text, '###'), strpos(text, ' de ')], lambda p: p > 0)) AS p FROM documents)
SELECT doc_id, p IS NOT NULL AS stopped, length(CASE WHEN p IS NULL THEN text ELSE substr(text, 1, p - 1) END) AS chars, md5(CASE WHEN p IS NULL THEN text ELSE substr(text, 1, p - 1) END) AS digest FROM s""")
def stop_string_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts before the earliest stop string."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.cut_at_stop(F.col("text"), STOPS).alias("cut"))
    return docs.select("doc_id", (F.length("cut") < F.length("text")).alias("stopped"), F.length("cut").cast("long").alias("chars"), F.md5("cut").alias("digest"))


def histories(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, seen (turns in the prompt), system (turn of the system message in force) of every turn.

    A system turn also clears: what came before it is not seen.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    system = F.max(F.when(F.col("role") == "system", F.col("turn"))).over(w)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = turns.withColumns({"system": system, "i": place})
    start = F.max(F.when(F.col("role") == "system", F.col("i"))).over(w)
    return t.select("conv_id", "turn", "role", (F.col("i") - F.coalesce(start, F.lit(1)) + 1).cast("long").alias("seen"), "system")


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
s AS (SELECT *, max(CASE WHEN role = 'system' THEN turn END) OVER w AS system, max(CASE WHEN role = 'system' THEN i END) OVER w AS start FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, role, i - coalesce(start, 1) + 1 AS seen, system FROM s""")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16."""
    return histories(table(spark, sf_dir, "conversations"))


_BODY = """CASE event_id % 5 WHEN 0 THEN '{"max_tokens": ' || (event_id % 90) || ', "stop": "x"}' WHEN 1 THEN '{"max_completion_tokens": ' || (event_id % 70) || ', "stop": ["a", "b"]}' WHEN 2 THEN '{"temperature": 0.5, "messages": [{"role": "user", "content": "hi"}]}' WHEN 3 THEN 'not json' ELSE '{"stream": true}' END"""


@query(f"""WITH b AS (SELECT event_id, {_BODY} AS body FROM events), j AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b)
SELECT event_id, j IS NOT NULL AS ok, CASE WHEN j IS NOT NULL THEN coalesce(CAST(j->>'max_tokens' AS BIGINT), CAST(j->>'max_completion_tokens' AS BIGINT), 256) END AS max_tokens, CASE WHEN j IS NOT NULL THEN coalesce(CAST(j->>'temperature' AS DOUBLE), 1.0) END AS temperature,
CASE WHEN j IS NOT NULL THEN coalesce(CAST(j->>'stream' AS BOOLEAN), false) END AS stream, CASE WHEN j IS NOT NULL THEN CASE json_type(j->'stop') WHEN 'ARRAY' THEN array_to_string(CAST(j->'stop' AS VARCHAR[]), '|') WHEN 'VARCHAR' THEN j->>'stop' ELSE '' END END AS stops,
CASE WHEN j IS NOT NULL THEN coalesce(json_array_length(j->'messages'), 0)::BIGINT END AS messages FROM j""")
def request_json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of request bodies, with aliases and defaults; a body that is no JSON gives nulls."""
    r = table(spark, sf_dir, "events").select("event_id", text.request(F.expr(_BODY)).alias("r"))
    return r.select("event_id", F.col("r").isNotNull().alias("ok"), F.col("r.max_tokens").cast("long").alias("max_tokens"), "r.temperature", "r.stream", F.array_join("r.stops", "|").alias("stops"), F.when(F.col("r").isNotNull(), F.size("r.messages")).cast("long").alias("messages"))


@query("""SELECT doc_id, '{"object":"text_completion","choices":[{"index":0,"text":"' || lang || '","finish_reason":"' || CASE WHEN n_chars // 4 >= 500 THEN 'length' ELSE 'stop' END || '"}],"usage":{"prompt_tokens":' || (doc_id % 50) || ',"completion_tokens":' || least(n_chars // 4, 500) || ',"total_tokens":' || (doc_id % 50 + least(n_chars // 4, 500)) || '}}' AS body FROM documents""")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 G9 ST9: completions as JSON with usage."""
    done = F.least(F.expr("n_chars div 4"), F.lit(500))
    return table(spark, sf_dir, "documents").select("doc_id", text.response(F.col("lang"), F.col("doc_id") % 50, done, F.lit(500)).alias("body"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS passage, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), l AS (SELECT * FROM p WHERE length(passage) > 400)
SELECT doc_id, i, length(passage) AS chars, substr(passage, 1, 40) AS head FROM l ORDER BY (doc_id * 2654435761 + i * 40503) % 4294967296, doc_id, i LIMIT 256""")
def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 passages of more than 400 characters in the order of an integer hash; each task keeps its own 256 first."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "passage")).where(F.length("passage") > 400).withColumn("i", (F.col("i") + 1).cast("long"))
    draw = (F.col("doc_id") * F.lit(2654435761) + F.col("i") * 40503) % F.lit(4294967296)
    return p.orderBy(draw, "doc_id", "i").limit(256).select("doc_id", "i", F.length("passage").cast("long").alias("chars"), F.substring("passage", 1, 40).alias("head"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents) SELECT doc_id, i // 256 AS chunk, count(*) AS words, sum(length(w))::BIGINT AS chars FROM w GROUP BY 1, 2 HAVING count(*) = 256""")
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full chunks of 256 words; cut within the row."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w")).where("size(w) >= 256")
    chunk = F.transform(F.sequence(F.lit(0), (F.size("w") / 256).cast("int") - 1), lambda k: F.slice("w", k * 256 + 1, F.lit(256)))
    c = w.select("doc_id", F.posexplode(chunk).alias("chunk", "c"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("words"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


#: Log lines as literals: file, line number, text.
LOG = [
    ("runs/a1.log", 1, "INFO starting server"),
    ("runs/a1.log", 2, "Throughput: 61.5 requests/s"),
    ("runs/a1.log", 3, "WARNING Error in optional import ignored"),
    ("runs/a1.log", 4, "draft 100 accepted 71"),
    ("runs/a1.log", 5, "throughput 9 tok/s, drafts 50, took 65 of them"),
    ("runs/b2.log", 1, "Error: out of memory"),
    ("runs/b2.log", 2, "Throughput: 7.25 requests/s"),
    ("runs/b2.log", 3, "draft 40 accepted 10"),
    ("runs/b2.log", 4, "draft 60 accepted 33"),
    ("runs/b2.log", 5, "done"),
]
_LOG_SQL = "(VALUES " + ", ".join(f"('{f}', {n}, '{t}')" for f, n, t in LOG) + ") l(file, n, line)"


@query(f"""WITH k AS (SELECT * FROM {_LOG_SQL} WHERE regexp_matches(line, 'Throughput|Error|draft') AND NOT regexp_matches(lower(line), 'ignored')), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC) AS back FROM k)
SELECT regexp_extract(file, '([^/]*)\\.log$', 1) AS run, count(*) FILTER (WHERE back <= 3) AS kept, max(CAST(nullif(regexp_extract(line, 'Throughput: ([0-9.]+)', 1), '') AS DOUBLE)) AS throughput, sum(CAST(nullif(regexp_extract(line, 'draft ([0-9]+)', 1), '') AS BIGINT))::BIGINT AS drafts,
round(100.0 * sum(CAST(nullif(regexp_extract(line, 'accepted ([0-9]+)', 1), '') AS BIGINT)) / sum(CAST(nullif(regexp_extract(line, 'draft ([0-9]+)', 1), '') AS BIGINT)), 6) AS percent FROM r GROUP BY 1""")
def bench_log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures out of log lines."""
    lines = spark.createDataFrame(LOG, "file string, n int, line string")
    k = lines.where(F.col("line").rlike("Throughput|Error|draft") & ~F.lower("line").rlike("ignored")).withColumn("back", F.row_number().over(Window.partitionBy("file").orderBy(F.col("n").desc())))
    number = lambda p, t: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).cast(t)
    drafts, taken = number("draft ([0-9]+)", "long"), number("accepted ([0-9]+)", "long")
    return k.groupBy(text.base_name(F.col("file")).alias("run")).agg(F.count(F.when(F.col("back") <= 3, 1)).alias("kept"), F.max(number("Throughput: ([0-9.]+)", "double")).alias("throughput"), F.sum(drafts).alias("drafts"), F.round(100.0 * F.sum(taken) / F.sum(drafts), 6).alias("percent"))


#: Tensor names as literals.
NAMES = [f"layers.{i}.{n}" for i in range(3) for n in ("attn.wq.weight", "attn.wq.scale", "norm.weight", "engram.embed.weight", "gate.bias_vl", "gate.bias", *(f"ffn.experts.{e}.w{k}.{s}" for e in (0, 1, 7, 12) for k in (1, 3) for s in ("weight", "scale")))] + ["head.weight"]
_NAMES_SQL = "(SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS name)"


@query(f"""WITH n AS {_NAMES_SQL} SELECT w.name, substr(w.name, 10) AS own, s.name IS NOT NULL AS scaled, CAST(nullif(regexp_extract(w.name, 'experts\\.([0-9]+)', 1), '') AS BIGINT) AS expert FROM n w LEFT JOIN n s ON s.name = replace(w.name, '.weight', '.scale') AND s.name <> w.name
WHERE starts_with(w.name, 'layers.1.') AND NOT contains(w.name, 'engram.embed') AND NOT ends_with(w.name, '.scale') AND NOT contains(w.name, 'bias_vl')""")
def scale_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's weights with their scales, by name; expert ids from names."""
    n = spark.createDataFrame([(x,) for x in NAMES], "name string")
    mine = n.where(F.col("name").startswith("layers.1.") & ~F.contains("name", F.lit("engram.embed")) & ~F.col("name").endswith(".scale") & ~F.contains("name", F.lit("bias_vl")))
    scales = n.where(F.col("name").endswith(".scale")).select(F.regexp_replace("name", r"\.scale$", ".weight").alias("name"), F.lit(True).alias("has"))
    return mine.join(scales, "name", "left").select("name", F.substring("name", 10, 1000).alias("own"), F.coalesce("has", F.lit(False)).alias("scaled"), F.nullif(F.regexp_extract("name", r"experts\.([0-9]+)", 1), F.lit("")).cast("long").alias("expert"))


@query("SELECT s_suppkey AS k, (s_suppkey % 7) || ':' || (s_suppkey % 5) || ',' || (s_suppkey % 7 + 10) || ':3' AS spec, (s_suppkey % 5 + 3)::BIGINT AS total, (s_suppkey % 4 + 2)::BIGINT AS cpus, 'run' || s_suppkey AS base, substr(sha1(s_name), 1, 12) AS tag FROM supplier")
def spec_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs, lists, names and tags."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.expr("(s_suppkey % 7) || ':' || (s_suppkey % 5) || ',' || (s_suppkey % 7 + 10) || ':3'").alias("spec"), F.expr("'0-' || (s_suppkey % 4) || ',9'").alias("cpus"), F.expr("'out/run' || s_suppkey || '.md'").alias("path"))
    return s.select(F.col("s_suppkey").alias("k"), "spec", F.aggregate(F.map_values(text.spec(F.col("spec"))), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size(text.cpu_list(F.col("cpus"))).cast("long").alias("cpus"), text.base_name(F.col("path")).alias("base"), hashing.build_tag("s_name").alias("tag"))


@query("SELECT event_id, lpad(CASE WHEN value < 0 AND t > 0 THEN '-' ELSE '' END || (t // 10) || '.' || (t % 10), 9, ' ') || ' ' || rpad(event_type, 12, ' ') || left(props, 6) AS line FROM (SELECT *, floor(abs(value) * 10 + 0.5)::BIGINT AS t FROM events)")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width lines with values to a tenth, halves away from zero."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lpad(text.tenths(F.col("value")), 9, " "), F.lit(" "), F.rpad("event_type", 12, " "), F.left("props", F.lit(6))).alias("line"))


@query()
def text_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of documents' words; Unicode, so tested in Python."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("uses"))
    keyed = words.select(text.normalised_key(F.col("raw"), text.normalised(F.col("raw"))).alias("key"), "uses")
    return keyed.groupBy("key").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("forms"))
