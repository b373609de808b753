"""Queries over quantized and transformed vectors (survey 2.8 and 2.11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import quant, vectors
from loomwork.registry import query
from loomwork.session import table


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("x"), "embedding")


def _digest(df: DataFrame, y: Column) -> DataFrame:
    """vec_id, the sums of y and of its squares, and two of its entries."""
    t = df.select("vec_id", y.alias("y"))
    return t.select("vec_id", F.round(vectors.total(F.col("y")), 6).alias("total"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v), 6).alias("square"), F.round(F.col("y")[1], 6).alias("y1"), F.round(F.col("y")[62], 6).alias("y62"))


_D = "round(list_sum(y), 6) AS total, round(list_sum([v * v for v in y]), 6) AS square, round(y[2], 6) AS y1, round(y[63], 6) AS y62"
_E = "(SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


@query(f"SELECT vec_id, {_D} FROM (SELECT vec_id, [v / sqrt(list_sum([u * u for u in x]) / len(x) + 1e-6) for v in x] AS y FROM {_E})")
def rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17 A16 A17."""
    return _digest(_x(spark, sf_dir), vectors.rms_norm(F.col("x")))


_FREQ = "[" + ", ".join(map(repr, vectors.frequencies(32))) + "]"


@query(f"""SELECT vec_id, {_D} FROM (SELECT vec_id, [CASE WHEN i <= 32 THEN x[i] WHEN i % 2 = 1 THEN x[i] * cos((vec_id % 97) * {_FREQ}[(i - 31) // 2]) - x[i + 1] * sin((vec_id % 97) * {_FREQ}[(i - 31) // 2])
ELSE x[i] * cos((vec_id % 97) * {_FREQ}[(i - 32) // 2]) + x[i - 1] * sin((vec_id % 97) * {_FREQ}[(i - 32) // 2]) END for i in range(1, 65)] AS y FROM {_E})""")
def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 F19."""
    return _digest(_x(spark, sf_dir), vectors.rope(F.col("x"), F.col("vec_id") % 97, 32, 64))


def _turned(x: str, sign: str) -> str:
    """rope() of all 64 entries for DuckDB; sign: "-" turns forth, "+" back."""
    other = "+" if sign == "-" else "-"
    return f"[CASE WHEN i % 2 = 1 THEN {x}[i] * cos((vec_id % 97) * {_FULL}[(i + 1) // 2]) {sign} {x}[i + 1] * sin((vec_id % 97) * {_FULL}[(i + 1) // 2]) ELSE {x}[i] * cos((vec_id % 97) * {_FULL}[i // 2]) {other} {x}[i - 1] * sin((vec_id % 97) * {_FULL}[i // 2]) END for i in range(1, 65)]"


_FULL = "[" + ", ".join(map(repr, vectors.frequencies(64))) + "]"


@query(f"SELECT vec_id, round(y[2], 6) AS y1, round(z[64], 6) AS z63, round(list_max([abs(x[i] - z[i]) for i in range(1, 65)]), 6) AS err FROM (SELECT *, {_turned('y', '+')} AS z FROM (SELECT *, {_turned('x', '-')} AS y FROM {_E}))")
def rope_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rotated there and back; entries of both, and the largest difference."""
    turned = _x(spark, sf_dir).withColumn("y", vectors.rope(F.col("x"), F.col("vec_id") % 97, 64, 64))
    back = turned.withColumn("z", vectors.rope(F.col("y"), F.col("vec_id") % 97, 64, 64, inverse=True))
    return back.select("vec_id", F.round(F.col("y")[1], 6).alias("y1"), F.round(F.col("z")[63], 6).alias("z63"), F.round(F.array_max(F.zip_with("x", "z", lambda a, b: F.abs(a - b))), 6).alias("err"))


@query(f"SELECT vec_id, {_D} FROM (SELECT vec_id, [least(8 * x[i], 1.5) / (1 + exp(-least(8 * x[i], 1.5))) * greatest(least(8 * x[65 - i], 1.5), -1.5) for i in range(1, 65)] AS y FROM {_E})")
def swiglu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    x = F.transform("x", lambda v: v * 8)
    return _digest(_x(spark, sf_dir), vectors.swiglu(x, F.reverse(x), 1.5))


@query(f"SELECT vec_id, round(1 / (1 + exp(-CASE WHEN d < 0 THEN -1 ELSE 1 END * sqrt(greatest(abs(d), 1e-6)))), 6) AS gate FROM (SELECT vec_id, list_sum([x[i] * x[65 - i] for i in range(1, 65)]) AS d FROM {_E})")
def signed_root_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15 F16 K18."""
    d = vectors.total(F.zip_with("x", F.reverse("x"), lambda a, b: a * b))
    return _x(spark, sf_dir).select("vec_id", F.round(vectors.signed_root_gate(d), 6).alias("gate"))


_ROW, _COLUMN = ("[m[i] / ({}) for i in range(1, 17)]".format(" + ".join(f"m[{at}]" for at in places)) for places in (("4 * ((i - 1) // 4) + 1", "4 * ((i - 1) // 4) + 2", "4 * ((i - 1) // 4) + 3", "4 * ((i - 1) // 4) + 4"), ("(i - 1) % 4 + 1", "(i - 1) % 4 + 5", "(i - 1) % 4 + 9", "(i - 1) % 4 + 13")))


@query(f"""WITH RECURSIVE s(vec_id, part, n, m) AS (SELECT vec_id, part, 0, [exp(x[16 * part + i]) for i in range(1, 17)] FROM {_E}, range(4) r(part)
UNION ALL SELECT vec_id, part, n + 1, {_COLUMN} FROM (SELECT vec_id, part, n, {_ROW} AS m FROM s WHERE n < 20))
SELECT vec_id, part, round(m[1] + m[2] + m[3] + m[4], 6) AS row0, round(m[1] + m[5] + m[9] + m[13], 6) AS col0, round(m[6], 6) AS m11 FROM s WHERE n = 20""")
def sinkhorn_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows and columns of the four 4 x 4 parts of each vector; their sums."""
    parts = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("x", k * 16 + 1, F.lit(16))))
    m = _x(spark, sf_dir).select("vec_id", parts.alias("part", "x")).select("vec_id", F.col("part").cast("long").alias("part"), vectors.sinkhorn(F.col("x")).alias("m"))
    return m.select("vec_id", "part", F.round(vectors.total(F.slice("m", 1, 4)), 6).alias("row0"), F.round(F.col("m")[0] + F.col("m")[4] + F.col("m")[8] + F.col("m")[12], 6).alias("col0"), F.round(F.col("m")[5], 6).alias("m11"))


#: Powers of two from 2**-40 to 2**40 for DuckDB: scales without logarithms.
_SCALE = "(SELECT min(p) FROM (SELECT pow(2.0, k) AS p FROM range(-40, 41) r(k)) WHERE p >= {a} / {top})"
_BLOCKS = f"(SELECT vec_id, b, [x[i] for i in range(32 * b + 1, 32 * b + 33)] AS x FROM {_E}, range(2) r(b))"


def _fake_sql(top: str, floor: str, rounded: str) -> str:
    return f"""WITH k AS {_BLOCKS}, a AS (SELECT vec_id, b, x, greatest(list_max([abs(v) for v in x]), {floor}) AS amax FROM k),
s AS (SELECT a.*, p.s FROM a, LATERAL (SELECT min(pow(2.0, k)) AS s FROM range(-40, 41) r(k) WHERE pow(2.0, k) >= amax / {top}) p),
q AS (SELECT vec_id, list_sum([{rounded} * s for v in x]) AS t, list_sum([({rounded} * s) * ({rounded} * s) for v in x]) AS sq FROM s)
SELECT vec_id, round(sum(t), 6) AS total, round(sum(sq), 6) AS square FROM q GROUP BY 1"""


def _fake(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    y = quant.fake_quant(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", kind, "y").select("vec_id", vectors.doubles(F.col("y")).alias("y"))
    return y.select("vec_id", F.round(vectors.total(F.col("y")), 6).alias("total"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v), 6).alias("square"))


#: The nearest E4M3 value of v / s for DuckDB.
_E4M3 = "(round_even(v / s / pow(2.0, greatest(floor(log2(greatest(abs(v / s), 1e-30))), -6) - 3), 0) * pow(2.0, greatest(floor(log2(greatest(abs(v / s), 1e-30))), -6) - 3))"


@query(_fake_sql("448", "1e-4", _E4M3))
def fp8_fake_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 F3 F4 F6 A15."""
    return _fake(spark, sf_dir, "fp8")


@query(_fake_sql("6", "1e-30", "(sign(v) * CASE WHEN abs(v / s) < 2 THEN round_even(abs(v / s) * 2, 0) / 2 WHEN abs(v / s) < 4 THEN round_even(abs(v / s), 0) ELSE round_even(abs(v / s) / 2, 0) * 2 END)"))
def fp4_fake_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 F8."""
    return _fake(spark, sf_dir, "fp4")


def _in_blocks(size: int, scale: str, rounded: str) -> str:
    """A block format for DuckDB: scale of amax, and the rounded v / s, both in float32."""
    return f"""SELECT vec_id, list_sum([y::DOUBLE for y in ys]) AS t, list_sum([y::DOUBLE * y::DOUBLE for y in ys]) AS sq FROM (SELECT vec_id, [CAST({rounded} * s AS FLOAT) for v in x] AS ys
FROM (SELECT vec_id, x, CAST({scale} AS FLOAT)::DOUBLE AS s FROM (SELECT vec_id, x, list_max([abs(v) for v in x]) AS amax FROM (SELECT vec_id, [x[i] for i in range({size} * b + 1, {size} * b + {size} + 1)] AS x FROM {_E}, range({64 // size}) r(b)))))"""


_OTHER = {
    "int8": _in_blocks(32, "CASE WHEN amax = 0 THEN 1 ELSE amax / 127 END", "round_even(CAST(v / s AS FLOAT)::DOUBLE, 0)"),
    "bf16": _in_blocks(64, "1", "CASE WHEN v = 0 THEN 0 ELSE round_even(v / pow(2.0, floor(log2(abs(v))) - 7), 0) * pow(2.0, floor(log2(abs(v))) - 7) END"),
    "fp4_e4m3": _in_blocks(16, _E4M3.replace("v / s", "CAST(greatest(amax, 6 * pow(2.0, -9)) / 6 AS FLOAT)::DOUBLE"), "sign(v) * CASE WHEN abs(CAST(v / s AS FLOAT)) < 2 THEN round_even(abs(CAST(v / s AS FLOAT)::DOUBLE) * 2, 0) / 2 WHEN abs(CAST(v / s AS FLOAT)) < 4 THEN round_even(abs(CAST(v / s AS FLOAT)::DOUBLE), 0) ELSE least(round_even(abs(CAST(v / s AS FLOAT)::DOUBLE) / 2, 0) * 2, 6) END"),
}


@query(" UNION ALL ".join(f"SELECT vec_id, '{kind}' AS kind, round(sum(t), 6) AS total, round(sum(sq), 6) AS square FROM ({q}) GROUP BY 1" for kind, q in _OTHER.items()))
def other_fake_quants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT8, bfloat16 and FP4 with E4M3 scales; float32 arithmetic."""
    parts = [_fake(spark, sf_dir, k).select("vec_id", F.lit(k).alias("kind"), "total", "square") for k in _OTHER]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_fake_sql("448", "1e-4", _E4M3))
def fp8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and scales, decoded by array expressions."""
    rows = quant.encode_fp8(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    y = rows.select("vec_id", quant.dequantize(F.col("codes"), F.col("scales"), 32).alias("y"))
    return y.select("vec_id", F.round(vectors.total(F.col("y")), 6).alias("total"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v), 6).alias("square"))


@query(f"""WITH c AS (SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, unnest([CAST(floor((v + 4) * 1000) AS BIGINT) % 16 for v in x]) AS c FROM {_E})
SELECT vec_id, sum(c)::BIGINT AS codes, count(*) // 2 AS bytes, sum(CASE WHEN c >= 8 THEN -1 ELSE 1 END * [0, 0.5, 1, 1.5, 2, 3, 4, 6][c % 8 + 1])::DOUBLE AS value FROM c GROUP BY 1""")
def fp4_pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codes packed two a byte, unpacked and decoded."""
    codes = F.transform("x", lambda v: (F.floor((v + 4) * 1000) % 16).cast("int"))
    packed = _x(spark, sf_dir).select("vec_id", quant.pack_nibbles(codes).alias("p"))
    rows = packed.select("vec_id", F.size("p").cast("long").alias("bytes"), quant.unpack_nibbles(F.col("p")).alias("c"))
    return rows.select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, v: a + v).alias("codes"), "bytes", vectors.total(F.transform("c", quant.decode_e2m1)).alias("value"))


#: Where entry i (from 0) of 2 x 4 tiles stands in an 8 x 8 array, for DuckDB.
_TILED = "((i // 16 * 2 + i % 8 // 4) * 8 + i // 8 % 2 * 4 + i % 4)"


@query(f"SELECT vec_id, round(t[9], 6) AS t4, round(list_sum([t[i] * i for i in range(1, 65)]), 6) AS weighted, list_sort(t) = list_sort(x) AS same FROM (SELECT vec_id, x, [x[{_TILED} + 1] for i in range(64)] AS t FROM {_E})")
def tile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an 8 x 8 array in 2 x 4 tiles and back; entry 4 of the second row's tile comes from row 1."""
    t = _x(spark, sf_dir).withColumn("t", quant.tile(F.col("x"), 8, 8, 2, 4))
    return t.select("vec_id", F.round(F.col("t")[8], 6).alias("t4"), F.round(vectors.total(F.transform("t", lambda v, i: v * (i + 1))), 6).alias("weighted"), (quant.untile(F.col("t"), 8, 8, 2, 4) == F.col("x")).alias("same"))


@query("""WITH s AS (SELECT s_suppkey AS row, (s_suppkey % 255)::BIGINT AS scale FROM supplier) SELECT row, round(CASE WHEN scale < 255 THEN ln(pow(2.0, scale - 127)) END, 6) AS log_scale FROM s""")
def scale_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8M0 codes as numbers, by their logarithm."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.round(F.log(quant.e8m0(F.col("s_suppkey") % 255)), 6).alias("log_scale"))


@query("""WITH a AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT vec_id AS n, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS w FROM embeddings WHERE vec_id < 16)
SELECT a.vec_id, b.n, round(sum(a.x * b.w), 6) AS y FROM a JOIN b ON b.k = a.k GROUP BY 1, 2""")
def gemm_split_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of all rows with a small matrix; the sum over k is cut in two parts that are added."""
    rows = _x(spark, sf_dir)
    w = F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("n"), F.col("x").alias("w"))))
    held = rows.select("vec_id", "x").crossJoin(F.broadcast(rows.where("vec_id < 16").agg(w.alias("m"))))  # a 16 x 64 matrix
    part = lambda m, a: vectors.total(F.zip_with(F.slice("x", a, 32), F.slice(m["w"], a, 32), lambda p, q: p * q))
    y = F.explode(F.transform("m", lambda m: F.struct(m["n"].alias("n"), F.round(part(m, 1) + part(m, 33), 6).alias("y"))))
    return held.select("vec_id", y.alias("o")).select("vec_id", "o.n", "o.y")


@query(f"""WITH x AS {_E}, n AS (SELECT vec_id, x, [v / sqrt(list_sum([u * u for u in x]) / len(x) + 1e-6) for v in x] AS y FROM x), w AS (SELECT n.vec_id, b.vec_id AS j, list_inner_product(n.y, b.x) AS w FROM n, x b WHERE b.vec_id < 4),
s AS (SELECT vec_id, sum(w * (1 + j * 0.25)) AS s FROM w GROUP BY 1) SELECT n.vec_id, round(s.s * list_sum(n.x), 6) AS total, round(s.s * n.x[63], 6) AS y62 FROM n JOIN s ON s.vec_id = n.vec_id""")
def hyper_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scaled copies of a row, mixed by products of its norm with four fixed rows."""
    rows = _x(spark, sf_dir).select("vec_id", "x")
    base = rows.where("vec_id < 4").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("b"))  # four rows
    held = rows.crossJoin(F.broadcast(base)).withColumn("y", vectors.rms_norm(F.col("x")))
    weights = F.transform("b", lambda b: vectors.total(F.zip_with("y", b["x"], lambda p, q: p * q)))
    copies = F.transform("b", lambda b: F.transform("x", lambda v: v * (1 + b["vec_id"] * 0.25)))
    mixed = held.withColumns({"c": copies, "w": weights}).select("vec_id", vectors.mix(F.col("c"), F.col("w")).alias("m"))
    return mixed.select("vec_id", F.round(vectors.total(F.col("m")), 6).alias("total"), F.round(F.col("m")[62], 6).alias("y62"))
