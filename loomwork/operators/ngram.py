"""N-gram features over token sequences (survey W1, W9, H1-H4, J1-J3, P15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.hashing import NgramHash
from loomwork.plans import ranks, storage
from loomwork.registry import query
from loomwork.session import TOKENS_SQL, coded, table

HASH = NgramHash.make(n=3, heads=2, size=1000, vocabulary=1 << 17)
PAD = 0
#: Fixed value: the token that ends a history; nothing before it is visible.
BREAK = 2


def masked(history: list[Column], stop: int | None = BREAK) -> list[Column]:
    """A token and those before it; the pad once the sequence's start (null) or a stop token was passed, and from then on."""
    out, blocked = [history[0]], F.lit(False)
    for back in history[1:]:
        blocked = blocked | back.isNull() | ((back == stop) if stop is not None else F.lit(False))
        out.append(F.when(blocked, F.lit(PAD)).otherwise(back).cast("long"))
    return out


_HISTORY = f"""(WITH t AS {TOKENS_SQL}, l AS (SELECT *, lag(tok, 1) OVER w AS b1, lag(tok, 2) OVER w AS b2 FROM t WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT seq, pos, tok AS t0, CASE WHEN b1 IS NULL OR b1 = {BREAK} THEN 0 ELSE b1 END AS t1, CASE WHEN b1 IS NULL OR b1 = {BREAK} OR b2 IS NULL OR b2 = {BREAK} THEN 0 ELSE b2 END AS t2 FROM l)"""
_IDS = HASH.sql(["t0", "t1", "t2"])


def history(df: DataFrame, n: int) -> DataFrame:
    """Seq, pos, the token (t0) and the n tokens before it (t1, ...); df: seq, tok, ts, event_id.

    Histories come from a window over each sequence, or, where one sequence
    is too long for a task, from windows over equal buckets of rows.
    """
    if ranks.hottest(df, "seq") > ranks.HOT_KEY_ROWS:
        rows = ranks.lags(df, "seq", ["ts", "event_id"], "tok", n).withColumn("pos", F.col("_pos"))
        past = [F.col(f"_lag{k}") for k in range(1, n + 1)]
    else:
        w = Window.partitionBy("seq").orderBy("ts", "event_id")
        rows = df.withColumns({"pos": F.row_number().over(w).cast("long") - 1, **{f"_lag{k}": F.lag("tok", k).over(w) for k in range(1, n + 1)}})
        past = [F.col(f"_lag{k}") for k in range(1, n + 1)]
    return rows.select("seq", "pos", *(c.alias(f"t{i}") for i, c in enumerate(masked([F.col("tok"), *past]))))


def ngram_ids(df: DataFrame, scheme: NgramHash = HASH) -> DataFrame:
    """H1: seq, pos and one id per n-gram length and head (h0, h1, ...); df: seq, tok, ts, event_id."""
    held = history(df, scheme.n - 1)
    return held.select("seq", "pos", *(c.alias(f"h{i}") for i, c in enumerate(scheme.columns([F.col(f"t{i}") for i in range(scheme.n)]))))


def layered_ids(df: DataFrame, schemes: dict[int, NgramHash]) -> DataFrame:
    """H1 H2: layer, seq, pos and the ids of each layer's scheme; histories are made once."""
    n = max(s.n for s in schemes.values())
    held, past = history(df, n - 1), [F.col(f"t{i}") for i in range(n)]
    each = [F.struct(F.lit(layer).cast("long").alias("layer"), *(c.alias(f"h{i}") for i, c in enumerate(s.columns(past)))) for layer, s in schemes.items()]
    return held.select("seq", "pos", F.inline(F.array(*each)))


@query(f"SELECT seq, pos, {', '.join(f'{e} AS h{i}' for i, e in enumerate(_IDS))} FROM {_HISTORY}")
def ngram_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 H1 H2 H3 H4 P15."""
    return ngram_ids(coded(spark, sf_dir))


LAYERS = NgramHash.layers([1, 4], n=3, heads=2, size=1000, vocabulary=1 << 17)


@query(" UNION ALL ".join(f"SELECT {layer}::BIGINT AS layer, seq, pos, {', '.join(f'{e} AS h{i}' for i, e in enumerate(s.sql(['t0', 't1', 't2'])))} FROM {_HISTORY}" for layer, s in LAYERS.items()))
def ngram_hash_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 H2 H3 H4: each layer has its own multipliers and tables."""
    return layered_ids(coded(spark, sf_dir), LAYERS)


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, ascii(word) * 32 + least(length(word), 31) AS t0, lag(ascii(word) * 32 + least(length(word), 31), 1, 0) OVER o AS t1, lag(ascii(word) * 32 + least(length(word), 31), 2, 0) OVER o AS t2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, {', '.join(f'{e} AS h{i}' for i, e in enumerate(_IDS))} FROM t)
SELECT doc_id, count(*) AS grams, {', '.join(f'sum(h{i})::BIGINT AS s{i}' for i in range(4))} FROM h GROUP BY doc_id""")
def ngram_hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the ids of each text's words; a fold over the row's own array carries the history, so nothing is shuffled or sorted."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    ids = F.transform(words, lambda w: (F.ascii(w) * 32 + F.least(F.length(w), F.lit(31))).cast("long"))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).where("size(ids) > 0")
    zero, back, sums = F.lit(PAD).cast("long"), [f"b{k}" for k in range(1, HASH.n)], [f"s{i}" for i in range((HASH.n - 1) * HASH.heads)]

    def step(a: Column, t: Column) -> Column:
        past = [t, *(a[b] for b in back)]
        return F.struct(*(p.alias(b) for p, b in zip(past, back)), *((a[s] + h).alias(s) for s, h in zip(sums, HASH.columns(past))))

    folded = F.aggregate("ids", F.struct(*(zero.alias(x) for x in (*back, *sums))), step)
    return docs.select("doc_id", F.size("ids").cast("long").alias("grams"), folded.alias("f")).select("doc_id", "grams", *(F.col(f"f.{x}") for x in sums))


@query(f"""WITH h AS (SELECT seq, pos, {_IDS[0]} AS id FROM {_HISTORY}), n AS (SELECT count(*) AS n FROM part)
SELECT h.seq, count(*) AS hits, round(sum(p.p_retailprice), 6) AS total FROM h, n JOIN part p ON p.p_partkey = h.id % n.n GROUP BY h.seq""")
def ngram_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids looked up in a large table; ids are counted before the join, so a common n-gram is looked up once a sequence."""
    ids = ngram_ids(coded(spark, sf_dir)).select("seq", "h0")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    size = part.agg(F.count(F.lit(1)).alias("n"))
    wanted = ids.crossJoin(F.broadcast(size)).groupBy("seq", (F.col("h0") % F.col("n")).alias("p_partkey")).agg(F.count(F.lit(1)).alias("times"))
    return wanted.join(part, "p_partkey").groupBy("seq").agg(F.sum("times").alias("hits"), F.round(F.sum(F.col("times") * F.col("p_retailprice")), 6).alias("total"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS word, generate_subscripts(string_split(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' '), 1) AS pos FROM documents),
k AS (SELECT regexp_replace(word, '[^a-z]', '', 'g') AS key, min((doc_id, pos)) AS seen, count(*) AS uses FROM w WHERE regexp_replace(word, '[^a-z]', '', 'g') <> '' GROUP BY 1)
SELECT key, uses, row_number() OVER (ORDER BY seen) - 1 AS id FROM k""")
def token_first_appearance_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of normalised words by first appearance; numbered by ranges, not in one task."""
    text = F.regexp_replace(F.lower("text"), "[ \\t\\r\\n]+", " ")
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text, " ")).alias("pos", "word"))
    keys = words.select("doc_id", "pos", F.regexp_replace("word", "[^a-z]", "").alias("key")).where("key <> ''")
    first = keys.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count(F.lit(1)).alias("uses")).select("key", "uses", "at.*")
    return ranks.global_index(first, ["doc_id", "pos"], "id").select("key", "uses", "id")


@query("SELECT e.event_id, round(sum(v.x), 6) AS total FROM events e JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) v ON v.vec_id = e.user_id % (SELECT count(*) FROM embeddings) GROUP BY 1")
def token_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their token's embedding; broadcast where the table is small enough, else shuffled."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    own = vectors.select("vec_id", F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x).alias("total"))
    own = F.broadcast(own) if storage.small_enough(own, 200_000) else own
    rows = table(spark, sf_dir, "events").select("event_id", "user_id").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("user_id") % F.col("n"))
    return rows.join(own, "vec_id").select("event_id", F.round("total", 6).alias("total"))
