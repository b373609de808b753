"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import byte_bpe, decontaminate, language, near_dup, pii, quality, token_count, url_filter, wavelet, wrapper
from loomwork.plans import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts by kind, digest of the base spans, all spans."""
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def _pii_sql() -> str:
    """op2_pii for DuckDB: each kind's matches, placed by the pieces between them, and the same checks."""
    plain = lambda p: p.replace("(?:(?<![A-Za-z0-9._%+-])|\\G)", "").replace("(?:(?<![0-9])|\\G)", "").replace("++", "+").replace("}+", "}").replace("?+", "?")  # noqa: E731  what only bounds Java's matcher
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"(list_sum([CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT ELSE 2 * {digits}[-i]::INT - CASE WHEN {digits}[-i]::INT > 4 THEN 9 ELSE 0 END END for i in range(1, length({digits}) + 1)]) % 10 = 0)"
    bare = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
    number = f"array_to_string([CASE WHEN ascii({bare}[i]) >= 65 THEN (ascii({bare}[i]) - 55)::VARCHAR ELSE {bare}[i] END for i in range(1, length({bare}) + 1)], '')"
    mod = f"(list_reduce(list_prepend(0, [x::INT for x in string_split({number}, '')]), lambda a, x: (a * 10 + x) % 97) = 1)"
    beside = lambda c: f"NOT regexp_matches(right(before, 1), '{c}') AND NOT regexp_matches(left(after, 1), '{c}')"
    checks = {
        "email": "true",
        "ip": "list_aggregate([regexp_matches(ltrim(x, '0'), '^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$') for x in string_split(m, '.')], 'bool_and')",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{beside(pii.NOT_BESIDE['iban'])} AND {mod}",
        "ssn": f"{beside(pii.NOT_BESIDE['ssn'])} AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(right(before, {pii.CONTEXT_CHARS}), '{pii.CONTEXT['ssn']}')",
    }
    one = []
    for rank, kind in enumerate(pii.KINDS):
        p = plain(pii.PATTERNS[kind])
        one.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT doc_id, ms[i] AS m, ps[i] AS before, ps[i + 1] AS after, list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS start
FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM documents WHERE regexp_matches(text, '{p}')))) WHERE {checks[kind]}""")
    name = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    counts = ", ".join(f"count(s.kind) FILTER (WHERE s.kind = '{k}') AS n_{k}" for k in pii.BASE)
    return f"""WITH s AS ({' UNION ALL '.join(one)}) SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({name}, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(pii.BASE)}), '')) AS base_sha256,
coalesce(string_agg({name}, ',' ORDER BY start, rank), '') AS spans FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    return wrapper.extract_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents that are not held out."""
    return language.identify(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level BPE of 50k entries."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


#: Exact sets, all pairs that share a shingle, and the closure of the links.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.least, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether rules and robust distances keep it."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


#: Fixed rules: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM u
), r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
       (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, verdict DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, verdict DESC LIMIT 1), 'allow') AS verdict
FROM h
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and survivor of every document; 4-word shingles, similarity 0.8 or more."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from wavelet shards."""
    path = storage.new_path(spark, "wavelet")
    wavelet.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0, path)
    return wavelet.documents(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_pii, op3_html_wrapper, op4_language_id, op5_token_counts, op6_url_filter, op7_minhash_near_dedup, op8_quality_rules, op9_byte_bpe, op10_wavelet_shards)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_pii": _pii_sql(), "op6_url_filter": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL}
