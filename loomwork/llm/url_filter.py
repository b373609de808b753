"""URL filters by host-suffix and path-prefix expressions.

A rule names a host and a path; it fits the host and all its subdomains where
the URL's path starts with the rule's.  Each URL is expanded into the suffixes
of its host at label borders, with the prefixes of its path at the lengths
that rules have; expressions meet rules in an equi-join on a short prefix of
their SHA-256, and what meets is confirmed on the full digests.  The longest rule
wins, between rules of one length the one that blocks.  A URL without a rule gets
the default verdict.

Defined results: a null URL or one without ``://`` has an empty host and path
and no rule; repeated rows stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join compares.
SHORT = 8
#: At most so many rules are broadcast (about 200 bytes each); more are joined by shuffling.
RULES_TO_SEND = 50_000

Rules = list[tuple[str, str, str]]


def split_url(url):
    """(host, path) of a URL column."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """verdict, rule, digest, short and rank (precedence, the highest wins) of rules (verdict, host, path)."""
    order = sorted(set(rules), key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2], r))
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(order)], "verdict string, rule_host string, rule_path string, rank int")
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    return df.select("verdict", F.concat("rule_host", "rule_path").alias("rule"), digest.alias("digest"), "rank").withColumn("short", F.substring("digest", 1, SHORT))


def judge(pages: DataFrame, rules: Rules, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url)."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = rule_table(spark, rules)
    sizes = F.array(*(F.lit(n) for n in sorted({len(p) for _, _, p in rules})))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.expr("path").substr(F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, F.lit("\n"), p), 256))))
    # a number for each row, as equal rows stay rows; an expression of no URL keeps those that no rule can fit
    url = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.explode_outer(digests)).withColumn("short", F.substring("digest", 1, SHORT))
    few = len(rules) <= RULES_TO_SEND
    keys = table.select("short", F.col("digest").alias("rule_digest"), "rank")
    met = url.join(F.broadcast(keys) if few else keys, "short", "left")
    # rows of one short prefix meet; the whole digest confirms
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("rank"))).alias("rank"))
    names = table.select("rank", "rule", "verdict")
    out = best.join(F.broadcast(names) if few else names, "rank", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
