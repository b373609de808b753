"""Personal data by regular expressions, checksums and context, in DataFrame functions only.

Expressions propose spans, leftmost and not overlapping per kind; validators
confirm them (Luhn for cards, mod-97 for bank account numbers, ranges for
addresses, digit counts for phones); words before a span adjust its score.
Spans are code points, the end exclusive.  The kinds email, ip, card and phone
are always kept once confirmed; other kinds need a score of at least 0.5.

Positions come from splitting a text at the matches: a match starts behind
all pieces and matches before it.  Repetitions are possessive or start at the
start of a run, so no text makes the expressions slow or deep.

Defined results: a null text is empty and has no spans; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
#: Score of a confirmed span, and words near it that raise it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write",
    "ip": r"(?i)(?:^|[^a-z])ip(?:[^a-z]|$)|address|server|host",
    "card": r"(?i)card|visa|credit|payment|account",
    "phone": r"(?i)phone|tel|call|mobile|fax",
    "iban": r"(?i)iban|bank|account",
    "ssn": r"(?i)(?:^|[^a-z])ssn(?:[^a-z]|$)|social|security",
}
#: What may not stand directly before or behind a span.
NOT_BESIDE = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]"}
CONTEXT_CHARS, BOOST, KEEP = 40, 0.3, 0.5
BLOCK = 256


def _matches(kind: str, text: Column) -> Column:
    """array<struct<start, end, match, before>> of all plausible matches of a kind.

    Running sums go over blocks of matches and then within each block, so a
    text with very many matches takes no quadratic time worth speaking of.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pieces = F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.struct(F.char_length(p).alias("n"), F.right(p, F.lit(CONTEXT_CHARS)).alias("near"), F.left(p, F.lit(1)).alias("first")))
    between = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.slice(pieces, F.lit(2), F.size(found)), lambda p, q: F.struct(p["n"].alias("n"), p["near"].alias("near"), q["first"].alias("after")))
    pairs = F.zip_with(found, between, lambda m, p: F.struct(m.alias("match"), p["n"].alias("n"), (p["n"] + F.char_length(m)).alias("step"), p["near"].alias("before"), p["after"].alias("after")))
    blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK)), lambda b: F.slice(pairs, b, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + F.aggregate(b, F.lit(0), lambda t, x: t + x["step"])).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["at"] + x["n"], acc["at"] + x["step"]
        span = F.struct(a.alias("start"), b.alias("end"), x["match"].alias("match"), x["before"].alias("before"))
        return F.struct(b.alias("at"), F.when(_plausible(kind, x), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def spans(block: Column, offset: Column) -> Column:
        begin = F.struct(offset.alias("at"), F.array().cast("array<struct<start:int,end:int,match:string,before:string>>").alias("out"))
        return F.aggregate(block, begin, step, lambda acc: acc["out"])

    return F.when(F.size(found) > 0, F.flatten(F.zip_with(blocks, offsets, spans))).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,before:string>>"))


def _plausible(kind: str, x: Column) -> Column:
    if kind in NOT_BESIDE:
        return ~F.right(x["before"], F.lit(1)).rlike(NOT_BESIDE[kind]) & ~x["after"].rlike(NOT_BESIDE[kind])
    return F.length(x["match"]) >= 12 if kind == "card" else F.lit(True)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.lit(2) * c.cast("int") - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (IBAN) leaves 1 modulo 97."""
    bare = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - F.lit(55))
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda a, v: (a * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v) % 97) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & F.when(F.length(_digits(match)).between(12, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


#: What a text must have for a kind to be looked for.
NEEDS = {"email": "@", "phone": "+"}


SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _found(rank: int, kind: str, text: Column) -> Column:
    def scored(s: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(s["before"].rlike(CONTEXT[kind]), F.lit(BOOST)).otherwise(F.lit(0.0)))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), score.alias("score"))

    good = F.transform(F.filter(_matches(kind, text), lambda s: _confirmed(kind, s["match"])), scored)
    if kind not in BASE:
        good = F.filter(good, lambda s: s["score"] >= KEEP)
    may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(may, good).otherwise(F.array().cast(SPANS))


def spans(text: Column) -> Column:
    """Spans of a column of texts without nulls: array of (start, rank of the kind, kind, end, score), by start, then kind as listed."""
    return F.array_sort(F.concat(*(_found(rank, kind, text) for rank, kind in enumerate(KINDS))))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and spans of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("spans", spans(F.col("text")))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans as text, of detect()'s rows."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]  # noqa: B023  read at once
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs (any columns, text among them) with the spans of its text replaced by their kinds, like [EMAIL].

    Where spans overlap, the first one's kind stands for both.  A null text
    becomes "".
    """
    found = "spans"
    while found.lower() in (c.lower() for c in docs.columns):
        found += "_"
    held = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(found, spans(F.col("text")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ahead = F.substring(F.col("text"), acc["at"] + F.lit(1), s["start"] - acc["at"])
        more = F.array(ahead, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], more).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + F.lit(1), F.char_length("text")))
    return held.withColumn("text", F.when(F.size(found) > 0, F.aggregate(found, start, step, end)).otherwise(F.col("text"))).drop(found)
