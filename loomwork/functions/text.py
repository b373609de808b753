"""Text functions: normalisation, stop strings, specs, JSON requests (survey G1-G10, S12, S14)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

REPLACEMENT = "�"


def normalise(text: str) -> str:
    """G1: compatibility form, accents off, lower case, runs of blanks as one space; a text of blanks alone is one space."""
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    t = "".join(c for c in t if unicodedata.category(c) != "Mn").lower()
    t = re.sub(r"[ \t\r\n]+", " ", t)
    return t if t == " " else t.strip()


def normalised(column: Column) -> Column:
    """normalise() of a column, by Arrow batches."""

    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(normalise, na_action="ignore")

    return run(column)


def normalised_key(raw: Column, form: Column) -> Column:
    """The normal form, or the raw text where that is empty or holds a replacement character."""
    return F.when(F.contains(raw, F.lit(REPLACEMENT)) | (form == ""), raw).otherwise(form)


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """Text before the earliest of the stop strings; the whole text is looked at, so a stop that spans pieces is found."""
    places = F.filter(F.array(*(F.instr(text, s) for s in stops)), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.substring(text, F.lit(1), F.array_min(places) - 1)).otherwise(text)


def spec(text: Column) -> Column:
    """G6: "k:v,k:v" as a map of integers."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit(":")), lambda k, v: v.cast("int"))


def int_list(text: Column) -> Column:
    """G7: "1,2" as an array of integers; "" is empty."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def cpu_list(text: Column) -> Column:
    """S29: "0-3,8" as the array of its numbers."""
    part = lambda x: F.sequence(F.split(x, "-")[0].cast("int"), F.coalesce(F.try_element_at(F.split(x, "-"), F.lit(2)).cast("int"), F.split(x, "-")[0].cast("int")))
    return F.flatten(F.transform(F.split(text, ","), lambda x: part(F.trim(x))))


def tenths(x: Column) -> Column:
    """A number to one decimal as text; halves go away from zero."""
    t = F.floor(F.abs(x) * 10 + 0.5).cast("long")
    return F.concat(F.when((x < 0) & (t > 0), "-").otherwise(""), F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def base_name(path: Column) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def parse_reply(text: Column) -> Column:
    """Content, reasoning and tool_calls (array of name and arguments, as JSON) of a reply.

    A <think> part may come first, <tool_call> parts with a JSON object behind
    the content; a reply whose parts aren't closed or whose calls are no JSON
    with a name is all content.
    """
    opened = lambda tag: F.size(F.split(text, f"<{tag}>")) - F.size(F.split(text, f"</{tag}>"))
    calls = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    good = (opened("think") == 0) & (opened("tool_call") == 0) & F.forall(calls, lambda c: F.get_json_object(c, "$.name").isNotNull())
    reasoning = F.nullif(F.regexp_extract(text, r"(?s)^\s*<think>(.*?)</think>", 1), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>", ""), r"(?s)<tool_call>.*?</tool_call>", "")
    content = F.when(F.size(calls) + F.when(reasoning.isNull(), 0).otherwise(1) > 0, F.trim(rest)).otherwise(text)
    each = F.transform(calls, lambda c: F.struct(F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, "$.arguments").alias("arguments")))
    return F.struct(F.when(good, content).otherwise(text).alias("content"), F.when(good, reasoning).alias("reasoning"), F.when(good, each).otherwise(F.array().cast("array<struct<name:string,arguments:string>>")).alias("tool_calls"))


def emitted(pieces: Column) -> Column:
    """Texts to emit after each piece (bytes) of a reply: what ends within a character is held back until it is complete; one pass over the pieces."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(x: pd.Series) -> pd.Series:
        def one(row):
            if b"".join(row).isascii():
                return [piece.decode() for piece in row]
            out, held = [], b""
            for piece in row:
                held += piece
                try:
                    out.append(held.decode())
                    held = b""
                except UnicodeDecodeError:
                    out.append("")
            return out

        return x.map(one, na_action="ignore")

    return run(pieces)


def endpoint(path: Column, model: str) -> Column:
    """Status and body of the static endpoints."""
    listed = F.to_json(F.struct(F.lit("list").alias("object"), F.array(F.struct(F.lit(model).alias("id"), F.lit("model").alias("object"), F.lit("local").alias("owned_by"))).alias("data")))
    answer = lambda status, body: F.struct(F.lit(status).alias("status"), body.alias("body"))
    return F.when(path == "/v1/models", answer(200, listed)).when(path == "/health", answer(200, F.lit('{"status":"ok"}'))).otherwise(answer(404, F.lit('{"error":"not found"}')))


#: Fixed value: the request's fields.
REQUEST = "struct<max_tokens:int,max_completion_tokens:int,temperature:double,top_p:double,stream:boolean,stop:string,messages:array<struct<role:string,content:string>>>"


def request(body: Column) -> Column:
    """A chat request's parameters with defaults; stop may be a string or a list; null where the body is no JSON object."""
    r = F.from_json(body, REQUEST)
    raw = F.get_json_object(body, "$.stop")
    stops = F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    ok = F.get_json_object(body, "$").isNotNull()
    return F.when(
        ok,
        F.struct(
            F.coalesce(r["max_tokens"], r["max_completion_tokens"], F.lit(256)).alias("max_tokens"),
            F.coalesce(r["temperature"], F.lit(1.0)).alias("temperature"),
            F.coalesce(r["top_p"], F.lit(1.0)).alias("top_p"),
            F.coalesce(r["stream"], F.lit(False)).alias("stream"),
            stops.alias("stops"),
            F.coalesce(r["messages"], F.array().cast("array<struct<role:string,content:string>>")).alias("messages"),
        ),
    )


def response(text: Column, prompt_tokens: Column, completion_tokens: Column, limit: Column) -> Column:
    """A completion as JSON with usage totals; counts are of tokens."""
    usage = F.struct(prompt_tokens.alias("prompt_tokens"), completion_tokens.alias("completion_tokens"), (prompt_tokens + completion_tokens).alias("total_tokens"))
    choice = F.struct(F.lit(0).alias("index"), text.alias("text"), F.when(completion_tokens >= limit, "length").otherwise("stop").alias("finish_reason"))
    return F.to_json(F.struct(F.lit("text_completion").alias("object"), F.array(choice).alias("choices"), usage.alias("usage")))
