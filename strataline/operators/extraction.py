"""Structured extraction: target schemas, an extractive instance of each, validation of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import text as T

# Of each target the list it fills, its text fields, its boolean fields, the required ones and the preferred item.
TARGETS = {
    "risk_factors": ("risk_factors", ("risk", "category", "evidence", "section"), (), ("risk", "evidence"), "1A"),
    "litigation": ("litigation", ("matter", "parties", "status", "evidence", "section"), (), ("matter", "evidence"), "3"),
    "mdna": ("highlights", ("topic", "summary", "evidence", "section"), (), ("topic", "evidence"), "7"),
    "internal_controls": ("controls", ("assessment", "evidence", "section"), ("material_weakness",), ("assessment", "evidence"), "9A"),
    "related_party": ("transactions", ("counterparty", "description", "evidence", "section"), (), ("description", "evidence"), "13"),
    "liquidity": ("concerns", ("concern", "severity", "evidence", "section"), (), ("concern", "evidence"), "7"),
}


def target(name: str) -> tuple:
    if name not in TARGETS:
        raise KeyError(f"unknown target {name!r}; known are {', '.join(sorted(TARGETS))}")
    return TARGETS[name]


def schema(name: str) -> str:
    array, texts, flags, _, _ = target(name)
    fields = ", ".join([f"{f}: string" for f in texts] + [f"{f}: boolean" for f in flags])
    return f"{array} array<struct<{fields}>>"


def preferred_item(name: str) -> str:
    return target(name)[4]


def instance(text: Column, name: str) -> Column:
    """The JSON a schema-bound extractive model gives: one entry for each of the first three sentences."""
    array, texts, flags, _, _ = target(name)
    entry = lambda s: F.struct(*[s.alias(f) for f in texts], *[F.lit(False).alias(f) for f in flags])
    return F.to_json(F.struct(F.transform(F.slice(T.sentences(text), 1, 3), entry).alias(array)))


def json_body(reply: Column) -> Column:
    """What a model reply holds within a code fence, else between the first { and the last }."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(reply, r"(?s)\{.*\}", 0))


def validated(replies: DataFrame, name: str, reply: str = "reply") -> DataFrame:
    """replies with data (parsed), valid and error. Valid means: JSON with the list of the target and its required fields in each entry."""
    array, _, _, required, _ = target(name)
    body = json_body(F.col(reply))
    parsed = F.from_json(body, schema(name))
    out = replies.withColumn("data", parsed)
    entries = F.col(f"data.{array}")
    complete = F.forall(entries, lambda e: ~F.exists(F.array(*[e[f].isNull() for f in required]), lambda x: x))
    error = F.when(F.coalesce(body, F.lit("")) == "", "no JSON").when(entries.isNull(), f"missing {array}").when(~complete, "missing required fields")
    return out.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def extract(hits: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """(query_id, data, valid, error): an extraction for each query from its retrieved chunks, those of the preferred item where there are any."""
    item = preferred_item(name)
    j = hits.join(chunks, "chunk_id")
    own = F.max(F.col("item_number") == item)
    from pyspark.sql.window import Window

    j = j.withColumn("has", own.over(Window.partitionBy("query_id"))).filter((F.col("item_number") == item) | ~F.col("has"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")
    g = j.groupBy("query_id").agg(text.alias("context"))
    return validated(g.select("query_id", instance(F.col("context"), name).alias("reply")), name)
