"""Nested values packed as JSON: word triples and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIPLES = "array<array<string>>"


def word_triples(packed: Column) -> Column:
    """array<struct<token, start_sec, end_sec>> of a JSON list of [token, start, end]; null where it isn't one."""
    return F.transform(F.from_json(packed, TRIPLES), lambda t: F.struct(F.get(t, F.lit(0)).alias("token"), F.get(t, F.lit(1)).cast("double").alias("start_sec"), F.get(t, F.lit(2)).cast("double").alias("end_sec")))


def packed_triples(words: Column) -> Column:
    """The JSON list of such structs; times to the millisecond."""
    time = lambda x: F.coalesce(F.round(x, 3).cast("string"), F.lit("null"))
    token = lambda t: F.substring(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2)
    parts = F.transform(words, lambda w: F.concat(F.lit("["), token(w["token"]), F.lit(", "), time(w["start_sec"]), F.lit(", "), time(w["end_sec"]), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def packed_fields(*columns: str) -> Column:
    """A JSON object of the named columns that aren't null."""
    return F.to_json(F.struct(*columns))


def field(packed: Column, name: str) -> Column:
    return F.get_json_object(packed, f"$.{name}")
