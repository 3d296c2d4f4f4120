"""Sizes and source names of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the size measure: a run of word characters or a run of other visible ones.
SIZE_TOKEN = r"(?U)\w+|[^\w\s]+"


def size_in_tokens(text: Column) -> Column:
    """Length in size tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_TOKEN)), F.lit(0))


def source_key(source: Column) -> Column:
    """One spelling of a source name: lower case, words joined by one underscore; null where nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")
    return F.when(key != "", key)
