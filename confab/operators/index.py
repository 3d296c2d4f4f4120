"""The lexical index as DataFrames: postings, document frequencies, lengths, vocabulary; built whole or by deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.phonetics import sound_keys
from confab.functions.stem import english
from confab.functions.text import content_tokens, vocabulary_terms

ANALYZERS: dict[str, Callable[[Column], Column]] = {"simple": content_tokens, "english": english}


def latest(table: DataFrame, keys: list[str], columns: list[str], order: str | None = "indexed_at") -> DataFrame:
    """One row a key, of several the latest; only the needed columns are shuffled."""
    order = order if order in table.columns else None
    picked = F.max_by(F.struct(*columns), F.struct(*([order] if order else []), *columns)) if columns else None
    rest = [c for c in columns if c not in keys]
    return table.groupBy(*keys).agg(picked.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def occurrences(chunks: DataFrame, analyzer: str = "simple", text: str = "text") -> DataFrame:
    """(lexeme, chunk_id, position): one row an occurrence."""
    return chunks.select(F.col("id").alias("chunk_id"), F.posexplode(ANALYZERS[analyzer](F.col(text))).alias("position", "lexeme"))


def postings(chunks: DataFrame, analyzer: str = "simple") -> DataFrame:
    """(lexeme, chunk_id, tf)."""
    return occurrences(chunks, analyzer).groupBy("lexeme", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(lexeme, df)."""
    return posted.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(chunks: DataFrame, posted: DataFrame) -> DataFrame:
    """(chunk_id, doc_len): lexeme occurrences, 0 where a chunk has none."""
    counted = posted.groupBy("chunk_id").agg(F.sum("tf").alias("doc_len"))
    return chunks.select(F.col("id").alias("chunk_id")).join(counted, "chunk_id", "left").select("chunk_id", F.coalesce("doc_len", F.lit(0)).cast("long").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, sum_doc_len."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("sum_doc_len"))


def vocabulary(chunks: DataFrame, keys: bool = True) -> DataFrame:
    """(term, df) of surface terms, by chunk; with sound keys where asked for."""
    terms = chunks.select("id", F.explode(vocabulary_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.withColumn("k", sound_keys(F.col("term"))).select("term", "df", "k.metaphone", F.col("k.first").alias("dmetaphone"), F.col("k.second").alias("dmetaphone_alt")) if keys else terms


def signature(*columns: str) -> Column:
    """Content hash of a row: the first 24 hex digits of the SHA-256 of its JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 24)


def changed(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose (keys, signature) isn't stored: what an idempotent index has to do."""
    return new.join(stored.select(*keys, "signature"), [*keys, "signature"], "left_anti")


def delta(posted: DataFrame, sign: int) -> DataFrame:
    """The change of document frequencies that adding (1) or deleting (-1) these postings makes."""
    return posted.groupBy("lexeme").agg((sign * F.count(F.lit(1))).alias("df"))


def merge_counts(stored: DataFrame, *deltas: DataFrame, key: str = "lexeme", value: str = "df") -> DataFrame:
    """Counts after deltas; addition is associative, so any number merge in one shuffle. Keys that fall to 0 go."""
    out = stored.select(key, value)
    for d in deltas:
        out = out.unionByName(d.select(key, value))
    return out.groupBy(key).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def corpus_delta(lengths: DataFrame, sign: int) -> DataFrame:
    """The change of n_docs and sum_doc_len that adding (1) or deleting (-1) these passages makes."""
    return corpus_stats(lengths).select((sign * F.col("n_docs")).alias("n_docs"), (sign * F.col("sum_doc_len")).alias("sum_doc_len"))


def merge_corpus(stored: DataFrame, *deltas: DataFrame) -> DataFrame:
    """n_docs and sum_doc_len after deltas, one row."""
    out = stored.select("n_docs", "sum_doc_len")
    for d in deltas:
        out = out.unionByName(d.select("n_docs", "sum_doc_len"))
    return out.agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_doc_len").alias("sum_doc_len"))


def drift(kept: DataFrame, computed: DataFrame, key: str = "lexeme", value: str = "df") -> DataFrame:
    """Keys whose kept and recomputed values differ, missing ones included."""
    a, b = kept.select(key, F.col(value).alias("kept")), computed.select(key, F.col(value).alias("computed"))
    return a.join(b, key, "full").where(~F.col("kept").eqNullSafe(F.col("computed")))


def without(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Cascade of a deletion: rows whose key was deleted go."""
    return table.join(deleted.select(key).distinct(), key, "left_anti")


def check_model(meta: DataFrame, model: str, dim: int) -> None:
    """Refuses to search an index that another embedding model or dimension built. meta: key, value rows."""
    found = {r["key"]: r["value"] for r in meta.where(F.col("key").isin("embedding_model", "embedding_dim")).limit(2).collect()}
    if found and (found.get("embedding_model"), found.get("embedding_dim")) != (model, str(dim)):
        raise ValueError(f"the index was built with {found}, not with {model} of {dim} dimensions")
