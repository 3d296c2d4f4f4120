"""From passages to moments: the utterance that answers, when its first matching word is spoken, and which moments stay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.text import tokens, word_count
from confab.functions.vectors import cosine
from confab.operators.islands import before
from confab.operators.retrieval import idf

SHORT_WORDS = 4


def passage_utterances(passages: DataFrame, utterances: DataFrame) -> DataFrame:
    """Passages joined to the utterances in [utt_start, utt_end): the range is exploded, so that the join is an equi-join."""
    spots = passages.where("utt_end > utt_start").withColumn("idx", F.explode(F.sequence("utt_start", F.col("utt_end") - 1)))
    return spots.join(utterances, ["file_id", "idx"])


def highlight(words: Column, lexemes: Column) -> Column:
    """array<struct<from, to, at>>: character spans of the words that hold a lexeme, in the text that joins the words by
    single spaces, and when each is spoken. words: array<struct<token, start_sec, ...>>."""
    step = lambda acc, w: F.struct(
        (acc["pos"] + F.length(w["token"]) + 1).alias("pos"),
        F.when(F.arrays_overlap(tokens(w["token"]), lexemes), F.concat(acc["hits"], F.array(F.struct(acc["pos"].alias("from"), (acc["pos"] + F.length(w["token"])).alias("to"), w["start_sec"].alias("at"))))).otherwise(acc["hits"]).alias("hits"),
    )
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<from:int,to:int,at:double>>").alias("hits"))
    return F.aggregate(words, start, step, lambda acc: acc["hits"])


def spans_of_markup(marked: Column, open_: str = "\x02", close: str = "\x03") -> Column:
    """array<struct<from, to>> of the marked stretches in the text without marks."""
    parts = F.split(marked, open_)
    step = lambda acc, p: F.struct(
        (acc["pos"] + F.length(F.replace(p, F.lit(close), F.lit("")))).alias("pos"),
        F.when((acc["n"] > 0) & p.contains(close) & ~p.startswith(close), F.concat(acc["spans"], F.array(F.struct(acc["pos"].alias("from"), (acc["pos"] + F.instr(p, close) - 1).alias("to"))))).otherwise(acc["spans"]).alias("spans"),
        (acc["n"] + 1).alias("n"),
    )
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def lexeme_gains(lexemes: DataFrame, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, lexeme, gain): idf times the greatest weight; lexemes that the corpus lacks have none."""
    n = corpus.select(F.col("n_docs").cast("double").alias("n"))  # one row
    top = lexemes.groupBy("query_id", "lexeme").agg(F.max("weight").alias("weight"))
    return top.join(stats, "lexeme").crossJoin(F.broadcast(n)).select("query_id", "lexeme", (F.col("weight") * idf(F.col("n"), F.col("df"))).alias("gain"))


def snap(candidates: DataFrame, gains: DataFrame, alpha: Column, semantic: Column | None = None) -> DataFrame:
    """The best utterance of each (query_id, id), the earliest of equals.

    candidates: a row a query, passage and utterance, with idx, text, q_vector and embedding if `semantic` is None, and
    `lexemes`, the utterance's lexemes. Lexical evidence is scaled by the passage's greatest, semantic evidence to
    [0, 1], half for utterances under four words; alpha weighs the lexical one where there is any.
    """
    matched = candidates.select("query_id", "id", "idx", F.explode(F.array_distinct("lexemes")).alias("lexeme")).join(gains, ["query_id", "lexeme"])
    evidence = matched.groupBy("query_id", "id", "idx").agg(F.sum("gain").alias("lex"))
    rows = candidates.join(evidence, ["query_id", "id", "idx"], "left").withColumns(
        {"lex": F.round(F.coalesce("lex", F.lit(0.0)), 9), "sem": F.round(F.coalesce(cosine(F.col("q_vector"), F.col("embedding")) if semantic is None else semantic, F.lit(0.0)), 6)}
    )
    w = Window.partitionBy("query_id", "id")
    top, low, high = F.max("lex").over(w), F.min("sem").over(w), F.max("sem").over(w)
    sem = F.when(high > low, (F.col("sem") - low) / (high - low)).otherwise(0.0) * F.when(word_count(F.col("text")) < SHORT_WORDS, 0.5).otherwise(1.0)
    share = F.when(top > 0, alpha).otherwise(0.0)
    score = share * F.when(top > 0, F.col("lex") / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0) + (1 - share) * sem
    rows = rows.withColumn("snap_score", F.round(score, 9))
    return rows.withColumn("_first", F.row_number().over(w.orderBy(F.desc("snap_score"), "idx"))).where("_first = 1").drop("_first")


def keep_moments(moments: list[tuple], gap: float, overlap: float) -> list[int]:
    """Positions kept, greedily in order. moments: (file, utterance id, utterance start, passage start, passage end)."""
    kept: dict[str, list[tuple]] = {}
    out = []
    for i, m in enumerate(moments):
        rivals = kept.setdefault(m[0], [])
        for r in rivals:
            shorter = max(min(r[4] - r[3], m[4] - m[3]), 1e-6)
            if r[1] == m[1] or abs(r[2] - m[2]) < gap or max(0.0, min(r[4], m[4]) - max(r[3], m[3])) / shorter > overlap:
                break
        else:
            rivals.append(m)
            out.append(i)
    return out


def suppress(moments: DataFrame, gap: float = 10.0, overlap: float = 0.5) -> DataFrame:
    """Temporal non-maximum suppression in order of `position` within each query: a moment goes if a better one of the same
    file has its utterance, starts within `gap` seconds or has an overlapping passage. A query has a bounded pool."""
    need = ["query_id", "position", "file_id", "utterance_id", "utt_start_sec", "chunk_start", "chunk_end"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", kind="stable")
        rows = list(pdf[need[2:]].itertuples(index=False, name=None))
        return pdf.iloc[keep_moments(rows, gap, overlap)][["query_id", "position"]]

    kept = moments.select(*need).groupBy("query_id").applyInPandas(run, "query_id string, position int")
    return moments.join(kept, ["query_id", "position"])


def pool_size(k: int) -> int:
    """Candidates that are looked at for k results."""
    return max(3 * k, k + 20)


def as_of(utterances: DataFrame, moments: DataFrame, slack: float = 0.05) -> DataFrame:
    """(file_id, at, id): the last utterance that starts at or before each moment plus slack. An as-of join by the greatest
    start before each row of the union of both sides, chunk by chunk; moments: file_id, at."""
    sides = utterances.select("file_id", F.col("start_sec").alias("t"), F.lit(0).alias("side"), "id", F.lit(None).cast("double").alias("at")).unionByName(
        moments.select("file_id", (F.col("at") + slack).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("id"), "at")
    )
    seen = before(sides, ["file_id"], ["t", "side", "id"], maxima={"found": F.when(F.col("side") == 0, F.struct("t", "id"))})
    return seen.where("side = 1").select("file_id", "at", F.col("found.id").alias("id"))


__all__ = ["as_of", "highlight", "keep_moments", "lexeme_gains", "passage_utterances", "pool_size", "snap", "spans_of_markup", "suppress"]
