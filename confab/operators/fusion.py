"""Fusing ranked channels: reciprocal ranks, convex combination, coverage multipliers, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.retrieval import idf


def reciprocal_ranks(channels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, best, ranks, position): sum of weight * multiplier / (k + rank).

    channels: query_id, channel, id, rank, weight, multiplier. Channels of weight 0 or less are left out altogether.
    Ties go to the better single rank, then the smaller id.
    """
    used = channels.where("weight > 0")
    fused = used.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("weight") * F.col("multiplier") / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("ranks"),
    )
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "id")))


def convex(channels: DataFrame) -> DataFrame:
    """(query_id, id, score, best, ranks, position): sum of weighted scores scaled to [0, 1] in each channel; a channel
    without spread gives 1."""
    w = Window.partitionBy("query_id", "channel")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    scaled = channels.where("weight > 0").withColumn("part", F.col("weight") * F.when(span == 0, 1.0).otherwise((F.col("score") - low) / F.when(span == 0, 1.0).otherwise(span)))
    fused = scaled.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("rank").alias("best"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("ranks"))
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def coverage(lexemes: DataFrame, hits: DataFrame, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, coverage): share of a query's information that a hit's matched lexemes hold.

    Units are the query's own lexemes weighted by idf, the largest possible where the corpus lacks them. A matched unit
    counts fully, one matched through an expansion by the expansion's weight. lexemes: query_id, lexeme, weight, source;
    hits: query_id, id, matched.
    """
    n = corpus.select(F.col("n_docs").cast("double").alias("n"))  # one row
    units = lexemes.where("lexeme = source").select("query_id", F.col("lexeme").alias("unit")).distinct()
    units = units.join(stats.withColumnRenamed("lexeme", "unit"), "unit", "left").crossJoin(F.broadcast(n))
    units = units.select("query_id", "unit", F.coalesce(idf(F.col("n"), F.col("df")), F.log(1 + (F.col("n") + 0.5) / 0.5)).alias("w"))
    totals = units.groupBy("query_id").agg(F.sum("w").alias("total"))
    credit = F.when(F.col("lexeme") == F.col("source"), 1.0).otherwise(F.col("weight"))
    matched = hits.select("query_id", "id", F.explode("matched").alias("lexeme")).join(lexemes, ["query_id", "lexeme"]).groupBy("query_id", "id", F.col("source").alias("unit")).agg(F.max(credit).alias("credit"))
    got = matched.join(units, ["query_id", "unit"]).groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("credit")).alias("got"))
    share = hits.select("query_id", "id").join(got, ["query_id", "id"], "left").join(totals, "query_id", "left")
    return share.select("query_id", "id", F.round(F.coalesce(F.col("got") / F.col("total"), F.lit(0.0)), 9).alias("coverage"))


def overlap_score(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's distinct content tokens that the passage holds."""
    from confab.functions.text import content_tokens

    q = F.array_distinct(content_tokens(query))
    return F.size(F.array_intersect(q, content_tokens(text))) / F.greatest(F.size(q), F.lit(1))


def rerank(fused: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, top: int = 30, k: int = 10) -> DataFrame:
    """Scores the first `top` passages again and fuses both orders; the tail follows unchanged. texts: id, text; queries:
    query_id, q_text."""
    head = fused.where(F.col("position") <= top).join(texts.select("id", "text"), "id").join(queries.select("query_id", "q_text"), "query_id")
    head = head.withColumn("again", F.round(scorer(F.col("q_text"), F.col("text")), 9)).withColumn("rerank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("again"), "position")))
    score = F.round(1 / (k + F.col("position")) + 1 / (k + F.col("rerank")), 9)
    head = head.select("query_id", "id", score.alias("score"), F.least("position", "rerank").alias("best"), F.map_concat("ranks", F.create_map(F.lit("rerank"), F.col("rerank"))).alias("ranks"))
    head = head.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "id")))
    return head.unionByName(fused.where(F.col("position") > top).select(head.columns))
