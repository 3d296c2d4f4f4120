"""Comparisons: systems, fusion settings, index variants, and ways to label words with speakers."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.config import IndexVariant, SearchOptions, Settings
from confab.operators import diarization, evaluation
from confab.plans.search import Index, search
from confab.session import stage
from confab.sources import transcripts


def judge(ix: Index, golden: DataFrame, options: SearchOptions, settings: Settings = Settings()) -> DataFrame:
    """One row a labelled query: its metrics under these options. golden: id, query, role, relevant."""
    queries = golden.select(F.col("id").alias("query_id"), "query", "role")
    hits = search(ix, queries, options, settings).select("query_id", "rank", F.col("file_id").alias("file"), "start_sec", "end_sec")
    gold = transcripts.golden_moments(golden)
    return evaluation.query_metrics(evaluation.interval_hits(hits, gold, settings.tolerance), gold)


def _all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def compare(ix: Index, golden: DataFrame, systems: dict[str, SearchOptions], settings: Settings = Settings()) -> DataFrame:
    """(system, query_id, metrics) of all systems over one index; each system's metrics are written once."""
    return _all(stage(judge(ix, golden, options, settings).withColumn("system", F.lit(name))) for name, options in systems.items())


def fusion_sweep(ix: Index, golden: DataFrame, rrf_k: tuple[int, ...] = (5, 10, 60), candidates: tuple[int, ...] = (30, 50), coverage: tuple[bool, ...] = (False, True), fusion: tuple[str, ...] = ("rrf", "cc"), settings: Settings = Settings()) -> DataFrame:
    """Metrics of every combination of fusion settings; `system` names the combination."""
    parts = []
    for k, n, c, f in itertools.product(rrf_k, candidates, coverage, fusion):
        options = SearchOptions(coverage=c, fusion=f)
        rows = judge(ix, golden, options, dataclasses.replace(settings, rrf_k=k, candidates=n))
        parts.append(stage(rows.withColumn("system", F.lit(f"{f} k={k} n={n} coverage={c}"))))
    return _all(parts)


def index_grid(build: Callable[[IndexVariant], Index], golden: DataFrame, variants: Iterable[IndexVariant], options: SearchOptions = SearchOptions()) -> DataFrame:
    """Metrics of the same search over several builds of the index."""
    return _all(stage(judge(build(v), golden, options, v.settings).withColumn("system", F.lit(v.name))) for v in variants)


def significance(metrics: DataFrame, value: str, a: str, b: str, limit: int = 100_000) -> float:
    """p of the paired sign-flip test between two systems over the queries both answered; at most `limit` queries."""
    rows = metrics.where(F.col("system").isin(a, b)).groupBy("query_id").pivot("system", [a, b]).agg(F.first(value)).dropna().orderBy("query_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} queries")
    return evaluation.permutation_p([r[a] for r in rows], [r[b] for r in rows])


def diarization_ablation(scored: DataFrame, truth: DataFrame, penalty: float = 4.0, discount: float = 0.15) -> DataFrame:
    """Share of words with a wrong speaker under four labelers: the best speaker word by word, a smoothed path with one
    cost, with discounted boundaries, and the majority of a segment. The order of speakers in `loglik` is that of `names`.

    scored: file_id, word_idx, segment, is_boundary, loglik array, names array; truth: file_id, word_idx, speaker.
    """
    best = F.array_position(F.col("loglik"), F.array_max("loglik")).cast("int")
    single = scored.select("file_id", "word_idx", F.get("names", best - 1).alias("speaker"))
    flat = scored.withColumn("is_boundary", F.lit(False))
    paths = {"raw": single, "segment-majority": diarization.segment_majority(scored.select("file_id", "segment", "word_idx", F.explode(F.arrays_zip("names", "loglik")).alias("x")).select("file_id", "segment", "word_idx", F.col("x.names").alias("speaker"), F.col("x.loglik").alias("loglik"))).select("file_id", "word_idx", "speaker")}
    for name, rows, share in (("uniform", flat, 1.0), ("boundary", scored, discount)):
        smoothed = diarization.smooth_words(rows.select("file_id", "word_idx", "is_boundary", "loglik"), penalty, share)
        paths[name] = smoothed
    # Labels of smoothed paths are numbered by appearance: the majority of a label's words names it.
    out = []
    for name, rows in paths.items():
        both = rows.join(truth.withColumnRenamed("speaker", "true"), ["file_id", "word_idx"])
        votes = both.groupBy("file_id", "speaker", "true").agg(F.count(F.lit(1)).alias("n"))
        hit = votes.withColumn("r", F.row_number().over(Window.partitionBy("file_id", "speaker").orderBy(F.desc("n"), "true"))).groupBy().agg(F.sum(F.when(F.col("r") == 1, F.col("n"))).alias("right"), F.sum("n").alias("words"))
        out.append(hit.select(F.lit(name).alias("labeler"), "words", F.round(1 - F.col("right") / F.col("words"), 6).alias("error")))
    return _all(out)
