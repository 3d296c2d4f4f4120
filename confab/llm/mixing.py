"""Mixing sources to target weights (problem 9).

Method: capped water-filling. The total is the size of all documents of the listed sources, each used once. Sources whose
share exceeds their size times max_repeats are clamped there, their excess goes to the others in proportion to the
weights, and again until all fit. A source that gets r times its size takes every document floor(r) times, and once
more those whose seeded hash falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.measures import size_in_tokens, source_key
from confab.session import stage

SEED = 17
#: More sources than this are refused: the allocation is solved on the driver over one row a source.
MOST_SOURCES = 100_000


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> tuple[dict[str, float], dict[str, int]]:
    """Size each source gets: proportional to weight, at most its cap; as much of the total as the caps allow. And the round
    in which each clamped source met its cap: in round 1 those whose cap is below the wanted share of the total, later
    those that the redistributed excess fills."""
    got: dict[str, float] = {}
    clamped: dict[str, int] = {}
    free, left = {s for s, w in weights.items() if w > 0}, total
    got.update({s: 0.0 for s in weights if s not in free})
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if caps[s] < weights[s] / weight * left}
        if not over:
            got.update({s: weights[s] / weight * left for s in free})
            break
        got.update({s: float(caps[s]) for s in over})
        step = 1 + max(clamped.values(), default=0)
        clamped.update({s: step for s in over})
        left -= sum(caps[s] for s in over)
        free -= over
    return got, clamped


def sized_sources(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size) with canonical source names; of a repeated doc_id the greatest (size, source) counts."""
    one = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(size_in_tokens(F.col("text")).alias("size"), source_key(F.col("source")).alias("source"))).alias("d"))
    return one.select("doc_id", "d.source", "d.size")


def allocation(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a listed source: documents, tokens, wanted share, cap, reaches (whether water-filling leaves it its wanted
    share of the total, that is doesn't clamp it in the first round), allotted tokens and repetitions. sized: as of
    `sized_sources`. Weights that are null or not positive want nothing; max_repeats that is null or under 1 counts as 1.
    Of targets spelt alike the greatest weight counts."""
    spark = sized.sparkSession
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).cast("long").alias("max_repeats"))
        .where("source is not null").groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.weight", "t.max_repeats")
    )
    held = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").cast("long").alias("tokens"))
    rows = [r.asDict() for r in wanted.join(held, "source", "left").na.fill(0, ["documents", "tokens"]).limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    rows.sort(key=lambda r: r["source"])
    total, weight = sum(r["tokens"] for r in rows), sum(r["weight"] for r in rows)
    caps = {r["source"]: r["tokens"] * r["max_repeats"] for r in rows}
    got, clamped = water_fill({r["source"]: r["weight"] for r in rows}, caps, total)
    out = []
    for r in rows:
        s = r["source"]
        out.append((s, r["documents"], r["tokens"], r["max_repeats"], r["weight"] / weight if weight else 0.0, float(caps[s]), clamped.get(s) != 1, clamped.get(s), got[s], got[s] / r["tokens"] if r["tokens"] else 0.0))
    return spark.createDataFrame(out, "source string, documents long, tokens long, max_repeats long, share double, cap double, reaches boolean, clamped int, allotted double, repeats double")


def copies(sized: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, copies): how often each document of a listed source is used, at least once."""
    # One row a listed source, at most MOST_SOURCES of them.
    docs = sized.join(F.broadcast(plan.select("source", "repeats")), "source")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("repeats")
    n = (whole + F.when(draw < F.col("repeats") - whole, 1).otherwise(0)).cast("int")
    return docs.withColumn("copies", n).where("copies > 0").select("doc_id", "source", "size", "copies")


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """`copies` under the allocation of the targets. The texts are read once; their sizes are kept."""
    sized = stage(sized_sources(documents))
    return copies(sized, allocation(sized, targets), seed)


def shares(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """Per listed source: wanted share, actual tokens and share of the mix, most repetitions."""
    sized = stage(sized_sources(documents))
    plan = allocation(sized, targets)
    used = copies(sized, plan, seed).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    joined = plan.join(used, "source", "left").na.fill(0, ["used", "most_copies"])
    total = joined.agg(F.sum("used").alias("all_used"))
    return joined.crossJoin(F.broadcast(total)).select(
        "source", "tokens", "share", "reaches", "allotted", "used", "most_copies", F.round(F.col("used") / F.greatest(F.col("all_used"), F.lit(1)), 6).alias("actual_share")
    )
