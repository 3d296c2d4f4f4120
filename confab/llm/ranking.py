"""One ranking from several differently scaled scores (problem 6).

Method: in each query and channel a score becomes its empirical percentile, ties averaged and absent items tied behind
all others; the inverse normal distribution maps percentiles to one scale, and items are ordered by the weighted mean.

Percentiles come from one order of all scores by query, channel, value and item, cut into ranges: a range counts its own
rows, and what lies before it follows from the first and last group of every range. So a query of any size, and equal
scores in any number, are spread over as many tasks as their rows ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.session import stage

#: Channels in which a low score is the better one.
ASCENDING = ("dense_l2",)
#: Parts of a query whose scores are summed apart.
SALTS = 16

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, within 1.2e-9 relative error."""
    q = p - 0.5
    r = q * q
    tail = lambda x: _poly(C, x) / _poly((*D, 1.0), x)
    return (
        F.when(p < LOW, tail(F.sqrt(-2 * F.log(p))))
        .when(p > 1 - LOW, -tail(F.sqrt(-2 * F.log(1 - p))))
        .otherwise(_poly(A, r) * q / _poly((*B, 1.0), r))
    )


RANGE = "query_id string, channel string, value double, id string, range int, below bigint, ties bigint, place bigint, total bigint, edge boolean, tied boolean"


def range_ranks(rows: DataFrame) -> DataFrame:
    """Adds to each (query_id, channel, value, id) how many rows of its query and channel have a lower value (below), how
    many the same (ties), its place from 1 in order of value and id, and the number of all (total). Values are not null."""
    schema = pa.schema(
        [("query_id", pa.string()), ("channel", pa.string()), ("value", pa.float64()), ("id", pa.string()), ("range", pa.int32()), ("below", pa.int64()), ("ties", pa.int64()), ("place", pa.int64()), ("total", pa.int64()), ("edge", pa.bool_()), ("tied", pa.bool_())]
    )

    def count(batches):  # noqa: ANN001, ANN202
        batches = list(batches)
        n = sum(b.num_rows for b in batches)
        if not n:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        group = np.zeros(n, dtype=bool)
        group[0] = True
        for c in ("query_id", "channel"):
            codes = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            group[1:] |= codes[1:] != codes[:-1]
        value = t.column("value").to_numpy()
        tie = group.copy()
        tie[1:] |= value[1:] != value[:-1]
        at = np.arange(n)

        def spans(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of each row: the first row of its span and the span's size; and the rows that open the first and last one."""
            first = np.flatnonzero(opens)
            own = np.cumsum(opens) - 1
            outer = np.zeros(n, dtype=bool)
            outer[[first[0], first[-1]]] = True
            return first[own], np.diff(np.append(first, n))[own], outer

        g, total, edge = spans(group)
        f, ties, tied = spans(tie)
        more = [np.full(n, TaskContext.get().partitionId(), dtype=np.int32), f - g, ties, at - g + 1, total, edge, tied]
        yield from pa.Table.from_arrays([*(t.column(c) for c in ("query_id", "channel", "value", "id")), *map(pa.array, more)], schema=schema).to_batches(max_chunksize=20_000)

    keys = ["query_id", "channel", "value", "id"]
    counted = stage(rows.select(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count, RANGE))
    # Two rows a range at most: its first and last group, and its first and last value.
    before = lambda *by: Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    group, tie = ("query_id", "channel"), ("query_id", "channel", "value")
    edges = counted.where("edge").select("range", *group, "total")
    edges = edges.select("range", *group, F.coalesce(F.sum("total").over(before(*group)), F.lit(0)).alias("ahead"), F.sum("total").over(Window.partitionBy(*group)).alias("all"))
    equal = counted.where("tied").select("range", *tie, "ties")
    equal = equal.select("range", *tie, F.coalesce(F.sum("ties").over(before(*tie)), F.lit(0)).alias("same_ahead"), F.sum("ties").over(Window.partitionBy(*tie)).alias("same"))
    out = counted.join(F.broadcast(edges), ["range", *group], "left").join(F.broadcast(equal), ["range", *tie], "left")
    ahead = F.coalesce("ahead", F.lit(0))
    return out.select(*keys, (F.col("below") + ahead - F.coalesce("same_ahead", F.lit(0))).alias("below"), F.coalesce("same", "ties").alias("ties"), (F.col("place") + ahead).alias("place"), F.coalesce("all", "total").alias("total"))


def normal_scores(fused: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, score): the mean of the normal scores of all channels a query has, by weight (1 unless given).

    Repeated (query_id, id) count once, the greater raw scores winning. NaN and null scores count as absent. An item
    without any score is tied last everywhere; rows without query_id or id take no part. Items themselves are counted as a
    channel without name; a channel whose name is null or empty is none.
    """
    pairs = fused.where("query_id is not null and id is not null").select(F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"), "raw")
    entry = F.struct(F.lit("").alias("key"), F.lit(0.0).alias("value"))
    scored = F.filter(F.coalesce(F.map_entries("raw"), F.array().cast("array<struct<key:string,value:double>>")), lambda e: (e["key"] != "") & e["value"].isNotNull() & ~F.isnan(e["value"]))
    oriented = F.transform(scored, lambda e: F.struct(e["key"].alias("key"), (F.when(e["key"].isin(*ASCENDING), -e["value"]).otherwise(e["value"]) + 0.0).alias("value")))
    rows = pairs.select("query_id", "id", F.explode(F.concat(F.array(entry), oriented)).alias("e")).groupBy("query_id", "id", F.col("e.key").alias("channel")).agg(F.max("e.value").alias("value"))
    ranked = range_ranks(rows).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    weight = F.lit(1.0) if not weights else F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")], F.lit(1.0))

    # A row a query: its items, and the score of one that is absent everywhere. Behind the total scores of a channel lie
    # items - total absent ones; ranks count from the lowest.
    totals = ranked.where("place = 1").select("query_id", "channel", "total")
    sizes = totals.groupBy("query_id").agg(F.max(F.when(F.col("channel") == "", F.col("total"))).alias("items"), F.collect_list(F.when(F.col("channel") != "", F.struct("channel", "total"))).alias("channels"))
    share = lambda below, n: (below + (n + 1) / 2 - 0.5) / F.col("items")
    absent = F.col("items") - F.col("total")
    last = F.when(absent > 0, inverse_normal(share(F.lit(0), absent))).otherwise(F.lit(0.0))
    each = sizes.select("query_id", "items", F.explode_outer("channels").alias("c")).select("query_id", "items", F.col("c.channel").alias("channel"), F.col("c.total").alias("total"))
    bases = each.groupBy("query_id").agg(F.max("items").alias("items"), F.sum(F.when(F.col("channel").isNotNull(), weight * last)).alias("base"), F.sum(F.when(F.col("channel").isNotNull(), weight)).alias("weights"))
    bases = bases.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gain = F.when(F.col("channel") == "", 0.0).otherwise(weight * (inverse_normal(share(absent + F.col("below"), F.col("ties"))) - last))
    gains = ranked.join(bases, ["query_id", "salt"]).groupBy("query_id", "salt", "id", "base", "weights").agg(F.sum(gain).alias("gain"))
    total = (F.col("base") + F.col("gain")) / F.col("weights")
    return gains.select("query_id", "id", F.round(F.coalesce(total, F.lit(0.0)), 9).alias("score"))


def leaders(scores: DataFrame) -> DataFrame:
    """(query_id, id) of each query's first item; ties go to the smaller id. Aggregated before it is shuffled."""
    best = scores.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("query_id", "b.id")


def full_ranking(scores: DataFrame) -> DataFrame:
    """Adds rank, from 1 in each query, best first; equal scores are ranked by id."""
    ranked = range_ranks(scores.select("query_id", F.lit("").alias("channel"), (-F.col("score") + 0.0).alias("value"), "id"))
    return ranked.select("query_id", "id", (-F.col("value") + 0.0).alias("score"), F.col("place").alias("rank"))
