"""Ordered-sequence building blocks: what lies before a row, islands of rows that belong together, interval unions.

A sequence (a recording) may hold a large share of all rows, so none is ordered as a whole: windows run inside chunks of
neighbouring rows, what lies before a chunk follows from one summary row a chunk, and the two are joined by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a chunk, and seconds where the order is that of times.
CHUNK, CHUNK_SEC = 2048, 600.0


def chunk_of(order: list[str], schema: dict[str, str]) -> Column:
    """The chunk of a row by the first column of the order, a position or a time; null sorts first."""
    wide = CHUNK_SEC if schema[order[0]] in ("double", "float") else CHUNK
    return F.coalesce(F.floor(F.col(order[0]) / wide), F.lit(-(1 << 40)))


def before(df: DataFrame, keys: list[str], order: list[str], last: list[str] = (), sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lead: list[str] = ()) -> DataFrame:
    """Adds to each row what lies before it in its sequence: has_last, and last_<column> of the row before; sums and maxima
    of all rows before, null where there is none; and lead_<column> of the row behind. Rows with a null key take no part."""
    sums, maxima = sums or {}, maxima or {}
    df = df.withColumn("_chunk", chunk_of(order, dict(df.dtypes)))
    by = [*keys, "_chunk"]
    inside = Window.partitionBy(*by).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    flagged = df.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_m_{n}": c for n, c in maxima.items()}) if sums or maxima else df
    row = F.struct(*order, *(F.col(c).alias(f"_v_{c}") for c in last))
    head = F.struct(*order, *(F.col(c).alias(f"_v_{c}") for c in lead))
    tops = flagged.groupBy(*by).agg(F.max(row).alias("_row"), F.min(head).alias("_head"), *(F.sum(f"_s_{n}").alias(f"_a_{n}") for n in sums), *(F.max(f"_m_{n}").alias(f"_b_{n}") for n in maxima))
    along = Window.partitionBy(*keys).orderBy("_chunk")  # a row a chunk
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, F.lag("_row").over(along).alias("_row"), F.lead("_head").over(along).alias("_head"), *(F.sum(f"_a_{n}").over(past).alias(f"_a_{n}") for n in sums), *(F.max(f"_b_{n}").over(past).alias(f"_b_{n}") for n in maxima))
    both = flagged.join(tops, by)
    first = F.row_number().over(inside) == 1
    out = {"has_last": ~first | F.col("_row").isNotNull()}
    for c in last:
        out[f"last_{c}"] = F.when(first, F.col(f"_row._v_{c}")).otherwise(F.lag(c).over(inside))
    for n in sums:
        near = F.sum(f"_s_{n}").over(upto)
        out[n] = F.when(near.isNull() & F.col(f"_a_{n}").isNull(), None).otherwise(F.coalesce(near, F.lit(0)) + F.coalesce(f"_a_{n}", F.lit(0)))
    for n in maxima:
        out[n] = F.greatest(F.max(f"_m_{n}").over(upto), F.col(f"_b_{n}"))
    end = F.lead(F.lit(1)).over(inside).isNull()
    for c in lead:
        out[f"lead_{c}"] = F.when(end, F.col(f"_head._v_{c}")).otherwise(F.lead(c).over(inside))
    return both.withColumns(out).select(*(c for c in df.columns if c != "_chunk" and c not in out), *out)


def islands(df: DataFrame, keys: list[str], order: list[str], opens: Column, name: str = "island") -> DataFrame:
    """Numbers stretches of rows from 0. `opens` is true where a row starts a new one, null counts as true; it is of the
    first row of each sequence."""
    return _numbered(df.withColumn("_opens", F.when(F.coalesce(opens, F.lit(True)), 1).otherwise(0)), keys, order, name)


def _numbered(flagged: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The number of openings up to each row, from 0. Of rows that tie in the order, one that opens comes first."""
    counted = before(flagged.withColumn("_rest", 1 - F.col("_opens")), keys, [*order, "_rest"], sums={"_sum": F.col("_opens")})
    return counted.withColumn(name, F.coalesce("_sum", F.lit(0)) + F.col("_opens") - 1).drop("_opens", "_rest", "_sum", "has_last")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float, *, inclusive: bool = True, extra: list[Column] | None = None) -> DataFrame:
    """Unions of intervals whose distance to the furthest earlier end is at most `gap` (less than it if not inclusive)."""
    order = [start, end]
    reached = before(df, keys, order, maxima={"_reach": F.col(end)})
    distance = F.col(start) - F.col("_reach")
    opens = F.col("_reach").isNull() | (distance > gap if inclusive else distance >= gap)
    numbered = _numbered(reached.withColumn("_opens", F.when(opens, 1).otherwise(0)), keys, order, "island")
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *(extra or []))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; planned with a group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
