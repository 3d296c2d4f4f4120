"""Filling fixed-capacity containers with documents (problem 8).

Method: harmonic packing. A piece of size s has class k if capacity/(k+1) < s <= capacity/k, up to CLASSES; a container
opened for class k takes k pieces of that class. Pieces are spread over blocks of about BLOCK pieces by a hash, and workers
pack blocks independently, so each block leaves at most one container of a class short. Classes are taken from the largest
pieces to the smallest, and a class first fills the room that containers of the classes before it have left, the tightest
first; the smallest class fills its containers by running length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.measures import size_in_tokens
from confab.session import stage

CAPACITY = 1024
#: The last class holds all smaller pieces.
CLASSES = 24
#: Pieces of a block, on average.
BLOCK = 20_000

PACKED = "bin string, doc_id bigint, piece int, start bigint, length int, split boolean"


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, size): tokens of each document; of a repeated doc_id the largest row counts, null texts have none."""
    return documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(size_in_tokens(F.col("text"))).alias("size"))


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents up to the capacity whole, larger ones as full pieces and a rest; empty ones have no piece."""
    whole = F.greatest(F.ceil(F.col("size") / capacity).cast("int"), F.lit(1))
    cut = sizes.where("size > 0").select("doc_id", "size", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).cast("int").alias("length"), (F.col("size") > capacity).alias("split"))


def fill(lengths: list[int], capacity: int, classes: int = CLASSES) -> list[int]:
    """The container of each piece, pieces given from the longest to the shortest."""
    rooms: list[tuple[int, int]] = []  # (room, container) of closed containers
    placed, opened, i, n = [], 0, 0, len(lengths)
    while i < n:
        k = min(capacity // lengths[i], classes)
        left, count = 0, 0  # the container that is open for this class
        fresh: list[tuple[int, int]] = []
        while i < n and min(capacity // lengths[i], classes) == k:
            size = lengths[i]
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, to = rooms.pop(at)
                if room > size:
                    insort(rooms, (room - size, to))
            else:
                if left < size or (count == k and k < classes):
                    if left:
                        fresh.append((left, opened - 1))
                    opened, left, count = opened + 1, capacity, 0
                to, left, count = opened - 1, left - size, count + 1
            placed.append(to)
            i += 1
        if left:
            fresh.append((left, opened - 1))
        rooms = sorted([*rooms, *fresh])
    return placed


def pack(documents: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(bin, doc_id, piece, start, length, split): every token of every document in exactly one container, no container
    over the capacity, no document of at most `capacity` tokens split. Documents without tokens are in none."""
    parts = stage(pieces(sized(documents), capacity))
    blocks = max(1, parts.count() // block)
    parts = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))

    def pack_block(table: pa.Table) -> pa.Table:
        length, doc, piece = (table.column(c).to_numpy() for c in ("length", "doc_id", "piece"))
        order = np.lexsort((piece, doc, -length))
        to = fill(length[order].tolist(), capacity)
        name = f"{table.column('block')[0].as_py()}-"
        rows = table.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "split"])
        return rows.add_column(0, "bin", pa.array([name + str(k) for k in to], pa.string()))

    return parts.groupBy("block").applyInArrow(pack_block, PACKED)


def divided(packed: DataFrame) -> DataFrame:
    """(doc_id) of documents that lie in more than one container."""
    return packed.groupBy("doc_id").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a <> b").select("doc_id")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, share of the containers' capacity that is used."""
    bins = packed.groupBy("bin").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
