"""Most similar vectors for every vector (problem 3).

Method: additive quantisation. A unit vector is approximated by the sum of one word of each of several full-dimensional
codebooks, learnt on residuals and encoded by beam search; the norm of the approximation is stored with the code. The
words of the first two codebooks name a cell, so the number of cells is the square of what is learnt and broadcast: a
vector is kept in the cell of its own words and asks in the PROBES cells whose words fit it best. There, tables of inner
products with the codebooks score all vectors of the cell, and the best are reranked with the exact cosine.

Exact copies are one class with one vector, so a group of copies costs one vector; classes are expanded at the end.
Cells that the sample shows to be crowded are divided into blocks, of rows as well as of queries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.clusters import kmeans, nearest
from confab.session import stage

#: Vectors a cell should hold, on average; the sample the codebooks are learnt on: so many vectors at least, and a word.
CELL, SAMPLE, PER_WORD = 300, 16_384, 32
#: Books after the cells, words in each, beam, cells asked, candidates reranked.
BOOKS, WORDS, BEAM, PROBES, RERANK = 8, 16, 3, 4, 24
#: Candidates of a cell reranked without a floor.
RERANK_FAR = 128
#: Rows or queries of a cell in one block.
BLOCK = 8192
#: Without a floor a query asks in so many cells for each root of their number; a task holds neighbouring cells of about
#: GROUP vectors.
SPREAD, GROUP = 1.5, 32_768


class Codebooks:
    """first, second: the codebooks whose words name the cells; books: the further ones, (BOOKS, WORDS, dimension). Cell
    numbers run over the second words of each first one."""

    def __init__(self, first: np.ndarray, second: np.ndarray, books: np.ndarray):
        self.first, self.second, self.books = first, second, books
        self.half = [0.5 * (b * b).sum(1) for b in (first, second)]
        self.cross = first @ second.T

    @property
    def n_cells(self) -> int:
        return len(self.first) * len(self.second)

    @staticmethod
    def train(x: np.ndarray, cells: int, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> Codebooks:
        rng = np.random.default_rng(seed)
        x = x[rng.permutation(len(x))]
        side = max(1, int(np.ceil(cells**0.5)))
        first = np.unique(kmeans(x, side, rng), axis=0)  # equal words would take each other's probes
        rest = x - first[nearest(x, first)]
        second = np.unique(kmeans(rest, max(1, -(-cells // len(first))), rng), axis=0)
        rest = rest - second[nearest(rest, second)]
        found = []
        for _ in range(books):
            book = kmeans(rest, words, rng)
            rest = rest - book[nearest(rest, book)]
            found.append(book)
        return Codebooks(first.astype(np.float32), second.astype(np.float32), np.array(found, dtype=np.float32))

    def centre(self, cell) -> np.ndarray:  # noqa: ANN001
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells whose words are nearest, best first, by beam search over both books."""
        n = min(n, self.n_cells)
        beam = min(len(self.first), max(16, n))
        out = np.empty((len(x), n), dtype=np.int64)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            a, b = part @ self.first.T - self.half[0], part @ self.second.T - self.half[1]
            head = np.argpartition(-a, beam - 1, axis=1)[:, :beam]
            score = (np.take_along_axis(a, head, 1)[:, :, None] + b[:, None, :] - self.cross[head]).reshape(len(part), -1)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
            out[i : i + 1024] = np.take_along_axis(head, best // len(self.second), 1) * len(self.second) + best % len(self.second)
        return out

    def encode(self, x: np.ndarray, cell: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search over the books, and the norms of what they stand for."""
        n = len(x)
        rest = (x - self.centre(cell))[:, None, :]
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        for book in self.books:
            words = len(book)
            error = (rest * rest).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // words, best % words
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        at = np.arange(n)
        best = (rest * rest).sum(2).argmin(1)
        return codes[at, best], np.linalg.norm(x - rest[at, best], axis=1).astype(np.float32)

    def search(self, q: np.ndarray, cell: int, codes: np.ndarray, norms: np.ndarray, x: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the `take` best rows of the cell by table lookup, and their exact cosines."""
        take = min(take, len(x))
        picked = np.empty((len(q), take), dtype=np.int64)
        cosine = np.empty((len(q), take), dtype=np.float32)
        columns = np.ascontiguousarray(codes.T.astype(np.intp))
        for i in range(0, len(q), 512):
            part = q[i : i + 512]
            score = np.repeat((part @ self.centre(cell))[:, None], len(x), axis=1)
            for book, column in zip(self.books, columns):
                score += np.take(part @ book.T, column, axis=1)
            score /= np.maximum(norms, 1e-6)
            best = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
            picked[i : i + 512] = best
            cosine[i : i + 512] = np.einsum("qd,qkd->qk", part, x[best])
        return picked, cosine


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-30).astype(np.float32)


def vectors(table: DataFrame, key: str, column: str, order: str | None) -> DataFrame:
    """(id, code, vector) of rows with an id and a finite vector that isn't all zero; code is the same for equal vectors."""
    v = F.col(column).cast("array<float>")
    usable = F.coalesce(F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    at = F.col(order) if order else F.lit(0)
    return table.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.when(usable, F.xxhash64(v, F.size(v))).alias("code"), v.alias("vector"), at.alias("at"))


def class_neighbours(reps: DataFrame, n: int, dimension: int, k: int, floor: float, probes: int | None = PROBES) -> DataFrame:
    """(code, other, cosine): for each vector its k most similar among the candidates, if their cosine is floor or more.

    reps: (code, vector), distinct vectors of one dimension; n: their number, which sets the number of cells;
    probes: cells asked, None for a number that grows with them, so that recall holds for vectors without close ones.
    """
    spark = reps.sparkSession
    cells = max(1, n // CELL)
    wanted = max(SAMPLE, int(PER_WORD * cells**0.5))
    sample = reps.where(F.pmod(F.xxhash64("code", F.lit(3)), F.lit(max(1, -(-n // wanted)))) == 0)
    sample = matrix(sample.select("vector").toArrow().column("vector"))
    if not len(sample):
        sample = matrix(reps.limit(1).select("vector").toArrow().column("vector"))
    if not len(sample):
        return spark.createDataFrame([], "code bigint, other bigint, cosine float")
    books = spark.sparkContext.broadcast(Codebooks.train(sample, cells))  # as many words as two roots of the cells
    seen = np.bincount(books.value.probes(sample, 1)[:, 0], minlength=books.value.n_cells)
    blocks = np.maximum(1, np.ceil(seen / len(sample) * n / BLOCK)).astype(int)
    crowded = bool((blocks > 1).any())
    # Where many cells are asked, a vector goes once to each group of neighbouring cells.
    groups, take = None, max(RERANK, 4 * k)
    if probes is None:
        take = max(take, RERANK_FAR)  # codes tell vectors that are all far less well apart
        probes = max(PROBES, int(np.ceil(SPREAD * len(blocks) ** 0.5)))
        if not crowded:
            centres = kmeans(books.value.first, max(1, min(len(books.value.first), n // GROUP)), np.random.default_rng(7))
            groups = np.repeat(nearest(books.value.first, centres), len(books.value.second))
    columns = ["cell", "block", "side", "role", "code", "vector"]
    routed = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("side", pa.int32()), ("role", pa.int8()), ("code", pa.int64()), ("vector", pa.binary(4 * dimension))])

    def route(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = matrix(batch.column("vector"))
            code = batch.column("code").to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            asked = books.value.probes(x, probes)
            # Rows of role 3 are kept and ask, of role 2 only ask, of role 1 are only kept.
            if groups is not None:
                into = groups[asked]
                new = np.ones(into.shape, dtype=bool)
                for j in range(1, into.shape[1]):
                    new[:, j] = (into[:, :j] != into[:, j : j + 1]).all(1)
                row, place = np.nonzero(new)
                yield routes(into[row, place], np.zeros(len(row)), np.zeros(len(row)), np.where(place == 0, 3, 2), code[row], x[row])
                continue
            row = np.repeat(np.arange(len(x)), asked.shape[1])
            cell, role = asked.ravel(), np.where(np.tile(np.arange(asked.shape[1]), len(x)) == 0, 3, 2)
            block = side = np.zeros(len(row), dtype=int)
            if crowded:
                kept = np.flatnonzero(role == 3)
                many = blocks[cell]
                mix = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                # As a query: in each block of the cell, on its own side; kept: in its own block, for each side.
                ask = np.repeat(np.arange(len(row)), many)
                block_ask = np.concatenate([np.arange(m) for m in many])
                hold = np.repeat(kept, many[kept])
                side_hold = np.concatenate([np.arange(m) for m in many[kept]])
                own = lambda i: (mix[row[i]] % many[i].astype(np.uint64)).astype(int)  # noqa: E731, B023
                pick = np.concatenate([ask, hold])
                block, side = np.concatenate([block_ask, own(hold)]), np.concatenate([own(ask), side_hold])
                role = np.concatenate([np.full(len(ask), 2), np.full(len(hold), 1)])
                row, cell = row[pick], cell[pick]
            yield routes(cell, block, side, role, code[row], x[row])

    def routes(cell, block, side, role, code, x) -> pa.RecordBatch:  # noqa: ANN001
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dimension), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(role.astype(np.int8)), pa.array(code), raw.cast(pa.binary())], names=columns)

    def look(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        code = table.column("code").to_numpy()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float32).reshape(len(code), dimension)
        cell = table.column("cell")[0].as_py()
        held, ask = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        empty = found.empty_table()
        if not len(held) or not len(ask):
            return empty
        b = books.value
        if groups is not None:
            return look_around(b, code, x, held, ask)
        codes, norms = b.encode(x[held], np.full(len(held), cell))
        parts = []
        for i in range(0, len(ask), 4096):
            rows = ask[i : i + 4096]
            picked, cosine = b.search(x[rows], cell, codes, norms, x[held], take)
            other = code[held][picked]
            cosine[(other == code[rows][:, None]) | (cosine < floor)] = -2
            best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(cosine, best, 1)
            r, c = np.nonzero(top > -2)
            parts.append(pa.table([pa.array(code[rows][r]), pa.array(np.take_along_axis(other, best, 1)[r, c]), pa.array(top[r, c])], schema=found))
        return pa.concat_tables(parts)

    def look_around(b: Codebooks, code: np.ndarray, x: np.ndarray, held: np.ndarray, ask: np.ndarray) -> pa.Table:
        """The k best of a group's cells for each vector that asks in some of them."""
        asked = np.concatenate([b.probes(x[i : i + 4096], probes) for i in range(0, len(x), 4096)])
        best, whose = np.full((len(x), k), -2, dtype=np.float32), np.zeros((len(x), k), dtype=np.int64)
        for cell in np.unique(asked[held, 0]):
            own = held[asked[held, 0] == cell]
            codes, norms = b.encode(x[own], np.full(len(own), cell))
            rows = ask[(asked[ask] == cell).any(1)]
            for part in np.array_split(rows, len(rows) // 4096 + 1):
                if not len(part):
                    continue
                picked, cosine = b.search(x[part], cell, codes, norms, x[own], take)
                other = code[own][picked]
                cosine[(other == code[part][:, None]) | (cosine < floor)] = -2
                cosine, other = np.concatenate([best[part], cosine], axis=1), np.concatenate([whose[part], other], axis=1)
                first = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                best[part], whose[part] = np.take_along_axis(cosine, first, 1), np.take_along_axis(other, first, 1)
        r, c = np.nonzero(best > -2)
        return pa.table([pa.array(code[r]), pa.array(whose[r, c]), pa.array(best[r, c])], schema=found)

    found = pa.schema([("code", pa.int64()), ("other", pa.int64()), ("cosine", pa.float32())])
    spread = reps.mapInArrow(route, "cell int, block int, side int, role tinyint, code bigint, vector binary")
    hits = spread.groupBy("cell", "block", "side").applyInArrow(look, "code bigint, other bigint, cosine float")
    best = Window.partitionBy("code").orderBy(F.desc("cosine"), "other")
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def nearest_ids(table: DataFrame, key: str = "id", column: str = "embedding", order: str | None = "indexed_at", k: int = 5, floor: float = -1.0, probes: int | None = PROBES) -> DataFrame:
    """(id, other, cosine): the k most similar other ids of every id, with a cosine of at least `floor`.

    Ties go to the smaller id. Of a repeated id the row with the latest `order` counts. Null, all-zero and not finite
    vectors take no part; vectors are compared with those of their own dimension, which have an index of their own.
    """
    spark = table.sparkSession
    order = order if order in table.columns else None
    rows = vectors(table, key, column, order)
    # Ids and codes only, so that vectors are shuffled once, by code.
    members = stage(rows.groupBy("id").agg(F.max(F.struct("at", "code", F.size("vector").alias("size"))).alias("m")).select("id", "m.code", "m.size").where("code is not null"))
    sizes = members.groupBy("size").count().orderBy(F.desc("count"), "size").collect()  # a row a dimension
    if not sizes:
        return spark.createDataFrame([], "id string, other string, cosine double")
    # The first k + 1 ids of each class; a class of copies of any size passes k + 1 rows a partition.
    first = Window.partitionBy("code").orderBy("id")
    heads = members.select("id", "code").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    near = []
    for size in sizes:
        reps = rows.where(F.col("code").isNotNull() & (F.size("vector") == size["size"])).groupBy("code").agg(F.first("vector").alias("vector"))
        reps = reps.join(members.select("code"), "code", "left_semi")
        near.append(class_neighbours(reps, size["count"], size["size"], k, floor, probes))
    near = reduce(DataFrame.unionByName, near)
    members = members.drop("size")
    # Ids of the neighbouring classes, best first, and those of the own class.
    ranked = near.join(heads.withColumnRenamed("code", "other"), "other").select("code", F.explode("ids").alias("id"), F.col("cosine").cast("double").alias("cosine"))
    far = ranked.groupBy("code").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "id"))), 1, k).alias("far"))
    lists = heads.join(far, "code", "left").where("size(ids) > 1 or far is not null")
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("minus"), i.alias("id")))
    both = F.slice(F.concat(own, F.coalesce("far", F.array().cast("array<struct<minus:double,id:string>>"))), 1, k)
    picked = members.join(lists, "code").select("id", F.explode(both).alias("n"))
    return picked.select("id", F.col("n.id").alias("other"), (-F.col("n.minus")).alias("cosine")).where(F.col("cosine") >= floor)


def similar_pairs(table: DataFrame, unit: str, floor: float = 0.9, k: int = 5, **kw) -> DataFrame:  # noqa: ANN003
    """(unit, id_a, id_b): pairs of ids with a cosine of at least `floor` of which one is among the other's k most similar."""
    near = nearest_ids(table, k=k, floor=floor, **kw)
    return near.select(F.lit(unit).alias("unit"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


__all__ = ["Codebooks", "class_neighbours", "nearest_ids", "similar_pairs"]
