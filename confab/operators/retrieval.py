"""Candidate retrieval for a table of queries: BM25, filters, phrases, exact vectors, sounds-like expansion."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from confab.config import Settings
from confab.functions.clusters import kmeans
from confab.functions.phonetics import sound_keys, substring_share, trigram_similarity, trigrams
from confab.functions.text import content_tokens
from confab.functions.vectors import cosine
from confab.operators.index import ANALYZERS
from confab.operators.islands import top_per_key
from confab.session import stage

#: Queries whose vectors are broadcast together; more scan the vectors again.
QUERY_BLOCK = 4096
#: Query rows multiplied at once inside a task.
ROWS = 256
#: Vectors a cell should hold, on average, the sample its centres are learnt on, and cells asked for each root of their number.
CELL, CELL_SAMPLE, CELL_SPREAD = 300, 16_384, 1.5
#: Chunks and queries of a cell of bm25_by_cells, and cells it makes where there are queries enough for them.
CELL_CHUNKS, CELL_QUERIES, CELLS, FEW_QUERIES = 65_536, 65_536, 6, 2_048
#: Chunks that pairs are held against in the first round of standing, and how many times more in each next one.
FIRST_CHUNKS, NEXT_CHUNKS = 20_480, 16
#: Spans of a block of best_touching on average; a place with more of them, or of moments, than CROWDED is divided.
BLOCK_SPANS, CROWDED = 4_096, 16_384
FILTERS = ("q_files", "q_speaker", "q_role")
# The acceptance rules of sounds-like terms.
LEAST_LETTERS, PER_TOKEN, OPEN, STRICT, RARE = 4, 3, 0.62, 0.80, 2


def query_lexemes(queries: DataFrame, analyzer: str = "simple", text: str = "q_text") -> DataFrame:
    """(query_id, lexeme, weight, source): one row a lexeme, occurrences adding up; its source is itself."""
    exploded = queries.select("query_id", F.explode(ANALYZERS[analyzer](F.col(text))).alias("lexeme"))
    return exploded.groupBy("query_id", "lexeme").agg(F.count(F.lit(1)).cast("double").alias("weight")).withColumn("source", F.col("lexeme"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def passes(files: Column, speaker: Column, role: Column) -> Column:
    """Whether a chunk (file_id, speakers, roles) passes a query's filters; a filter that isn't set passes all."""
    return (
        (F.coalesce(F.size(files), F.lit(0)) <= 0) | F.array_contains(files, F.col("file_id"))
    ) & (speaker.isNull() | F.array_contains("speakers", speaker)) & (role.isNull() | F.array_contains("roles", role))


def bm25(lexemes: DataFrame, posted: DataFrame, stats: DataFrame, lengths: DataFrame, corpus: DataFrame, settings: Settings = Settings(), filters: DataFrame | None = None, phrased: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(query_id, id, score, rank, matched): the best chunks of each query.

    Postings meet only the lexemes that are asked for; scores are rounded before they are ordered, so that equal ones tie.
    filters: query_id, q_files, q_speaker, q_role, has_phrases of every query; they are tested on the rows that meet, with the
    chunk's attributes in lengths. phrased: (query_id, chunk_id) that hold the phrases of the queries that have any.
    """
    wanted = lexemes.groupBy("query_id", "lexeme").agg(F.sum("weight").alias("weight"))
    scale = corpus.select(F.col("n_docs").cast("double").alias("n"), (F.col("sum_doc_len") / F.greatest("n_docs", F.lit(1))).alias("avgdl"))  # one row
    asks = [] if filters is None else [*FILTERS, "has_phrases"]
    wanted = wanted if filters is None else wanted.join(filters.select("query_id", *asks), "query_id")
    terms = wanted.join(stats, "lexeme").crossJoin(F.broadcast(scale)).select("query_id", "lexeme", (F.col("weight") * idf(F.col("n"), F.col("df"))).alias("gain"), "avgdl", *asks)
    hits = terms.join(posted, "lexeme").join(lengths, "chunk_id")
    if filters is not None:
        hits = hits.where(passes(*map(F.col, FILTERS)))
    if phrased is not None:
        hits = hits.join(phrased.select("query_id", "chunk_id", F.lit(True).alias("_held")), ["query_id", "chunk_id"], "left").where("not has_phrases or _held")
    k1, b = settings.k1, settings.b
    part = F.col("gain") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    scored = hits.groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.round(F.sum(part), 6).alias("score"), F.sort_array(F.collect_set("lexeme")).alias("matched"))
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.asc("id")], limit or settings.candidates)


def _saturated(tf: np.ndarray, length: np.ndarray, avgdl: float, settings: Settings) -> np.ndarray:
    """What an occurrence count tells in a chunk of a length, gains aside."""
    k1, b = settings.k1, settings.b
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def _totals(queries: pa.Table, chunks: pa.Table, avgdl: float, settings: Settings):  # noqa: ANN202
    """A generator of (i, mine, total, row, part) for each query i that meets a chunk of the cell: its lists of postings as
    (gain, term, start, end), the scores of all chunks, and the postings. chunks: terms joined by blanks, in order of their ids."""
    n = chunks.num_rows
    words = pc.split_pattern(chunks.column("terms").combine_chunks(), " ")
    length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    asked = queries.column("lexemes").combine_chunks()
    names = asked.flatten().dictionary_encode()
    held = words.flatten().dictionary_encode()
    known = pc.fill_null(pc.index_in(held.dictionary, value_set=names.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    code, row = known[held.indices.to_numpy()], np.repeat(np.arange(n), length)
    key, tf = np.unique((code * n + row)[code >= 0], return_counts=True)
    code, row = key // n, key % n
    part = _saturated(tf, length[row], avgdl, settings)
    start = np.searchsorted(code, np.arange(len(names.dictionary) + 1))
    lexeme, gain = names.indices.to_numpy(), queries.column("gains").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))])
    for i in range(queries.num_rows):
        mine = [(g, t, start[t], start[t + 1]) for g, t in zip(gain[upto[i] : upto[i + 1]].tolist(), lexeme[upto[i] : upto[i + 1]].tolist()) if start[t + 1] > start[t]]
        if mine:
            total = np.bincount(np.concatenate([row[x:y] for _, _, x, y in mine]), weights=np.concatenate([g * part[x:y] for g, _, x, y in mine]), minlength=n)
            yield i, mine, total, row, part


def _by_id(chunks: pa.Table) -> pa.Table:
    return chunks.take(pc.sort_indices(chunks.column("id").combine_chunks()))  # equal scores go by id, so by row


def _best_of_cell(queries: pa.Table, chunks: pa.Table, k: int, avgdl: float, settings: Settings) -> pa.Table:
    """The k best chunks of each query among the chunks of one cell: scores (descending) and ids as arrays, a row a query."""
    none = pa.table({"query_id": pa.array([], pa.string()), "scores": pa.array([], pa.list_(pa.float64())), "ids": pa.array([], pa.list_(pa.string()))})
    if not queries.num_rows or not chunks.num_rows:
        return none
    chunks = _by_id(chunks)
    most: dict[int, float] = {}
    which, scores, rows = [], [], []
    for i, mine, total, row, part in _totals(queries, chunks, avgdl, settings):
        for _, t, x, y in mine:
            if t not in most:
                most[t] = part[x:y].max()
        # The k-th best of the chunks with the most telling term is a bar that no chunk of the list lies under.
        telling = max((x for x in mine if x[3] - x[2] >= k), key=lambda x: x[0] * most[x[1]], default=None)
        bar = 0.0
        if telling:
            there = total[row[telling[2] : telling[3]]]
            bar = np.partition(there, len(there) - k)[len(there) - k] - 2e-6  # as scores are rounded
        near = np.flatnonzero(total >= bar if bar > 0 else total > 0)
        if len(near) > 4 * k:  # chunks that can't be among the k best, ties of rounded scores aside
            there = total[near]
            near = near[there >= np.partition(there, len(there) - k)[len(there) - k] - 2e-6]
        score = np.round(total[near], 6)
        order = np.lexsort((near, -score))[:k]
        which.append(i)
        scores.append(score[order])
        rows.append(near[order])
    if not which:
        return none
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32))
    ids = chunks.column("id").combine_chunks().take(pa.array(np.concatenate(rows)))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return pa.table({"query_id": queries.column("query_id").combine_chunks().take(pa.array(which)), "scores": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(scores))), "ids": pa.ListArray.from_arrays(offsets, ids)})


def asked_terms(lexemes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, int, float]:
    """(query_id, lexemes, gains) as arrays, a row a query that asks for anything the collection has; the number of chunks,
    and their average length. chunks: id, terms (content lexemes in any order)."""
    corpus = chunks.agg(F.count(F.lit(1)), F.sum(F.when(F.col("id").isNotNull(), F.size("terms")))).first()  # one row
    n, avgdl = corpus[0], (corpus[1] or 0) / max(corpus[0], 1)
    df = chunks.select(F.explode(F.array_distinct("terms")).alias("lexeme")).groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
    wanted = lexemes.where("query_id is not null").groupBy("query_id", "lexeme").agg(F.sum("weight").alias("weight"))
    gains = wanted.join(df, "lexeme").select("query_id", F.struct("lexeme", (F.col("weight") * idf(F.lit(float(n)), F.col("df"))).alias("gain")).alias("g"))
    return stage(gains.groupBy("query_id").agg(F.sort_array(F.collect_list("g")).alias("g")).select("query_id", F.col("g.lexeme").alias("lexemes"), F.col("g.gain").alias("gains"))), n, avgdl


def _cells(asked: DataFrame, chunks: DataFrame, n: float):  # noqa: ANN202
    """Blocks of queries and blocks of about n chunks, grouped so that they meet in cells; and the number of blocks of chunks."""
    wide, many = max(1, int(-(-n // CELL_CHUNKS))), asked.count()
    high = max(1, -(-many // CELL_QUERIES), min(CELLS // wide, many // FEW_QUERIES))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("down", block("query_id", high)).withColumn("across", every(wide))
    right = chunks.where("id is not null and size(terms) > 0").select("id", F.array_join("terms", " ").alias("terms"), block("id", wide).alias("across")).withColumn("down", every(high))
    return left.groupBy("down", "across").cogroup(right.groupBy("down", "across")), wide


def bm25_by_cells(lexemes: DataFrame, chunks: DataFrame, k: int, settings: Settings = Settings()) -> DataFrame:
    """(query_id, id, score, rank): as `bm25` without filters, for query sets that meet most of the collection.

    There the rows that meet are the product of queries and chunks, too many to shuffle. So blocks of chunks meet blocks of
    queries in cells; each scores all its pairs in memory and passes on k chunks a query. chunks: id, terms (content lexemes
    in any order).
    """
    asked, n, avgdl = asked_terms(lexemes, chunks)
    meet = lambda q, c: _best_of_cell(q, c, k, avgdl, settings)
    found = _cells(asked, chunks, n)[0].applyInArrow(meet, "query_id string, scores array<double>, ids array<string>")
    pairs = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("less"), i.alias("id")))
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", "x.id", (-F.col("x.less")).alias("score"), (F.col("at") + 1).alias("rank"))


def score_pairs(pairs: DataFrame, avgdl: float, settings: Settings = Settings()) -> DataFrame:
    """Scores of given pairs of a query (lexemes, gains) and a chunk (terms): score takes the place of these columns. Pairs
    without a lexeme in common are left out. lexemes and terms: arrays, or joined by blanks."""
    parts = lambda x: pc.split_pattern(x, " ") if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x
    rest = [c for c in pairs.columns if c not in ("lexemes", "gains", "terms")]

    def scored(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            terms, lexemes = parts(batch.column("terms")), parts(batch.column("lexemes"))
            names, held = lexemes.flatten().dictionary_encode(), terms.flatten().dictionary_encode()
            known = pc.fill_null(pc.index_in(held.dictionary, value_set=names.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            length, asks = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (terms, lexemes))
            code, row, wide = known[held.indices.to_numpy()], np.repeat(np.arange(batch.num_rows), length), max(1, len(names.dictionary))
            key, tf = np.unique((row * wide + code)[code >= 0], return_counts=True)
            row = np.repeat(np.arange(batch.num_rows), asks)
            wanted = row * wide + names.indices.to_numpy()
            at = np.searchsorted(key, wanted)
            there = at < len(key)
            there[there] = key[at[there]] == wanted[there]
            row, tf, gain = row[there], tf[at[there]], batch.column("gains").flatten().to_numpy(zero_copy_only=False)[there]
            score = np.round(np.bincount(row, weights=gain * _saturated(tf, length[row], avgdl, settings), minlength=batch.num_rows), 6)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score, pa.float64())], names=[*rest, "score"])
            yield out.filter(pa.array(np.bincount(row, minlength=batch.num_rows) > 0))

    return pairs.select(*rest, "lexemes", "gains", "terms").mapInArrow(scored, ", ".join([*(f"`{c}` {t}" for c, t in pairs.select(*rest).dtypes), "score double"]))


def _best_in_block(spans: pa.Table, moments: pa.Table, none: pa.Table, k: int, avgdl: float, tolerance: float, settings: Settings) -> pa.Table:
    """The spans of a block that touch its moments, scored, without those that k chunks of the block come before. none: no
    rows of the result."""
    if not spans.num_rows or not moments.num_rows:
        return none
    spans = _by_id(spans)
    numbers = lambda t, c: t.column(c).to_numpy()
    reals = lambda t, c: np.nan_to_num(numbers(t, c), nan=np.inf, posinf=np.inf, neginf=-np.inf)  # noqa: E731  # nan is the greatest
    # Places are a file, a stretch and a part; the spans of a place are neighbours in `order`.
    files = spans.column("file").combine_chunks().dictionary_encode()
    there, low, many = numbers(spans, "stretch"), numbers(spans, "stretch").min(), numbers(spans, "part").max() + 1
    wide = there.max() - low + 1
    place = (files.indices.to_numpy().astype(np.int64) * wide + there - low) * many + numbers(spans, "part")
    order = np.argsort(place, kind="stable")
    file = pc.fill_null(pc.index_in(moments.column("file").combine_chunks(), value_set=files.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    there, part = numbers(moments, "stretch"), numbers(moments, "part")
    sought = np.where((file < 0) | (there < low) | (there >= low + wide) | (part >= many), -1, (file * wide + there - low) * many + part)
    start, upto = (np.searchsorted(place[order], sought, side) for side in ("left", "right"))
    kept = np.flatnonzero(upto > start)
    if not len(kept):
        return none
    moments, start, upto = moments.take(pa.array(kept)), start[kept], upto[kept]
    lexemes = pc.split_pattern(moments.column("lexemes").combine_chunks(), " ")
    s_from, s_to, s_first = reals(spans, "start_sec"), reals(spans, "end_sec"), numbers(spans, "first")
    m_from, m_to, m_first, m_at = reals(moments, "start_sec") - tolerance, reals(moments, "end_sec") + tolerance, numbers(moments, "first"), numbers(moments, "stretch")
    ids = spans.column("id").combine_chunks()
    fresh = np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)])  # a chunk lies in several stretches
    chunk, above = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0)), np.nextafter(0.0, 1.0)
    which, rows, scores = [], [], []
    for i, _, total, _, _ in _totals(moments.select(["gains"]).append_column("lexemes", lexemes), spans, avgdl, settings):
        own = order[start[i] : upto[i]]
        own = own[(s_from[own] <= m_to[i]) & (s_to[own] >= m_from[i]) & (np.maximum(s_first[own], m_first[i]) == m_at[i]) & (total[own] > 0)]
        if not len(own):
            continue
        score = np.round(total[own], 6)
        near = np.flatnonzero(fresh & (total >= max(score.min() - 2e-6, above)))
        if len(near) > k:
            rival = total[near]
            near = near[rival >= np.partition(rival, len(rival) - k)[len(rival) - k] - 2e-6]
            best = near[np.lexsort((near, -np.round(total[near], 6)))[:k]]
            stands = np.isin(chunk[own], best)
            own, score = own[stands], score[stands]
        which.append(np.full(len(own), i))
        rows.append(own)
        scores.append(score)
    if not which:
        return none
    m, r = moments.take(pa.array(np.concatenate(which))), spans.take(pa.array(np.concatenate(rows)))
    return pa.table([m.column("query_id"), r.column("id"), r.column("start_sec"), m.column("label"), m.column("grade"), m.column("start_sec"), pa.array(np.concatenate(scores), pa.float64())], names=none.column_names)


def best_touching(spans: DataFrame, moments: DataFrame, k: int, n: int, avgdl: float, tolerance: float, settings: Settings = Settings()) -> DataFrame:
    """(query_id, id, start_sec, label, grade, gold_start, score): of the chunks that touch a labelled moment of a query, in the
    sense of `interval_hits`, and have a lexeme in common with it those that may be among its k best.

    Where many chunks and moments lie at one time, their pairs are too many to shuffle or stage. So both meet in blocks of
    places (file and stretch), and a block passes on only pairs that fewer than k of its chunks come before. spans: id, file,
    start_sec, end_sec, terms; moments: query_id, label, grade, file, start_sec, end_sec, lexemes, gains; both as `spread` has
    them, terms and lexemes joined by blanks. n: the number of chunks.
    """
    usable = lambda df: df.where("file is not null and start_sec is not null and end_sec is not null")
    spans, moments = usable(spans), usable(moments)
    # Crowded places are divided: each part of their spans meets each part of their moments.
    held = spans.select("file", "stretch", F.lit(1).alias("r"), F.lit(0).alias("g")).unionAll(moments.select("file", "stretch", F.lit(0), F.lit(1)))
    parts = lambda c: F.greatest(F.ceil(F.sum(c) / CROWDED), F.lit(1)).cast("int")
    crowded = F.broadcast(held.groupBy("file", "stretch").agg(parts("r").alias("across"), parts("g").alias("down")).where("across > 1 or down > 1"))
    across, down = (F.coalesce(c, F.lit(1)) for c in ("across", "down"))
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    number = lambda key, m: F.pmod(F.xxhash64(key), m).cast("int")
    block = F.pmod(F.xxhash64("file", "stretch", "part"), F.lit(max(1, -(-n // BLOCK_SPANS)))).cast("int").alias("block")

    def parted(df: DataFrame, x: Column, y: Column, *columns: str) -> DataFrame:
        df = df.join(crowded, ["file", "stretch"], "left").withColumns({"_x": x, "_y": y}).withColumn("part", F.col("_x") * down + F.col("_y"))
        return df.select(block, "part", "file", "stretch", "first", "start_sec", "end_sec", *columns).groupBy("block")

    left = parted(spans, number("id", across), every(down), "id", "terms")
    right = parted(moments, every(across), number("query_id", down), "query_id", "label", "grade", "lexemes", "gains")
    types = dict(moments.dtypes)
    schema = f"query_id string, id string, start_sec double, label {types['label']}, grade {types['grade']}, gold_start double, score double"
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return right.cogroup(left).applyInArrow(lambda m, s: _best_in_block(s, m, none, k, avgdl, tolerance, settings), schema)


STANDING = "query_id string, id string, score double, ahead int, more int"


def _ahead_in_cell(queries: pa.Table, chunks: pa.Table, k: int, avgdl: float, settings: Settings) -> pa.Table:
    """Of the queries' pairs (ids, scores, ahead) those that fewer than k chunks of the cell come before, with their number."""
    flat = lambda c: queries.column(c).combine_chunks().flatten()
    sizes = pc.list_value_length(queries.column("ids").combine_chunks()).to_numpy(zero_copy_only=False) if queries.num_rows else np.zeros(0, dtype=int)
    upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids, scores, ahead = flat("ids"), flat("scores").to_numpy(zero_copy_only=False), flat("ahead")
    more = np.zeros(len(scores), dtype=np.int32)
    if queries.num_rows and chunks.num_rows:
        chunks = _by_id(chunks)
        names, above = chunks.column("id").to_pylist(), np.nextafter(0.0, 1.0)
        for i, _, total, _, _ in _totals(queries, chunks, avgdl, settings):
            own = range(upto[i], upto[i + 1])
            near = np.flatnonzero(total >= max(min(scores[x] for x in own) - 2e-6, above))
            there = np.round(total[near], 6)
            for x in own:
                tied = near[there == scores[x]]
                more[x] = np.count_nonzero(there > scores[x]) + (np.count_nonzero(tied < bisect_left(names, ids[x].as_py())) if len(tied) else 0)
    stand = pa.array(more < k)
    which = pa.array(np.repeat(np.arange(queries.num_rows), sizes), pa.int64())
    out = pa.table({"query_id": queries.column("query_id").combine_chunks().take(which), "id": ids, "score": pa.array(scores, pa.float64()), "ahead": ahead, "more": pa.array(more, pa.int32())})
    return out.filter(stand)


def standing(pairs: DataFrame, asked: DataFrame, chunks: DataFrame, k: int, n: int, avgdl: float, settings: Settings = Settings()) -> DataFrame:
    """(query_id, id, score, rank): of scored pairs (query_id, id, score) those that are among the k best of their query in the
    ranking of all chunks, as `bm25` has it.

    Only the pairs and the number of chunks before each are passed on, no ranking. A pair that k chunks come before is out
    whatever follows, so chunks come in rounds, few in the first, and each round meets only the pairs that stand; these
    meet every chunk once. asked, n, avgdl: of `asked_terms`; chunks: id, terms.
    """
    edges, upto = [0.0], FIRST_CHUNKS / max(n, 1)
    while upto < 0.5:
        edges.append(upto)
        upto *= NEXT_CHUNKS
    edges.append(1.0)
    share = F.pmod(F.xxhash64("id", F.lit("round")), F.lit(1 << 30)) / (1 << 30)
    left = pairs.select("query_id", "id", "score", F.lit(0).alias("ahead"))
    meet = lambda q, c: _ahead_in_cell(q, c, k, avgdl, settings)
    for low, high in zip(edges, edges[1:]):
        lists = left.groupBy("query_id").agg(F.collect_set(F.struct("id", "score", "ahead")).alias("p"))
        queries = stage(asked.join(lists, "query_id").select("query_id", "lexemes", "gains", F.col("p.id").alias("ids"), F.col("p.score").alias("scores"), F.col("p.ahead").alias("ahead")))
        cells, wide = _cells(queries, chunks.where((share >= low) & (share < high)), n * (high - low))
        counted = cells.applyInArrow(meet, STANDING).groupBy("query_id", "id", "score", "ahead").agg(F.count(F.lit(1)).alias("cells"), F.sum("more").alias("more"))
        left = counted.where((F.col("cells") == wide) & (F.col("ahead") + F.col("more") < k)).select("query_id", "id", "score", (F.col("ahead") + F.col("more")).cast("int").alias("ahead"))
    return left.select("query_id", "id", "score", (F.col("ahead") + 1).alias("rank"))


def filter_clause(files: list[str] | None = None, speaker: str | None = None, langs: list[str] | None = None) -> Column:
    """Conjunction of the filters that are given; true without any. Values are literals, never SQL text."""
    parts = [F.col("file_id").isin(*files)] if files else []
    parts += [F.array_contains("speakers", speaker)] if speaker else []
    parts += [F.col("lang").isin(*langs)] if langs else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def with_role(chunks: DataFrame, speakers: DataFrame, role: str) -> DataFrame:
    """Chunks in which a speaker of the role speaks: a semi-join on the file with array membership."""
    who = speakers.where(F.col("role") == role).select(F.col("file_id").alias("f"), F.col("label").alias("l"))
    return chunks.join(who, (F.col("file_id") == F.col("f")) & F.array_contains("speakers", F.col("l")), "left_semi")


def chunk_roles(chunks: DataFrame, speakers: DataFrame) -> DataFrame:
    """(id, roles): the roles of those who speak in a chunk; a recording's few speakers are one map beside its chunks."""
    known = speakers.where("file_id is not null and label is not null").groupBy("file_id", "label").agg(F.max(F.lower(F.trim("role"))).alias("role")).where("role is not null")
    cast = known.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "role"))).alias("cast"))
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform("speakers", lambda s: F.col("cast")[s]))))
    return chunks.select("id", "file_id", "speakers").join(cast, "file_id", "left").select("id", F.coalesce(found, F.array().cast("array<string>")).alias("roles"))


def phrase_matches(queries: DataFrame, occurrences: DataFrame, analyzer: str = "simple", phrases: str = "q_phrases") -> DataFrame:
    """(query_id, chunk_id) where every phrase of the query stands in the chunk as neighbouring lexemes.

    A phrase's i-th lexeme at position p votes for a match at p - i; a match has a vote of each lexeme. One equi-join,
    however long phrases are. Phrases without lexemes are ignored.
    """
    listed = queries.select("query_id", F.posexplode(phrases).alias("phrase", "text"))
    parts = listed.select("query_id", "phrase", F.posexplode(ANALYZERS[analyzer](F.col("text"))).alias("i", "lexeme"))
    sizes = parts.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("size"))
    votes = parts.join(occurrences, "lexeme").groupBy("query_id", "phrase", "chunk_id", (F.col("position") - F.col("i")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    found = votes.join(sizes, ["query_id", "phrase"]).where("n = size").select("query_id", "phrase", "chunk_id").distinct()
    need = sizes.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    return found.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).join(need, "query_id").where("n = need").select("query_id", "chunk_id")


def unit_rows(column) -> np.ndarray:  # noqa: ANN001
    """Rows of an Arrow list column as unit vectors of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def best_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row in order, the first of equals before the others; -inf never counts."""
    k = min(k, score.shape[1])
    bar = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    r, c = np.nonzero((score >= bar) & (score > -np.inf))
    order = np.lexsort((c, -score[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def _allowed(asked: list[dict], batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """For queries the number of their combination of filters, and for each combination which rows of the batch pass."""
    names: dict[tuple, int] = {}
    which = np.array([names.setdefault((tuple(sorted(q["q_files"] or ())), q["q_speaker"], q["q_role"]), len(names)) for q in asked])
    files = np.array(batch.column("file_id").to_pylist(), dtype=object)
    held = {c: batch.column(c).to_pylist() for c in ("speakers", "roles")}
    has = lambda c, v: np.array([v in (x or ()) for x in held[c]], dtype=bool)
    masks: list[np.ndarray | None] = []
    for wanted, speaker, role in names:
        parts = ([np.isin(files, list(wanted))] if wanted else []) + ([has("speakers", speaker)] if speaker else []) + ([has("roles", role)] if role else [])
        masks.append(reduce(np.logical_and, parts) if parts else None)
    return which, masks


def dense(queries: DataFrame, vectors: DataFrame, k: int, vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): exact cosine of a stated query set against all vectors.

    Each partition keeps a running list of k rows a query over its batches, so it passes on no more. Null and all-zero
    vectors take no part. Queries with q_files, q_speaker and q_role see only the vectors whose file_id, speakers and roles
    pass. The query set is shipped in blocks of at most `block` rows, so what is broadcast is bounded; more queries scan
    the vectors again.
    """
    usable = lambda df: df.where(F.exists(F.col(vector), lambda x: x != 0))
    filtered = set(FILTERS) <= set(queries.columns)
    asked = usable(queries).select("query_id", vector, *(FILTERS if filtered else ()))
    spark = queries.sparkSession
    blocks = max(1, -(-asked.count() // block))
    found = []
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()
        if not part.num_rows:
            continue
        shipped = spark.sparkContext.broadcast((part.drop_columns([vector]).to_pylist(), unit_rows(part.column(vector))))

        def best(batches, shipped=shipped):  # noqa: ANN001, ANN202
            asked, q = shipped.value
            top = np.full((len(q), k), -np.inf)
            ids = np.full((len(q), k), None, dtype=object)
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = np.array(batch.column("id").to_pylist(), dtype=object)
                x = unit_rows(batch.column(vector)).T
                which, masks = _allowed(asked, batch) if filtered else (np.zeros(len(q), dtype=int), [None])
                for at in range(0, len(q), ROWS):
                    rows = slice(at, at + ROWS)
                    score = np.round(q[rows] @ x, 6)
                    for m in np.unique(which[rows]):
                        if masks[m] is not None:
                            score[np.ix_(which[rows] == m, ~masks[m])] = -np.inf
                    r, c = best_rows_by_name(score, names, k)
                    # The list so far and the batch's best, merged by score, then id.
                    n = np.bincount(r, minlength=len(score))
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    both, held = np.full((len(score), 2 * k), -np.inf), np.full((len(score), 2 * k), None, dtype=object)
                    both[:, :k], held[:, :k] = top[rows], ids[rows]
                    both[r, k + place], held[r, k + place] = score[r, c], names[c]
                    fresh = np.flatnonzero(n)
                    for i in fresh:
                        known = np.flatnonzero(both[i] > -np.inf)
                        order = known[np.lexsort((held[i][known].astype(str), -both[i][known]))][:k]
                        top[at + i, : len(order)], ids[at + i, : len(order)] = both[i][order], held[i][order]
            r, c = np.nonzero(top > -np.inf)
            if len(r):
                yield pa.RecordBatch.from_pydict({"query_id": [asked[i]["query_id"] for i in r], "id": ids[r, c].tolist(), "score": top[r, c]})

        columns = ["id", vector, *(("file_id", "speakers", "roles") if filtered else ())]
        found.append(usable(vectors).select(columns).mapInArrow(best, "query_id string, id string, score double"))
    if not found:
        return spark.createDataFrame([], "query_id string, id string, score double, rank int")
    return top_per_key(reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("score"), F.asc("id")], k)


def best_rows_by_name(score: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`best_rows` with equals in order of their names."""
    order = np.argsort(names.astype(str), kind="stable")
    r, c = best_rows(score[:, order], k)
    return r, order[c]


def dense_among(queries: DataFrame, vectors: DataFrame, phrased: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """`dense` for queries with phrases: only the (query_id, chunk_id) that hold them are scored, as far as they pass the
    query's filters."""
    pairs = phrased.select("query_id", F.col("chunk_id").alias("id")).join(vectors.select("id", vector, "file_id", "speakers", "roles"), "id").join(queries.select("query_id", F.col(vector).alias("q"), *FILTERS), "query_id")
    scored = pairs.where(passes(*map(F.col, FILTERS))).select("query_id", "id", F.round(cosine(F.col(vector), F.col("q")), 6).alias("score")).where("score is not null")
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def centres_of(vectors: DataFrame, vector: str = "embedding", cell: int = CELL) -> np.ndarray:
    """Centres of cells of about `cell` vectors, learnt on at most about CELL_SAMPLE vectors picked by a hash of the id; so
    there are at most CELL_SAMPLE / 4 centres, and beyond that cells grow."""
    usable = vectors.where(F.exists(F.col(vector), lambda x: x != 0))
    n = usable.count()
    picked = usable.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // CELL_SAMPLE)))) == 0).select(vector).toArrow()
    x = unit_rows(picked.column(vector)) if picked.num_rows else np.zeros((0, 1))
    return kmeans(x, int(min(max(1, n // cell), max(1, CELL_SAMPLE // 4), len(x))), np.random.default_rng(7)) if len(x) else x


def dense_by_cells(queries: DataFrame, vectors: DataFrame, centres: np.ndarray, k: int, vector: str = "embedding", spread: float = CELL_SPREAD) -> DataFrame:
    """`dense` over the cells nearest to each query, `spread` for each root of their number: an approximate search whose work
    grows with the root of the collection. Vectors meet the queries that ask in their cell, a block of a cell at a time."""
    if not len(centres):
        return queries.sparkSession.createDataFrame([], "query_id string, id string, score double, rank int")
    shipped = queries.sparkSession.sparkContext.broadcast(centres)  # at most CELL_SAMPLE / 4 rows
    probes = min(len(centres), max(4, int(np.ceil(spread * len(centres) ** 0.5))))
    blocks = 4  # parts of a cell, so that a crowded one is several groups

    def place(batches, n: int):  # noqa: ANN001, ANN202
        for batch in batches:
            x = unit_rows(batch.column(vector))
            score = x @ shipped.value.T - 0.5 * (shipped.value * shipped.value).sum(1)
            own = np.argpartition(-score, n - 1, axis=1)[:, :n] if len(x) else np.zeros((0, n), dtype=int)
            row = pa.array(np.repeat(np.arange(len(x)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(own.ravel().astype(np.int32))], names=["name", "v", "cell"])

    usable = lambda df, key: df.where(F.exists(F.col(vector), lambda x: x != 0)).select(F.col(key).alias("name"), F.col(vector).cast("array<float>").alias(vector))
    schema = "name string, v array<float>, cell int"
    held = usable(vectors, "id").mapInArrow(lambda b: place(b, 1), schema).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    asks = usable(queries, "query_id").mapInArrow(lambda b: place(b, probes), schema).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        names, asked = np.array(right.column("name").to_pylist(), dtype=object), np.array(left.column("name").to_pylist(), dtype=object)
        q, x = unit_rows(left.column("v")), unit_rows(right.column("v")).T
        parts = []
        for at in range(0, len(q), ROWS):
            score = np.round(q[at : at + ROWS] @ x, 6)
            r, c = best_rows_by_name(score, names, k)
            parts.append(pa.table({"query_id": pa.array(asked[at + r].tolist(), pa.string()), "id": pa.array(names[c].tolist(), pa.string()), "score": pa.array(score[r, c])}))
        return pa.concat_tables(parts)

    found = asks.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(meet, "query_id string, id string, score double")
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


def sound_candidates(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term) pairs worth scoring: a shared sound key, enough shared trigrams, or containment of the token without
    its last letter. Four equi-joins; trigrams of containment narrow the last."""
    near = tokens.withColumn("k", sound_keys(F.col("token"))).select("token", F.col("k.metaphone").alias("metaphone"), F.explode(F.array_distinct(F.array("k.first", "k.second"))).alias("code"))
    by_sound = near.select("token", "metaphone").distinct().where("metaphone <> ''").join(vocabulary.select("term", "metaphone"), "metaphone").select("token", "term")
    codes = vocabulary.select("term", F.explode(F.array_distinct(F.array("dmetaphone", "dmetaphone_alt"))).alias("code")).where("code <> ''")
    by_code = near.select("token", "code").join(codes, "code").select("token", "term")
    left = tokens.select("token", F.explode(trigrams(F.col("token"))).alias("g"))
    grams = vocabulary.select("term", F.size(trigrams(F.col("term"))).alias("nt"), F.explode(trigrams(F.col("term"))).alias("g"))
    shared = left.join(grams, "g").groupBy("token", "term").agg(F.count(F.lit(1)).alias("s"), F.first("nt").alias("nt"))
    by_spelling = shared.where(F.col("s") / (F.size(trigrams(F.col("token"))) + F.col("nt") - F.col("s")) >= 0.3).select("token", "term")
    # Containment shares all inner trigrams of the stump.
    stump = F.expr("left(token, length(token) - 1)")
    inner = F.size(trigrams(stump)) - 3
    by_part = shared.where((F.length("token") >= 5) & (F.col("s") >= F.greatest(inner, F.lit(1)))).where(F.col("term").contains(stump)).select("token", "term")
    return by_sound.unionByName(by_code).unionByName(by_spelling).unionByName(by_part).where("term <> token").distinct()


def lexicon_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token): the distinct content tokens of a table of texts, as a lexicon of words that are spelt right."""
    return texts.select(F.explode(content_tokens(F.col(text))).alias("token")).distinct()


def expansions(tokens: DataFrame, vocabulary: DataFrame, lexicon: DataFrame | list[str] | None = None, phonetic: bool = True) -> DataFrame:
    """(token, term, score, kind, rank): terms of the vocabulary that sound or look like a token the corpus lacks, or
    holds rarely. tokens: token. Without `phonetic` only spelling counts.

    Known tokens are expanded strictly if rare and not in the lexicon; unknown ones openly, or strictly if in it.
    """
    asked = tokens.where((F.length("token") >= LEAST_LETTERS) & F.col("token").rlike("^[a-z]+$")).select("token").distinct()
    if isinstance(lexicon, list):
        lexicon = tokens.sparkSession.createDataFrame([(t,) for t in lexicon], "token string")
    known = vocabulary.select(F.col("term").alias("token"), F.col("df"))
    common = F.lit(False)
    if lexicon is not None:
        asked = asked.join(lexicon.select("token", F.lit(True).alias("listed")).distinct(), "token", "left")
        common = F.coalesce("listed", F.lit(False))
    policy = F.when(F.col("df").isNull(), F.when(common, "strict").otherwise("open")).when((F.col("df") <= RARE) & ~common, "strict")
    asked = asked.join(known, "token", "left").withColumn("policy", policy).where("policy is not null").select("token", "policy")
    if not phonetic:
        vocabulary = vocabulary.select("term", "df", F.lit("").alias("metaphone"), F.lit("").alias("dmetaphone"), F.lit("").alias("dmetaphone_alt"))
    pairs = sound_candidates(asked.select("token"), vocabulary).join(asked, "token").join(vocabulary, "term")
    pairs = pairs.withColumn("k", sound_keys(F.col("token")))
    same = (F.col("metaphone") == F.col("k.metaphone")) & (F.col("metaphone") != "")
    codes = F.arrays_overlap(F.array("dmetaphone", "dmetaphone_alt"), F.array("k.first", "k.second")) & (F.col("dmetaphone") != "")
    like = trigram_similarity(trigrams(F.col("term")), trigrams(F.col("token")))
    longest = F.greatest(F.length("token"), F.length("term"), F.lit(1))
    pairs = pairs.withColumns({"same": same, "codes": codes, "like": like, "lev": 1 - F.levenshtein("token", "term") / longest})
    ortho = F.greatest("like", "lev")
    ortho = F.when((F.length("token") >= 5) & (substring_share(F.col("token"), F.col("term")) >= 0.85), F.greatest(ortho, F.lit(0.70))).otherwise(ortho)
    score = F.when(F.col("same"), F.least(F.lit(1.0), F.greatest(F.col("ortho"), F.lit(0.55)) + 0.25)).when(F.col("codes"), F.least(F.lit(1.0), F.col("ortho") + 0.12)).otherwise(F.col("ortho"))
    pairs = pairs.withColumn("ortho", ortho).withColumns({"raw": score, "kind": F.when(F.col("same") | F.col("codes"), "phonetic").otherwise("spelling")})
    good = ~(F.col("codes") & ~F.col("same") & (F.col("like") < 0.25)) & F.when(F.col("policy") == "open", F.col("raw") >= OPEN).otherwise(F.col("same") & (F.col("raw") >= STRICT))
    kept = pairs.where(good).select("token", "term", F.round("raw", 3).alias("score"), "kind")
    return top_per_key(kept, ["token"], [F.desc("score"), F.asc("term")], PER_TOKEN)


def expansion_lexemes(queries: DataFrame, lexemes: DataFrame, expanded: DataFrame, weight: float = 0.9, analyzer: str = "simple") -> DataFrame:
    """(query_id, lexeme, weight, source) of the expansions' lexemes that the query hasn't got; of several ways to one
    lexeme the first counts, by token, then rank. queries: query_id, q_content."""
    asked = queries.select("query_id", F.explode(F.array_distinct("q_content")).alias("token")).join(expanded, "token")
    analysed = asked.withColumns({"parts": ANALYZERS[analyzer](F.col("term")), "unit": F.coalesce(F.get(ANALYZERS[analyzer](F.col("token")), F.lit(0)), F.col("token"))})
    rows = analysed.select("query_id", "token", "rank", "score", "unit", F.explode("parts").alias("lexeme"))
    fresh = rows.join(lexemes.select("query_id", "lexeme"), ["query_id", "lexeme"], "left_anti")
    return top_per_key(fresh, ["query_id", "lexeme"], [F.asc("token"), F.asc("rank")], 1, "place").select("query_id", "lexeme", (weight * F.col("score")).alias("weight"), F.col("unit").alias("source"))
