"""The mathematics of speaker attribution, from window vectors to a smoothed speaker for each word."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.islands import before
from confab.session import stage

FRAME = 0.1
#: Frames of a stretch of a recording that one group holds, and of one in which single frames look for their windows.
STRETCH, NEAR = 6000, 64


def two_way_clusters(vectors: np.ndarray, clusters: int = 2, prune: float = 0.3, seed: int = 0) -> np.ndarray:
    """Labels from a pruned cosine graph: own normalised-Laplacian embedding, then spherical k-means refinement.

    Every row keeps its strongest share of similarities (at least two), negatives count as none. For clusters or fewer
    rows, labels go round."""
    n = len(vectors)
    if n <= clusters:
        return np.arange(n) % clusters
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    close = x @ x.T
    keep = max(2, int(np.ceil(prune * n)))
    bar = -np.sort(-close, axis=1)[:, keep - 1 : keep]
    graph = np.where(close >= bar, np.maximum(close, 0), 0)
    graph = (graph + graph.T) / 2
    np.fill_diagonal(graph, 1)
    scale = 1 / np.sqrt(np.maximum(graph.sum(1), 1e-12))
    _, basis = np.linalg.eigh(graph * scale[:, None] * scale[None, :])
    rows = basis[:, -clusters:]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    # Centres: rows farthest from one another in the spectral embedding.
    centres = [int(np.random.default_rng(seed).integers(n))]
    centres = [int(np.argmin(rows @ rows[centres[0]]))]
    while len(centres) < clusters:
        centres.append(int(np.argmin((rows @ rows[centres].T).max(1))))
    labels = (rows @ rows[centres].T).argmax(1)
    for _ in range(5):
        means = np.stack([x[labels == c].mean(0) if (labels == c).any() else x[c % n] for c in range(clusters)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-8)
        moved = (x @ means.T).argmax(1)
        if (moved == labels).all():
            break
        labels = moved
    return labels


def posteriors(vectors: np.ndarray, labels: np.ndarray, temperature: float = 10.0) -> np.ndarray:
    """Softmax of the scaled cosine to each label's mean."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    means = np.stack([x[labels == c].mean(0) for c in range(int(labels.max()) + 1)])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-8)
    e = np.exp(temperature * (x @ means.T - 1))
    return e / e.sum(1, keepdims=True)


def frame_posteriors(windows: DataFrame, durations: DataFrame) -> DataFrame:
    """(file_id, frame, speaker, p, covered) on a grid of 0.1 s: the mean over the windows that cover a frame, equal shares
    where none does. windows: file_id, from_sec, to_sec, speaker, p; durations: file_id, duration."""
    first = F.floor(F.round(F.col("from_sec") / FRAME, 9)).cast("int")
    last = F.greatest(first + 1, F.ceil(F.round(F.col("to_sec") / FRAME, 9)).cast("int"))
    spread = windows.select("file_id", "speaker", "p", F.explode(F.sequence(first, last - 1)).alias("frame"))
    seen = spread.groupBy("file_id", "frame", "speaker").agg(F.avg("p").alias("p"))
    speakers = windows.select("file_id", "speaker").distinct()
    grid = durations.select("file_id", F.explode(F.sequence(F.lit(0), F.ceil(F.round(F.col("duration") / FRAME, 9)).cast("int"))).alias("frame")).join(speakers, "file_id")
    share = 1 / F.count(F.lit(1)).over(Window.partitionBy("file_id", "frame"))
    return grid.join(seen, ["file_id", "frame", "speaker"], "left").select("file_id", "frame", "speaker", F.coalesce("p", share).alias("p"), F.col("p").isNotNull().alias("covered"))


def word_likelihoods(words: DataFrame, frames: DataFrame) -> DataFrame:
    """(file_id, word_idx, speaker, loglik): log of the mean covered posterior over a word's span, or that of the nearest
    covered frame. Spans are exploded to frames, so the join is an equi-join; the nearest frame comes from the last and
    next covered one by window."""
    first = F.floor(F.round(F.col("start_sec") / FRAME, 9)).cast("int")
    last = F.greatest(first + 1, F.ceil(F.round(F.col("end_sec") / FRAME, 9)).cast("int"))
    spans = words.select("file_id", "word_idx", first.alias("a"), last.alias("b"))
    covered = frames.where("covered")
    inside = spans.select("file_id", "word_idx", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("frame")).join(covered, ["file_id", "frame"])
    direct = inside.groupBy("file_id", "word_idx", "speaker").agg(F.avg("p").alias("p"))
    lost = spans.join(direct.select("file_id", "word_idx").distinct(), ["file_id", "word_idx"], "left_anti").withColumn("middle", F.floor((F.col("a") + F.col("b")) / 2).cast("int"))
    spots = covered.select("file_id", "frame").distinct().withColumn("at", F.col("frame")).unionByName(lost.select("file_id", F.col("middle").alias("frame")).distinct().withColumn("at", F.lit(None).cast("int")))
    back = Window.partitionBy("file_id").orderBy("frame", F.col("at").isNull())
    forth = Window.partitionBy("file_id").orderBy(F.desc("frame"), F.col("at").isNull())
    placed = spots.withColumns({"left": F.last("at", ignorenulls=True).over(back), "right": F.last("at", ignorenulls=True).over(forth)}).where("at is null")
    near = placed.select("file_id", F.col("frame").alias("middle"), F.when(F.col("left").isNull() | (F.col("right") - F.col("frame") < F.col("frame") - F.col("left")), F.col("right")).otherwise(F.col("left")).alias("frame"))
    borrowed = lost.select("file_id", "word_idx", "middle").join(near, ["file_id", "middle"]).join(covered, ["file_id", "frame"]).select("file_id", "word_idx", "speaker", "p")
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-4)), F.lit(1.0))
    return direct.unionByName(borrowed).select("file_id", "word_idx", "speaker", F.log(clipped).alias("loglik"))


def _span(start: str, end: str) -> tuple[Column, Column]:
    """First frame of a span of seconds and the one behind its last."""
    first = F.floor(F.round(F.col(start) / FRAME, 9)).cast("int")
    return first, F.greatest(first + 1, F.ceil(F.round(F.col(end) / FRAME, 9)).cast("int"))


def _frame_sums(key: tuple, words: pa.Table, windows: pa.Table, size: int) -> pa.Table:
    """Of one stretch of a recording: for each word (or part of one) and speaker the sum and number of its covered frames'
    posteriors; a row without speaker where none is covered."""
    at = key[1].as_py() * size
    inside = lambda t, c: np.clip(t.column(c).to_numpy() - at, 0, size)
    a, b = inside(words, "a"), inside(words, "b")
    names = windows.column("speaker").combine_chunks().dictionary_encode() if windows.num_rows else None
    k = len(names.dictionary) if names is not None else 0
    n = np.zeros((words.num_rows, k), dtype=np.int64)
    s = np.zeros((words.num_rows, k))
    if k:
        who, first, last, p = names.indices.to_numpy(), inside(windows, "a"), inside(windows, "b"), windows.column("p").to_numpy()
        for c in range(k):
            own = who == c
            count = lambda x, w=None: np.bincount(x, weights=w, minlength=size + 1)[:size]
            covering = np.cumsum(count(first[own]) - count(last[own]))
            total = np.cumsum(count(first[own], p[own]) - count(last[own], p[own]))
            mean = np.where(covering > 0, total / np.maximum(covering, 1), 0.0)
            upto, seen = np.concatenate([[0.0], np.cumsum(mean)]), np.concatenate([[0], np.cumsum(covering > 0)])
            s[:, c], n[:, c] = upto[b] - upto[a], seen[b] - seen[a]
    row, c = np.nonzero(n)
    none = np.flatnonzero(n.sum(1) == 0)
    rows = pa.array(np.concatenate([row, none]))
    speaker = pa.concat_arrays([names.dictionary.take(pa.array(c)).cast(pa.string()) if k else pa.array([], pa.string()), pa.nulls(len(none), pa.string())])
    sums, counts = np.concatenate([s[row, c], np.zeros(len(none))]), np.concatenate([n[row, c], np.zeros(len(none), dtype=np.int64)])
    held = words.select(["file_id", "word_idx", "a", "b", "whole"]).take(rows)
    return held.append_column("speaker", speaker).append_column("s", pa.array(sums)).append_column("n", pa.array(counts))


def window_likelihoods(words: DataFrame, windows: DataFrame) -> DataFrame:
    """`word_likelihoods` of the frames of windows (file_id, from_sec, to_sec, speaker, p), without a row a frame.

    Words and windows meet in stretches of STRETCH frames, so no group holds a recording; words that reach over an edge add
    up. For words without a covered frame the nearest one is the last or first of a window, found among the windows' ends.
    """
    size, last = STRETCH, F.greatest(F.col("a"), F.col("b") - 1)
    spread = lambda df, wide: df.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("a") / wide), F.floor(last / wide))))
    a, b = _span("from_sec", "to_sec")
    windows = windows.where("file_id is not null").select("file_id", F.greatest(a, F.lit(0)).alias("a"), b.alias("b"), "speaker", F.col("p").cast("double").alias("p")).where("b > 0 and p is not null")
    a, b = _span("start_sec", "end_sec")
    spans = spread(words.where("file_id is not null").select("file_id", "word_idx", a.alias("a"), b.alias("b")), size).withColumn("whole", F.floor(F.col("a") / size) == F.floor(last / size))
    types = dict(spans.dtypes)
    schema = f"file_id {types['file_id']}, word_idx {types['word_idx']}, a int, b int, whole boolean, speaker string, s double, n long"
    parts = stage(spans.groupBy("file_id", "stretch").cogroup(spread(windows, size).groupBy("file_id", "stretch")).applyInArrow(lambda key, w, v: _frame_sums(key, w, v, size), schema))
    cut = parts.where("not whole").groupBy("file_id", "word_idx", "a", "b", "speaker").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    direct = parts.where("whole").select("file_id", "word_idx", "speaker", "s", "n").unionByName(cut.select("file_id", "word_idx", "speaker", "s", "n")).where("n > 0").select("file_id", "word_idx", "speaker", (F.col("s") / F.col("n")).alias("p"))
    lost = parts.where("whole and n = 0").select("file_id", "word_idx", "a", "b").unionByName(cut.groupBy("file_id", "word_idx", "a", "b").agg(F.sum("n").alias("n")).where("n = 0").drop("n"))
    lost = lost.select("file_id", "word_idx", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("frame"), F.lit(None).cast("int").alias("at"))
    ends = windows.select("file_id", F.lit(None).cast(types["word_idx"]).alias("word_idx"), (F.col("b") - 1).alias("frame"), (F.col("b") - 1).alias("at")).distinct()
    left = before(lost.unionByName(ends), ["file_id"], ["frame"], maxima={"left": F.col("at")}).where("at is null").select("file_id", "word_idx", "left", (-F.col("frame")).alias("frame"), "at")
    starts = windows.select("file_id", F.lit(None).cast(types["word_idx"]).alias("word_idx"), F.lit(None).cast("int").alias("left"), (-F.col("a")).alias("frame"), (-F.col("a")).alias("at")).distinct()
    both = before(left.unionByName(starts), ["file_id"], ["frame"], maxima={"right": F.col("at")}).where("at is null").select("file_id", "word_idx", "left", (-F.col("right")).alias("right"), (-F.col("frame")).alias("frame"))
    near = F.when(F.col("left").isNull() | (F.col("right") - F.col("frame") < F.col("frame") - F.col("left")), F.col("right")).otherwise(F.col("left"))
    asks = both.select("file_id", "word_idx", near.alias("near")).where("near is not null").withColumn("stretch", F.floor(F.col("near") / NEAR))
    borrowed = asks.join(spread(windows, NEAR), ["file_id", "stretch"]).where("near >= a and near < b").groupBy("file_id", "word_idx", "speaker").agg(F.avg("p").alias("p"))
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-4)), F.lit(1.0))
    return direct.unionByName(borrowed).select("file_id", "word_idx", "speaker", F.log(clipped).alias("loglik"))


def viterbi(loglik: np.ndarray, boundary: np.ndarray, penalty: float = 4.0, discount: float = 0.15) -> np.ndarray:
    """Best path over speakers: a change costs the penalty, at a boundary the discounted one; ties go to the lower speaker."""
    n, k = loglik.shape
    if not n:
        return np.zeros(0, dtype=int)
    trace = np.empty((n, k), dtype=int)
    best = loglik[0]
    stay = np.eye(k, dtype=bool)
    for i in range(1, n):
        reach = np.where(stay, best[:, None], best[:, None] - penalty * (discount if boundary[i] else 1.0))
        trace[i] = reach.argmax(0)
        best = reach.max(0) + loglik[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(trace[i, path[-1]]))
    return np.array(path[::-1])


def first_appearance(path: np.ndarray) -> np.ndarray:
    """Labels renumbered in order of appearance."""
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(c), len(seen)) for c in path], dtype=int)


def smooth_words(scored: DataFrame, penalty: float = 4.0, discount: float = 0.15) -> DataFrame:
    """(file_id, word_idx, speaker): the smoothed speaker of every word, numbered by appearance.

    scored: file_id, word_idx, is_boundary, loglik array (a value a speaker). One recording is one sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        path = first_appearance(viterbi(np.stack(pdf.loglik.to_list()), pdf.is_boundary.to_numpy(), penalty, discount))
        return pd.DataFrame({"file_id": pdf.file_id, "word_idx": pdf.word_idx, "speaker": [f"SPEAKER_{c:02d}" for c in path]})

    return scored.groupBy("file_id").applyInPandas(run, "file_id string, word_idx int, speaker string")


def segment_majority(scored: DataFrame) -> DataFrame:
    """Ablation: every word of a segment gets the speaker with the greatest summed likelihood (ties: first speaker).

    scored: file_id, segment, word_idx, speaker, loglik."""
    total = scored.groupBy("file_id", "segment", "speaker").agg(F.round(F.sum("loglik"), 9).alias("total"))
    winner = total.groupBy("file_id", "segment").agg(F.min(F.struct((-F.col("total")).alias("m"), "speaker")).alias("w")).select("file_id", "segment", F.col("w.speaker").alias("speaker"))
    return scored.select("file_id", "segment", "word_idx").distinct().join(winner, ["file_id", "segment"])
