"""Splitting oversized chunks at natural boundaries (problem 4).

Method: pointer doubling. Every word position of a text is joined to its farthest legal successor, the start of the
piece that would follow a piece starting there, overlap included. Squaring this successor table again and again reaches
all greedy cuts from the first word in a logarithmic number of vectorised steps, for all texts of a batch at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.text import word_count
from confab.operators.sequence import ABBREVIATIONS

LIMIT, OVERLAP = 120, 20
#: A piece that is cut at a natural boundary keeps at least this share of the limit; an overlap that starts at one may
#: differ from OVERLAP by at most this share of it.
LEAST, SLACK = 0.5, 0.5

PIECES = "id string, piece int, n_pieces int, word_start int, word_end int, overlap int, utt_start int, utt_end int, natural boolean, text string"
ARROW = pa.schema(
    [("id", pa.string()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("word_start", pa.int32()), ("word_end", pa.int32()), ("overlap", pa.int32()), ("utt_start", pa.int32()), ("utt_end", pa.int32()), ("natural", pa.bool_()), ("text", pa.string())]
)
SENTENCE_END = re.compile(r"[.?!…][\"')\]>»”]*$")
WORD = re.compile(r"\S+")


def boundaries(words: list[str], utterance_words: list[int] | None) -> np.ndarray:
    """Rank of a cut before each word position 0..n: 2 between utterances, 1 after a sentence, 0 elsewhere."""
    rank = np.zeros(len(words) + 1, dtype=np.int8)
    for i, w in enumerate(words):
        if SENTENCE_END.search(w) and w.lower() not in ABBREVIATIONS:
            rank[i + 1] = 1
    if utterance_words is not None:
        ends = np.cumsum(utterance_words)
        rank[ends[(ends > 0) & (ends <= len(words))]] = 2
    rank[0] = rank[-1] = 2
    return rank


def _last_at(ok: np.ndarray) -> np.ndarray:
    """For each position, the last position at or before it where ok holds, or -1."""
    return np.maximum.accumulate(np.where(ok, np.arange(len(ok)), -1))


def successors(rank: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a piece starting at each position: where it ends, and where the next one starts (n: none follows)."""
    n = len(rank) - 1
    at = np.arange(n + 1)
    far = np.minimum(at + limit, n)
    end = far.copy()
    least = max(int(limit * LEAST), overlap + int(overlap * SLACK) + 1)
    for level in (1, 2):  # the better boundary wins where it is in reach
        last = _last_at(rank >= level)[far]
        end = np.where((far < n) & (last >= at + least), last, end)
    slack = int(overlap * SLACK)
    begin = np.maximum(end - overlap, 0)
    hi = np.minimum(end - overlap + slack, n)
    natural = _last_at(rank >= 1)[np.maximum(hi, 0)]
    begin = np.where(natural >= end - overlap - slack, natural, begin)
    begin = np.maximum(begin, at + 1)  # progress
    return end, np.where(end >= n, n, np.minimum(begin, end))


def greedy_starts(follow: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All positions reached from the roots along the successor table, by squaring it."""
    reached = np.zeros(len(follow), dtype=bool)
    reached[roots] = True
    jump = follow
    while True:  # the k-th round has all positions less than 2^k steps away
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        if (more == reached).all():
            return reached
        reached, jump = more, jump[jump]


def cut_all(texts: list[list[str]], utterances: list[list[int] | None], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int, bool]]]:
    """For each text the pieces (start, end, whether the end is a natural boundary)."""
    if not texts:
        return []
    ranks = [boundaries(w, u) for w, u in zip(texts, utterances)]
    offset = np.concatenate([[0], np.cumsum([len(r) for r in ranks])]).astype(np.int64)
    tables = [successors(r, limit, overlap) for r in ranks]
    follow = np.concatenate([f + o for (_, f), o in zip(tables, offset)])
    reached = greedy_starts(follow, offset[:-1])
    out = []
    for k, ((end, _), rank) in enumerate(zip(tables, ranks)):
        starts = np.flatnonzero(reached[offset[k] : offset[k + 1] - 1])
        out.append([(int(s), int(end[s]), bool(rank[end[s]] > 0)) for s in starts])
    return out


def split_oversized(chunks: DataFrame, utterances: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk whose text has more than `limit` words; stored lengths are not believed.

    Pieces have at most `limit` words, neighbours share about `overlap`, cuts lie between utterances, else after
    sentences, else anywhere. utt_start/utt_end are the utterances a piece touches, where the chunk's utterances have
    as many words as its text; otherwise the chunk's own. Of repeated ids the latest row counts (ties: greatest text);
    null texts and ids have no pieces.
    """
    big = chunks.where(F.col("id").isNotNull() & (word_count(F.col("text")) > limit))
    latest = F.max(F.struct(*(["indexed_at"] if "indexed_at" in chunks.columns else []), "text", "file_id", "utt_start", "utt_end"))
    big = big.groupBy("id").agg(latest.alias("c")).select("id", "c.file_id", "c.text", "c.utt_start", "c.utt_end")
    spans = big.where("utt_end > utt_start").select("id", "file_id", F.explode(F.sequence("utt_start", F.col("utt_end") - 1)).alias("idx"))
    said = utterances.select("file_id", "idx", word_count(F.col("text")).alias("n"))
    counts = spans.join(said, ["file_id", "idx"]).groupBy("id", "idx").agg(F.max("n").alias("n")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("parts"))

    def cut(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = batch.to_pylist()
            words = [WORD.findall(r["text"]) for r in rows]
            fits = [r["parts"] if r["parts"] and sum(p["n"] for p in r["parts"]) == len(w) else None for r, w in zip(rows, words)]
            out = []
            for r, w, parts, pieces in zip(rows, words, fits, cut_all(words, [p and [x["n"] for x in p] for p in fits], limit, overlap)):
                ends = np.cumsum([p["n"] for p in parts]) if parts else None
                spot = [m.span() for m in WORD.finditer(r["text"])]
                for k, (s, e, natural) in enumerate(pieces):
                    first, last = r["utt_start"], r["utt_end"]
                    if ends is not None:
                        first = parts[int(np.searchsorted(ends, s, side="right"))]["idx"]
                        last = parts[int(np.searchsorted(ends, e, side="left"))]["idx"] + 1
                    shared = max(0, pieces[k - 1][1] - s) if k else 0
                    out.append({"id": r["id"], "piece": k, "n_pieces": len(pieces), "word_start": s, "word_end": e, "overlap": shared, "utt_start": first, "utt_end": last, "natural": natural, "text": r["text"][spot[s][0] : spot[e - 1][1]]})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return big.join(counts, "id", "left").mapInArrow(cut, PIECES)
