"""Runs of consecutive events of one voice (problem 1), and the stitching that problem 2 shares.

Method: boundary interval lookup. A recording is divided into entity chunks of CHUNK positions. In each chunk the
positions where a run starts are gathered into a sorted array, every event is assigned to its run by binary search in
that array, and the runs are aggregated. Runs that touch a chunk's edge are then joined with those of the neighbouring
chunks: first inside groups of GROUP chunks, then along the recording, over at most two rows a group. So no task ever
holds more than a chunk's events, or the edges of one group, however long a recording is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.llm.voices import ALIAS_TYPE, alias_maps, resolver
from confab.session import stage

CHUNK = 2048
GROUP = 4096

PARTIAL = (
    "file_id string, chunk bigint, pos bigint, voice string, first_idx bigint, last_idx bigint, n_events bigint,"
    " lo bigint, hi bigint, start_sec double, end_sec double, first_id string, last_id string, head boolean, tail boolean"
)
PARTIAL_ARROW = pa.schema(
    [
        ("file_id", pa.string()), ("chunk", pa.int64()), ("pos", pa.int64()), ("voice", pa.string()), ("first_idx", pa.int64()), ("last_idx", pa.int64()),
        ("n_events", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("start_sec", pa.float64()), ("end_sec", pa.float64()),
        ("first_id", pa.string()), ("last_id", pa.string()), ("head", pa.bool_()), ("tail", pa.bool_()),
    ]
)


def run_starts(voice: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sorted positions at which a run starts. voice: codes, -1 without a voice (each such event stands alone)."""
    if not len(voice):
        return np.zeros(0, dtype=np.int64)
    joined = (voice[1:] == voice[:-1]) & (voice[1:] >= 0) & (lo[1:] <= hi[:-1])
    return np.concatenate([[0], 1 + np.flatnonzero(~joined)])


def aggregate_runs(starts: np.ndarray, n: int, start_sec: np.ndarray, end_sec: np.ndarray) -> dict[str, np.ndarray]:
    """Assigns each of n events to its run by binary search, then aggregates."""
    run = np.searchsorted(starts, np.arange(n), side="right") - 1
    return {
        "n_events": np.bincount(run, minlength=len(starts)),
        "last": np.append(starts[1:], n) - 1,
        "start_sec": np.fmin.reduceat(start_sec, starts) if n else start_sec,
        "end_sec": np.fmax.reduceat(end_sec, starts) if n else end_sec,
    }


def with_aliases(grouped: DataFrame, keys: DataFrame, maps: DataFrame) -> DataFrame:
    """Gives each entity chunk its recording's aliases. The maps are spread over the chunks' keys first, so that the
    events themselves are joined on (file_id, chunk), which no recording makes hot."""
    return grouped.join(keys.distinct().join(maps, "file_id").select("file_id", "chunk", "aliases"), ["file_id", "chunk"], "left")


def partial_runs(events: DataFrame, maps: DataFrame) -> DataFrame:
    """Runs inside each entity chunk. events: file_id, pos, speaker, lo, hi, start_sec, end_sec."""
    events = events.where("file_id is not null and pos is not null").withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    grouped = events.groupBy("file_id", "chunk").agg(F.collect_set(F.struct("pos", "speaker", "lo", "hi", "start_sec", "end_sec")).alias("rows"))

    def find(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out: dict[str, list] = {name: [] for name in PARTIAL_ARROW.names}
            rows, aliases = batch.column("rows"), batch.column("aliases").to_pylist()
            files, chunks = batch.column("file_id").to_pylist(), batch.column("chunk").to_pylist()
            for i in range(batch.num_rows):
                values = rows[i].values
                col = {f.name: values.field(k) for k, f in enumerate(values.type)}
                pos = col["pos"].to_numpy(zero_copy_only=False)
                spelt = col["speaker"].dictionary_encode()
                resolve = resolver(aliases[i])
                voices = [resolve(x) for x in spelt.dictionary.to_pylist()]
                names = sorted({v for v in voices if v})
                code = np.array([names.index(v) if v else -1 for v in voices] + [-1], dtype=np.int64)
                voice = code[spelt.indices.fill_null(len(voices)).to_numpy(zero_copy_only=False)]
                # Of rows that share a position, the one with the last voice in order counts.
                order = np.lexsort((voice, pos))
                order = order[np.append(pos[order][1:] != pos[order][:-1], True)]
                open_ = {"lo": -(1 << 62), "hi": 1 << 62}
                take = {k: col[k].fill_null(v).to_numpy(zero_copy_only=False)[order] for k, v in open_.items()}
                times = {k: col[k].to_numpy(zero_copy_only=False).astype(float)[order] for k in ("start_sec", "end_sec")}
                pos, voice = pos[order], voice[order]
                starts = run_starts(voice, take["lo"], take["hi"])
                runs = aggregate_runs(starts, len(pos), times["start_sec"], times["end_sec"])
                k, last = len(starts), runs["last"]
                head, tail = np.arange(k) == 0, np.arange(k) == k - 1
                keep = np.flatnonzero((voice[starts] >= 0) | head | tail)
                out["file_id"] += [files[i]] * len(keep)
                out["chunk"] += [chunks[i]] * len(keep)
                out["voice"] += [names[v] if v >= 0 else None for v in voice[starts[keep]].tolist()]
                out["pos"] += pos[starts[keep]].tolist()
                out["first_idx"] += pos[starts[keep]].tolist()
                out["last_idx"] += pos[last[keep]].tolist()
                out["lo"] += take["lo"][starts[keep]].tolist()
                out["hi"] += take["hi"][last[keep]].tolist()
                out["first_id"] += [None] * len(keep)
                out["last_id"] += [None] * len(keep)
                for name, array in (("n_events", runs["n_events"]), ("start_sec", runs["start_sec"]), ("end_sec", runs["end_sec"]), ("head", head), ("tail", tail)):
                    out[name] += [None if x != x else x for x in array[keep].tolist()]
            yield pa.RecordBatch.from_pydict(out, schema=PARTIAL_ARROW)

    return with_aliases(grouped, events.select("file_id", "chunk"), maps).mapInArrow(find, PARTIAL)


def _merge(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Joins runs across the borders of chunks inside each group of keys; head and tail then speak of the group."""
    w = Window.partitionBy(*keys).orderBy("chunk", "pos")
    before = F.lag(F.struct("voice", "chunk", "hi", "tail")).over(w)
    joins = (before["voice"] == F.col("voice")) & (before["chunk"] != F.col("chunk")) & before["tail"] & F.col("head") & (F.col("lo") <= before["hi"])
    numbered = edges.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(w))
    merged = numbered.groupBy(*keys, "run").agg(
        F.min("pos").alias("pos"), F.max("voice").alias("voice"),
        F.min_by("first_idx", "pos").alias("first_idx"), F.max_by("last_idx", "pos").alias("last_idx"),
        F.sum("n_events").alias("n_events"), F.min_by("lo", "pos").alias("lo"), F.max_by("hi", "pos").alias("hi"),
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"),
        F.min_by("first_id", "pos").alias("first_id"), F.max_by("last_id", "pos").alias("last_id"),
    )
    own = Window.partitionBy(*keys)
    return merged.withColumns({"head": F.col("run") == F.min("run").over(own), "tail": F.col("run") == F.max("run").over(own)}).drop("run")


def stitch(partial: DataFrame) -> DataFrame:
    """Whole runs from the runs inside chunks."""
    columns = ["file_id", "voice", "first_idx", "last_idx", "n_events", "start_sec", "end_sec", "first_id", "last_id"]
    partial = stage(partial)  # read three times below
    edges = partial.where("head or tail").withColumn("group", F.floor(F.col("chunk") / GROUP))
    grouped = _merge(edges, ["file_id", "group"]).withColumnRenamed("group", "chunk")
    along = _merge(grouped.where("head or tail"), ["file_id"])
    whole = partial.where("not head and not tail").select(columns)
    for part in (grouped.where("not head and not tail"), along):
        whole = whole.unionByName(part.select(columns))
    return whole.where("voice is not null").withColumn("duration_sec", F.round(F.col("end_sec") - F.col("start_sec"), 6))


def collapse_runs(events: DataFrame, speakers: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row a maximal run of neighbouring events of one voice: count, first and last position, time and duration.

    events: file_id, pos, speaker, lo, hi, start_sec, end_sec. Neighbours are consecutive positions that exist; an event
    joins the one before if its lo isn't beyond the other's hi (null: always). Exact repeats count once; of different
    rows at one position the one whose voice comes last in order counts, rows with a voice before those without. Rows without file_id or
    pos take no part, rows without speaker end a run and are in none, null times don't count.
    """
    return stitch(partial_runs(events, alias_maps(speakers, manifest)))


def word_events(words: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    return words.select("file_id", F.col("word_idx").cast("long").alias("pos"), "speaker", none.alias("lo"), none.alias("hi"), F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"))


def turn_events(turns: DataFrame) -> DataFrame:
    return turns.select(
        "file_id", F.col("idx").cast("long").alias("pos"), "speaker", F.col("utterance_start").cast("long").alias("lo"), F.col("utterance_end").cast("long").alias("hi"),
        F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"),
    )


__all__ = ["ALIAS_TYPE", "collapse_runs", "stitch", "turn_events", "with_aliases", "word_events"]
