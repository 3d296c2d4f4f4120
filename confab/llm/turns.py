"""Clean speaker turns from utterances (problem 2).

Method: inside file segments (stretches of SEGMENT words of a recording) clock resets are undone and inconsistent times
repaired by isotonic regression of the start times along the order of the words; the repaired times give the order.
Utterances are cleaned by a small grammar (labels, clock times, annotations, hesitations) and intervals of one canonical
speaker are merged, across segments with the stitching of problem 1.

Between two resets a recording's clock runs in one epoch. Segments tell only the first and last start and the latest end of
their epochs; from these the shift of every epoch follows by prefix sums along the recording, so that a reset moves all
later segments.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.llm.runs import PARTIAL, PARTIAL_ARROW, stitch, with_aliases
from confab.llm.voices import alias_maps, resolver, voice_key
from confab.session import stage

SEGMENT = 4096
#: A fall of the clock by more than this many seconds is a reset, a smaller one an inconsistent time.
RESET_SEC = 30.0

HESITATION = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|e+h+|a+h+|h+m+|m+h+m+|m{2,})$")
CLOCK = r"(?:\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?|\d+h\s?\d+m(?:\s?\d+s)?)"
LEAD_CLOCK = re.compile(rf"^\s*(?:[\[(<]\s*{CLOCK}\s*[\])>]|{CLOCK}\s*(?:-->|[-–]\s))\s*")
ANY_CLOCK = re.compile(rf"[\[(<]\s*{CLOCK}\s*[\])>]|{CLOCK}\s*-->")
BRACKETED = re.compile(r"♪[^♪]*♪|\(\([^()]*\)\)|<<[^<>]*>>|\*\*[^*]+\*\*|\*[^*]+\*|\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|♪+")
MARK = re.compile(r"^\s*(?:>>+|[-–—•])\s*")
BOXED_LABEL = re.compile(r"^\s*\[([^\[\]]{1,80})\]\s*:?\s*")
PLAIN_LABEL = re.compile(r"^\s*([^:\[\]<>()]{1,80}?)\s*(?::|\s[-–—])\s*")
WORD = re.compile(r"\w+(?:['’]\w+)*")

CLEAN = "file_id string, chunk bigint, pos bigint, id string, label string, start_sec double, end_sec double, text string"
CLEAN_ARROW = pa.schema(
    [("file_id", pa.string()), ("chunk", pa.int64()), ("pos", pa.int64()), ("id", pa.string()), ("label", pa.string()), ("start_sec", pa.float64()), ("end_sec", pa.float64()), ("text", pa.string())]
)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(unicodedata.normalize("NFKC", text))]


def is_speech(words: list[str]) -> bool:
    """Whether any word is more than a hesitation sound."""
    return any(not HESITATION.match(w) for w in words)


def split_label(text: str, label_of) -> tuple[str | None, str]:  # noqa: ANN001
    """The canonical label that opens the text, and the rest without label and leading clock times."""
    rest, label, moved = text, None, True
    while moved:
        moved = False
        for pattern in (LEAD_CLOCK, MARK):
            if m := pattern.match(rest):
                rest, moved = rest[m.end() :], True
        if label is None:
            for pattern in (BOXED_LABEL, PLAIN_LABEL):
                if (m := pattern.match(rest)) and (found := label_of(m[1])):
                    label, rest, moved = found, rest[m.end() :], True
                    break
    return label, rest


def clean_text(rest: str, spoken: list[str] | None) -> str:
    """Drops clock times, annotations and hesitations, and closes the sentence. Of bracketed parts those are kept whose
    words were spoken, as told by the utterance's own words; without these, those of more than three words."""
    known = None if spoken is None else {voice_key(w) for w in spoken}

    def kept(m: re.Match) -> str:
        inner = [voice_key(w) for w in WORD.findall(m[0])]
        real = bool(inner) and (len(inner) > 3 if known is None else all(w in known for w in inner))
        return m[0] if real else " "

    body = BRACKETED.sub(kept, ANY_CLOCK.sub(" ", rest)).replace("♪", " ")
    said = []
    for piece in body.split():
        words = words_of(piece)
        if words and all(HESITATION.match(w) for w in words):
            if said and piece[-1] in ".?!" and said[-1][-1] not in ".?!":
                said[-1] = said[-1].rstrip(",;:") + piece[-1]
        else:
            said.append(piece)
    out = " ".join(said).strip(" ,;-–")
    if not words_of(out):
        return ""
    first = next((i for i, c in enumerate(out) if c.isalpha()), 0)
    out = out[:first] + out[first].upper() + out[first + 1 :]
    return out if out[-1] in ".?!…\"')]>" else out + "."


def isotonic(values: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    if len(values) < 2 or (np.diff(values) >= 0).all():
        return values
    means: list[float] = []
    sizes: list[int] = []
    for v in values.tolist():
        mean, size = v, 1
        while means and means[-1] > mean:
            m, s = means.pop(), sizes.pop()
            mean, size = (m * s + mean * size) / (s + size), s + size
        means.append(mean)
        sizes.append(size)
    return np.repeat(means, sizes)


def repair_times(start: np.ndarray, end: np.ndarray, shifts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Times of a segment in spoken order: the shift of its epoch is added to each, so that after a reset the clock runs on
    from the latest end before it; then starts are fitted to be non-decreasing and ends not to precede them. Consistent
    times are returned as they are. shifts: of the segment's epochs, None where it is the whole recording."""
    if np.isnan(start).any():  # a missing start is that of the utterance before, or the first known one
        known = np.flatnonzero(~np.isnan(start))
        at = np.maximum.accumulate(np.where(np.isnan(start), known[0] if len(known) else 0, np.arange(len(start))))
        start = np.nan_to_num(start[at], nan=0.0)
    end = np.where(np.isnan(end), start, end)
    epoch = np.concatenate([[0], np.cumsum(np.diff(start) < -RESET_SEC)]).astype(int)[: len(start)]
    if shifts is None:
        first = np.searchsorted(epoch, np.arange(epoch[-1] + 1 if len(epoch) else 0))
        gaps = [max(0.0, float(end[a:b].max() - start[b])) for a, b in zip(first, first[1:])]
        shifts = np.concatenate([[0.0], np.cumsum(gaps)])
    if shifts.any():
        start, end = start + shifts[epoch], end + shifts[epoch]
    fit = isotonic(start)
    return fit, np.maximum(end, fit)


def clean_segment(rows: list[dict], votes: dict[str, list[dict]], aliases: dict | list | None, shifts: list[float] | None, unspoken: bool = False) -> list[dict]:
    """Spoken utterances of one segment in order of their repaired times, with canonical label and clean text. With
    `unspoken` all of them."""
    resolve = resolver(aliases)

    def label_of(raw: str | None) -> str | None:
        v = resolve(raw)
        return None if v is None or v.startswith("?") else v

    ordered = sorted(rows, key=lambda r: (r["pos"], r["word_end"], r["start_sec"] or 0.0, r["id"]))
    as_float = lambda k: np.array([np.nan if r[k] is None else r[k] for r in ordered], dtype=float)
    start, end = repair_times(as_float("start_sec"), as_float("end_sec"), np.array(shifts or [0.0]))
    out = []
    for i in np.argsort(start, kind="stable"):
        r, s, e = ordered[i], float(start[i]), float(end[i])
        inside, rest = split_label(r["text"] or "", label_of)
        spoken = None if r["tokens"] is None else [w for t in r["tokens"] for w in words_of(t or "")]
        text = clean_text(rest, spoken)
        if not unspoken and not is_speech(words_of(text) if spoken is None else spoken):
            continue
        label = label_of(r["speaker"]) or inside
        if label is None:
            tally: dict[str, int] = {}
            for v in votes.get(r["id"], ()):
                if (who := label_of(v["speaker"])) is not None:
                    tally[who] = tally.get(who, 0) + v["n"]
            label = max(sorted(tally), key=tally.get) if tally else None
        out.append({"id": r["id"], "label": label, "start_sec": s, "end_sec": e, "text": text})
    return out


def placed(utterances: DataFrame) -> DataFrame:
    """One row an id, of several the latest, then the greatest: with pos, the place among the recording's words, and chunk.
    A row without word_start has the place of the last one that starts at or before it by the clock, behind it; one without
    start either stands at the end."""
    real = lambda c: F.col(c).cast("double").alias(c)
    columns = [F.col(c) if c in utterances.columns else F.lit(None).alias(c) for c in ("indexed_at",)]
    row = F.struct(*columns, "word_start", "word_end", real("start_sec"), "speaker", "text", real("end_sec"), F.col("words.token").alias("tokens"), "file_id")
    one = utterances.where("file_id is not null and id is not null").groupBy("id").agg(F.max(row).alias("r")).select("id", "r.*")
    one = stage(one.select("id", "file_id", "speaker", "start_sec", "end_sec", "text", "word_start", "word_end", "tokens"))  # read three times
    known = one.where("word_start is not null").withColumns({"pos": F.col("word_start").cast("long"), "word_end": F.coalesce("word_end", "word_start").cast("long")})
    minute = F.coalesce(F.floor(F.col("start_sec") / 60), F.lit(1 << 40)).alias("minute")
    lost = one.where("word_start is null")
    heard = known.where("start_sec is not null").select("file_id", minute, "pos", "start_sec").unionByName(lost.select("file_id", minute, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("double").alias("start_sec")))
    minutes = heard.groupBy("file_id", "minute").agg(F.max("pos").alias("last"), F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("start_sec", "pos"))).alias("spots"))
    before = Window.partitionBy("file_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)  # a row a minute
    minutes = minutes.withColumn("reach", F.max("last").over(before))
    inside = F.array_max(F.transform(F.filter("spots", lambda x: x["start_sec"] <= F.col("start_sec")), lambda x: x["pos"]))
    found = lost.withColumn("minute", minute).join(minutes.select("file_id", "minute", "spots", "reach"), ["file_id", "minute"], "left")
    found = found.withColumns({"pos": F.coalesce(inside, "reach", F.lit(0)), "word_end": F.lit(1 << 40)})
    columns = ["id", "file_id", "speaker", "start_sec", "end_sec", "text", "word_start", "word_end", "tokens", "pos"]
    return known.select(columns).unionByName(found.select(columns)).withColumn("chunk", F.floor(F.col("pos") / SEGMENT))


def clock_shifts(rows: DataFrame) -> DataFrame:
    """(file_id, chunk, shifts): what to add to the times of each epoch of a segment."""
    known = rows.where("start_sec is not null").select("file_id", "chunk", "pos", "word_end", "start_sec", "id", F.coalesce("end_sec", "start_sec").alias("end_sec"))
    order = ("pos", "word_end", "start_sec", "id")
    inside = Window.partitionBy("file_id", "chunk").orderBy(*order)
    known = known.withColumn("falls", F.coalesce((F.col("start_sec") - F.lag("start_sec").over(inside) < -RESET_SEC).cast("int"), F.lit(0)))
    known = known.withColumn("epoch", F.sum("falls").over(inside))
    parts = known.groupBy("file_id", "chunk", "epoch").agg(F.min(F.struct(*order))["start_sec"].alias("first"), F.max(F.struct(*order))["start_sec"].alias("last"), F.max("end_sec").alias("top"))
    # Along a recording: a row a segment and epoch.
    along = Window.partitionBy("file_id").orderBy("chunk", "epoch")
    opens = (F.col("epoch") > 0) | F.coalesce(F.col("first") - F.lag("last").over(along) < -RESET_SEC, F.lit(False))
    parts = parts.withColumn("opens", opens.cast("int")).withColumn("whole", F.sum("opens").over(along))
    whole = parts.groupBy("file_id", "whole").agg(F.max("top").alias("top"), F.min(F.struct("chunk", "epoch", "first"))["first"].alias("first"))
    runs_on = Window.partitionBy("file_id").orderBy("whole")
    whole = whole.withColumn("gap", F.greatest(F.coalesce(F.lag("top").over(runs_on) - F.col("first"), F.lit(0.0)), F.lit(0.0))).withColumn("shift", F.sum("gap").over(runs_on))
    shifted = parts.join(whole.select("file_id", "whole", "shift"), ["file_id", "whole"])
    return shifted.groupBy("file_id", "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch", "shift"))), lambda x: x["shift"]).alias("shifts"))


def _segments(utterances: DataFrame, words: DataFrame, maps: DataFrame) -> DataFrame:
    """(file_id, chunk, rows, shifts, votes, aliases): a row a file segment."""
    rows = placed(utterances)
    grouped = rows.groupBy("file_id", "chunk").agg(F.collect_list(F.struct("id", "speaker", "start_sec", "end_sec", "text", "pos", "word_end", "tokens")).alias("rows"))
    # Only utterances without speaker ask their words; the words' speakers are counted before anything is resolved.
    asking = rows.where(F.coalesce(F.trim("speaker"), F.lit("")) == "").where("word_end > word_start")
    wanted = asking.select("file_id", "chunk", "id", F.explode(F.sequence(F.col("word_start").cast("long"), F.col("word_end") - 1)).alias("word_idx"))
    told = words.where("speaker is not null").select("file_id", F.col("word_idx").cast("long").alias("word_idx"), "speaker")
    votes = (
        wanted.join(told, ["file_id", "word_idx"]).groupBy("file_id", "chunk", "id", "speaker").agg(F.countDistinct("word_idx").alias("n"))
        .groupBy("file_id", "chunk").agg(F.collect_list(F.struct("id", "speaker", "n")).alias("votes"))
    )
    grouped = grouped.join(clock_shifts(rows), ["file_id", "chunk"], "left").join(votes, ["file_id", "chunk"], "left")
    return with_aliases(grouped, rows.select("file_id", "chunk"), maps)


def _each(batches, unspoken: bool = False):  # noqa: ANN001, ANN202
    for batch in batches:
        for r in batch.to_pylist():
            votes: dict[str, list[dict]] = {}
            for v in r["votes"] or ():
                votes.setdefault(v["id"], []).append(v)
            yield r["file_id"], r["chunk"], clean_segment(r["rows"], votes, r["aliases"], r["shifts"], unspoken)


def clean_utterances(utterances: DataFrame, words: DataFrame, speakers: DataFrame, manifest: DataFrame | None = None, unspoken: bool = False) -> DataFrame:
    """One row a spoken utterance: file_id, id, label, repaired start_sec and end_sec, clean text; (chunk, pos) give the
    order in the recording. Rows without file_id or id take no part; an utterance nobody can be named for has a null label;
    an empty or null text is left out unless its words hold speech or `unspoken` asks for all; repeats count once."""

    def rows(batches):  # noqa: ANN001, ANN202
        for file_id, chunk, said in _each(batches, unspoken):
            yield pa.RecordBatch.from_pylist([{"file_id": file_id, "chunk": chunk, "pos": i, **u} for i, u in enumerate(said)], schema=CLEAN_ARROW)

    return _segments(utterances, words, alias_maps(speakers, manifest)).mapInArrow(rows, CLEAN)


def speaker_turns(utterances: DataFrame, words: DataFrame, speakers: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row a maximal run of spoken utterances of one speaker, in spoken order: file_id, label, first_id, last_id,
    number of utterances, times. Utterances without speech interrupt nothing; one nobody can be named for ends a turn
    and is in none. Nulls and repeats as in `clean_utterances`."""

    def rows(batches):  # noqa: ANN001, ANN202
        for file_id, chunk, said in _each(batches):
            out, last = [], object()
            for i, u in enumerate(said):
                if u["label"] is not None and u["label"] == last:
                    run = out[-1]
                    run["n_events"] += 1
                    run |= {"last_idx": i, "last_id": u["id"], "end_sec": max(run["end_sec"], u["end_sec"])}
                else:
                    out.append({"file_id": file_id, "chunk": chunk, "pos": chunk * (1 << 32) + i, "voice": u["label"], "first_idx": i, "last_idx": i, "n_events": 1, "lo": 0, "hi": 0, "start_sec": u["start_sec"], "end_sec": u["end_sec"], "first_id": u["id"], "last_id": u["id"], "head": False, "tail": False})
                last = u["label"]
            if out:
                out[0]["head"], out[-1]["tail"] = True, True
                yield pa.RecordBatch.from_pylist(out, schema=PARTIAL_ARROW)

    partial = _segments(utterances, words, alias_maps(speakers, manifest)).mapInArrow(rows, PARTIAL)
    return stitch(partial).select("file_id", F.col("voice").alias("label"), "first_id", "last_id", F.col("n_events").alias("n_utterances"), "start_sec", "end_sec", "duration_sec")
