"""Runs, turns and splitting against plain restatements, and their edge cases."""

import random

import numpy as np
import pytest

from confab.llm import runs, splitting, turns
from confab.llm.voices import aliases_of, resolver

WORDS = "file_id string, word_idx int, text string, start_sec double, end_sec double, prob double, speaker string, speaker_conf double, rows string, chunk int"
TURNS = "file_id string, idx int, speaker string, start_sec double, end_sec double, utterance_start int, utterance_end int, voice string"
SPEAKERS = "file_id string, label string, role string, display_name string, people int"
UTTERANCES = (
    "id string, file_id string, idx int, speaker string, start_sec double, end_sec double, text string, word_start int, word_end int,"
    " words array<struct<token:string,start_sec:double,end_sec:double>>, chunk int, votes string"
)
PEOPLE = [("f", "SPEAKER_00", "host", "Ada Bell", 1), ("f", "SPEAKER_01", "guest", "Cyd Dorn", 1), ("f", "SPEAKER_01", "guest", "Cyd Dorn", 2), (None, None, None, None, None)]


def brute_runs(rows, same):
    """rows in order: (pos, voice, lo, hi)."""
    out = []
    for r in rows:
        if out and r[1] is not None and out[-1][-1][1] == r[1] and same(out[-1][-1], r):
            out[-1].append(r)
        else:
            out.append([r])
    return {(x[0][0], x[-1][0], len(x)) for x in out if x[0][1] is not None}


@pytest.mark.parametrize("chunk,group", [(4, 2), (7, 3), (2048, 4096)])
def test_runs_do_not_depend_on_chunks(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    monkeypatch.setattr(runs, "GROUP", group)
    rnd = random.Random(chunk)
    spelt = {"SPEAKER_00": ["SPEAKER_00", "speaker 0", "host:", "Bell, Ada", "A. Bell"], "SPEAKER_01": ["S1", "Cyd", "[Guest]", "SPK01", "DORN"]}
    rows, voice = [], None
    for i in range(300):
        if rnd.random() < 0.12:
            voice = rnd.choice(["SPEAKER_00", "SPEAKER_01", None])
        if rnd.random() < 0.05:
            continue  # positions may be missing
        rows.append((i, voice, 0, 0))
    data = [("f", i, "x", i * 0.5, i * 0.5 + 0.4, 1.0, rnd.choice(spelt[v]) if v else rnd.choice([None, "", " "]), None, "a", 1) for i, v, _, _ in rows]
    data += [d for d in data if rnd.random() < 0.1] + [(None, 1, "x", 0.0, 1.0, 1.0, "S1", 1.0, None, None), ("f", None, None, None, None, None, None, None, None, None)]
    rnd.shuffle(data)
    found = runs.collapse_runs(runs.word_events(spark.createDataFrame(data, WORDS)), spark.createDataFrame(PEOPLE, SPEAKERS)).collect()
    assert {(r.first_idx, r.last_idx, r.n_events) for r in found} == brute_runs(rows, lambda a, b: True)
    assert all(r.duration_sec == pytest.approx(r.end_sec - r.start_sec) for r in found)


def test_turn_runs_need_adjoining_utterances(spark):
    data = [("f", 0, "S0", 0.0, 1.0, 0, 2, "x"), ("f", 1, "host", 1.0, 2.0, 2, 3, "x"), ("f", 2, "S0", 2.0, 3.0, 4, 5, "x"), ("f", 3, "S0", 2.0, 3.0, 4, 5, "x"), ("f", 4, "zzz", None, None, None, None, "x"), ("f", 5, "zzz", None, None, None, None, "x")]
    found = runs.collapse_runs(runs.turn_events(spark.createDataFrame(data, TURNS)), spark.createDataFrame(PEOPLE, SPEAKERS)).collect()
    assert {(r.first_idx, r.last_idx) for r in found} == {(0, 1), (2, 3), (4, 5)}


def test_empty_tables(spark):
    people = spark.createDataFrame([], SPEAKERS)
    assert runs.collapse_runs(runs.word_events(spark.createDataFrame([], WORDS)), people).count() == 0
    words, said = spark.createDataFrame([], WORDS), spark.createDataFrame([], UTTERANCES)
    assert turns.speaker_turns(said, words, people).count() == 0
    assert turns.clean_utterances(said, words, people).count() == 0
    assert splitting.split_oversized(spark.createDataFrame([], CHUNKS), said).count() == 0


def said(id_, speaker, start, text, at, n, tokens=None):
    tokens = text.split() if tokens is None else tokens
    return (id_, "f", 0, speaker, start, None if start is None else start + 1, text, at, at + n, [(t, 0.0, 0.0) for t in tokens], 1, "v")


def test_turns(spark):
    data = [
        said("u0", "Speaker 0", 0.0, "[00:01] Hello there.", 0, 2, ["Hello", "there."]),
        said("u1", None, 2.0, "(mic bump)", 2, 0, []),
        said("u9", "host", 3.0, "Late but mine.", 2, 3),
        said("u2", None, 5.0, ">> DORN, CYD: Uh, yes.", 5, 2, ["Uh,", "yes."]),
        said("u3", None, 7.0, "By its words.", 7, 3),
        said("u4", "S0", 9.0, "Um.", 10, 1),
        said("u5", "guest", 11.0, "Still me [that was Ada, not me].", 11, 7),
        said("u6", None, 13.0, "Nobody knows.", 30, 2),
        said("u6", None, 13.0, "Nobody knows.", 30, 2),
        (None, "f", 0, "S0", 0.0, 1.0, "x", 0, 1, None, 1, "v"),
        ("u7", "f", 0, "S0", None, None, None, 40, 40, None, 1, "v"),
        ("u8", "f", 0, "S0", None, None, "Spoken [noise] " + "very " * 3000 + "long", 41, 41, None, 1, "v"),
    ]
    words = [("f", i, "w", 0.0, 0.0, 1.0, s, 1.0, "r", 1) for i, s in ((7, "S1"), (8, "spk_1"), (9, "S0"))]
    tables = spark.createDataFrame(data, UTTERANCES), spark.createDataFrame(words, WORDS), spark.createDataFrame(PEOPLE, SPEAKERS)
    found = {(r.label, r.first_id, r.last_id, r.n_utterances) for r in turns.speaker_turns(*tables).collect()}
    assert found == {("SPEAKER_00", "u0", "u9", 2), ("SPEAKER_01", "u2", "u5", 3), ("SPEAKER_00", "u8", "u8", 1)}
    text = {r.id: r.text for r in turns.clean_utterances(*tables).collect()}
    assert text["u0"] == "Hello there." and text["u2"] == "Yes." and text["u5"] == "Still me [that was Ada, not me]."
    assert text["u6"] == "Nobody knows." and "noise" not in text["u8"]


def test_turns_do_not_depend_on_segments(spark, monkeypatch, small):
    tables = [spark.read.parquet(f"{small}/{t}.parquet") for t in ("utterances", "words", "speakers", "manifest")]
    key = lambda df: sorted(tuple(r) for r in df.select("file_id", "label", "first_id", "last_id", "n_utterances").collect())
    whole = key(turns.speaker_turns(*tables))
    monkeypatch.setattr(turns, "SEGMENT", 60)
    assert key(turns.speaker_turns(*tables)) == whole and whole


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        y = rng.normal(size=12) + np.arange(12) * 0.3
        # Brute force: the max-min formula of isotonic regression.
        fit = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(turns.isotonic(y), fit)
    assert (turns.isotonic(np.array([1.0, 2.0, 2.0])) == [1, 2, 2]).all()


def test_clock_resets_run_on():
    start, end = turns.repair_times(np.array([0.0, 50.0, 100.0, 0.0, 40.0]), np.array([10.0, 60.0, 110.0, 10.0, 50.0]))
    assert start.tolist() == [0, 50, 100, 110, 150] and end.tolist() == [10, 60, 110, 120, 160]
    start, end = turns.repair_times(np.array([0.0, 5.0, 4.0, np.nan]), np.array([4.0, 4.5, np.nan, np.nan]))
    assert start == pytest.approx([0, 13 / 3, 13 / 3, 13 / 3]) and (end >= start).all()


def test_resets_move_all_later_segments(spark, monkeypatch):
    """Resets inside segments and at their borders, an inconsistent time, and a row without words: the same times and order
    whatever the segments, equal to those of the whole recording repaired at once."""
    rnd = random.Random(12)
    rows, clock = [], 0.0
    for i in range(240):
        if i in (30, 61, 100, 180):  # 60 words a segment: borders at 60 words, so some lie inside
            clock = rnd.uniform(0, 3)
        late = -4.0 if i == 150 else 0.0
        rows.append(said(f"u{i:03d}", rnd.choice(("host", "guest")), clock + late, "Words of mine.", 2 * i, 2))
        clock += rnd.uniform(5, 9)
    rows.append(("lost", "f", 999, "host", 55.0, 56.0, "No words.", None, None, None, 1, "v"))
    table, words, people = spark.createDataFrame(rows, UTTERANCES), spark.createDataFrame([], WORDS), spark.createDataFrame(PEOPLE, SPEAKERS)
    start, end = turns.repair_times(np.array([r[4] for r in rows[:-1]]), np.array([r[5] for r in rows[:-1]]))
    assert (np.diff(start) >= 0).all() and start[-1] > 1300
    for size in (60, 4096):
        monkeypatch.setattr(turns, "SEGMENT", size)
        found = sorted(turns.clean_utterances(table, words, people).collect(), key=lambda r: (r.chunk, r.pos))
        times = {r.id: (r.start_sec, r.end_sec) for r in found}
        assert len(found) == 241 and [r.start_sec for r in found] == sorted(r.start_sec for r in found)
        for r, s, e in zip(rows, start, end):
            assert times[r[0]] == pytest.approx((s, e))


CHUNKS = "id string, file_id string, text string, utt_start int, utt_end int, n_words int, doc_len int, parts string, piece int"


def test_pieces(spark):
    rnd = random.Random(3)
    sentence = lambda: " ".join(rnd.choice(("a", "bb", "ccc")) for _ in range(rnd.randrange(3, 30))) + "."
    said = [("u", "f", i, "s", 0.0, 1.0, sentence(), 0, 0, None, 1, "v") for i in range(30)]
    joined = " ".join(u[6] for u in said)
    texts = {"whole": joined, "none": "word " * 120, "flat": "word " * 500, "null": None, "empty": "", "huge": "x. " * 20000}
    rows = [(k, "f", t, 0, 30, 0, None, "p", 1) for k, t in texts.items()] + [("whole", "f", joined, 0, 30, 5, 5, "p", 1), (None, "f", joined, 0, 30, 1, 1, "p", 1)]
    found = splitting.split_oversized(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(said, UTTERANCES)).collect()
    assert {r.id for r in found} == {"whole", "flat", "huge"}
    for k in ("whole", "flat", "huge"):
        pieces, words = sorted((r for r in found if r.id == k), key=lambda r: r.piece), texts[k].split()
        assert [r.piece for r in pieces] == list(range(pieces[0].n_pieces))
        assert pieces[0].word_start == 0 and pieces[-1].word_end == len(words)
        for a, b in zip(pieces, pieces[1:]):
            assert 10 <= a.word_end - b.word_start <= 30 and b.overlap == a.word_end - b.word_start
        for r in pieces:
            assert r.word_end - r.word_start <= 120 and r.text.split() == words[r.word_start : r.word_end]
            assert 0 <= r.utt_start < r.utt_end <= 30
    assert all(r.natural for r in found if r.id == "huge")


def test_doubling_follows_the_successors():
    rnd = random.Random(5)
    for _ in range(30):
        n = rnd.randrange(2, 200)
        follow = np.array([min(n, i + rnd.randrange(1, 9)) for i in range(n)] + [n])
        i, walked = 0, set()
        while i < n:
            walked.add(i)
            i = int(follow[i])
        assert set(np.flatnonzero(splitting.greedy_starts(follow, np.array([0])))) - {n} == walked


def test_voices():
    people = [("SPEAKER_00", "host", "Ada Bell"), ("SPEAKER_01", "guest", None), ("SPEAKER_02", "unknown", "Ada Dorn")]
    resolve = resolver(aliases_of(people, "Ada Bell", "Eve Fox"))
    assert [resolve(x) for x in ("spk_0", "Bell", "[Host]", "FOX, EVE", "SPEAKER 02:", "Ada")] == ["SPEAKER_00", "SPEAKER_00", "SPEAKER_00", "SPEAKER_01", "SPEAKER_02", "?ada"]
