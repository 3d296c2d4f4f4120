"""Words to utterances, turns, passages; speaker roles; smoothing. Expected values restate published cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.config import Settings
from confab.operators import diarization, roles, sequence

WORD = "file_id string, word_idx int, text string, start_sec double, end_sec double, speaker string"
SAID = "file_id string, idx int, speaker string, start_sec double, end_sec double, text string"


def words(*rows, file="f"):
    return [(file, i, t, s, e, who) for i, (t, s, e, who) in enumerate(rows)]


def test_sentence_ends(spark):
    tokens = {"today.": True, "really?": True, '"yes!"': True, "Dr.": False, "U.S.": False, "hello,": False, "a.b.c.": False, "ok)": False, "end.)": True}
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", sequence.ends_sentence(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in rows} == tokens


def cut(spark, rows, **kw):
    """The words of each utterance. rows: (text, speaker, start)."""
    data = [("f", i, t, s, s + 0.2, who) for i, (t, who, s) in enumerate(rows)]
    return [list(range(r.word_start, r.word_end)) for r in sequence.build_utterances(spark.createDataFrame(data, WORD), **kw).orderBy("idx").collect()]


def test_utterances_split_at_speakers_pauses_and_sentences(spark):
    rows = [("Hi", "a", 0.0), ("there.", "a", 0.3), ("Well", "b", 0.6), ("I", "b", 0.9), ("left", "b", 1.2), ("then", "b", 4.0), ("came", "b", 4.3), ("back.", "b", 4.6), ("Oh", "a", 5.0)]
    assert cut(spark, rows) == [[0, 1], [2, 3, 4], [5, 6, 7], [8]]


def test_long_utterances_split_at_commas(spark, monkeypatch):
    from confab.operators import islands

    parts = cut(spark, [(f"word{i}" + ("," if i == 35 else ""), "a", i * 0.3) for i in range(60)])
    assert [len(c) for c in parts] == [36, 24] and sum(parts, []) == list(range(60))
    assert [len(c) for c in cut(spark, [("w", "a", i * 0.3) for i in range(60)])] == [50, 10]
    assert [len(c) for c in cut(spark, [("w" if i < 49 else "w.", "a", i * 0.3) for i in range(50)])] == [50]
    # Word by word: a part is closed at its last allowed word, the words behind a comma are carried on.
    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["w", "w", "w", "w,", "w."], p=[0.5, 0.2, 0.2, 0.09, 0.01])), "ab"[int(rng.random() < 0.02)], i * 0.3 + 2 * (rng.random() < 0.01)) for i in range(700)]
    want, part = [], []
    for i, (t, who, s) in enumerate(rows):
        if part and (who != rows[i - 1][1] or s - (rows[i - 1][2] + 0.2) >= 1.5):
            want, part = [*want, part], []
        part = [*part, i]
        if t == "w.":
            want, part = [*want, part], []
        elif len(part) == 8:
            at = max((k + 1 for k in range(5, 8) if rows[part[k]][0] == "w,"), default=8)
            want, part = [*want, part[:at]], part[at:]
    want = [*want, part] if part else want
    for size in (2048, 50):
        monkeypatch.setattr(islands, "CHUNK", size)
        assert cut(spark, rows, max_words=8) == want


def test_build_utterances_and_turns(spark):
    data = words(("A.", 0.0, 0.2, "s0"), ("B.", 0.3, 0.5, "s0"), ("C.", 0.6, 0.8, "s1"), ("D.", 0.9, 1.1, "s0"))
    said = sequence.build_utterances(spark.createDataFrame(data, WORD))
    assert [(r.id, r.text, r.word_start, r.word_end) for r in said.orderBy("idx").collect()] == [("f_u0000", "A.", 0, 1), ("f_u0001", "B.", 1, 2), ("f_u0002", "C.", 2, 3), ("f_u0003", "D.", 3, 4)]
    turns = sequence.build_turns(said).orderBy("turn").collect()
    assert [(r.speaker, r.utterance_start, r.utterance_end) for r in turns] == [("s0", 0, 2), ("s1", 2, 3), ("s0", 3, 4)]


def test_clean_words(spark):
    data = words((" a", 1.0, 1.2, None), ("  ", 1.2, 1.3, None), ("b", 0.9, 0.9, None))
    found = sequence.clean_words(spark.createDataFrame(data, WORD)).orderBy("word_idx").collect()
    assert [(r.text, r.start_sec, r.end_sec) for r in found] == [("a", 1.0, 1.2), ("b", 1.0, 1.02)]
    assert [r.new_idx for r in sequence.reindex(spark.createDataFrame(data, WORD)).orderBy("word_idx").collect()] == [0, 1, 1]


def test_merge_continuations(spark):
    w = [("f", 0, " an", 0.0, 0.2, 0.9), ("f", 1, " F", 0.2, 0.5, 0.8), ("f", 2, "-15", 0.5, 0.8, 0.6), ("f", 3, " jet.", 0.8, 1.0, 0.9), ("f", 4, "-x", 1.0, 1.1, 0.5), ("f", 5, " ", 1.1, 1.2, 0.5), ("f", 6, "lost", 1.2, 1.3, 0.5), ("f", 7, "y", 1.3, 1.4, 0.5), ("g", 0, "a", 0.0, 0.1, 1.0)]
    table = spark.createDataFrame(w, "file_id string, word_idx int, text string, start_sec double, end_sec double, prob double")
    s = spark.createDataFrame([("f", " an F-15 jet.", 0, 4), ("f", "-x y", 4, 8), ("g", "a", 0, 1), ("g", "", 1, 1)], "file_id string, text string, word_start int, word_end int")
    found = [(r.file_id, r.word_idx, r.text, r.prob, r.ends_segment) for r in sequence.merge_continuations(table, s).orderBy("file_id", "word_idx").collect()]
    assert found == [("f", 0, "an", 0.9, False), ("f", 1, "F-15", 0.6, False), ("f", 2, "jet.", 0.9, True), ("f", 3, "-x", 0.5, False), ("f", 4, "lost", 0.5, False), ("f", 5, "y", 0.5, True), ("g", 0, "a", 1.0, True)]


def test_what_lies_before_does_not_depend_on_chunks(spark, small, monkeypatch):
    from confab import catalogue
    from confab.operators import islands

    names = ("e2_turns", "e3_speech_regions", "e5_build_utterances", "e8_clean_words", "e10_reindex", "e11_boundaries", "c_as_of_utterance")
    rows = lambda name: sorted(map(repr, catalogue.QUERIES[name](spark, small).collect()))
    whole = {n: rows(n) for n in names}
    monkeypatch.setattr(islands, "CHUNK", 7)
    monkeypatch.setattr(islands, "CHUNK_SEC", 5.0)
    for n in names:
        assert rows(n) == whole[n] and whole[n], n


def test_regions_and_windows(spark):
    data = words(("a", 0.0, 0.5, None), ("b", 0.7, 1.0, None), ("c", 3.0, 3.5, None))
    assert sorted((r.start_sec, r.end_sec) for r in sequence.speech_regions(spark.createDataFrame(data, WORD)).collect()) == [(0.0, 1.0), (3.0, 3.5)]
    regions = spark.createDataFrame([("f", 0, 0.0, 4.0), ("f", 1, 5.0, 5.2), ("f", 2, 6.0, 7.0)], "file_id string, island int, start_sec double, end_sec double")
    cut = [(r.from_sec, r.to_sec) for r in sequence.sliding_windows(regions).orderBy("island", "window").collect()]
    assert cut == [(0.0, 1.5), (0.75, 2.25), (1.5, 3.0), (2.25, 3.75), (2.5, 4.0), (6.0, 7.0)]


def test_equal_intervals_are_one_union(spark):
    from confab.operators import islands

    rows = [("f", float(10 * (k // 4)), 10.0 * (k // 4) + 1) for k in range(400)]
    found = islands.merge_intervals(spark.createDataFrame(rows, "file string, s double, e double").repartition(7), ["file"], "s", "e", 2.0).collect()
    assert len(found) == 100 and {r.n for r in found} == {4}


def test_boundaries(spark):
    data = spark.createDataFrame(words(("a", 0.0, 0.2, None), ("b", 0.3, 0.5, None), ("c", 0.6, 0.8, None), ("d", 1.9, 2.0, None)), WORD)
    ends = spark.createDataFrame([("f", 1)], "file_id string, word_idx int")
    flags = lambda df: [r.is_boundary for r in df.orderBy("word_idx").collect()]
    assert flags(sequence.boundaries(data)) == [True, False, False, True] and flags(sequence.boundaries(data, segment_ends=ends)) == [True, False, True, True]


def test_passages_cover_everything():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 15, rng.integers(1, 40)).tolist()
        cut = sequence.passages(np.array(counts), 20, 10).tolist()
        assert {i for a, b in cut for i in range(a, b)} == set(range(len(counts))) and (not counts or cut[-1][1] == len(counts))
        assert all(a[0] < b[0] for a, b in zip(cut, cut[1:]))
        assert all(sum(counts[a:b]) >= 20 for a, b in cut[:-1])


def test_chunks_and_context(spark):
    said = [("f", 0, "h", 0.0, 1.0, "How are you?"), ("f", 1, "h", 1.0, 2.0, "Go on."), ("f", 2, "g", 2.0, 3.0, "I am fine " * 5), ("f", 3, "g", 3.0, 4.0, "and so on " * 5), ("f", 4, "h", 500.0, 501.0, "Right.")]
    df = spark.createDataFrame(said, SAID)
    asked = {r.idx: r.question_idx for r in sequence.context_questions(df).collect()}
    assert asked == {2: 0, 3: 0}
    settings = Settings(chunk_target=20, chunk_stride=10, chunk_context="question+title")
    titles = spark.createDataFrame([("f", "Show")], "file_id string, title string")
    chunks = sequence.build_chunks(df, settings, titles).orderBy("idx").collect()
    assert chunks[0].embed_text.startswith("Show.\n") and all("How are you?" not in c.text for c in chunks[1:])
    inner = next(c for c in chunks if c.utt_start == 3)
    assert inner.embed_text == "Show.\nHow are you?\n" + inner.text and inner.speakers[0] == "g"
    for bad in (Settings(chunk_target=0), Settings(chunk_context="x")):
        with pytest.raises(ValueError):
            sequence.build_chunks(df, bad)


def test_roles(spark):
    said = [("f", i, who, float(i), i + 1.0, t) for i, (who, t) in enumerate([("a", "Why go?"), ("b", "Because it was there and we had the time."), ("a", "Really?"), ("b", "Yes, for years and years we had planned it."), ("a", "I see."), ("b", "So we went."), ("b", "It was hard.")])]
    manifest = spark.createDataFrame([("f", ("Ann", "Bob"))], "file_id string, speakers struct<host:string,guest:string>")
    got = {r.label: r for r in roles.infer_roles(roles.speaker_profiles(spark.createDataFrame(said, SAID)), manifest).collect()}
    assert (got["a"].role, got["a"].display_name, got["a"].question_rate) == ("host", "Ann", 0.6667) and (got["b"].role, got["b"].display_name) == ("guest", "Bob")


def test_clustering_separates_two_voices():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=16), rng.normal(size=16)
    x = np.concatenate([a + 0.05 * rng.normal(size=(40, 16)), b + 0.05 * rng.normal(size=(30, 16))])
    labels = diarization.two_way_clusters(x)
    assert len(set(labels[:40])) == 1 and len(set(labels[40:])) == 1 and labels[0] != labels[-1]
    p = diarization.posteriors(x, labels)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == labels).all()
    assert diarization.two_way_clusters(x[:2]).tolist() == [0, 1]


def test_viterbi_ignores_flicker():
    p = np.full((15, 2), 0.1)
    p[:10, 0], p[10:, 1], p[5] = 0.9, 0.9, (0.1, 0.9)
    boundary = np.zeros(15, dtype=bool)
    boundary[10] = True
    assert diarization.viterbi(np.log(p), boundary).tolist() == [0] * 10 + [1] * 5
    assert diarization.first_appearance(np.array([1, 1, 0, 1])).tolist() == [0, 0, 1, 0]


def test_frames_and_word_likelihoods(spark):
    windows = spark.createDataFrame([("f", 0.0, 1.0, s, p) for s, p in (("A", 1.0), ("B", 0.0))] + [("f", 1.0, 2.0, s, p) for s, p in (("A", 0.0), ("B", 1.0))], "file_id string, from_sec double, to_sec double, speaker string, p double")
    frames = diarization.frame_posteriors(windows, spark.createDataFrame([("f", 3.0)], "file_id string, duration double")).cache()
    got = {(r.frame, r.speaker): (r.p, r.covered) for r in frames.collect()}
    assert got[(5, "A")] == (1.0, True) and got[(15, "A")] == (0.0, True) and got[(25, "A")] == (0.5, False)
    spoken = spark.createDataFrame(words(("x", 0.2, 0.4, None), ("y", 2.6, 2.8, None)), WORD)
    best = {(r.word_idx, r.speaker): r.loglik for r in diarization.word_likelihoods(spoken, frames).collect()}
    assert best[(0, "A")] == 0.0 and best[(1, "B")] == 0.0 and best[(1, "A")] == pytest.approx(np.log(1e-4))


def test_likelihoods_of_windows_need_no_frames(spark, small, monkeypatch):
    """The same as by frames, whatever the stretches; words over their edges, without windows or in files without any."""
    rng = np.random.default_rng(5)
    at = np.sort(rng.random(120) * 90)
    rows = [(f, i, "w", round(float(t), 2), round(float(t + d), 2), None) for f in ("f", "g") for i, (t, d) in enumerate(zip(at, rng.choice([0.1, 0.3, 2.0, 9.0], 120)))]
    spoken = spark.createDataFrame([*rows, ("none", 0, "w", 1.0, 2.0, None), ("f", 900, "w", None, None, None)], WORD)
    starts = [(f, round(float(t), 2)) for f, n in (("f", 25), ("g", 6)) for t in rng.random(n) * 80 + 5]
    data = [(f, t, round(t + 1.5, 2), s, p) for f, t in starts for s, p in (("A", float(rng.random())), ("B", float(rng.random())))] + [("g", 40.0, 41.0, "C", 0.7)]
    windows = spark.createDataFrame(data, "file_id string, from_sec double, to_sec double, speaker string, p double")
    frames = diarization.frame_posteriors(windows, windows.groupBy("file_id").agg(F.max("to_sec").alias("duration")))
    seen = lambda df: {(r.file_id, r.word_idx, r.speaker): round(r.loglik, 6) for r in df.collect()}
    want = seen(diarization.word_likelihoods(spoken, frames))
    assert len(want) > 400
    for size, near in ((6000, 64), (50, 16)):
        monkeypatch.setattr(diarization, "STRETCH", size)
        monkeypatch.setattr(diarization, "NEAR", near)
        assert seen(diarization.window_likelihoods(spoken, windows)) == pytest.approx(want, abs=2e-6)
    from confab import catalogue

    # The plan by frames had about 220 exchanges, which the driver couldn't hold.
    assert catalogue.e14_e15_word_likelihoods(spark, small)._jdf.queryExecution().executedPlan().toString().count("Exchange") < 60
