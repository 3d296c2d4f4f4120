"""Neighbours, overlap, ranking, terms, packing, mixing and reading levels: brute force and edge cases."""

import random
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.functions.text import tokenise
from confab.llm import mixing, neighbours, overlap, packing, ranking, reading, terms

VECTORS = "id string, embedding array<float>, indexed_at timestamp, code int, cell string, at int"


def pairs_of(x, ids, k, floor):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (-round(float(s[i, j]), 6), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order if s[i, j] >= floor}
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(700, 24))
    x = np.repeat(centres, 3, axis=0) + 0.1 * rng.normal(size=(2100, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"v{i:05d}" for i in range(len(x))]
    rows = [(i, [float(a) for a in v * (1 + k % 3)], None, 1, "c", 2) for k, (i, v) in enumerate(zip(ids, x))]
    rows += rows[:50] + [("null", None, None, 1, "c", 2), ("zero", [0.0] * 24, None, 1, "c", 2), ("short", [1.0], None, 1, "c", 2), ("nan", [float("nan")] * 24, None, 1, "c", 2), (None, [1.0] * 24, None, 1, "c", 2)]
    table = spark.createDataFrame(rows, VECTORS)
    truth = pairs_of(x, ids, 5, 0.9)
    found = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(table, "u").collect()}
    assert len(found & truth) / len(truth) >= 0.98 and len(found - truth) <= 0.02 * len(truth)
    # Crowded cells are divided without losing a link.
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    assert {(r.id_a, r.id_b) for r in neighbours.similar_pairs(table, "u").collect()} == found


def test_copies_are_one_class(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0], None, 1, "c", 2) for i in range(40)] + [("d0", [1.0, 2.0, 3.1], None, 1, "c", 2)]
    found = neighbours.nearest_ids(spark.createDataFrame(rows, VECTORS), floor=0.9).groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("o")).collect()
    near = {r.id: r.o for r in found}
    assert len(near) == 41 and near["c010"] == ["c000", "c001", "c002", "c003", "c004"] and near["c002"] == ["c000", "c001", "c003", "c004", "c005"]
    assert neighbours.nearest_ids(spark.createDataFrame(rows + [("s1", [1.0, 0.0], None, 1, "c", 2), ("s2", [2.0, 0.1], None, 1, "c", 2)], VECTORS), floor=0.9).where("id = 's1'").first().other == "s2"
    assert near["d0"] == ["c000", "c001", "c002", "c003", "c004"]
    assert neighbours.nearest_ids(spark.createDataFrame([], VECTORS)).count() == 0


def test_every_vector_has_its_nearest_without_floor(spark, small):
    from confab.llm import queries

    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(f"v{i:05d}", v.tolist(), None, 1, "c", 2) for i, v in enumerate(x)], VECTORS)
    got = defaultdict(set)
    for r in neighbours.nearest_ids(table, probes=None).collect():
        got[r.id].add(r.other)
    assert len(got) == len(x) and all(len(o) == 5 for o in got.values())
    s = x[:500] @ x.T
    s[np.arange(500), np.arange(500)] = -2
    true = np.argsort(-s, axis=1)[:, :5]
    assert sum(f"v{j:05d}" in got[f"v{i:05d}"] for i in range(500) for j in true[i]) >= 0.9 * 2500
    rows = queries.QUERIES["p3_nearest"](spark, small).groupBy("unit", "id").count().collect()
    assert {r.unit for r in rows} == {"utterances", "chunks"} and all(r["count"] == 5 for r in rows)


GOLDEN = "id string, query string, category string, split string, role string, relevant array<struct<file:string,start_sec:double,end_sec:double,grade:int,quote:string>>, side int, text int"


def test_overlap(spark, monkeypatch):
    at = [("f", 10.0, 20.0, 1, None)]
    rows = [
        ("a1", "what Ada said about the ramp chain", "q", "train", None, at, 1, 1), ("a2", "role:host WHAT ADA SAID, exactly, about the ramp-chian?", "q", " Dev", None, [("f", 19.0, 30.0, 1, None)], 1, 1),
        ("a3", "what Cyd said about the ramp chain", "q", "test", None, at, 1, 1), ("a4", "about the ramp chain what Ada said", "q", "TEST ", None, at, 1, 1),
        ("a5", "what Ada said about the ramp chain", "q", "test", None, [("g", 10.0, 20.0, 1, None)], 1, 1), ("a6", "what Ada said about the ramp chain", "q", "test", None, [("f", 21.0, 30.0, 1, None)], 1, 1),
        ("a7", "what Ada said about the ramp chain", "q", None, None, at, 1, 1), ("a8", None, None, "dev", None, None, 1, 1), (None, "x", "q", "dev", None, at, 1, 1), ("a9", "", "q", "dev", None, [None], 1, 1),
    ]
    rows += rows[:2]
    golden = spark.createDataFrame(rows, GOLDEN)
    pairs = lambda: {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(golden).collect()}
    assert pairs() == {("a1", "a2"), ("a1", "a4")}
    monkeypatch.setattr(overlap, "STRETCH", 3.0)
    assert pairs() == {("a1", "a2"), ("a1", "a4")}
    report = {(r.split, r.file_id): (r.queries, r.held, r.pairs) for r in overlap.overlap_report(golden).collect()}
    assert report[("dev", "f")] == (1, 1, 1) and report[("test", "f")] == (3, 1, 1) and report[("test", "g")] == (1, 0, 0)
    assert overlap.cross_split_pairs(spark.createDataFrame([], GOLDEN)).count() == 0


def test_overlap_report_counts_every_shared_recording(spark):
    both = [("f", 10.0, 20.0, 1, None), ("g", 5.0, 9.0, 1, None)]
    rows = [("a1", "what Ada said about the ramp chain", "q", "train", None, both, 1, 1), ("a2", "what Ada said about the ramp chain", "q", "dev", None, [*both, ("h", 1.0, 2.0, 1, None)], 1, 1)]
    golden = spark.createDataFrame(rows, GOLDEN)
    assert [(r.id_a, r.id_b, r.file_id, r.file_ids) for r in overlap.cross_split_pairs(golden).collect()] == [("a1", "a2", "f", ["f", "g"])]
    report = {(r.split, r.file_id): (r.queries, r.held, r.pairs) for r in overlap.overlap_report(golden).collect()}
    assert report == {("dev", "f"): (1, 1, 1), ("dev", "g"): (1, 1, 1), ("dev", "h"): (1, 0, 0)}


def test_coverage_is_that_of_all_shared_spans():
    rnd = random.Random(4)
    left, right = (["".join(rnd.choice("ab c") for _ in range(rnd.randrange(0, 40))) for _ in range(60)] for _ in range(2))
    size, over, missing, covered = overlap.shared_coverage(left, right)
    at = 0
    for side, (own, other) in enumerate(((left, right), (right, left))):
        for k, (a, b) in enumerate(zip(own, other)):
            x, y = (f"\x02{t.replace(' ', '')}\x03\x03" for t in (a, b))
            spans = [(i, j) for i in range(len(x)) for j in range(i + overlap.SPAN, len(x) + 1) if x[i:j] in y]
            held = {c for i, j in spans for c in range(i, j)}
            n = len(x) - 3
            assert size[side, k] == n and covered[at : at + n].tolist() == [c + 1 in held for c in range(n)]
            assert over[side, k] == sum(c + 1 not in held for c in range(n))
            assert missing[side, k] == len({x[i : i + 4] for i in range(n)} - {y[i : i + 4] for i in range(len(y))})
            at += n


def test_no_pair_is_lost(spark):
    """Against the decision on all pairs that share a moment."""
    rnd = random.Random(11)
    things = ["ramp chain", "signal coil", "crew bunk", "ink roller", "walkway rail"]
    rows = []
    for k in range(240):
        text = f"what guests from Vahaln think about the {rnd.choice(things)} and {rnd.choice(['Lovanarth', 'Elkas', 'Joumsarth'])}"
        if rnd.random() < 0.5:
            i = rnd.randrange(len(text))
            text = text[:i] + rnd.choice("aeiou") + text[i + rnd.randrange(2) :]
        at = rnd.randrange(0, 900)
        rows.append((f"q{k:03d}", text, "q", rnd.choice(("train", "dev", "test")), None, [("f", float(at), at + 90.0, 1, None)], 1, 1))
    golden = spark.createDataFrame(rows, GOLDEN)
    meet = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a[3] == "train") != (b[3] == "train") and abs(a[5][0][1] - b[5][0][1]) < 90]
    same, _ = overlap.same_questions([overlap.plain(a[1]) for a, _ in meet], [overlap.plain(b[1]) for _, b in meet])
    truth = {(a[0], b[0]) for (a, b), ok in zip(meet, same) if ok}
    assert truth and {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(golden).collect()} == truth
    spelt = lambda row: [t for t in things if t in row[1]]
    assert not any(spelt(a) and spelt(b) and spelt(a) != spelt(b) for (a, b), ok in zip(meet, same) if ok)


def test_names_tell_questions_apart():
    same = lambda a, b: bool(overlap.same_questions([overlap.plain(a)], [overlap.plain(b)])[0][0])
    assert same("what Ada said about the ramp chain", "role:host WHAT ADA SAID, exactly, about the ramp-chian?")
    assert not same("what Ada said about the ramp chain", "what Cyd said about the ramp chain")
    assert same("load cell", "loadcell") and same("fog horn", "Fog Horn!") and not same("fog horn", "crew bunk") and not same("", "fog")


FUSED = "query_id string, id string, ranks map<string,int>, raw map<string,double>, score double, channel int, value string, items int, n int"


def brute_scores(raws):
    """raws: id -> {channel: value}."""
    channels = {c for r in raws.values() for c in r}
    total = defaultdict(float)
    for c in channels:
        v = {i: (-r[c] if c == "dense_l2" else r[c]) if c in r else -np.inf for i, r in raws.items()}
        for i in raws:
            below, ties = sum(x < v[i] for x in v.values()), sum(x == v[i] for x in v.values())
            total[i] += NormalDist().inv_cdf((below + (ties + 1) / 2 - 0.5) / len(raws))
    return {i: total[i] / max(1, len(channels)) for i in raws}


def test_normal_scores(spark):
    rnd = random.Random(6)
    queries = {f"q{k}": {f"i{n:02d}": {c: float(rnd.choice([rnd.gauss(0, 10**s), 1.0, 0.0, -2.5])) for s, c in enumerate(("lexical", "dense", "dense_l2", "rerank")) if rnd.random() < 0.7} for n in range(rnd.randrange(1, 25))} for k in range(12)}
    rows = [(q, i, None, raw, None, 1, "v", 1, 1) for q, items in queries.items() for i, raw in items.items()]
    rows += rows[:9] + [(None, "x", None, {"dense": 1.0}, None, 1, "v", 1, 1), ("q0", None, None, None, None, 1, "v", 1, 1), ("lone", "n", None, None, None, 1, "v", 1, 1), ("lone", "m", None, {"dense": float("nan"), "rerank": None}, None, 1, "v", 1, 1)]
    scores = ranking.normal_scores(spark.createDataFrame(rows, FUSED)).cache()
    got = defaultdict(dict)
    for r in scores.collect():
        got[r.query_id][r.id] = r.score
    assert got.pop("lone") == {"n": 0.0, "m": 0.0}
    for q, items in queries.items():
        assert got[q] == pytest.approx(brute_scores(items), abs=1e-6)
    first = {q: min(s, key=lambda i: (-s[i], i)) for q, s in got.items()} | {"lone": "m"}
    assert {r.query_id: r.id for r in ranking.leaders(scores).collect()} == first
    ranked = defaultdict(list)
    for r in ranking.full_ranking(scores).collect():
        ranked[r.query_id].append((r.rank, r.id))
    for q, s in got.items():
        assert [i for _, i in sorted(ranked[q])] == sorted(s, key=lambda i: (-s[i], i)) and sorted(r for r, _ in ranked[q]) == list(range(1, len(s) + 1))
    assert ranking.normal_scores(spark.createDataFrame([], FUSED)).count() == 0


def test_ranks_over_ranges(spark):
    """One large group and many ties, spread over several ranges."""
    rnd = random.Random(13)
    rows = [("big", "c", rnd.choice((0.5, 0.5, rnd.random(), rnd.random())), f"i{k:05d}") for k in range(4000)] + [(f"q{k % 7}", "c", float(k % 3), f"i{k}") for k in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "query_id string, channel string, value double, id string")
        found = ranking.range_ranks(table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for q, c, v, i in rows:
        groups[q].append((v, i))
    assert len(found) == len(rows)
    for r in found:
        own = sorted(groups[r.query_id]) if r.query_id != "big" else None
        if own is not None:
            assert r.place == own.index((r.value, r.id)) + 1 and r.below == sum(v < r.value for v, _ in own) and r.ties == sum(v == r.value for v, _ in own) and r.total == len(own)
    big = sorted(groups["big"])
    place = {i: k + 1 for k, (_, i) in enumerate(big)}
    count = Counter(v for v, _ in big)
    below, total = {}, 0
    for v in sorted(count):
        below[v], total = total, total + count[v]
    assert all((r.place, r.below, r.ties, r.total) == (place[r.id], below[r.value], count[r.value], 4000) for r in found if r.query_id == "big")


RECORDS = "id string, text string, first string, suffix int, record int, n int"


def test_terms(spark):
    rnd = random.Random(7)
    texts = {f"r{k}": " ".join(rnd.choice(("a", "an", "the", "ramp's", "ＣＨＡＩＮ", "x1")) for _ in range(rnd.randrange(0, 40))) for k in range(60)}
    texts |= {"long": "deep " * 5000, "null": None, "blank": " ... "}
    rows = [(k, t, "f", 1, 1, 1) for k, t in texts.items()]
    table = spark.createDataFrame(rows + rows[:20] + [(None, "lost", "f", 1, 1, 1)], RECORDS)
    occurrences, held = Counter(), Counter()
    for t in texts.values():
        w = tokenise(t)
        grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        occurrences.update(grams)
        held.update(set(grams))
    found = terms.ngram_counts(table, "id", "text", 3).collect()
    assert {r.ngram: r.occurrences for r in found} == occurrences and {r.ngram: r.records for r in found} == held
    marks = {r.term: r.mark for r in terms.marked_terms(table).collect()}
    assert marks["deep"] == "rare" and marks["the"] == "common" and "lost" not in marks and marks["chain"] == "common"
    assert terms.marked_terms(spark.createDataFrame([], RECORDS)).count() == 0


DOCS = "doc_id bigint, text string, lang string, source string, size int, bin string, block int, copies int, band string"


def documents(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or {}).get(k, "s"), 9, "b", 1, 1, "x") for k, t in texts.items()]
    return spark.createDataFrame(rows + rows[:3] + [(None, "lost", "en", "s", 1, "b", 1, 1, "x")], DOCS)


def test_packing(spark):
    rnd = random.Random(8)
    texts = {k: "w " * rnd.choice([1, 5, 40, 300, 340, 500, 513, 700, 1024]) for k in range(400)} | {900: "w, " * 1300, 901: None, 902: "", 903: "w " * 5000}
    packed = packing.pack(documents(spark, texts), block=150).cache()
    rows = packed.collect()
    used = defaultdict(int)
    for r in rows:
        used[r.bin] += r.length
    assert max(used.values()) <= 1024
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
    for k, t in texts.items():
        size = len((t or "").replace(",", " ,").split())
        spans = sorted(by_doc.get(k, []))
        assert sum(n for _, n in spans) == size and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert len(spans) == (1 if 0 < size <= 1024 else -(-size // 1024))
    assert {r.doc_id for r in rows if r.split} == {900, 903}
    assert {r.doc_id for r in packing.divided(packed).collect()} == {900, 903}
    assert packing.fill_report(packed).first().fill > 0.95
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


TARGETS = "source string, weight double, max_repeats int, tokens int"


def test_mixing(spark):
    sources = {k: ("Big One", "small-two", " third ", None)[0 if k < 60 else 1 if k < 70 else 2 if k < 99 else 3] for k in range(100)}
    docs = documents(spark, {k: "w " * 50 for k in range(100)}, sources)
    targets = spark.createDataFrame([("big_one", 1.0, 1, 5), ("SMALL TWO", 3.0, 3, 5), ("third", 2.0, None, 5), ("gone", 1.0, 4, 5), (None, 9.0, 9, 5), ("idle", None, 1, 5)], TARGETS)
    plan = {r.source: r for r in mixing.allocation(mixing.sized_sources(docs), targets).collect()}
    assert {s for s, r in plan.items() if not r.reaches} == {"gone", "small_two"}
    assert plan["small_two"].allotted == 1500 and plan["gone"].allotted == 0 and plan["idle"].allotted == 0
    assert plan["third"].allotted == pytest.approx(1450) and plan["big_one"].allotted == pytest.approx(99 * 50 - 1500 - 1450)
    copies = mixing.mix(docs, targets).collect()
    assert {r.copies for r in copies if r.source == "small_two"} == {3} and max(r.copies for r in copies if r.source != "small_two") == 1
    assert sorted(map(tuple, copies)) == sorted(map(tuple, mixing.mix(docs, targets).collect()))
    shares = mixing.shares(docs, targets).collect()
    assert sum(r.actual_share for r in shares) == pytest.approx(1, abs=1e-5)
    assert mixing.mix(spark.createDataFrame([], DOCS), targets).count() == 0 and mixing.allocation(mixing.sized_sources(docs), spark.createDataFrame([], TARGETS)).count() == 0


def test_water_fill_keeps_proportions():
    got = mixing.water_fill({"a": 1, "b": 1, "c": 2}, {"a": 10, "b": 100, "c": 35}, 100)
    assert got == ({"a": 10, "c": 35, "b": 55}, {"a": 1, "c": 1})
    assert mixing.water_fill({"a": 1, "b": 1}, {"a": 3, "b": 4}, 100) == ({"a": 3, "b": 4}, {"a": 1, "b": 1})
    # A cap that only the redistributed excess fills is met in a later round.
    assert mixing.water_fill({"a": 1, "b": 1, "c": 1}, {"a": 3, "b": 35, "c": 100}, 99) == ({"a": 3, "b": 35, "c": 61}, {"a": 1, "b": 2})


def test_reading_levels(spark, small):
    samples = spark.read.parquet(f"{small}/graded_samples.parquet")
    kept = {r.sample_id: (r.text, r.band) for r in samples.collect()}
    train, held = {k: v for k, v in kept.items() if k % 4}, {k: v for k, v in kept.items() if k % 4 == 0}
    texts = {k: "<p>- " + t.replace(". ", "\n") + "</p>" for k, (t, _) in held.items()} | {9000: None, 9001: "", 9002: "12:30 [noise]", 9003: held[min(held)][0] * 200}
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in reading.reading_levels(docs, samples.where(F.col("sample_id").isin(*train))).collect()}
    assert set(found) == set(texts) and all(found[k].band is None for k in (9000, 9001, 9002)) and found[9003].band == held[min(held)][1]
    assert sum(found[k].band == band for k, (_, band) in held.items()) >= 0.9 * len(held)
    assert reading.reading_levels(spark.createDataFrame([], DOCS), samples).count() == 0
    assert all(r.grade is None for r in reading.reading_levels(docs, samples.limit(0)).collect())


def test_every_document_has_a_level(spark, small):
    samples = spark.read.parquet(f"{small}/graded_samples.parquet")
    text = samples.first().text
    langs = {1: " EN", 2: "fr", 3: None, 4: "en"}
    rows = [(k, None if k == 4 else text, lang, "s", 9, "b", 1, 1, "x") for k, lang in langs.items()] + [(1, text * 3, "fr", "s", 9, "b", 1, 1, "x")]
    found = {r.doc_id: r for r in reading.reading_levels(spark.createDataFrame(rows, DOCS), samples).collect()}
    assert {k: r.reason for k, r in found.items()} == {1: None, 2: "language", 3: "language", 4: "words"}
    assert [k for k, r in found.items() if r.grade is not None and r.band] == [1]


def test_folds_hold_whole_sources(spark, small):
    samples = spark.read.parquet(f"{small}/graded_samples.parquet")
    rows = [(r.text, r.band) for r in samples.collect()]
    by_source = reading.train(rows, [f"s{i % 7}" for i in range(len(rows))])
    assert by_source.accuracy > 0.8 and reading.train(rows, ["one"] * len(rows)).accuracy == reading.train(rows).accuracy
    docs = documents(spark, {k: t for k, (t, _) in enumerate(rows[:8])}, {k: "Big One" if k < 4 else "big-one" if k < 6 else None for k in range(8)})
    found = {r.source: r for r in reading.levels_by_source(docs, samples).collect()}
    assert (found["big_one"].documents, found[None].documents) == (6, 2)
    assert all(r.graded == r.documents == sum(r[b] for b in reading.BANDS) and r.in_band > 0.8 for r in found.values())


def test_variety_is_of_the_whole_text():
    rnd = random.Random(10)
    for n in (1, 99, 100, 101, 350):
        words = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("abc") for _ in range(n)]
        windows = [words[i : i + 100] for i in range(max(1, n - 99))]
        assert reading.variety(words) == pytest.approx(sum(len(set(w)) / len(w) for w in windows) / len(windows))
    head = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    assert reading.features(head + " again" * 300)[10] < 0.5 * reading.features(head)[10]


def test_forest_lowers_the_error():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1]
    assert np.abs(reading.Forest().fit(x, y).predict(x) - y).mean() < 0.25 * np.abs(y - y.mean()).mean()
