"""Parsing, analysis, retrieval, fusion, moments, evaluation, sources, streaming."""

import json
import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from confab import catalogue
from confab.config import SYSTEMS, SearchOptions, Settings
from confab.functions import phonetics, stem
from confab.functions.text import tokenise
from confab.functions.vectors import hash_vectors
from confab.operators import alignment, evaluation, fusion, index, moments, querying, retrieval
from confab.plans import search as plan
from confab.sources import transcripts
from confab.streaming import indexing


def parsed(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, query string")
    return [r for r in sorted(querying.parse_queries(rows).collect(), key=lambda r: r.n)]


def test_parse(spark):
    q, again, plain, *bad = parsed(spark, '"firing room" role:guest file:moon_launch launch', "ROLE:Host Speaker:a speaker:b file:x file:y  go\u00a0on", 'so " " it', "", "   ", None, "role:host", "role:pilot x", "x" * 600)
    assert (q.q_phrases, q.q_role, q.q_files, q.q_text, q.q_intent, q.q_error) == (["firing room"], "guest", ["moon_launch"], "firing room launch", "phrase", None)
    assert (again.q_role, again.q_speaker, again.q_files, again.q_text) == ("host", "B", ["x", "y"], "go on") and plain.q_phrases == []
    long = parsed(spark, "the deck lamp near a far red box behind one old tow path in fog")[0]
    assert long.q_content == ["deck", "lamp", "near", "far", "red", "box", "behind", "one", "old", "tow", "path", "fog"]
    assert all(r.q_error and r.q_text is None and r.q_intent is None and r.q_files == [] for r in bad) and "pilot" in bad[4].q_error


def test_intent(spark):
    cases = {"cesium": "keyword", "El Paso": "keyword", "Why did it fail?": "question", "how they trained": "question", "the long road that pilots take to the moon": "topic", "...": "keyword"}
    assert [r.q_intent for r in parsed(spark, *cases)] == list(cases.values())


def test_folded_tokens(spark):
    from confab.functions.text import tokens

    texts = ["ＡＢＣ ’tis ²③ 𝐛old", "ESA's T-38s", "K ñ ﬀ", "", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(tokens(F.col("x")).alias("t")).collect()]
    assert got[:2] == [tokenise(t) for t in texts[:2]] and got[2] == ["k"] and got[3] == [] and not got[4]


def test_tokens():
    assert tokenise("ESA's T-38s") == ["esa", "t", "38s"]
    assert tokenise(None) == [] and tokenise("ＡＢＣ ’tis") == ["abc", "tis"]


@pytest.mark.parametrize("word,expected", [("caresses", "caress"), ("ponies", "poni"), ("guppies", "guppi"), ("guppy", "guppi"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("national", "nation"), ("relational", "relat"), ("happy", "happi"), ("cry", "cri"), ("by", "by"), ("skies", "sky"), ("consistency", "consist"), ("knightly", "knight"), ("argument", "argument"), ("controlling", "control"), ("adjustable", "adjust")])
def test_stems(word, expected):
    assert stem.stem(word) == expected


def test_sound_keys():
    assert phonetics.metaphone("sells") == phonetics.metaphone("cells") and phonetics.metaphone("knight") == phonetics.metaphone("night")
    assert phonetics.metaphone("phone") == "FN" and phonetics.metaphone("thing")[0] == "0"
    assert phonetics.double_metaphone("smith") == ("SM0", "XMT") and phonetics.double_metaphone("catherine")[0][:2] == "K0"
    assert set(phonetics.double_metaphone("schmidt")) & set(phonetics.double_metaphone("smith"))


def test_word_similarity(spark):
    df = spark.createDataFrame([("zubaire", "abizubair"), ("inside", "insights"), ("word", "two")], "a string, b string")
    got = df.select("a", phonetics.substring_share(F.col("a"), F.col("b")).alias("s"), phonetics.trigram_similarity(phonetics.trigrams(F.col("a")), phonetics.trigrams(F.col("b"))).alias("t")).collect()
    by = {r.a: r for r in got}
    assert by["zubaire"].s == pytest.approx(6 / 7) and by["inside"].s == pytest.approx(4 / 6) and by["word"].t == 0.0


VOCABULARY = ["cells", "pizzamilio", "insights", "abizubair", "rocket"]


def test_expansions(spark):
    chunks = spark.createDataFrame([(f"c{i}", " ".join(VOCABULARY)) for i in range(4)], "id string, text string")
    tokens = spark.createDataFrame([(t,) for t in ("sells", "pizzamiglio", "harbour", "zubaire", "rocket", "abc")], "token string")
    vocabulary = index.vocabulary(chunks)
    got = {r.token: (r.term, r.score, r.kind) for r in retrieval.expansions(tokens, vocabulary).collect()}
    assert got["sells"][0] == "cells" and got["sells"][1] >= 0.8 and got["sells"][2] == "phonetic"
    assert got["pizzamiglio"][0] == "pizzamilio" and got["zubaire"][0] == "abizubair" and not set(got) & {"harbour", "rocket", "abc"}
    strict = retrieval.expansions(tokens, vocabulary, lexicon=["sells", "pizzamiglio"]).select("token").collect()
    assert "sells" in {r.token for r in strict}


CHANNEL = "query_id string, channel string, id string, rank int, score double, weight double, multiplier double"


def channel_rows(weight=1.0):
    return [("q", "lexical", i, k + 1, s, 1.0, 1.0) for k, (i, s) in enumerate((("a", 9.0), ("b", 8.0)))] + [("q", "dense", i, k + 1, s, weight, 1.0) for k, (i, s) in enumerate((("b", 0.9), ("c", 0.8)))]


def test_fusion(spark):
    fused = fusion.reciprocal_ranks(spark.createDataFrame(channel_rows(), CHANNEL)).orderBy("position").collect()
    assert fused[0].id == "b" and fused[0].ranks == {"lexical": 2, "dense": 1}
    single = fusion.reciprocal_ranks(spark.createDataFrame(channel_rows(0.0), CHANNEL)).orderBy("position").collect()
    assert [r.id for r in single] == ["a", "b"] and single[1].ranks == {"lexical": 2}
    cc = {r.id: r.score for r in fusion.convex(spark.createDataFrame(channel_rows(), CHANNEL)).collect()}
    assert cc == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_coverage_multiplier_reorders(spark):
    rows = [("q", "lexical", "noise", 1, 5.0, 1.0, 0.05), ("q", "lexical", "gold", 2, 4.0, 1.0, 1.0)]
    assert fusion.reciprocal_ranks(spark.createDataFrame(rows, CHANNEL)).orderBy("position").first().id == "gold"


def test_marks(spark):
    df = spark.createDataFrame([([("The", 1.0, 1.1), ("old", 1.2, 1.3), ("rocket,", 1.4, 1.5), ("rocket", 1.6, 1.7)], ["rocket"], "The old \x02rocket\x03, \x02rocket\x03")], "words array<struct<token:string,start_sec:double,end_sec:double>>, lex array<string>, m string")
    r = df.select(moments.highlight(F.col("words"), F.col("lex")).alias("h"), moments.spans_of_markup(F.col("m")).alias("s")).first()
    assert [(x["from"], x["to"], x["at"]) for x in r.h] == [(8, 15, 1.4), (16, 22, 1.6)] and [(x["from"], x["to"]) for x in r.s] == [(8, 14), (16, 22)]


def test_suppression_keeps_distant_moments():
    rows = [("f", "u1", 0.0, 0.0, 10.0), ("f", "u2", 5.0, 20.0, 30.0), ("f", "u3", 60.0, 55.0, 70.0), ("g", "u4", 1.0, 0.0, 10.0)]
    assert moments.keep_moments(rows, 10.0, 0.5) == [0, 2, 3]
    rnd = random.Random(1)
    for _ in range(30):
        rows = [("f", f"u{i}", s := rnd.uniform(0, 100), s - 3, s + 9) for i in range(20)]
        kept = moments.keep_moments(rows, 10.0, 0.5)
        assert all(abs(rows[i][2] - rows[j][2]) >= 10 for i in kept for j in kept if i < j) and kept[0] == 0


def test_dense_blocks_agree(spark):
    rnd = random.Random(2)
    rows = [(f"i{k}", [rnd.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [("zero", [0.0] * 8), ("null", None)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = v.where("id < 'i2'").withColumnRenamed("id", "query_id")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(retrieval.dense(q, v, 5)) == key(retrieval.dense(q, v, 5, block=3))
    assert all(r.id == r.query_id and r.score == pytest.approx(1) for r in retrieval.dense(q, v, 1).collect())


def test_dense_is_the_brute_force_list(spark):
    """Ties in order of id, filters, and more rows than a batch holds."""
    rnd = random.Random(5)
    rows = [(f"i{k:04d}", [float(rnd.randrange(-1, 2)) for _ in range(4)], f"f{k % 3}", ["a"] if k % 2 else ["a", "b"], ["host"] if k % 5 else []) for k in range(700)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>, file_id string, speakers array<string>, roles array<string>")
    asked = [("q0", [1.0, 1.0, 0.0, 0.0], [], None, None), ("q1", [1.0, 0.0, -1.0, 1.0], ["f1", "f2"], "b", None), ("q2", [0.0, 1.0, 1.0, 0.0], None, None, "host"), ("q3", [0.0, 0.0, 0.0, 1.0], ["none"], None, None)]
    q = spark.createDataFrame(asked, "query_id string, embedding array<float>, q_files array<string>, q_speaker string, q_role string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.dense(q, v, 9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), 6)
    want = {}
    for name, x, files, speaker, role in asked:
        fits = [(-cos(x, e), i) for i, e, f, who, roles in rows if any(e) and (not files or f in files) and (not speaker or speaker in who) and (not role or role in roles)]
        want |= {(name, k + 1): (i, -s) for k, (s, i) in enumerate(sorted(fits)[:9])}
    assert got == {k: (i, pytest.approx(s)) for k, (i, s) in want.items()}


def test_cells_recall(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16)) + 2 * rng.normal(size=(30, 16))[rng.integers(0, 30, 6000)]
    v = spark.createDataFrame([(f"i{k:04d}", [float(a) for a in e]) for k, e in enumerate(x)], "id string, embedding array<float>")
    q = v.where("id like '%7'").withColumnRenamed("id", "query_id")
    exact, near = ({(r.query_id, r.id) for r in df.collect()} for df in (retrieval.dense(q, v, 10), retrieval.dense_by_cells(q, v, retrieval.centres_of(v, cell=100), 10)))
    assert len(exact & near) >= 0.9 * len(exact) and len(near) == len(exact)


def test_cells_of_queries_and_chunks_are_the_ranking(spark, small, monkeypatch):
    """Cells give what bm25 gives, however they are cut; ties go by id."""
    rnd = random.Random(3)
    pool = [f"term{i}" for i in range(30)]
    texts = [(f"c{i:03d}", " ".join(rnd.choices(pool, weights=range(30, 0, -1), k=rnd.randint(0, 12)))) for i in range(300)] + [("none", None)]
    chunks = spark.createDataFrame([*texts, *((f"t{i}", "tied words") for i in range(40))], "id string, text string")
    asked = [(f"q{i}", " ".join(rnd.choices([*pool, "missing"], k=rnd.randint(1, 5)))) for i in range(60)] + [("tie", "tied tied"), ("few", "term29 unheard"), ("no", "unheard")]
    lexemes = retrieval.query_lexemes(spark.createDataFrame(asked, "query_id string, q_text string"))
    posted = index.postings(chunks)
    lengths = index.doc_lengths(chunks, posted)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    want = rows(retrieval.bm25(lexemes, posted, index.term_stats(posted), lengths, index.corpus_stats(lengths), limit=10))
    terms = chunks.select("id", F.coalesce(retrieval.content_tokens(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    for wide, high in ((65_536, 65_536), (50, 20)):
        monkeypatch.setattr(retrieval, "CELL_CHUNKS", wide)
        monkeypatch.setattr(retrieval, "CELL_QUERIES", high)
        assert rows(retrieval.bm25_by_cells(lexemes, terms, 10)) == want
    assert rows(retrieval.bm25_by_cells(lexemes.limit(0), terms, 10)) == rows(retrieval.bm25_by_cells(lexemes, terms.limit(0), 10)) == []


@pytest.mark.parametrize("name", ["d15_bootstrap", "i_b27_interval_hits", "d13_summary_by_category", "i2_mrr_and_success"])
def test_judged_queries_shuffle_no_postings(spark, small, name):
    """Their plans start from staged hits; before, each joined all postings with all queries."""
    plan_of = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "lexeme" not in plan_of and "chunk_id" not in plan_of


@pytest.mark.parametrize("first", [20_480, 20])
def test_standing_pairs_are_those_of_the_ranking(spark, monkeypatch, first):
    """Given pairs get the scores and ranks that the whole ranking gives them, in one round or several; ties go by id."""
    rnd = random.Random(5)
    pool = [f"term{i}" for i in range(30)]
    texts = [(f"c{i:03d}", " ".join(rnd.choices(pool, weights=range(30, 0, -1), k=rnd.randint(0, 12)))) for i in range(300)] + [("none", None), (None, "tied term1")]
    chunks = spark.createDataFrame([*texts, *((f"t{i:02d}", "tied words") for i in range(40))], "id string, text string")
    asked = [(f"q{i}", " ".join(rnd.choices([*pool, "missing"], k=rnd.randint(1, 5)))) for i in range(60)] + [("tie", "tied tied"), ("few", "term29 unheard"), ("no", "unheard")]
    lexemes = retrieval.query_lexemes(spark.createDataFrame(asked, "query_id string, q_text string"))
    terms = chunks.select("id", F.coalesce(retrieval.content_tokens(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    posted = index.postings(chunks)
    lengths = index.doc_lengths(chunks, posted)
    whole = retrieval.bm25(lexemes, posted, index.term_stats(posted), lengths, index.corpus_stats(lengths), limit=10).collect()
    named = {(q, i) for q, _ in asked for i, _ in rnd.sample(texts[:300], 40)} | {("tie", f"t{i:02d}") for i in range(0, 40, 3)} | {(r.query_id, r.id) for r in whole if rnd.random() < 0.3}
    want = sorted((r.query_id, r.id, r.score, r["rank"]) for r in whole if (r.query_id, r.id) in named)
    for name, value in (("FIRST_CHUNKS", first), ("NEXT_CHUNKS", 4), *((("CELL_CHUNKS", 50), ("CELL_QUERIES", 20)) if first == 20 else ())):
        monkeypatch.setattr(retrieval, name, value)
    asks, n, avgdl = retrieval.asked_terms(lexemes, terms)
    pairs = retrieval.score_pairs(spark.createDataFrame(sorted(named), "query_id string, id string").join(asks, "query_id").join(terms, "id"), avgdl)
    got = sorted((r.query_id, r.id, r.score, r["rank"]) for r in retrieval.standing(pairs, asks, terms, 10, n, avgdl).collect())
    assert len(want) > 50 and got == want
    assert retrieval.standing(pairs.limit(0), asks, terms, 10, n, avgdl).count() == 0


def test_spans_without_end_touch_moments(spark):
    """A span is spread no further than moments reach; before, one of 1e15 seconds could not be spread."""
    spans = spark.createDataFrame([("a", "f", 10.0, 1e15), ("b", "f", -1e15, 20.0), ("c", "f", 500.0, 501.0), ("d", "g", 0.0, 1e15), ("e", "f", 90.0, None)], "id string, file string, start_sec double, end_sec double")
    gold = spark.createDataFrame([("q", 0, "f", 90.0, 130.0), ("q", 1, "f", 0.0, 5.0)], "query_id string, label int, file string, start_sec double, end_sec double")
    assert sorted(tuple(r) for r in evaluation.touching(spans, gold, ["file"]).select("r.id", "g.label").collect()) == [("a", 0), ("a", 1), ("b", 1)]


@pytest.mark.parametrize("name", ["d15_bootstrap", "i_b27_interval_hits", "d13_summary_by_category", "i2_mrr_and_success"])
def test_judged_queries_pass_on_no_ranking(spark, small, monkeypatch, name):
    """Before, ten chunks of every query went from cell to cell by name; at size that was most of the disk."""
    def ranking(*_):  # noqa: ANN002, ANN202
        raise AssertionError("a ranking of all chunks")

    monkeypatch.setattr(retrieval, "bm25_by_cells", ranking)
    assert catalogue.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["i_b27_interval_hits", "d13_summary_by_category", "i2_mrr_and_success"])
def test_judged_queries_leave_no_shuffle_files(spark, small, name):
    """What a step shuffled goes when its result is staged; before, all of it lay on disk until the driver collected garbage."""
    folders = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f: f.stat().st_size for folder in folders for f in folder.rglob("shuffle_*.data")}
    before, ends = set(shuffled()), time.time() + 10
    catalogue.QUERIES[name](spark, small)
    left = lambda: sum(size for f, size in shuffled().items() if f not in before)
    while left() > 2_000 and time.time() < ends:  # executors delete them a moment later
        time.sleep(0.2)
    assert left() <= 2_000  # those of single counts


@pytest.mark.parametrize(("block", "crowded"), [(4_096, 16_384), (20, 8)])
def test_pairs_passed_on_hold_the_ten_best(spark, monkeypatch, block, crowded):
    """Of the pairs that touch only some are passed on, with their scores, and the same stand; however places are divided."""
    rnd = random.Random(8)
    pool = [f"term{i}" for i in range(12)]
    span = lambda lo: (lo, lo + rnd.choice([0.0, 3.0, 50.0, 200.0]))
    held = [(f"c{i:03d}", rnd.choice(["f", "g"]), *span(rnd.uniform(0, 300)), rnd.choices(pool, k=rnd.randint(1, 6))) for i in range(400)]
    odd = [("o1", None, 0.0, 9.0, ["term1"]), ("o2", "f", None, 9.0, ["term1"]), ("o3", "f", 0.0, None, ["term1"]), ("o4", "f", 50.0, 1e15, ["term1"]), ("o5", "f", -1e15, 70.0, ["term1"]), ("o6", "f", 0.0, math.nan, ["term1"])]
    chunks = spark.createDataFrame(held + odd, "id string, file string, start_sec double, end_sec double, terms array<string>")
    named = [(f"q{i}", rnd.choices([*pool, "missing"], k=3)) for i in range(30)]
    lexemes = retrieval.query_lexemes(spark.createDataFrame([(q, " ".join(t)) for q, t in named], "query_id string, q_text string"))
    asks, n, avgdl = retrieval.asked_terms(lexemes, chunks.select("id", "terms"))
    gold = spark.createDataFrame([(q, k, f, *span(rnd.uniform(0, 300)), k) for q, _ in named for k, f in enumerate(["f", "g", "none", None])] + [("q1", 7, "f", None, 9.0, 1), ("q1", 8, "f", 9.0, None, 1)], "query_id string, label int, file string, start_sec double, end_sec double, grade int")
    asking, joined = gold.join(asks.withColumn("lexemes", F.array_join("lexemes", " ")), "query_id"), chunks.withColumn("terms", F.array_join("terms", " "))
    pairs = evaluation.touching(joined, asking, ["file"]).select("g.query_id", "r.id", "r.start_sec", "g.label", "g.grade", F.col("g.start_sec").alias("gold_start"), "g.lexemes", "g.gains", "r.terms")
    every = retrieval.score_pairs(pairs, avgdl)
    monkeypatch.setattr(retrieval, "BLOCK_SPANS", block)
    monkeypatch.setattr(retrieval, "CROWDED", crowded)
    got = retrieval.best_touching(*evaluation.spread(joined, asking), 10, n, avgdl, 5.0).select(every.columns)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    stand = lambda df: rows(retrieval.standing(df, asks, chunks.select("id", "terms"), 10, n, avgdl))
    passed, all_pairs = rows(got), rows(every)
    assert set(passed) <= set(all_pairs) and len(set(passed)) == len(passed) < (0.7 if block == 20 else 0.3) * len(all_pairs)
    assert len(stand(every)) > 20 and stand(got) == stand(every)
    assert retrieval.best_touching(*evaluation.spread(joined.limit(0), asking), 10, n, avgdl, 5.0).count() == 0


def test_judged_queries_pass_on_few_pairs_of_crowded_times(spark, small, monkeypatch, tmp_path):
    """Twenty copies of all chunks and queries lie at the same times. Before, all pairs that touch were staged, 400 times as
    many as of one copy; the rows are those of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    for name in ("chunks", "golden_queries"):
        t = spark.read.parquet(f"{small}/{name}.parquet")
        t.crossJoin(spark.range(20).withColumnRenamed("id", "_k")).withColumn("id", F.concat("id", F.lit("~"), "_k")).drop("_k").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"create or replace view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    seen, standing = [], retrieval.standing

    def counted(pairs, *rest):  # noqa: ANN001, ANN002, ANN202
        seen.append(pairs.count())
        return standing(pairs, *rest)

    monkeypatch.setattr(retrieval, "standing", counted)
    got = catalogue.i2_mrr_and_success(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(duckdb.sql(f"select query_id, mrr, success5 from ({catalogue.SQL['i2_mrr_and_success']})").fetchall())
    assert 0 < seen[0] <= 10 * catalogue.unquoted_labels(spark, str(tmp_path)).count()


def test_credit_as_columns(spark):
    """The same credits as rank by rank, without a group of pandas rows a query."""
    rnd = random.Random(4)
    hits = {(f"q{q}", rnd.randint(1, 10), rnd.randint(0, 4)) for q in range(40) for _ in range(12)}
    grade = {(q, label): rnd.randint(0, 3) for q, _, label in hits}
    df = spark.createDataFrame([(q, r, label, grade[q, label]) for q, r, label in hits], "query_id string, rank int, label int, grade int")
    got = evaluation.credited(df)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(q, r, label, grade[q, label]) for q in {h[0] for h in hits} for r, label in evaluation.credit([(r, label, grade[q, label]) for p, r, label in hits if p == q]).items()}
    assert {tuple(r) for r in got.collect()} == want


def test_metrics(spark):
    gold = spark.createDataFrame([("q", 0, "f", 10.0, 20.0, 2), ("q", 1, "f", 100.0, 110.0, 1), ("q", 2, "g", 0.0, 5.0, 2)], "query_id string, label int, file string, start_sec double, end_sec double, grade int")
    got = spark.createDataFrame([("q", 1, "f", 500.0, 510.0), ("q", 2, "f", 12.0, 18.0), ("q", 3, "g", 1.0, 3.0), ("q", 4, "g", 2.0, 3.0)], "query_id string, rank int, file string, start_sec double, end_sec double")
    m = evaluation.query_metrics(evaluation.interval_hits(got, gold), gold).first()
    assert (m.recall3, m.recall5, m.precision3, m.mrr, m.first_hit, m.offset_sec) == (0.666667, 0.666667, 0.666667, 0.5, 2, 2.0)
    assert m.ndcg10 == pytest.approx((3 / math.log2(3) + 3 / math.log2(4)) / (3 + 3 / math.log2(3) + 1 / 2), abs=1e-6)
    assert evaluation.credit([(1, 0, 2), (2, 0, 2), (3, 2, 2)]) == {1: 0, 3: 2}


def test_statistics():
    rnd = random.Random(1)
    a = [rnd.choice([0.0, 1.0]) for _ in range(60)]
    low, high = evaluation.bootstrap(a)
    assert low < sum(a) / 60 < high
    # The standard library draws the same resamples.
    draw = random.Random(13)
    means = sorted(sum(a[draw.randrange(60)] for _ in range(60)) / 60 for _ in range(2000))
    assert (low, high) == pytest.approx((means[50], means[1950]))
    flip, gaps = random.Random(7), [x - y for x, y in zip(a, a[1:] + a[:1])]
    shifted = [x + 0.1 for x in a]
    extreme = sum(abs(sum(g + 0.1 if flip.random() < 0.5 else -g - 0.1 for g in gaps)) >= abs(sum(gaps) + 6.0) - 1e-12 for _ in range(5000))
    assert evaluation.permutation_p(shifted, a[1:] + a[:1]) == pytest.approx((extreme + 1) / 5001, abs=1e-3)
    assert evaluation.permutation_p(a, a) == 1.0 and evaluation.permutation_p([1.0] * 30, [0.0] * 30) < 0.001
    with pytest.raises(ValueError):
        evaluation.permutation_p([], [])


def test_error_rates(spark):
    texts = spark.createDataFrame([("It's the T-38, um, two!",), (None,), ("'' 'quoted'",)], "t string")
    assert [r.s for r in texts.select(alignment.spoken(F.col("t")).alias("s")).collect()] == [["it's", "the", "t", "38", "2"], [], ["quoted"]]
    assert alignment.align("a b c d".split(), "a x c d e".split())[:3] == (1, 0, 1)
    reference = spark.createDataFrame([("f", 0, "Ann", "zero lead in words"), ("f", 1, "Ann", "we went to the moon and back again in a day"), ("f", 2, "Bob", "no we did not go there at all my dear friend of mine")], "file_id string, turn int, speaker string, text string")
    spoken = [("S0", "we went to the moon and back again in a week"), ("S1", "no we did not go there at all my dear friend of mine")]
    heard = [(w, s) for s, t in spoken for w in t.split()]
    rates = alignment.error_rates(reference, spark.createDataFrame([("f", i, w, s) for i, (w, s) in enumerate(heard)], "file_id string, word_idx int, text string, speaker string")).first()
    assert rates.substitutions == 1 and rates.deletions == 0 and rates.insertions == 0 and rates.speaker_accuracy == 1.0
    assert alignment.overall(spark.createDataFrame([(90, 0.1, 1.0), (10, 0.2, 0.0)], "ref_words int, wer double, speaker_accuracy double")).first().wer == pytest.approx(0.11)


def test_error_rates_of_long_recordings(spark, small):
    rnd = random.Random(21)
    said = [str(rnd.randrange(900)) for _ in range(30_000)]
    gone = set(rnd.sample(range(30_000), 300))
    assert alignment.align(said, [w for i, w in enumerate(said) if i not in gone])[:3] == (0, 300, 0)
    for _ in range(60):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(0, 150))] for _ in range(2))
        cost = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, cost[0] = cost[0], i
            for j, y in enumerate(b, 1):
                left, cost[j] = cost[j], min(left + (x != y), cost[j] + 1, cost[j - 1] + 1)
        subs, dels, ins, pairs = alignment.align(a, b)
        assert subs + dels + ins == cost[-1] and len(pairs) == len(a) - dels == len(b) - ins and sum(a[i] != b[j] for i, j in pairs) == subs
    # Many voices: every label gets the name it agrees with.
    assert alignment.best_mapping([(f"n{i}", f"l{39 - i}") for i in range(40)])[0] == 1.0
    # Every recording has a row, long ones and those without excerpt included.
    rows = catalogue.e21_i7_error_rates(spark, small).collect()
    files = {r.file_id for t in ("utterances", "words") for r in spark.read.parquet(f"{small}/{t}.parquet").select("file_id").distinct().collect()} - {None}
    assert {r.file_id for r in rows} == files



def test_incremental_index_equals_recomputation(spark, small):
    chunks = spark.read.parquet(f"{small}/chunks.parquet").select("id", "file_id", "text").dropDuplicates(["id"])
    posted = index.postings(chunks, "english").cache()
    parts = [index.delta(posted.where(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == k), 1) for k in range(3)]
    assert index.drift(index.merge_counts(*parts), index.term_stats(posted)).count() == 0
    file = chunks.first().file_id
    kept = index.without(chunks, spark.createDataFrame([(file,)], "file_id string"), "file_id")
    gone = index.delta(posted.join(chunks.where(F.col("file_id") == file).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), -1)
    assert index.drift(index.merge_counts(index.term_stats(posted), gone), index.term_stats(index.postings(kept, "english"))).count() == 0
    signed = chunks.withColumn("signature", index.signature("id", "text"))
    assert index.changed(signed, signed, ["id"]).count() == 0 and index.changed(signed, signed.limit(5), ["id"]).count() == signed.count() - 5
    meta = spark.createDataFrame([("embedding_model", "hash"), ("embedding_dim", "64")], "key string, value string")
    index.check_model(meta, "hash", 64)
    with pytest.raises(ValueError):
        index.check_model(meta, "hash", 32)


@pytest.fixture(scope="module")
def library(spark):
    lines = ["The pilots trained in the old simulator every morning.", "We lost the guppie in the harbour last winter.", "Nobody found the pilot's license under the seat.", "A rocket engine needs cold fuel and patience.", "She asked about the rocket twice."]
    said, chunks = [], []
    for f in ("alpha", "beta"):
        for i, t in enumerate(lines):
            t = t if f == "alpha" else t.replace("rocket", "balloon")
            said.append((f"{f}_u{i}", f, i, f"SPEAKER_0{i % 2}", i * 30.0, i * 30.0 + 9, t, [(w, i * 30 + 0.4 * k, i * 30 + 0.4 * k + 0.3) for k, w in enumerate(t.split())]))
        for i in range(len(lines) - 1):
            chunks.append((f"{f}_c{i}", f, i, i * 30.0, i * 30.0 + 39, i, i + 2, ["SPEAKER_00", "SPEAKER_01"], " ".join(s[6] for s in said if s[1] == f and i <= s[2] < i + 2)))
    u = spark.createDataFrame(said, "id string, file_id string, idx int, speaker string, start_sec double, end_sec double, text string, words array<struct<token:string,start_sec:double,end_sec:double>>")
    c = spark.createDataFrame(chunks, "id string, file_id string, idx int, start_sec double, end_sec double, utt_start int, utt_end int, speakers array<string>, text string").withColumn("embed_text", F.col("text"))
    s = spark.createDataFrame([(f, f"SPEAKER_0{k}", r, f"{f} {r}") for f in ("alpha", "beta") for k, r in enumerate(("host", "guest"))], "file_id string, label string, role string, display_name string")
    m = spark.createDataFrame([("alpha", "Alpha show")], "file_id string, title string")
    return plan.build_index(c, u, s, m, "english"), plan.build_index(c, u, s, m)


def ask(spark, ix, text, **options):
    q = spark.createDataFrame([("q", text)], "query_id string, query string")
    return plan.search(ix, q, SearchOptions(**options)).orderBy("rank").collect()


def test_search_end_to_end(spark, library):
    english, simple = library
    hits = ask(spark, english, "rocket")
    assert hits[0].file_id == "alpha" and hits[0].title == "Alpha show" and hits[0].text[slice(*hits[0].highlights[0])].startswith("rocket")
    assert hits[0].start_sec <= hits[0].match_time <= hits[0].end_sec
    assert {r.utterance_id for r in ask(spark, english, "guppies", mode="lexical", phonetic=False)} == {"alpha_u1", "beta_u1"}
    assert {r.file_id for r in ask(spark, simple, '"rocket engine"', mode="lexical")} == {"alpha"} and not ask(spark, simple, '"engine rocket"', mode="lexical")
    assert {r.file_id for r in ask(spark, simple, "file:beta simulator")} == {"beta"}
    assert {r.role for r in ask(spark, simple, "role:guest rocket engine balloon")} == {"guest"}
    assert ask(spark, simple, "roket", mode="lexical") and not ask(spark, simple, "roket", mode="lexical", phonetic=False)
    spread = ask(spark, simple, "rocket")
    assert all(abs(a.start_sec - b.start_sec) >= Settings().nms_gap for a in spread for b in spread if a.rank < b.rank and a.file_id == b.file_id)
    assert not ask(spark, simple, "role:host")


@pytest.mark.parametrize("name", sorted(SYSTEMS))
def test_every_system_runs(spark, library, name):
    q = spark.createDataFrame([("q", "rocket engine fuel"), ("p", "who lost the guppie?")], "query_id string, query string")
    rows = plan.search(library[1], q, SYSTEMS[name]).collect()
    assert {r.query_id for r in rows} == {"q", "p"} and all(r.rank <= 10 for r in rows)


def test_hash_vectors():
    v = hash_vectors(["a b", "rocket fuel", "", None])
    assert v.shape == (4, 64) and abs(float((v[1] ** 2).sum()) - 1) < 1e-6 and v[2] == pytest.approx(0.125) and v[3] == pytest.approx(0.125)


def test_transcript_files(spark, tmp_path):
    doc = {"schema_version": 1, "file_id": "f", "duration": 2.0, "words": [{"w": "Hi", "s": 0.12345, "e": 0.5, "p": 0.9, "spk": "SPEAKER_00", "sc": 0.8}], "utterances": [], "turns": [], "speakers": [], "meta": {"a": "b"}}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    df = transcripts.read_transcripts(spark, str(tmp_path / "f.json"))
    transcripts.write_transcripts(df, str(tmp_path / "out"))
    again = transcripts.exploded_words(transcripts.read_transcripts(spark, str(tmp_path / "out"))).first()
    assert (again.text, again.start_sec, again.speaker) == ("Hi", 0.123, "SPEAKER_00")
    (tmp_path / "g.json").write_text(json.dumps({**doc, "schema_version": 2}))
    with pytest.raises(Exception, match="schema_version"):
        transcripts.read_transcripts(spark, str(tmp_path / "g.json")).collect()


def test_manifest_and_golden(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"file_id": "f", "excerpt": {"start": 1.0, "end": 2.0}}]}))
    row = transcripts.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row.title, row.audio_path, row.excerpt.end_sec) == ("f", "audio/f.mp3", 2.0)
    with pytest.raises(ValueError):
        transcripts.manifest_rows([{"file_id": "f"}, {"file_id": "f"}])
    good = {"id": "q", "query": "x", "category": "keyword", "split": "dev", "relevant": [{"file": "f", "start": 1, "end": 2}]}
    (tmp_path / "g.json").write_text(json.dumps({"queries": [good]}))
    assert transcripts.golden_moments(transcripts.read_golden(spark, str(tmp_path / "g.json"))).first().grade == 2
    for bad in ({"category": "x"}, {"split": "train"}, {"relevant": []}, {"relevant": [{"file": "f", "start": 3, "end": 2}]}):
        with pytest.raises(ValueError):
            transcripts.golden_rows([{**good, **bad}])


def test_page_turns(spark):
    html = """<nav>x</nav><p><strong>Transcript</strong></p><p><strong>Ann Bell (Host):</strong></p><p>Hello&nbsp;there.</p><p>&lt;Intro Music&gt;</p>
    <p>And on.</p><p><strong>Cyd</strong></p><p>Yes <b>really</b>.</p><p><strong>Cyd</strong></p><p>More.</p><script>no</script>"""
    expected = [("Ann Bell", "Hello there. And on."), ("Cyd", "Yes really . More.")]
    got = transcripts.page_turns(html)
    assert [s for s, _ in got] == ["Ann Bell", "Cyd"] and got[0] == expected[0] and "More." in got[1][1]
    rows = transcripts.html_turns(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert len(rows) == 2


def test_audio_and_reports(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"abc")
    row = transcripts.audio_files(spark, str(tmp_path / "a.mp3")).first()
    assert (row.size_bytes, row.sha256[:8]) == (3, "ba7816bf")
    md, js = transcripts.write_report(spark.createDataFrame([("full", 0.5)], "system string, mrr double"), str(tmp_path / "r"), "Report")
    assert "| full | 0.5000 |" in md.read_text() and json.loads(js.read_text())["rows"] == [{"system": "full", "mrr": 0.5}]


def test_streaming_equals_batch(spark, small, tmp_path):
    chunks = spark.read.parquet(f"{small}/chunks.parquet").select("id", "text").dropDuplicates(["id"]).cache()
    chunks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    indexing.index_stream(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert index.drift(indexing.stream_counts(spark, str(tmp_path / "ix")), index.term_stats(index.postings(chunks))).count() == 0


def test_session_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = indexing.sessions(stream).writeStream.format("memory").queryName("s").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    batch = {tuple(r) for r in indexing.sessions(events).collect()}
    closed = {tuple(r) for r in spark.table("s").collect()}
    assert closed and closed <= batch
