"""Comparisons and the command line on a small library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.__main__ import main
from confab.config import SearchOptions
from confab.plans import experiments, library
from confab.plans.search import build_index
from confab.session import ship


def tables(spark, small):
    ship(spark)
    read = lambda t, *k: spark.read.parquet(f"{small}/{t}.parquet").dropDuplicates(list(k))
    return read("chunks", "id"), read("utterances", "id"), read("speakers", "file_id", "label"), read("manifest", "file_id")


def test_systems_are_compared(spark, small):
    ix = build_index(*tables(spark, small))
    golden = spark.read.parquet(f"{small}/golden_queries.parquet").dropDuplicates(["id"]).limit(12)
    rows = experiments.compare(ix, golden, {"a": SearchOptions(mode="lexical", phonetic=False), "b": SearchOptions(mode="semantic")})
    assert rows.select("system").distinct().count() == 2 and rows.count() == 2 * golden.count()
    assert 0 < experiments.significance(rows, "mrr", "a", "b") <= 1
    swept = experiments.fusion_sweep(ix, golden, (10,), (50,), (True,), ("rrf", "cc"))
    assert swept.select("system").distinct().count() == 2


def test_labelers_are_compared(spark):
    rng = np.random.default_rng(3)
    truth = np.repeat([0, 1, 0, 1], 25)
    p = np.clip(np.where(truth == 0, 0.75, 0.25) + rng.normal(0, 0.25, 100), 0.02, 0.98)
    rows = [("f", i, i // 10, bool(i % 25 == 0), [float(np.log(p[i])), float(np.log(1 - p[i]))], ["A", "B"]) for i in range(100)]
    scored = spark.createDataFrame(rows, "file_id string, word_idx int, segment int, is_boundary boolean, loglik array<double>, names array<string>")
    real = spark.createDataFrame([("f", i, "AB"[truth[i]]) for i in range(100)], "file_id string, word_idx int, speaker string")
    error = {r.labeler: r.error for r in experiments.diarization_ablation(scored, real).collect()}
    assert set(error) == {"raw", "uniform", "boundary", "segment-majority"} and error["boundary"] <= error["raw"] and error["boundary"] <= 0.05


def test_command_line(spark, small, tmp_path, capsys):
    main(["build", small, str(tmp_path / "ix")])
    main(["build", small, str(tmp_path / "ix")])
    assert "up to date" in capsys.readouterr().out
    main(["stats", str(tmp_path / "ix")])
    assert "passages" in capsys.readouterr().out
    main(["files", str(tmp_path / "ix")])
    main(["transcript", str(tmp_path / "ix"), "open_channel_feed"])
    assert len(capsys.readouterr().out.splitlines()) > 5
    at = library.current(spark, str(tmp_path / "ix"))
    word = spark.read.parquet(f"{at}/stats").where("df between 2 and 5").agg(F.min("lexeme")).first()[0]
    main(["search", str(tmp_path / "ix"), word, "--system", "bm25", "-k", "3"])
    assert capsys.readouterr().out.strip().startswith("1 ")
    golden = spark.read.parquet(f"{small}/golden_queries.parquet").dropDuplicates(["id"]).limit(5)
    golden.write.parquet(str(tmp_path / "golden.parquet"))
    main(["evaluate", str(tmp_path / "ix"), str(tmp_path / "golden.parquet"), str(tmp_path / "report"), "--systems", "bm25"])
    assert "| bm25 |" in (tmp_path / "report/report.md").read_text()
    with pytest.raises(ValueError):
        library.load(spark, str(tmp_path / "ix"), "e5")
    main(["reset", str(tmp_path / "ix")])
    with pytest.raises(FileNotFoundError):
        library.load(spark, str(tmp_path / "ix"))


def test_files_are_replaced_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "file_id string, n int")
    library.replace_files(rows(("a b", 1), ("c", 2)), folder)
    library.replace_files(rows(("c", 3), ("d", 4)), folder)
    held = lambda: {(r.file_id, r.n) for r in spark.read.parquet(folder).collect()}
    assert held() == {("a b", 1), ("c", 3), ("d", 4)}
    library.delete_files(spark, folder, ["a b", "none"])
    assert held() == {("c", 3), ("d", 4)}


def test_query_vectors_are_stored(spark):
    queries = spark.createDataFrame([("1", "fog horn"), ("2", " fog horn"), ("3", "rim"), ("4", None)], "query_id string, q_text string")
    store = spark.createDataFrame([("rim", [9.0])], "text string, embedding array<float>")
    found, fresh = library.stored_vectors(queries, store)
    vectors = {r.query_id: r.embedding for r in found.collect()}
    assert vectors["3"] == [9.0] and vectors["1"] == vectors["2"] and len(vectors["1"]) == 64 and vectors["4"] is None
    assert [r.text for r in fresh.collect()] == ["fog horn"]
