"""Command line: build an index, search it, list what it holds, evaluate it, delete it."""

from __future__ import annotations

import argparse
import dataclasses
import os

from pyspark.sql import functions as F

from confab.config import SYSTEMS
from confab.operators import evaluation, index
from confab.plans import experiments, library
from confab.plans.search import build_index, search
from confab.session import build_session, ship, staging
from confab.sources import transcripts

def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="confab", description=__doc__)
    parser.add_argument("--master", default=None)
    parser.add_argument("--analyzer", choices=("simple", "english"), default="simple")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index the tables chunks, utterances, speakers and manifest of a folder")
    build.add_argument("tables")
    build.add_argument("index")
    build.add_argument("--force", action="store_true", help="build even if the passages haven't changed")
    for name, what in (("files", "list recordings"), ("reset", "delete an index")):
        commands.add_parser(name, help=what).add_argument("index")
    show = commands.add_parser("transcript", help="print one recording")
    show.add_argument("index")
    show.add_argument("file_id")
    ask = commands.add_parser("search", help="answer one query")
    ask.add_argument("index")
    ask.add_argument("query")
    ask.add_argument("--system", choices=sorted(SYSTEMS), default="full")
    ask.add_argument("-k", type=int, default=None)
    stats = commands.add_parser("stats", help="count what an index holds")
    stats.add_argument("index")
    rate = commands.add_parser("evaluate", help="compare systems on labelled queries and write a report")
    rate.add_argument("index")
    rate.add_argument("golden", help="parquet table or JSON/YAML file of labelled queries")
    rate.add_argument("report")
    rate.add_argument("--systems", nargs="+", choices=sorted(SYSTEMS), default=["bm25", "dense", "full"])
    args = parser.parse_args(argv)
    spark = build_session("confab", args.master)
    ship(spark)
    if args.command == "build":
        def read(table: str, *keys: str):  # noqa: ANN202
            df = spark.read.parquet(os.path.join(args.tables, f"{table}.parquet"))
            return index.latest(df, list(keys), df.columns)

        chunks = read("chunks", "id")
        content, at = library.fingerprint(chunks), library.current(spark, args.index)
        same = at and not args.force and spark.read.parquet(f"{at}/meta").where((F.col("key") == "content") & (F.col("value") == content)).limit(1).count()
        if same:
            print("the index is up to date")
            return
        with staging(spark):
            built = build_index(chunks, read("utterances", "id"), read("speakers", "file_id", "label"), read("manifest", "file_id"), args.analyzer)
            library.save(spark, built, args.index, content=content)
        return
    if args.command == "reset":
        library.reset(spark, args.index)
        return
    ix = library.load(spark, args.index)
    if args.command == "files":
        for r in library.files(ix.manifest, ix.speakers).toLocalIterator():
            print(r["file_id"], r["title"], ", ".join(x["display_name"] or x["label"] for x in r["speakers"] or []))
    elif args.command == "transcript":
        for r in library.transcript(ix.utterances, args.file_id).toLocalIterator():
            print(f"[{r['start_sec']:.1f}] {r['speaker']}: {r['text']}")
    elif args.command == "search":
        one = spark.createDataFrame([("q", args.query)], "query_id string, query string")
        options = dataclasses.replace(SYSTEMS[args.system], k=args.k)
        for r in search(ix, one, options).orderBy("rank").collect():  # at most max_k rows
            marked = r["text"]
            for m in reversed(r["highlights"] or []):
                marked = f"{marked[: m['from']]}*{marked[m['from'] : m['to']]}*{marked[m['to'] :]}"
            minutes, seconds = divmod(max(r["match_time"], 0.0), 60)
            print(f"{r['rank']:2d} {int(minutes):02d}:{seconds:04.1f} {r['title']} [{r['speaker_name'] or r['role']}] {marked}")
    elif args.command == "stats":
        row = ix.corpus.first()
        print({"passages": row["n_docs"], "lexemes": ix.stats.count(), "postings": ix.postings.count(), "terms": ix.vocabulary.count(), "utterances": ix.utterances.count()})
    else:
        golden = spark.read.parquet(args.golden) if args.golden.endswith(".parquet") else transcripts.read_golden(spark, args.golden)
        golden = golden.dropDuplicates(["id"])
        rows = experiments.compare(ix, golden, {name: SYSTEMS[name] for name in args.systems})
        rows = rows.join(golden.select(F.col("id").alias("query_id"), "category"), "query_id")
        transcripts.write_report(evaluation.summary(rows, ["system", "category"]).where("system is not null").orderBy("system", "category"), args.report, "Evaluation")


__all__ = ["main"]

if __name__ == "__main__":
    main()
