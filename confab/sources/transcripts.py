"""Files in and out: transcripts, recognition output, manifests, labelled queries, web transcripts, audio bytes, reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
WORD = "struct<w:string,s:double,e:double,p:double,spk:string,sc:double>"
UTTERANCE = "struct<id:string,idx:int,speaker:string,start:double,end:double,text:string,word_start:int,word_end:int>"
TURN = "struct<idx:int,speaker:string,start:double,end:double,utterance_start:int,utterance_end:int>"
SPEAKER = "struct<label:string,role:string,role_confidence:double,display_name:string,talk_time:double,n_words:int,n_utterances:int,question_rate:double>"
TRANSCRIPT = f"schema_version int, file_id string, duration double, words array<{WORD}>, utterances array<{UTTERANCE}>, turns array<{TURN}>, speakers array<{SPEAKER}>, meta map<string,string>"
SEGMENT = "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,word_start:int,word_end:int>"
RECOGNITION = f"words array<{WORD}>, segments array<{SEGMENT}>, language string, meta map<string,string>"
# The categories and splits of labelled queries, and a reference to utterances.
CATEGORIES = ("keyword", "phrase", "paraphrase", "question", "cross_file", "misspelled", "speaker")
SPLITS = ("dev", "test")
REFERENCE = r"^([a-z_0-9]+):([0-9]+)(?:-([0-9]+))?(?:@([12]))?$"
QUOTE = 240
#: A report of more rows is refused, not cut.
REPORT_ROWS = 10_000


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row a transcript file; another schema version fails the job."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)
    wrong = F.concat(F.lit("unsupported schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")))
    return raw.withColumn("file_id", F.when(F.col("schema_version") == VERSION, F.col("file_id")).otherwise(F.raise_error(wrong).cast("string")))


def write_transcripts(df: DataFrame, path: str) -> None:
    """One JSON object a line, times to the millisecond."""
    def rounded(column: str, start: str, end: str) -> Column:
        return F.transform(column, lambda x: x.withField(start, F.round(x[start], 3)).withField(end, F.round(x[end], 3)))

    times = {"words": rounded("words", "s", "e"), "utterances": rounded("utterances", "start", "end"), "turns": rounded("turns", "start", "end")}
    df.withColumns(times).withColumn("schema_version", F.lit(VERSION)).write.mode("overwrite").json(path)


def exploded_words(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("file_id", F.posexplode("words").alias("word_idx", "x")).select("file_id", "word_idx", F.col("x.w").alias("text"), F.col("x.s").alias("start_sec"), F.col("x.e").alias("end_sec"), F.coalesce("x.p", F.lit(1.0)).alias("prob"), F.col("x.spk").alias("speaker"), F.col("x.sc").alias("speaker_conf"))


def read_recognition(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words and segments, one row a file, named by the file."""
    return spark.read.schema(RECOGNITION).option("multiLine", True).json(path).withColumn("file_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def write_recognition(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _load(path: str | Path) -> object:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need PyYAML; the same content as JSON doesn't") from e
        return yaml.safe_load(text)
    return json.loads(text)


def manifest_rows(entries: Iterable[dict], audio_dir: str = "audio") -> list[dict]:
    """Entries with their defaults; a repeated file_id is an error."""
    out, seen = [], set()
    for e in entries:
        if e["file_id"] in seen:
            raise ValueError(f"duplicate file_id {e['file_id']}")
        seen.add(e["file_id"])
        excerpt, speakers, published = e.get("excerpt") or {}, e.get("speakers") or {}, e.get("published")
        out.append(
            {
                "file_id": e["file_id"], "title": e.get("title") or e["file_id"], "audio_path": f"{audio_dir}/{e['file_id']}.mp3", "episode": e.get("episode"),
                "published": published.isoformat() if hasattr(published, "isoformat") else published, "page_url": e.get("page_url"), "source_audio_url": e.get("source_audio_url"),
                "excerpt": {"start_sec": excerpt.get("start"), "end_sec": excerpt.get("end")}, "speakers": {"host": speakers.get("host"), "guest": speakers.get("guest")}, "topic": e.get("topic"),
            }
        )
    return out


MANIFEST = "file_id string, title string, audio_path string, episode int, published string, page_url string, source_audio_url string, excerpt struct<start_sec:double,end_sec:double>, speakers struct<host:string,guest:string>, topic string"
GOLDEN = "id string, query string, category string, split string, role string, notes string, relevant array<struct<file:string,start_sec:double,end_sec:double,grade:int,quote:string>>"


def read_manifest(spark: SparkSession, path: str, audio_dir: str = "audio") -> DataFrame:
    found = _load(path)
    return spark.createDataFrame(manifest_rows(found.get("files", []) if isinstance(found, dict) else found, audio_dir), MANIFEST)


def golden_rows(queries: Iterable[dict]) -> list[dict]:
    """Labelled queries, checked: unique ids, known category and split, at least one moment, ends not before starts."""
    out, seen = [], set()
    for q in queries:
        moments = [{"file": m["file"], "start_sec": float(m["start"]), "end_sec": float(m["end"]), "grade": int(m.get("grade", 2)), "quote": m.get("quote", "")} for m in q.get("relevant") or []]
        for bad, why in (
            (q["id"] in seen, "duplicate id"), (q.get("category") not in CATEGORIES, "unknown category"), (q.get("split") not in SPLITS, "unknown split"),
            (not moments, "no relevant moment"), (any(m["end_sec"] < m["start_sec"] for m in moments), "a moment ends before it starts"),
        ):
            if bad:
                raise ValueError(f"{q['id']}: {why}")
        seen.add(q["id"])
        out.append({"id": q["id"], "query": q["query"], "category": q["category"], "split": q["split"], "role": q.get("role"), "notes": q.get("notes"), "relevant": moments})
    return out


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    found = _load(path)
    return spark.createDataFrame(golden_rows(found["queries"] if isinstance(found, dict) else found), GOLDEN)


def golden_moments(golden: DataFrame) -> DataFrame:
    """(query_id, label, file, start_sec, end_sec, grade, quote): a row a labelled moment, numbered in its query."""
    return golden.select(F.col("id").alias("query_id"), F.posexplode("relevant").alias("label", "m")).select("query_id", "label", "m.file", "m.start_sec", "m.end_sec", F.coalesce("m.grade", F.lit(2)).alias("grade"), "m.quote")


def resolve_references(references: DataFrame, utterances: DataFrame, column: str = "reference") -> DataFrame:
    """Utterance ranges `file:a-b@grade` as times with a quote of at most 240 characters; malformed ones are left out.

    references: query_id and the reference; ranges are exploded, so the join is an equi-join."""
    part = lambda k: F.regexp_extract(column, REFERENCE, k)
    parsed = references.where(F.col(column).rlike(REFERENCE)).select(
        "query_id", column, part(1).alias("file_id"), part(2).cast("int").alias("a"), F.coalesce(F.expr(f"try_cast(regexp_extract({column}, '{REFERENCE}', 3) as int)"), part(2).cast("int")).alias("b"), F.coalesce(F.expr(f"try_cast(regexp_extract({column}, '{REFERENCE}', 4) as int)"), F.lit(2)).alias("grade")
    )
    spots = parsed.where("b >= a").withColumn("idx", F.explode(F.sequence("a", "b"))).join(utterances.select("file_id", "idx", "start_sec", "end_sec", "text"), ["file_id", "idx"])
    quote = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    found = spots.groupBy("query_id", column, "file_id", "grade", "a", "b").agg(F.round(F.min("start_sec"), 2).alias("start_sec"), F.round(F.max("end_sec"), 2).alias("end_sec"), quote.alias("quote"), F.count(F.lit(1)).alias("n"))
    short = F.when(F.length("quote") <= QUOTE, F.col("quote")).otherwise(F.concat(F.substring("quote", 1, QUOTE - 3), F.lit("...")))
    return found.where("n = b - a + 1").select("query_id", F.col("file_id").alias("file"), "start_sec", "end_sec", "grade", short.alias("quote"))


#: The first bytes of audio files.
MAGIC = {"RIFF": "wav", "fLaC": "flac", "OggS": "ogg", "ID3": "mp3"}


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256, kind, duration_sec) of audio files: kind by the first bytes, null where they are no known
    audio; the duration of uncompressed WAV from its header, null for others. Decoding and recognition need tools that
    aren't there; they are interfaces."""
    head = lambda n: F.substring(F.col("content"), 1, n)
    kind = F.lit(None).cast("string")
    for magic, name in MAGIC.items():
        kind = F.when(F.hex(head(len(magic))) == magic.encode().hex().upper(), name).otherwise(kind)
    # Bytes 29 to 32 of a WAV header: bytes a second, the lowest first.
    rate = sum((F.conv(F.hex(F.substring(F.col("content"), 29 + k, 1)), 16, 10).cast("double") * 256**k for k in range(4)), F.lit(0.0))
    duration = F.when((F.col("kind") == "wav") & (F.col("length") > 44), F.try_divide(F.col("length") - 44, rate))
    read = spark.read.format("binaryFile").load(path).withColumn("kind", kind)
    return read.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "kind", duration.alias("duration_sec"))


class _Page(HTMLParser):
    """Paragraphs of a page with the text that is bold in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[tuple[str, str]] = []
        self.text: list[str] | None = None
        self.bold: list[str] = []
        self.deep = self.skip = 0

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        if tag in ("p", "h2", "h3", "h4"):
            self.close_paragraph()
            self.text = []
        self.deep += tag in ("strong", "b")
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.deep = max(0, self.deep - (tag in ("strong", "b")))
        self.skip = max(0, self.skip - (tag in ("script", "style")))
        if tag in ("p", "h2", "h3", "h4"):
            self.close_paragraph()

    def handle_data(self, data: str) -> None:
        if self.text is not None and not self.skip:
            self.text.append(data)
            if self.deep:
                self.bold.append(data)

    def close_paragraph(self) -> None:
        if self.text is not None:
            squeeze = lambda parts: " ".join(" ".join(parts).replace("\xa0", " ").split())
            self.paragraphs.append((squeeze(self.text), squeeze(self.bold)))
        self.text, self.bold = None, []


def page_turns(html: str | None) -> list[tuple[str, str]]:
    """(speaker, text) of a page: speakers are short paragraphs that are all bold and end no sentence; paragraphs that are
    one stage direction go; neighbours of one speaker are joined. Where the page has a paragraph "Transcript", turns start
    behind it."""
    page = _Page()
    page.feed(html or "")
    page.close_paragraph()
    rows = page.paragraphs
    start = next((i + 1 for i, (text, bold) in enumerate(rows) if bold.lower() == "transcript" and text == bold), 0)
    turns: list[tuple[str, list[str]]] = []
    for text, bold in rows[start:]:
        if not text or re.fullmatch(r"[<\[][^>\]]*[>\]]", text):
            continue
        if bold and bold == text and len(text.split()) <= 6 and text[-1] not in ".?!":
            name = re.sub(r"\s*\(host\)\s*$", "", text.rstrip(":").strip(), flags=re.IGNORECASE)
            if not (turns and turns[-1][0] == name):
                turns.append((name, []))
        elif turns:
            turns[-1][1].append(text)
    said = [(name, " ".join(parts)) for name, parts in turns if parts and not name.startswith("<")]
    out: list[tuple[str, str]] = []
    for name, text in said:
        if out and out[-1][0] == name:
            out[-1] = (name, out[-1][1] + " " + text)
        else:
            out.append((name, text))
    return out


def html_turns(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, turn, speaker, text)."""

    @F.pandas_udf("array<struct<speaker:string,text:string>>")
    def turns(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [{"speaker": s, "text": t} for s, t in page_turns(h if isinstance(h, str) else "")])

    return pages.select(key, F.posexplode(turns(F.col(html))).alias("turn", "t")).select(key, "turn", "t.speaker", "t.text")


def write_report(summary: DataFrame, folder: str, title: str) -> tuple[Path, Path]:
    """A summary of a few rows as Markdown and JSON."""
    rows = [r.asDict(recursive=True) for r in summary.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; summarise first")
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    md, js = to / "report.md", to / "report.json"
    names = summary.columns
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)]
    md.write_text("\n".join(lines) + "\n", encoding="utf-8")
    js.write_text(json.dumps({"title": title, "rows": rows}, indent=1, default=str), encoding="utf-8")
    return md, js


def clock(seconds: Column) -> Column:
    """MM:SS.s, not below zero."""
    tenths = F.round(F.greatest(seconds, F.lit(0.0)) * 10).cast("long")
    return F.format_string("%02d:%02d.%d", F.floor(tenths / 600).cast("long"), F.floor(F.pmod(tenths, F.lit(600)) / 10).cast("long"), F.pmod(tenths, F.lit(10)))
