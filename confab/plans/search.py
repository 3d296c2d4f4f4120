"""Batch moment search: a table of queries in, ranked moments out, as one plan keyed by query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.config import PREFIXES, SearchOptions, Settings
from confab.functions.vectors import dot, hash_embedding
from confab.operators import fusion, index, moments, querying, retrieval
from confab.session import stage

RESULT = ("query_id", "rank", "id", "file_id", "title", "utterance_id", "speaker", "role", "speaker_name", "start_sec", "end_sec", "match_time", "text", "highlights", "score", "ranks")
MARKS = "array<struct<from:int,to:int,at:double>>"


@dataclass
class Index:
    """The tables a search reads. chunks: id, file_id, idx, start_sec, end_sec, utt_start, utt_end, speakers, roles, text,
    embedding; lengths: chunk_id, doc_len, and file_id, speakers, roles for filters; utterances: id, file_id, idx, speaker, start_sec, end_sec, text, words, lexemes, embedding. Vectors have
    unit length."""

    chunks: DataFrame
    utterances: DataFrame
    speakers: DataFrame
    manifest: DataFrame
    occurrences: DataFrame
    postings: DataFrame
    stats: DataFrame
    lengths: DataFrame
    corpus: DataFrame
    vocabulary: DataFrame
    analyzer: str = "simple"
    profile: str = "hash"


def build_index(chunks: DataFrame, utterances: DataFrame, speakers: DataFrame, manifest: DataFrame, analyzer: str = "simple", profile: str = "hash") -> Index:
    """All index tables, written to the shared folder and read again; vectors come from the deterministic embedder over embed_text."""
    acted = chunks.join(retrieval.chunk_roles(chunks, speakers), "id")
    embedded = stage(acted.withColumn("embedding", hash_embedding(F.col("embed_text"), PREFIXES[profile][1])))
    said = utterances.select("id", "file_id", "idx", "speaker", "start_sec", "end_sec", "text", "words")
    said = stage(said.withColumns({"lexemes": index.ANALYZERS[analyzer](F.col("text")), "embedding": hash_embedding(F.col("text"), PREFIXES[profile][1])}))
    occurrences = stage(index.occurrences(embedded, analyzer))
    posted = stage(occurrences.groupBy("lexeme", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("tf")))
    lengths = stage(index.doc_lengths(embedded, posted).join(embedded.select(F.col("id").alias("chunk_id"), "file_id", "speakers", "roles"), "chunk_id"))
    return Index(embedded, said, speakers, manifest, occurrences, posted, stage(index.term_stats(posted)), lengths, stage(index.corpus_stats(lengths)), stage(index.vocabulary(embedded)), analyzer, profile)


def search(ix: Index, queries: DataFrame, options: SearchOptions = SearchOptions(), settings: Settings = Settings(), lexicon: DataFrame | list[str] | None = None) -> DataFrame:
    """Ranked moments of every answerable query. queries: query_id, query, and role where given apart from the text.

    Explicit roles win over inline ones. Queries that can't be parsed have no rows; their error is in `parse_queries`.
    """
    k = options.limit(settings)
    pool = moments.pool_size(k)
    parsed = querying.parse_queries(queries, "query", settings.max_query_chars).where("q_error is null")
    if "role" in queries.columns:
        parsed = parsed.withColumn("q_role", F.coalesce(F.lower(F.trim("role")), "q_role"))
    parsed = stage(parsed.withColumn("embedding", hash_embedding(F.col("q_text"), PREFIXES[ix.profile][0])))
    lexemes = retrieval.query_lexemes(parsed, ix.analyzer)

    asks = parsed.select("query_id", *retrieval.FILTERS, (F.size("q_phrases") > 0).alias("has_phrases"))
    phrased = stage(retrieval.phrase_matches(parsed.where("size(q_phrases) > 0"), ix.occurrences, ix.analyzer))
    with_phrases = parsed.where("size(q_phrases) > 0")

    channels, hits = [], None
    if options.mode != "semantic":
        if options.phonetic:
            asked = parsed.select(F.explode("q_content").alias("token")).distinct()
            expanded = retrieval.expansions(asked, ix.vocabulary, lexicon)
            lexemes = lexemes.unionByName(retrieval.expansion_lexemes(parsed, lexemes, expanded, settings.expansion_weight, ix.analyzer))
        lexemes = stage(lexemes)
        hits = stage(retrieval.bm25(lexemes, ix.postings, ix.stats, ix.lengths, ix.corpus, settings, asks, phrased))
        channels.append(hits.select("query_id", F.lit("lexical").alias("channel"), "id", "rank", "score"))
    vectors = parsed
    if options.mode != "lexical":
        free = retrieval.dense(parsed.where("size(q_phrases) = 0"), ix.chunks, settings.candidates)
        bound = retrieval.dense_among(with_phrases, ix.chunks, phrased, settings.candidates)
        channels.append(free.unionByName(bound).select("query_id", F.lit("dense").alias("channel"), "id", "rank", "score"))
    listed = channels[0] if len(channels) == 1 else channels[0].unionByName(channels[1])
    weight = F.lit(1.0)
    if options.mode == "hybrid":
        weight = F.when(F.col("channel") == "lexical", querying.channel_weight(F.col("q_intent"), "lexical", options.adaptive)).otherwise(querying.channel_weight(F.col("q_intent"), "dense", options.adaptive))
    listed = listed.join(parsed.select("query_id", "q_intent"), "query_id").withColumn("weight", weight)
    if options.mode == "hybrid" and options.coverage:
        share = fusion.coverage(lexemes, hits, ix.stats, ix.corpus).withColumn("channel", F.lit("lexical"))
        listed = listed.join(share, ["query_id", "id", "channel"], "left").withColumn("multiplier", F.coalesce("coverage", F.lit(1.0)))
    else:
        listed = listed.withColumn("multiplier", F.lit(1.0))
    fused = fusion.convex(listed) if options.fusion == "cc" and options.mode == "hybrid" else fusion.reciprocal_ranks(listed, settings.rrf_k)
    if options.rerank:
        fused = fusion.rerank(fused, ix.chunks, parsed, top=settings.rerank_top, k=settings.rrf_k)
    pooled = stage(fused.where(F.col("position") <= pool))

    passages = pooled.join(ix.chunks.select("id", "file_id", F.col("start_sec").alias("chunk_start"), F.col("end_sec").alias("chunk_end"), "utt_start", "utt_end"), "id").join(vectors.select("query_id", "q_intent", "q_role", "q_speaker", F.col("embedding").alias("q_vector")), "query_id")
    said = ix.utterances.select("file_id", "idx", F.col("id").alias("utterance_id"), "speaker", F.col("start_sec").alias("utt_start_sec"), F.col("end_sec").alias("utt_end_sec"), "text", *(("lexemes", "embedding") if options.snap else ()))
    matched = lexemes.groupBy("query_id").agg(F.collect_set("lexeme").alias("q_lexemes"))
    roles = ix.speakers.select("file_id", F.col("label").alias("speaker"), F.coalesce(F.lower(F.trim("role")), F.lit("unknown")).alias("role"), F.col("display_name").alias("speaker_name")).dropDuplicates(["file_id", "speaker"])
    if options.snap:
        rows = moments.passage_utterances(passages, said)
    else:
        rows = passages.withColumn("idx", F.col("utt_start")).join(said, ["file_id", "idx"])
    rows = rows.join(roles, ["file_id", "speaker"], "left").withColumn("role", F.coalesce("role", F.lit("unknown")))
    rows = rows.where("(q_role is null or role = q_role) and (q_speaker is null or speaker = q_speaker)" if options.snap else "true")
    if options.snap:
        lexical = F.when(F.col("q_intent").isin("keyword", "phrase"), 0.8).otherwise(0.5) if options.mode != "semantic" else F.lit(0.3)
        similar = dot(F.col("q_vector"), F.col("embedding"))
        rows = moments.snap(rows, moments.lexeme_gains(lexemes, ix.stats, ix.corpus), lexical, similar).drop("lexemes", "embedding", "q_vector")
    kept = moments.suppress(rows, settings.nms_gap, settings.nms_overlap) if options.nms else rows
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("rank") <= k)
    if options.snap:  # words are fetched and marked for the moments that are shown only
        ranked = ranked.join(ix.utterances.select("file_id", "idx", "words"), ["file_id", "idx"], "left").join(matched, "query_id", "left")
        ranked = ranked.withColumn("marks", F.coalesce(moments.highlight(F.col("words"), F.coalesce("q_lexemes", F.array().cast("array<string>"))), F.array().cast(MARKS)))
        ranked = ranked.withColumn("match_time", F.coalesce(F.get("marks", F.lit(0))["at"], F.col("utt_start_sec")))
    else:
        ranked = ranked.withColumns({"marks": F.array().cast(MARKS), "match_time": F.col("chunk_start")})
    titled = ranked.join(ix.manifest.groupBy("file_id").agg(F.max("title").alias("title")), "file_id", "left")
    return titled.select(
        "query_id", "rank", "id", "file_id", F.coalesce("title", "file_id").alias("title"), "utterance_id", "speaker", "role", "speaker_name",
        F.round("utt_start_sec", 2).alias("start_sec"), F.round("utt_end_sec", 2).alias("end_sec"), F.round("match_time", 2).alias("match_time"), "text",
        F.transform("marks", lambda m: F.struct(m["from"].alias("from"), m["to"].alias("to"))).alias("highlights"), F.round("score", 6).alias("score"), "ranks",
    )
