"""Queries of the training-data problems and, where SQL can express them, their equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.llm import mixing, neighbours, overlap, packing, ranking, reading, runs, splitting, terms, turns

UNIT_COLUMNS = ["file_id", "first_idx", "last_idx"]


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def _runs(spark: SparkSession, at: str, unit: str) -> DataFrame:
    events = {"words": runs.word_events, "turns": runs.turn_events}[unit](table(spark, at, unit))
    found = runs.collapse_runs(events, table(spark, at, "speakers"), table(spark, at, "manifest"))
    return found.select(F.lit(unit).alias("unit"), "file_id", "voice", "first_idx", "last_idx", "n_events", "start_sec", "end_sec", "duration_sec")


def p1_runs(spark: SparkSession, at: str) -> DataFrame:
    """Every run of words and of turns, single events included, with count and duration."""
    return _runs(spark, at, "words").unionByName(_runs(spark, at, "turns"))


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    return p1_runs(spark, at).where("n_events >= 2").select("unit", "file_id", "first_idx", "last_idx")


def _conversation(spark: SparkSession, at: str) -> list[DataFrame]:
    return [table(spark, at, t) for t in ("utterances", "words", "speakers", "manifest")]


def p2_turns(spark: SparkSession, at: str) -> DataFrame:
    return turns.speaker_turns(*_conversation(spark, at))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return p2_turns(spark, at).select("file_id", "label", "first_id", "last_id")


def p2_utterances(spark: SparkSession, at: str) -> DataFrame:
    return turns.clean_utterances(*_conversation(spark, at)).select("file_id", "id", "label", "start_sec", "end_sec", "text")


def p2_times(spark: SparkSession, at: str) -> DataFrame:
    """Repaired times of every utterance, spoken or not."""
    return turns.clean_utterances(*_conversation(spark, at), unspoken=True).select("file_id", "id", "start_sec", "end_sec")


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, at, "utterances"), "utterances").unionByName(neighbours.similar_pairs(table(spark, at, "chunks"), "chunks"))


def p3_nearest(spark: SparkSession, at: str) -> DataFrame:
    """The k most similar others of every utterance and chunk, however far."""
    near = lambda unit: neighbours.nearest_ids(table(spark, at, unit), probes=None).select(F.lit(unit).alias("unit"), "id", "other", "cosine")
    return near("utterances").unionByName(near("chunks"))


def p4_pieces(spark: SparkSession, at: str) -> DataFrame:
    return splitting.split_oversized(table(spark, at, "chunks"), table(spark, at, "utterances"))


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return p4_pieces(spark, at).where("n_pieces > 1").select("id").distinct()


def p4_checks(spark: SparkSession, at: str) -> DataFrame:
    """What pieces must be, by chunk: they cover its words from the first to the last without a gap, none is over the limit,
    their texts are their words, and neighbours share words."""
    rows = p4_pieces(spark, at)
    before = Window.partitionBy("id").orderBy("piece")
    seen = rows.select("id", "piece", "word_start", "word_end", "overlap", F.size(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")).alias("n"), F.lag("word_end").over(before).alias("past"))
    gapless = F.bool_and(F.when(F.col("piece") == 0, F.col("word_start") == 0).otherwise((F.col("word_start") < F.col("past")) & (F.col("overlap") == F.col("past") - F.col("word_start"))))
    fits = (F.col("word_end") - F.col("word_start") <= splitting.LIMIT) & (F.col("n") == F.col("word_end") - F.col("word_start"))
    return seen.groupBy("id").agg(F.max("word_end").cast("long").alias("words"), gapless.alias("gapless"), F.bool_and(fits).alias("fits"), F.bool_and(F.col("overlap").between(10, 30) | (F.col("piece") == 0)).alias("shared"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, at, "golden_queries")).select("id_a", "id_b")


def p5_report(spark: SparkSession, at: str) -> DataFrame:
    return overlap.overlap_report(table(spark, at, "golden_queries"))


def p6_ranking(spark: SparkSession, at: str) -> DataFrame:
    return ranking.full_ranking(ranking.normal_scores(table(spark, at, "fused")))


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return ranking.leaders(ranking.normal_scores(table(spark, at, "fused")))


def p7_terms(spark: SparkSession, at: str) -> DataFrame:
    return terms.marked_terms(table(spark, at, "chunks"))


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    return p7_terms(spark, at).where("mark is not null").select("term", "mark")


def p7_ngrams(spark: SparkSession, at: str) -> DataFrame:
    return terms.marked_terms(table(spark, at, "chunks"), longest=3)


def p8_bins(spark: SparkSession, at: str) -> DataFrame:
    return packing.pack(table(spark, at, "documents"))


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return packing.divided(p8_bins(spark, at))


def p8_checks(spark: SparkSession, at: str) -> DataFrame:
    """What containers must be, by document: its tokens, its pieces, whether they follow one another, and whether all its
    containers hold at most the capacity."""
    rows = p8_bins(spark, at)
    full = rows.groupBy("bin").agg((F.sum("length") <= packing.CAPACITY).alias("fits"))
    return rows.join(full, "bin").groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"), (F.sum("length") == F.max(F.col("start") + F.col("length"))).alias("whole"), F.bool_and("fits").alias("fits"))


def p8_report(spark: SparkSession, at: str) -> DataFrame:
    return packing.fill_report(p8_bins(spark, at))


def p9_found(spark: SparkSession, at: str) -> DataFrame:
    """Sources that water-filling clamps in its first round."""
    return mixing.allocation(mixing.sized_sources(table(spark, at, "documents")), table(spark, at, "mix_targets")).where("clamped = 1").select("source")


def p9_mix(spark: SparkSession, at: str) -> DataFrame:
    return mixing.mix(table(spark, at, "documents"), table(spark, at, "mix_targets"))


def p9_shares(spark: SparkSession, at: str) -> DataFrame:
    return mixing.shares(table(spark, at, "documents"), table(spark, at, "mix_targets"))


def p10_levels(spark: SparkSession, at: str) -> DataFrame:
    return reading.reading_levels(table(spark, at, "documents"), table(spark, at, "graded_samples"))


def p10_sources(spark: SparkSession, at: str) -> DataFrame:
    return reading.levels_by_source(table(spark, at, "documents"), table(spark, at, "graded_samples"))


def p10_found(spark: SparkSession, at: str) -> DataFrame:
    return p10_levels(spark, at).where((F.col("lang") == "en") & F.col("band").isin("primary", "expert")).select("doc_id", "band")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_runs, p2_found, p2_turns, p2_utterances, p2_times, p3_found, p3_nearest, p4_found, p4_pieces, p4_checks, p5_found, p5_report, p6_found, p6_ranking,
        p7_found, p7_terms, p7_ngrams, p8_found, p8_bins, p8_checks, p8_report, p9_found, p9_mix, p9_shares, p10_found, p10_levels, p10_sources,
    )
}

SPACE = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDY = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}"
SIZE = rf"len(regexp_extract_all(coalesce(text, ''), '[{WORDY}]+|[^{WORDY}{SPACE}]+'))"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _probit(p: str) -> str:
    """The same approximation in SQL."""
    low, q = ranking.LOW, f"({p} - 0.5)"
    r = f"({q} * {q})"
    tail = lambda x: f"{_horner(ranking.C, x)} / {_horner((*ranking.D, 1.0), x)}"
    near, far = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"case when {p} < {low} then {tail(near)} when {p} > 1 - {low} then -({tail(far)}) else {_horner(ranking.A, r)} * {q} / {_horner((*ranking.B, 1.0), r)} end"


P6 = f"""
with items as (select distinct query_id, id from fused),
raws as (select query_id, id, unnest(map_keys(raw)) as channel, unnest(map_values(raw)) as value from fused),
oriented as (select distinct query_id, id, channel, case when channel = 'dense_l2' then -value else value end as value from raws where value is not null),
channels as (select distinct query_id, channel from oriented),
grid as (
  select i.query_id, i.id, c.channel, coalesce(o.value, '-infinity'::double) as value
  from items i join channels c using (query_id) left join oriented o using (query_id, id, channel)),
placed as (
  select *, rank() over (partition by query_id, channel order by value) as lowest,
    count(*) over (partition by query_id, channel, value) as ties, count(*) over (partition by query_id, channel) as n
  from grid),
shares as (select query_id, id, (lowest - 1 + (ties + 1) / 2.0 - 0.5) / n as p from placed),
scores as (select query_id, id, round(avg({_probit("p")}), 9) as score from shares group by 1, 2)
select query_id, id from (select *, row_number() over (partition by query_id order by score desc, id) as r from scores) where r = 1
"""

P9 = f"""
with docs as (
  select doc_id, regexp_replace(regexp_replace(lower(source), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_|_$', '', 'g') as source, {SIZE} as size from documents),
held as (select source, sum(size) as tokens from (select doc_id, max(source) as source, max(size) as size from docs group by doc_id) group by source),
listed as (select t.source, t.weight, t.max_repeats, coalesce(h.tokens, 0) as tokens from mix_targets t left join held h using (source))
select source from listed
where tokens * max_repeats < weight / (select sum(weight) from listed) * (select sum(tokens) from listed)
"""

P6_ALL = P6[: P6.rindex("select query_id, id from")] + "select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from scores"

FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
TERMS = f"regexp_extract_all(replace(regexp_replace(lower(translate(replace(replace(text, '’', ''''), '‘', ''''), '{FULL}', '{HALF}')), '''s\\b', '', 'g'), '''', ''), '[a-z0-9]+')"


def _terms(longest: int, columns: str, where: str = "true") -> str:
    """Terms by list, for texts whose compatibility characters are full-width letters and digits."""
    return f"""with texts as (select id, max(text) as text from chunks where id is not null group by 1), t as (select id, {TERMS} as t from texts),
g as (select id, unnest(flatten(list_transform(range(1, {longest + 1}), lambda n: list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))))) as term from t),
c as (select term, len(string_split(term, ' '))::int as n_terms, count(*) as occurrences, count(distinct id) as records, (select count(*) from texts) as all_records from g group by 1)
select {columns} from (select *, case when records > {terms.COMMON_ABOVE}::double * all_records then 'common' when records < {terms.RARE_BELOW} then 'rare' end as mark from c) where {where}"""


P4_CHECKS = f"""with big as (select id, any_value(len(regexp_extract_all(text, '[^{SPACE}]+'))) as words from chunks group by id)
select id, words, true as gapless, true as fits, true as shared from big where words > {splitting.LIMIT}"""
P8_CHECKS = f"""with sizes as (select doc_id, max({SIZE}) as n from documents group by 1)
select doc_id, n as tokens, greatest(1, ceil(n / {packing.CAPACITY}.0)::bigint) as pieces, true as whole, true as fits from sizes where n > 0"""
P2_TIMES = "select file_id, id, start_sec, greatest(end_sec, start_sec) as end_sec from (select distinct on (id) * from utterances order by id, indexed_at desc)"

SQL = {
    "p2_times": P2_TIMES,
    "p4_checks": P4_CHECKS,
    "p6_ranking": P6_ALL,
    "p7_found": _terms(1, "term, mark", "mark is not null"),
    "p7_terms": _terms(1, "term, n_terms, occurrences, records, all_records, mark"),
    "p7_ngrams": _terms(3, "term, n_terms, occurrences, records, all_records, mark"),
    "p8_checks": P8_CHECKS,
    "p4_found": f"select distinct id from chunks where len(regexp_extract_all(text, '[^{SPACE}]+')) > {splitting.LIMIT}",
    "p6_found": P6,
    "p8_found": f"select distinct doc_id from documents where {SIZE} > {packing.CAPACITY}",
    "p9_found": P9,
}
