"""Speaker profiles and who leads the conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.text import word_count
from confab.operators.sequence import is_question

QUESTIONS, SHARE, OPENER, STEEPNESS, NAMED = 3.0, 1.5, 0.5, 4.0, 0.75


def speaker_profiles(utterances: DataFrame) -> DataFrame:
    """Talk time, words, utterances and share of questions of each speaker; first_idx is the first utterance."""
    return utterances.groupBy("file_id", F.col("speaker").alias("label")).agg(
        F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 2).alias("talk_time"),
        F.sum(word_count(F.col("text"))).cast("long").alias("n_words"),
        F.count(F.lit(1)).alias("n_utterances"),
        F.round(F.avg(F.when(is_question(F.col("text")), 1.0).otherwise(0.0)), 4).alias("question_rate"),
        F.min("idx").alias("first_idx"),
    )


def infer_roles(profiles: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Adds role, role_confidence and display_name: the host is the speaker who asks more, talks less and opens; names are
    given from a confidence of 0.75 on, guests' only where there are two speakers."""
    file = Window.partitionBy("file_id")
    words = F.greatest(F.sum("n_words").over(file), F.lit(1))
    opens = F.when(F.col("first_idx") == F.min("first_idx").over(file), OPENER).otherwise(0.0)
    scored = profiles.withColumn("score", F.round(QUESTIONS * F.col("question_rate") + SHARE * (0.5 - F.col("n_words") / words) + opens, 9))
    best = file.orderBy(F.desc("score"), "first_idx")
    scored = scored.withColumns({"place": F.row_number().over(best), "speakers": F.count(F.lit(1)).over(file)})
    top = F.max(F.when(F.col("place") == 1, F.col("score"))).over(file)
    second = F.max(F.when(F.col("place") == 2, F.col("score"))).over(file)
    confidence = 1 / (1 + F.exp(-STEEPNESS * F.coalesce(top - second, F.lit(1.0))))
    out = scored.withColumns({"role": F.when(F.col("place") == 1, "host").otherwise("guest"), "confidence": confidence})
    if manifest is not None:
        names = manifest.groupBy("file_id").agg(F.max("speakers.host").alias("host_name"), F.max("speakers.guest").alias("guest_name"))
        out = out.join(names, "file_id", "left")
    else:
        out = out.withColumns({"host_name": F.lit(None).cast("string"), "guest_name": F.lit(None).cast("string")})
    name = F.when(F.col("confidence") >= NAMED, F.when(F.col("role") == "host", F.col("host_name")).when(F.col("speakers") == 2, F.col("guest_name")))
    return out.select("file_id", "label", "talk_time", "n_words", "n_utterances", "question_rate", "role", F.round("confidence", 4).alias("role_confidence"), name.alias("display_name"))
