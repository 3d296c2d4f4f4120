"""The stored library: published versions of an index, tables replaced file by file, listings, and stored query vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions.vectors import hash_embedding
from confab.operators import index
from confab.plans.search import Index

TABLES = ("chunks", "utterances", "speakers", "manifest", "occurrences", "postings", "stats", "lengths", "corpus", "vocabulary")
POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the published version, None where none is."""
    files, pointer = _files(spark, f"{folder}/{POINTER}")
    return f"{folder}/{spark.read.text(f'{folder}/{POINTER}').first()[0]}" if files.exists(pointer) else None


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    """Writes all tables as a new version and makes it the current one by renaming one small file, so readers see the old
    version or the new one, never a part; the version before it is deleted."""
    old, name = current(spark, folder), f"v-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    files, fresh = _files(spark, f"{folder}/{POINTER}-{name}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    pointer = _files(spark, f"{folder}/{POINTER}")[1]
    if files.exists(pointer):
        files.delete(pointer, False)
    files.rename(fresh, pointer)
    if old:
        files.delete(_files(spark, old)[1], True)
    return f"{folder}/{name}"


def reset(spark: SparkSession, folder: str) -> None:
    """Deletes a library."""
    files, target = _files(spark, folder)
    files.delete(target, True)


def fingerprint(chunks: DataFrame) -> str:
    """One text for the content of all chunks, whatever their order: two sums of row hashes and the count."""
    mix = lambda seed: F.sum(F.xxhash64(F.lit(seed), "id", "file_id", "text", "embed_text").cast("decimal(38,0)"))
    row = chunks.agg(F.count(F.lit(1)).alias("n"), mix(1).alias("a"), mix(2).alias("b")).first()
    return f"{row['n']}:{row['a']}:{row['b']}"


def save(spark: SparkSession, ix: Index, folder: str, dim: int = 64, content: str = "") -> str:
    meta = [("embedding_model", ix.profile), ("embedding_dim", str(dim)), ("analyzer", ix.analyzer), ("content", content)]
    tables = {name: getattr(ix, name) for name in TABLES}
    return publish(spark, folder, tables | {"meta": spark.createDataFrame(meta, "key string, value string")})


def load(spark: SparkSession, folder: str, profile: str | None = None, dim: int = 64) -> Index:
    """The published index; refuses one that another model than `profile` built."""
    at = current(spark, folder)
    if at is None:
        raise FileNotFoundError(f"no index is published in {folder}")
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{at}/meta").limit(10).collect()}
    index.check_model(spark.read.parquet(f"{at}/meta"), profile or meta["embedding_model"], dim)
    return Index(*(spark.read.parquet(f"{at}/{name}") for name in TABLES), meta["analyzer"], meta["embedding_model"])


def replace_files(table: DataFrame, folder: str, key: str = "file_id") -> None:
    """Writes the rows of some recordings over what a table holds of them; other recordings stay as they are."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def delete_files(spark: SparkSession, folder: str, names: list[str], key: str = "file_id") -> None:
    """Drops the named recordings from a table written by `replace_files`."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in names:
        files, target = _files(spark, f"{folder}/{key}={escape(name)}")
        files.delete(target, True)


# Listings, one row what is listed, in order.
def files(manifest: DataFrame, speakers: DataFrame) -> DataFrame:
    """(file_id, title, published, topic, speakers): recordings by name, each with its speakers by label."""
    who = speakers.where("file_id is not null and label is not null").groupBy("file_id", "label").agg(F.max(F.struct("role", "display_name")).alias("s"))
    who = who.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("label", "s.role", "s.display_name"))).alias("speakers"))
    one = manifest.groupBy("file_id").agg(F.max(F.struct("title", "published", "topic")).alias("m")).select("file_id", F.coalesce("m.title", "file_id").alias("title"), "m.published", "m.topic")
    return one.join(who, "file_id", "left").orderBy("file_id")


def transcript(utterances: DataFrame, file_id: str) -> DataFrame:
    """(idx, speaker, start_sec, end_sec, text) of one recording, in order of idx."""
    return utterances.where(F.col("file_id") == file_id).select("idx", "speaker", "start_sec", "end_sec", "text").orderBy("idx")


def statistics(chunks: DataFrame, utterances: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: chunks, utterances, files, hours."""
    hours = manifest.groupBy("file_id").agg(F.max("excerpt.end_sec").alias("e")).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("e") / 3600, 2).alias("hours"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(chunks, "chunks").crossJoin(count(utterances, "utterances")).crossJoin(hours)  # one row each


def stored_vectors(queries: DataFrame, store: DataFrame, profile_prefix: str = "", text: str = "q_text") -> tuple[DataFrame, DataFrame]:
    """Queries with their vectors (embedding), and the rows to add to the store: only texts that it lacks are embedded, each
    once. store: text, embedding."""
    asked = queries.select(F.trim(F.col(text)).alias("text")).where("text is not null").distinct()
    fresh = asked.join(store.select("text"), "text", "left_anti").withColumn("embedding", hash_embedding(F.col("text"), profile_prefix))
    known = store.select("text", "embedding").unionByName(fresh)
    return queries.withColumn("_text", F.trim(F.col(text))).join(known.withColumnRenamed("text", "_text"), "_text", "left").drop("_text"), fresh
