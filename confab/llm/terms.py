"""Occurrences and record counts of every term and n-gram (problem 7).

Method: suffix-sorted n-gram counting. Each text's suffixes, truncated to `longest` terms and pre-aggregated per text,
are routed by their first term, sorted in reverse lexicographic order and read once with a stack that holds one counter
and one set of records for each prefix of the current suffix; a prefix is finished when the order leaves it. A very
frequent first term would make one route hot, so routes also carry a shard of the record: records are whole in a shard,
so occurrences and record counts of the shards add up. Shards hold a fixed number of records, so a route stays as large,
however many records there are.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.text import tokenise

#: Records of a shard, on average. A route holds at most the suffixes that open with one term in one shard.
SHARD = 2000
RARE_BELOW, COMMON_ABOVE = 3, 0.4
SEPARATOR = " "


def truncated_suffixes(terms: list[str], longest: int) -> Counter:
    return Counter(tuple(terms[i : i + longest]) for i in range(len(terms)))


def count_prefixes(suffixes):  # noqa: ANN001, ANN201
    """(prefix, occurrences, records) of suffixes in reverse lexicographic order. suffixes: (terms, record, count).

    A stack level's records are merged into the level below when it is finished, so each is held once.
    """
    stack: list[list] = []  # [term, occurrences, records]

    def close(depth: int):  # noqa: ANN202
        while len(stack) > depth:
            prefix = tuple(level[0] for level in stack)
            _, n, records = stack.pop()
            yield prefix, n, len(records)
            if stack:
                below = stack[-1]
                below[1] += n
                if len(records) > len(below[2]):
                    below[2], records = records, below[2]
                below[2] |= records

    for terms, record, n in suffixes:
        shared = 0
        while shared < min(len(stack), len(terms)) and stack[shared][0] == terms[shared]:
            shared += 1
        yield from close(shared)
        for term in terms[shared:]:
            stack.append([term, 0, set()])
        stack[-1][1] += n
        stack[-1][2].add(record)
    yield from close(0)


def ngram_counts(records: DataFrame, key: str, text: str, longest: int = 1) -> DataFrame:
    """(ngram, n_terms, occurrences, records) of every n-gram of up to `longest` terms, terms joined by one space.

    Terms are the lower-case alphanumeric tokens of the NFKC text. A repeated key is one record: the greatest text
    counts. Rows without key take no part; null and empty texts have no terms.
    """
    shards = max(1, -(-records.count() // SHARD))
    texts = records.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("record")).agg(F.max(text).alias("text"))

    def suffixes(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            first, suffix, record, n = [], [], [], []
            for k, t in zip(batch.column("record").to_pylist(), batch.column("text").to_pylist()):
                for terms, c in truncated_suffixes(tokenise(t), longest).items():
                    first.append(terms[0])
                    suffix.append(SEPARATOR.join(terms))
                    record.append(k)
                    n.append(c)
            yield pa.RecordBatch.from_pydict({"first": first, "suffix": suffix, "record": record, "n": pa.array(n, pa.int64())}, schema=routed)

    routed = pa.schema([("first", pa.string()), ("suffix", pa.string()), ("record", pa.string()), ("n", pa.int64())])
    rows = texts.mapInArrow(suffixes, "first string, suffix string, record string, n bigint").withColumn("shard", F.pmod(F.xxhash64("record"), F.lit(shards)).cast("int"))
    # The separator sorts below every character of a term, so ordering the joined suffixes orders their lists of terms.
    ordered = rows.repartition("first", "shard").sortWithinPartitions("shard", F.desc("suffix"))

    def stacked(batches):  # noqa: ANN001, ANN202
        def feed():  # noqa: ANN202
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "suffix", "record", "n")))

        def counts():  # noqa: ANN202
            for _, rows in groupby(feed(), key=itemgetter(0)):
                yield from count_prefixes((tuple(suffix.split(SEPARATOR)), record, n) for _, suffix, record, n in rows)

        found = []
        for prefix, n, held in counts():
            found.append((SEPARATOR.join(prefix), len(prefix), n, held))
            if len(found) >= 10_000:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    def batch_of(found):  # noqa: ANN001, ANN202
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), counted.types)], schema=counted)

    counted = pa.schema([("ngram", pa.string()), ("n_terms", pa.int64()), ("n", pa.int64()), ("held", pa.int64())])
    partial = ordered.mapInArrow(stacked, "ngram string, n_terms bigint, n bigint, held bigint")
    return partial.groupBy("ngram").agg(F.max("n_terms").cast("int").alias("n_terms"), F.sum("n").alias("occurrences"), F.sum("held").alias("records"))


def marked_terms(records: DataFrame, key: str = "id", text: str = "text", longest: int = 1, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """`ngram_counts` with `mark`: rare if fewer than `rare_below` records hold the n-gram, common if more than the share
    `common_above` of all records do (null texts included), else null. Of both, common wins."""
    total = records.where(F.col(key).isNotNull()).agg(F.countDistinct(key).alias("all_records"))
    counts = ngram_counts(records, key, text, longest).crossJoin(F.broadcast(total))  # one row
    mark = F.when(F.col("records") > common_above * F.col("all_records"), "common").when(F.col("records") < rare_below, "rare")
    return counts.select(F.col("ngram").alias("term"), "n_terms", "occurrences", "records", "all_records", mark.alias("mark"))
