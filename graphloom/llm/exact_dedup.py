"""Exact deduplication with a heavy-hitter split.

Digests of the normalised texts are written once. A Misra-Gries summary of every partition
finds the frequent digests; one verifying pass gives each its exact count and winner. The
winners (at most ``counters`` rows) are broadcast, so hot groups are settled where they lie.
The other digests, each with fewer than 2/counters of all rows, are grouped by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, lower_ascii, whole, written


class MisraGries:
    """A mergeable summary: an estimate is below the true count by at most n / (counters + 1)."""

    def __init__(self, counters: int) -> None:
        self.counters, self.counts = counters, Counter()

    def add(self, keys: list) -> None:
        self.counts.update(keys)
        if len(self.counts) > self.counters:
            cut = sorted(self.counts.values(), reverse=True)[self.counters]
            self.counts = Counter({k: v - cut for k, v in self.counts.items() if v > cut})


def frequent_digests(digests: DataFrame, rows: int, counters: int) -> DataFrame:
    """Digests that may hold 1/counters of the rows or more: every digest with 2/counters of them
    is among these, and there are never more than ``counters``."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(counters)
        for batch in batches:
            summary.add(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())], ["digest", "estimate"])

    found = digests.select("digest").mapInArrow(summarise, "digest binary, estimate long")
    return found.groupBy("digest").agg(F.sum("estimate").alias("estimate")).where(F.col("estimate") * counters >= max(rows, 1)).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 512) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and
    empty texts form one group. The largest id of a group stays. A null id loses against any
    other; rows that repeat the winning id are all marked kept. Other columns of the input are
    not read, whatever their names. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    normal = lower_ascii(whole(text_col))
    digests = written(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normal, 256)).alias("digest")), "digests")
    frequent = frequent_digests(digests, digests.count(), counters)
    group = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*group)
    tagged = digests.join(F.broadcast(winners), "digest", "left")
    hot = tagged.where(F.col("group_size").isNotNull())
    rest = tagged.where(F.col("group_size").isNull()).select("id", "digest")
    settled = rest.join(rest.groupBy("digest").agg(*group), "digest")
    columns = [F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return hot.select(columns).unionByName(settled.select(columns))
