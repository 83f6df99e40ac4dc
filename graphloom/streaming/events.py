"""Streams: windows over events, and a graph kept up to date by change batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.lineage import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """Events of a folder's Parquet files as they arrive, their time as an instant in UTC."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files).parquet(folder)
    return raw.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of each window."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of each user's runs of events without a longer pause."""
    own = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def followed(events: DataFrame, first: str, second: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(user_id, first_id, second_id): events of one type and those of another by the same user no later than
    ``within`` after. The bound on time lets Spark forget what nothing can meet any more."""
    of = lambda kind, side: events.where(F.col("event_type") == kind).withWatermark("ts", late).select(F.col("user_id").alias(f"{side}_user"), F.col("event_id").alias(f"{side}_id"), F.col("ts").alias(f"{side}_ts"))
    near = (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    pairs = of(first, "first").join(of(second, "second"), (F.col("first_user") == F.col("second_user")) & near)
    return pairs.select(F.col("first_user").alias("user_id"), "first_id", "second_id")


def running(events: DataFrame) -> DataFrame:
    """(user_id, n, last_id): each user's events so far and the latest of them (by time, then id), after each
    batch that has some. What is kept of a user is three numbers."""
    kept = "n long, last_ts long, last_id long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *last = state.get if state.exists else (0, -(2**62), -(2**62))
        for rows in batches:
            n += len(rows)
            last = max([tuple(last), *zip(rows["us"].tolist(), rows["event_id"].tolist(), strict=True)])
        state.update((n, *last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_id": [last[1]]})

    own = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last_id long", kept, "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream gives for what is there now, as a table: it runs to its end and stops. In append
    mode only windows that the watermark has closed are there."""
    spark = stream.sparkSession
    base = shared_folder(spark, "graphloom-stream")
    kinds = stream.schema

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    try:
        return spark.read.schema(kinds).parquet(f"{base}/out")
    except AnalysisException:
        return spark.createDataFrame([], kinds)


def follow_changes(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, every: str = "500 milliseconds"):
    """Runs ``apply`` (changed, removed) on each batch of a stream of (path, removed, ts): paths that repeat in
    a batch count once, by their last change. Batches collect what arrives within ``every``."""

    def one(batch: DataFrame, n: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("removed", "ts").alias("removed"))
        apply(last.where(~F.col("removed")).select("path"), last.where("removed").select("path"))

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
