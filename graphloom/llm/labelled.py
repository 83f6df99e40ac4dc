"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, whole


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 40_000_000) -> tuple[pd.DataFrame, float]:
    """At most ``most_rows`` rows (text, label) outside the held-out fifth, and the share of label 1
    among all such labelled rows.

    Up to half of the bound goes to either label, those first whose hashed id is smallest; of these
    as many, in that order, as have ``most_chars`` code points together, each text whole. An id with
    labels of both kinds is left out; of texts that repeat an id, the smallest counts. So the sample
    is the same at every run. The ids chosen are a bounded table, which is broadcast.
    """
    sound = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col) & F.col(id_col).isNotNull())
    known = sound.groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other").drop("other")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64(F.col("id").cast("string"), F.lit(label)), F.col("id")]
    chosen = known.where("label = 0").orderBy(*order).limit(most_rows // 2).unionByName(known.where("label = 1").orderBy(*order).limit(most_rows // 2))
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumn("before", F.sum(F.char_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where(F.col("before") <= most_chars).select("id", "label", "text").toPandas().sort_values("id", ignore_index=True)
    total = sum(counts.values())
    return rows, counts.get(1, 0) / total if total else 0.5
