"""History of files: line-by-line authorship in its porcelain form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blame_lines(files: DataFrame) -> DataFrame:
    """(file_path, line, hash, author, ts) of files (file_path, text in the porcelain form): a block for each line
    begins with its commit and numbers and ends with the line itself behind a tab; author and time stand only in
    a commit's first block. ts is in seconds."""
    blocks = files.select("file_path", F.explode(F.split("text", r"(?md)^\t[^\n]*\n?")).alias("block"))
    head = r"(?md)\A([0-9a-f]{40}) [0-9]+ ([0-9]+)"
    found = lambda pattern: F.nullif(F.regexp_extract("block", pattern, 1), F.lit(""))
    rows = blocks.where(F.col("block").rlike(head)).select("file_path", F.regexp_extract("block", head, 2).cast("long").alias("line"), F.regexp_extract("block", head, 1).alias("hash"), found(r"(?md)^author ([^\n]*)$").alias("author"), found(r"(?md)^author-time ([0-9]+)$").cast("long").alias("ts"))
    commit = Window.partitionBy("file_path", "hash")
    return rows.select("file_path", "line", "hash", F.max("author").over(commit).alias("author"), F.max("ts").over(commit).alias("ts"))
