"""Line deduplication across documents, with DataFrame functions only.

Lines are normalised, exploded and hashed (96 bits); the distinct documents of every hash are
counted after a partial count in each task. Positions of frequent lines come back per document
and the text is reassembled without them. The few very frequent hashes (at most ``heavy``, by
their share of all lines) meet the lines by a broadcast, all others by a shuffled join, so that
no key brings more than 1/heavy of the lines to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, unused, whole, written

KEY = ("h1", "h2")


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    return F.transform(F.split(lower_ascii(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def dropped_positions(docs: DataFrame, row: list[str], text: Column, min_chars: int, min_docs: int, heavy: int = 4096) -> DataFrame:
    """(row, gone): for each document with frequent lines, their positions from 0."""
    own = F.filter(line_keys(text), lambda x: F.char_length(x) >= min_chars)
    counts = docs.select(F.explode(F.array_distinct(F.transform(own, hashed))).alias("key")).select("key.*").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    frequent = written(counts.where(F.col("n") >= min_docs), "frequent_lines")
    total = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # fewer than `heavy` hashes can each have more than 1/heavy of the frequent lines' rows
    hot = F.col("n") * heavy > total
    marked = F.transform(line_keys(text), lambda x, i: F.struct(i.alias("at"), F.char_length(x).alias("size"), hashed(x).alias("key")))
    lines = docs.select(*row, F.explode(F.filter(marked, lambda x: x["size"] >= min_chars)).alias("line")).select(*row, "line.at", "line.key.*")
    hit = lines.join(F.broadcast(frequent.where(hot).select(*KEY, F.lit(True).alias("hot"))), list(KEY), "left")
    rest = hit.where(F.col("hot").isNull()).join(frequent.where(~hot).select(*KEY), list(KEY), "left_semi")
    found = hit.where(F.col("hot")).select(*row, "at").unionByName(rest.select(*row, "at"))
    return found.groupBy(*row).agg(F.collect_set("at").alias("__gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, heavy: int = 4096) -> DataFrame:
    """Drops, in every document, the lines whose key is found in ``min_docs`` documents or more.

    A key is the line without blanks ([\\x20\\x09-\\x0D]) at its ends and with A-Z lower-cased;
    keys shorter than ``min_chars`` code points never count. Returns the input's columns with the
    text replaced by the lines that stay, joined by a newline, and two more: n_lines (before) and
    n_dropped; columns of these names in the input are replaced. A null or empty text is one
    empty line and gives an empty text. Every row is a document of its own, also where ids repeat
    or are null. An empty table gives an empty result.
    """
    base = docs.drop("n_lines", "n_dropped")
    row = [unused(docs, "__id"), unused(docs, "__hash")]  # rows that agree in both have the same text, and so the same positions
    gone_, lines_, text_ = (unused(docs, x) for x in ("__gone", "__lines", "__text"))
    numbered = base.withColumns({row[0]: whole(F.col(id_col).cast("string")), row[1]: F.xxhash64(F.col(text_col))})
    gone = dropped_positions(numbered.select(*row, text_col), row, whole(text_col), min_chars, min_docs, heavy).withColumnRenamed("__gone", gone_)
    lines = F.split(whole(text_col), "\n")
    joined = numbered.join(gone, row, "left").withColumn(lines_, lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone_))
    out = joined.withColumn(text_, F.when(F.col(gone_).isNull(), whole(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines_), i)), "\n")))
    columns = [F.col(text_).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in base.columns]
    return out.select(*columns, F.size(lines_).cast("long").alias("n_lines"), F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias("n_dropped"))
