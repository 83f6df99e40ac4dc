"""Documents: Markdown sections and links, plain text, notebooks, rationale comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that begin a rationale comment.
RATIONALES = ("NOTE", "HACK", "WHY", "TODO", "FIXME", "IMPORTANT")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(uid, title, level, start_line, end_line) of documents (uid, content): a heading outside fences opens a
    section that ends before the next of its level or above, or with the text. Lines count from 1."""
    lines = docs.select("uid", F.size(F.split("content", "\n")).alias("lines"), F.posexplode(F.split("content", "\n")).alias("i", "line"))
    order = Window.partitionBy("uid").orderBy("i")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    open_ = F.sum(F.when(fence, 1).otherwise(0)).over(order) % 2 == 1
    marked = lines.select("uid", "lines", "i", "line", (open_ | fence).alias("fenced"))
    heads = marked.where(~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S")).select("uid", "lines", (F.col("i") + 1).alias("start_line"), F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("title"))
    # the next heading of each level, then the nearest of those at this level or above
    after = Window.partitionBy("uid").orderBy("start_line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("start_line"))).over(after)) for k in range(1, 7)]
    end = F.coalesce(F.least(*nexts) - 1, F.col("lines"))
    return heads.select("uid", "title", "level", "start_line", end.alias("end_line"))


def markdown_documents(docs: DataFrame) -> DataFrame:
    """(uid, name): the first heading of level 1, else "document"."""
    first = markdown_sections(docs).where("level = 1").groupBy("uid").agg(F.min_by("title", "start_line").alias("name"))
    return docs.select("uid").join(first, "uid", "left").select("uid", F.coalesce("name", F.lit("document")).alias("name"))


def markdown_links(docs: DataFrame) -> DataFrame:
    """(uid, link): relative links, without anchors and web addresses."""
    links = docs.select("uid", F.explode(F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\(([^)\s]+)"), F.lit(1))).alias("link"))
    return links.where(~F.col("link").startswith("#") & ~F.col("link").rlike("^(?i)(https?:|mailto:)"))


def notebook_cells(docs: DataFrame) -> DataFrame:
    """(uid, cell, kind, source, first_line): cells of notebooks (uid, content) with their running line."""
    cell = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    cells = docs.select("uid", F.posexplode(F.from_json("content", cell)["cells"]).alias("cell", "x"))
    rows = cells.select("uid", "cell", F.col("x.cell_type").alias("kind"), F.array_join("x.source", "").alias("source"))
    size = F.size(F.split("source", "\n"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("uid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("uid", "cell", "kind", "source", (before + 1).alias("first_line"))


def rationales(files: DataFrame) -> DataFrame:
    """(file_path, line, kind, text) of comments in files (file_path, content) that begin with a rationale word."""
    lines = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    found = rf"(?:#|//|--|\*)\s*({'|'.join(RATIONALES)})\b:?\s*(.*)$"
    return lines.where(F.col("line").rlike(found)).select("file_path", (F.col("i") + 1).alias("line"), F.regexp_extract("line", found, 1).alias("kind"), F.trim(F.regexp_extract("line", found, 2)).alias("text"))
