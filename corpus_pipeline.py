"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``; columns with the names
that operators use inside stay what they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table, written
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.near_dedup import drop_near_duplicates
from graphloom.llm.piece_bpe import encode_decode
from graphloom.llm.quality import score_quality, train_quality
from graphloom.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more stay.

    Null and empty texts are scored as empty; repeated rows score alike. Without labels of both kinds every
    score is label 1's share (0.5 without labels), so all stay or go. An empty table stays empty.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, score_col="__score").where("__score >= 0.3").drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text.

    A null text comes out empty; every row counts as a document, also where ids repeat or are null.
    """
    out = line_dedup(docs, min_chars=1, min_docs=10).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document with the smallest id stays.

    Null and empty texts all stay, as they resemble nothing; a null id loses against any other; rows that
    repeat an id and a text stay or go together.
    """
    return drop_near_duplicates(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts stay, and so does everything if the benchmark is empty; rows that repeat an id and a
    text stay or go together. Items of fewer than 8 words are never found (op5's docstring).
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), agreeing=0.6)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the text they decode to: ids, decoded and n_tokens, beside the columns.

    Null and empty texts have no ids; columns of these three names are replaced.
    """
    out = encode_decode(docs, tokenizer("piece_bpe_32k.model"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("encode", encode)]
#: SQL can't express the quality network; tests/llm/test_pipeline.py holds run() against brute force, given the network's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
