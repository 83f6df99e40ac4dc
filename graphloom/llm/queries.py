"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .decontaminate import MASKS, decontaminate
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .packing import RankTokenizer, pack, read_packed_rows, write_packed
from .piece_bpe import encode_decode
from .pii import KINDS, find_pii
from .quality import score_quality, train_quality
from .toxicity import score_toxicity, train_toxicity
from .warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op10_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({LOWER_SQL.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), min_chars=1, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = f"""
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {{documents}})),
keyed AS (SELECT *, {LOWER_SQL.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '') AS text
  FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id)"""
ORACLES["op4_line_dedup"] = f"WITH {LINES_SQL.format(documents='documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept"


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file; $GRAPHLOOM_TOKENIZERS names another folder."""
    if folder := os.environ.get("GRAPHLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, tokenizer("piece_bpe_32k.model")).drop("text")
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = RankTokenizer.load(tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    folder = write_packed(pack(table(spark, sf_dir, "documents"), ranks, width=2048))
    return read_packed_rows(spark, folder, 2048, 2 if ranks.end < 1 << 16 else 4)


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = read_warc(write_warc(pages, min_bytes=0), dict(pages.dtypes)["page_id"])
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM g
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda x: x["kind"] == "secret")).cast("long").alias("n_secret"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), agreeing=0.6)
    return out.select(F.col("id").alias("doc_id"), "contaminated", "n_items", "best_score", "items")


def _seed_sql(words: str) -> str:
    """For each mask, the words that count from place ``pos`` on, joined."""
    joined = lambda m: " || ' ' || ".join(f"{words}[pos + {j + 1}]" for j, x in enumerate(m) if x == "1")
    return "CASE mask " + " ".join(f"WHEN {i} THEN {joined(m)}" for i, m in enumerate(MASKS)) + " END"


def decontamination_sql(documents: str) -> str:
    lengths = "[" + ", ".join(str(len(m)) for m in MASKS) + "]"
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    seeds = lambda of, key: f"""SELECT {key}, mask, pos, {_seed_sql('words')} AS seed FROM (SELECT {key}, words, unnest(range(len(words))) AS pos FROM {of}) CROSS JOIN (SELECT unnest(range({len(MASKS)})) AS mask)
      WHERE pos + {lengths}[mask + 1] <= len(words)"""  # noqa: E731
    return f"""
    doc_words AS (SELECT doc_id, {words} AS words FROM {documents}),
    item_words AS (SELECT item_id, {words} AS words FROM benchmark),
    item_seeds AS ({seeds('item_words', 'item_id')}),
    doc_seeds AS ({seeds('doc_words', 'doc_id')}),
    lain AS (SELECT DISTINCT doc_id, item_id, d.pos - i.pos AS off FROM doc_seeds d JOIN item_seeds i USING (mask, seed)),
    side AS (SELECT doc_id, item_id, off, j, CASE WHEN off + j >= 0 AND d.words[off + j + 1] = i.words[j + 1] THEN 1 ELSE -1 END AS x
      FROM lain JOIN doc_words d USING (doc_id) JOIN item_words i USING (item_id), unnest(range(len(i.words))) AS u(j)),
    sums AS (SELECT *, sum(x) OVER (PARTITION BY doc_id, item_id, off ORDER BY j) AS c FROM side),
    scored AS (SELECT doc_id, item_id, max(c - low) AS score FROM
      (SELECT *, least(0, min(c) OVER (PARTITION BY doc_id, item_id, off ORDER BY j)) AS low FROM sums) GROUP BY doc_id, item_id),
    beside AS (SELECT doc_id, item_id, max(n) AS agreed FROM (SELECT doc_id, item_id, off, count(*) FILTER (WHERE x = 1) AS n FROM side GROUP BY doc_id, item_id, off) GROUP BY doc_id, item_id),
    judged AS (SELECT doc_id, item_id, score, score >= least(12, greatest(ceil(len(words) * 0.45), 8)) OR agreed >= greatest(ceil(len(words) * 0.6), 8) AS bad
      FROM scored JOIN beside USING (doc_id, item_id) JOIN item_words USING (item_id)),
    contaminated AS (SELECT doc_id, max(score) AS best_score, count(*) FILTER (WHERE bad) AS n_items, string_agg(item_id, ',' ORDER BY item_id) FILTER (WHERE bad) AS items FROM judged GROUP BY doc_id)"""


ORACLES["op5_decontaminate"] = f"""WITH {decontamination_sql('documents')}
SELECT doc_id, coalesce(n_items, 0) > 0 AS contaminated, coalesce(n_items, 0) AS n_items, CAST(coalesce(best_score, 0) AS INTEGER) AS best_score, coalesce(items, '') AS items
FROM documents LEFT JOIN contaminated USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
