"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a run of words of which a fixed mask ignores some, so that a replaced word there does no
harm. Seeds of the benchmark and of the documents meet by their hash; a sieve of bounded size is
broadcast first, so that of the documents' seeds only hits (and a few chance ones) are shuffled.
Around each hit, item and document are laid side by side and the best stretch is scored: a word
that agrees counts 1, one that differs -1. Items too short to score enough with many replaced words
are judged by the share of their words that agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_join, whole, without_rows, written

#: 1: the word counts, 0: it is ignored. Replacing every third, fourth or later word leaves hits.
MASKS = ("1110111", "11011011", "1101011")
#: The sieve has at most so many rows, however large the benchmark is.
SIEVE = 1 << 20


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


#: Bits of the sieve for single words: bounded, and small enough to be part of the plan.
WORD_BITS = 1 << 16


def words_of(items: DataFrame) -> Column:
    """The bits of all words of the benchmark's "codes", as a constant array of 64-bit numbers."""
    found = items.select(F.explode("codes").alias("c")).select(F.col("c").bitwiseAND(WORD_BITS - 1).alias("c")).distinct().collect()
    bits = [0] * (WORD_BITS // 64)
    for r in found:
        bits[r["c"] >> 6] |= 1 << (r["c"] & 63)
    return F.array(*[F.lit(b - (1 << 64) if b >> 63 else b).cast("long") for b in bits])


def known(code: Column, bits: Column) -> Column:
    """Whether a word may be one of the benchmark's."""
    low = code.bitwiseAND(WORD_BITS - 1).cast("int")
    return F.call_function("shiftright", F.get(bits, F.shiftright(low, 6)), low.bitwiseAND(63)).bitwiseAND(1) == 1


#: Words of a row's chunk, which bounds what a task holds at once.
CHUNK = 2048


def seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., at, seed) for all masks and places of each row's array "codes" of word hashes,
    of which null ones are in no seed. Texts go in chunks that overlap by a mask's length, so that no row carries a long array along."""
    span = max(map(len, MASKS)) - 1
    starts = F.when(F.size("codes") > 0, F.sequence(F.lit(0), F.size("codes") - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    chunks = rows.select(*keep, F.explode(F.transform(starts, lambda i: F.struct(i.alias("from"), F.slice("codes", i + 1, CHUNK + span).alias("own")))).alias("c")).select(*keep, "c.*")

    def of(i: int, m: str) -> Column:
        last = F.least(F.size("own") - len(m), F.lit(CHUNK - 1))
        hashed = lambda at: F.xxhash64(F.lit(i), *[F.get("own", at + j) for j, x in enumerate(m) if x == "1"])
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        full = lambda at: reduce(Column.__and__, [F.get("own", at + j).isNotNull() for j, x in enumerate(m) if x == "1"])
        return F.transform(F.filter(places, full), lambda at: F.struct((F.col("from") + at).alias("at"), hashed(at).alias("seed")))

    return chunks.select(*keep, F.explode(F.concat(*[of(i, m) for i, m in enumerate(MASKS)])).alias("s")).select(*keep, "s.*")


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose number ``key`` may be among ``wanted``'s, by two broadcast tables of at most SIEVE rows."""
    for shift in (0, 24):
        number = F.pmod(F.shiftright(F.col(key), shift), F.lit(SIEVE))
        rows = rows.join(F.broadcast(wanted.select(number.alias(f"__s{shift}")).distinct()), number == F.col(f"__s{shift}"), "left_semi")
    return rows


def met(sown: DataFrame, own: DataFrame) -> DataFrame:
    """Places of documents and items with the same seed. A phrase that many share meets in blocks of about 4,096 places by 256."""
    count = lambda of, n: of.groupBy("seed").agg(F.count(F.lit(1)).alias(n))
    both = count(sown, "n").join(count(own, "m"), "seed")
    both = written(both.withColumns({"across": F.ceil(F.col("n") / 4096), "down": F.ceil(F.col("m") / 256)}), "shared_seeds")
    block = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = share_join(sown, both.drop("m"), "seed", "n").select(*ROW, "at", "seed", F.pmod(F.xxhash64(*ROW, "at"), F.col("across")).alias("a"), block("down").alias("b"))
    right = share_join(own, both.drop("n"), "seed", "m").select("item", "item_at", "seed", block("across").alias("a"), F.pmod(F.xxhash64("item", "item_at"), F.col("down")).alias("b"))
    return left.join(right, ["seed", "a", "b"])


def codes(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


ROW = ["k1", "k2"]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(k1, k2, item, score, agreed, words): each document and item that share a seed, with the best score,
    the most words that agree side by side, and the item's count of words."""
    rows = docs.select(whole(F.col(id_col).cast("string")).alias("k1"), F.xxhash64(text_col).alias("k2"), whole(text_col).alias("text"))
    items = written(benchmark.select(F.col(item_col).alias("item"), codes(whole(item_text_col)).alias("codes")), "items")
    own = written(seeds(items, ["item"]).select("seed", "item", F.col("at").alias("item_at")), "item_seeds")
    bits = words_of(items)
    marked = rows.withColumn("codes", F.transform(tokens(F.col("text")), lambda x: F.when(known(F.xxhash64(x), bits), F.xxhash64(x))))
    found = met(written(sieved(seeds(marked, ROW), own, "seed"), "sown"), own)
    lain = written(found.select(*ROW, "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct(), "offsets")
    hit = sieved(rows, lain.select("k2"), "k2").join(lain.select(*ROW).distinct(), ROW, "left_semi").dropDuplicates(ROW).select(*ROW, codes(F.col("text")).alias("codes"))
    laid = lain.join(hit, ROW).join(items.select("item", F.col("codes").alias("words")), "item")
    start = F.greatest(F.col("offset"), F.lit(0))
    laid = laid.select(*ROW, "item", "words", "offset", F.slice("codes", start + 1, F.size("words")).alias("near"), (start - F.col("offset")).alias("skip"))
    agree = F.transform("words", lambda x, j: F.when(F.get(F.col("near"), F.when(j >= F.col("skip"), j - F.col("skip")).otherwise(F.lit(-1))) == x, 1).otherwise(-1))
    best = F.aggregate("agree", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, x: F.struct(F.greatest(a["now"] + x, F.lit(0)).alias("now"), F.greatest(a["best"], a["now"] + x).alias("best")))["best"]
    agreed = F.size(F.filter("agree", lambda x: x == 1))
    laid = laid.select(*ROW, "item", "words", agree.alias("agree")).select(*ROW, "item", best.alias("score"), agreed.alias("agreed"), F.size("words").alias("words"))
    return laid.groupBy(*ROW, "item").agg(*[F.max(c).alias(c) for c in ("score", "agreed", "words")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", enough: int = 12, least: int = 8, share: float = 0.45, agreeing: float | None = None) -> DataFrame:
    """One row per document: k1, k2 (the row's key), id, contaminated, n_items, best_score, items.

    A document is contaminated by an item if the best stretch of the two side by side scores at least
    ``enough``, or for short items ``share`` of the item's words but no less than ``least``; with
    ``agreeing``, also if so large a share of the item's words, and no fewer than ``least``, agree side
    by side: at 0.6, items of 11 words and more are found with every third word replaced. Items of
    fewer than ``least`` words, or shorter than the masks, are never found. best_score is that of all
    items with a seed in common (0: none), items the sorted ids of the contaminating ones. Null and
    empty texts are clean; so is everything if the benchmark is empty. Rows with the same id and text
    get the same result. Other columns are not read.
    """
    over = overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col)
    limit = F.least(F.lit(enough), F.greatest(F.ceil(F.col("words") * share).cast("int"), F.lit(least)))
    found = F.col("score") >= limit
    if agreeing is not None:
        found |= F.col("agreed") >= F.greatest(F.ceil(F.col("words") * agreeing).cast("int"), F.lit(least))
    bad = F.when(found, F.col("item"))
    each = over.groupBy(*ROW).agg(F.max("score").alias("best_score"), F.sort_array(F.collect_set(bad)).alias("items"))
    rows = docs.select(whole(F.col(id_col).cast("string")).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(id_col).alias("id"))
    joined = rows.join(each, ROW, "left")
    none = F.col("items").isNull()
    n = F.when(none, 0).otherwise(F.size("items")).cast("long")
    return joined.select(*ROW, "id", (n > 0).alias("contaminated"), n.alias("n_items"), F.coalesce("best_score", F.lit(0)).alias("best_score"), F.when(none, "").otherwise(F.concat_ws(",", F.col("items").cast("array<string>"))).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: object) -> DataFrame:
    """The input's rows, with its columns, that no item contaminates."""
    gone = decontaminate(docs, benchmark, id_col, text_col, **limits).where("contaminated").select("k1", "k2").distinct()
    return without_rows(docs, gone, id_col, text_col)
