"""Retrieval: an inverted index and BM25, exact vector search, fusion, reranking, mentions, metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import tokenize
from ..functions.vector import dot

K1, B = 1.2, 0.75


def inverted_index(docs: DataFrame, uid: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """(uid, term, tf, dl) of all terms of the fields together, and (uid, dl) of all documents, empty ones too.

    Texts are read and cut into terms once, which are written. A caller that searches often writes the
    postings as well; a query then only joins its terms with them."""
    terms = tokenize(F.concat_ws(" ", *fields))
    own = cut(docs.select(F.col(uid).alias("uid"), terms.alias("terms")).withColumn("dl", F.size("terms").cast("long")))
    postings = own.select("uid", "dl", F.explode("terms").alias("term")).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    return postings, own.select("uid", "dl")


def contributions(postings: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, uid, term, tf, idf, tf_norm, score) for queries (query_id, text); a term that a query
    repeats counts as often."""
    wanted = queries.select("query_id", F.explode(tokenize("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = postings.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = hits.join(df, "term").crossJoin(F.broadcast(corpus)).join(wanted, "term")
    return rows.select("query_id", "uid", "term", "tf", idf.alias("idf"), tf.alias("tf_norm"), (F.col("times") * idf * tf).alias("score"))


def ranked(rows: DataFrame, by: str, limit: int | None, *group: str) -> DataFrame:
    """The best ``limit`` rows (None: all) of each group with their rank from 1; equals go by uid. Scores
    that only a sum's order of adding may tell apart are equal."""
    order = [F.round(by, 9).desc(), F.col("uid")]
    all_ = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return all_ if limit is None else all_.where(F.col("rank") <= limit)


def bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame, limit: int | None = 20) -> DataFrame:
    """(query_id, uid, score, rank) of the best documents of each query, of all that match if limit is None."""
    scored = contributions(postings, lengths, queries).groupBy("query_id", "uid").agg(F.sum("score").alias("score")).where("score > 0")
    return ranked(scored, "score", limit, "query_id")


def knn(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, uid, score, rank) by cosine of unit vectors: vectors (uid, vector) against a stated set of
    queries (query_id, vector), which is broadcast. Zero vectors (nothing embedded) never match."""
    some = vectors.where(F.exists("vector", lambda x: x != 0))
    pairs = some.crossJoin(F.broadcast(queries.select("query_id", F.col("vector").alias("q"))))
    return ranked(pairs.select("query_id", "uid", dot("vector", "q").alias("score")), "score", limit, "query_id")


def rrf(first: DataFrame, second: DataFrame, k: float = 60.0, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query_id, uid, score, rank): the sum of 1 / (k + rank)."""
    side = lambda df, name: df.select("query_id", "uid", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    both = side(first, "first").join(side(second, "second"), ["query_id", "uid"], "full")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return ranked(both.withColumn("score", part("first_rank") + part("second_rank")), "score", limit, "query_id")


def rerank(results: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], text: str = "text", query: str = "query") -> DataFrame:
    """Adds rerank_score by a scorer over batches of rows; the fused score stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(rerank_score=scorer(batch).astype(float))

    schema = ", ".join(f"`{n}` {t}" for n, t in results.dtypes) + ", rerank_score double"
    return results.mapInPandas(run, schema)


def lexical_score(query: Column, text: Column) -> Column:
    """The share of a query's distinct terms that a text has: a scorer without a model."""
    q = F.array_distinct(tokenize(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokenize(text))) / F.size(q))


def attached_edges(results: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(uid, direction, kind, other): edges of the results (uid) with the other end's name."""
    names = symbols.select(F.col("uid").alias("other_uid"), F.col("name").alias("other"))
    own = results.select("uid").distinct()
    ends = F.explode(F.array(F.struct(F.col("source_uid").alias("uid"), F.lit("out").alias("direction"), F.col("target_uid").alias("other_uid")), F.struct(F.col("target_uid").alias("uid"), F.lit("in").alias("direction"), F.col("source_uid").alias("other_uid"))))
    return edges.select("kind", ends.alias("e")).select("kind", "e.*").join(own, "uid", "left_semi").join(names, "other_uid").select("uid", "direction", "kind", "other")


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, at, mean): the mean vector of each label, by place."""
    return vectors.select(label, F.posexplode("vector").alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pca_2d(vectors: DataFrame) -> DataFrame:
    """(uid, x, y): the first two principal components, each scaled to [-1, 1]; the largest load is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("uid", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(v)
    sign = [1.0 if max(c, key=abs) > 0 else -1.0 for c in model.pc.toArray().T]
    p = model.transform(v).select("uid", vector_to_array("p").alias("p")).select("uid", *[(F.col("p")[i] * sign[i]).alias(n) for i, n in enumerate("xy")])
    ends = p.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise(2 * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) - 1).alias(c) for c in "xy"]
    return p.crossJoin(F.broadcast(ends)).select("uid", *scaled)


def mentions(content: DataFrame, names: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(uid, target, n, lines): names (uid, name) that stand as words in content (uid, text), case as it is.
    Names must look like identifiers: three characters and more, with "_", a digit, mixed case or all capitals."""
    c = F.col("name")
    looks = (F.length(c) >= 3) & (c.contains("_") | c.rlike(r"\d") | c.rlike(r"^[A-Z]{3,}$") | (c.rlike("[a-z]") & c.rlike(r"^.+[A-Z]")))
    known = names.where(looks & ~c.isin(*skip) if skip else looks).select(F.col("uid").alias("target"), "name")
    words = content.select("uid", F.posexplode(F.split("text", "\n")).alias("line", "row")).select("uid", "line", F.explode(F.split("row", r"[^\p{L}\p{N}_]+")).alias("name"))
    hits = words.join(known, "name").where("uid <> target")
    return hits.groupBy("uid", "target").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set(F.col("line") + 1)), lambda x: x.cast("string")), ",").alias("lines"))


def retrieval_metrics(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(recall_at_k..., mrr) over all queries of ``relevant`` (query_id, uid); ranking: (query_id, uid, rank)."""
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hits = ranking.join(relevant, ["query_id", "uid"]).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.min("rank").alias("first"))
    each = total.join(hits, "query_id", "left")
    return each.agg(*[F.round(F.avg(F.coalesce(f"h{k}", F.lit(0)) / F.col("total")), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def golden_set(rankings: DataFrame, relevant: DataFrame, modes: tuple[str, ...], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(mode, intent, queries, recall_at_k..., mrr): rankings (mode, query_id, uid, rank) of the ways to search,
    by the intent of the queries of ``relevant`` (query_id, intent, uid). A query without a hit counts as 0."""
    total = relevant.groupBy("query_id", "intent").agg(F.count_distinct("uid").alias("total"))
    asked = total.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    hits = rankings.join(relevant.select("query_id", "uid").distinct(), ["query_id", "uid"]).groupBy("mode", "query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.min("rank").alias("first"))
    each = asked.join(hits, ["mode", "query_id"], "left")
    return each.groupBy("mode", "intent").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(F.coalesce(f"h{k}", F.lit(0)) / F.col("total")), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
