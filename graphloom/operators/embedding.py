"""Embeddings without a model: a hashing encoder, whose vectors they are, neighbours, an inverted-file index, matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import tokenize
from ..functions.vector import dot, normalised
from .retrieval import knn, ranked


@dataclass(frozen=True)
class Encoder:
    """What made a table's vectors; vectors of different encoders can't be compared."""

    provider: str = "hashing"
    model: str = "terms"
    dims: int = 256

    @property
    def identity(self) -> str:
        return f"{self.provider}/{self.model}/{self.dims}"


def encode(text: Column | str, dims: int = 256) -> Column:
    """A unit vector of a text: each term adds 1 or -1 (by its hash) at a place of its hash; no term, a zero vector."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends = np.asarray(batch.offsets) - batch.offsets[0].as_py()
            terms = batch.flatten().to_numpy(zero_copy_only=False)
            h = pd.util.hash_array(np.concatenate([terms, [""]]).astype(object), categorize=False)[:-1]
            out = np.zeros((len(batch), dims), np.float32)
            owner = np.repeat(np.arange(len(batch)), np.diff(ends))
            np.add.at(out, (owner, (h % np.uint64(dims)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dims, pa.int32()), pa.array(out.ravel()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType="array<float>")(F.coalesce(tokenize(text), F.array().cast("array<string>")))


def embedded(docs: DataFrame, uid: str, text: str, encoder: Encoder = Encoder()) -> DataFrame:
    """(uid, vector, identity) of every row; a text without terms has a null vector."""
    v = docs.select(F.col(uid).alias("uid"), encode(text, encoder.dims).alias("vector"))
    return v.select("uid", known_vector(F.col("vector")).alias("vector"), F.lit(encoder.identity).alias("identity"))


def known_vector(vector: Column) -> Column:
    """Null for a zero vector, which stands for nothing embedded."""
    return F.when(F.exists(vector, lambda x: x != 0), vector)


def same_identity(old: DataFrame, new: DataFrame) -> None:
    """An error where tables of vectors (identity) were made by different encoders."""
    found = [r[0] for r in old.select("identity").union(new.select("identity")).distinct().orderBy("identity").limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors of different encoders: {', '.join(map(str, found))}; embed everything anew")


def neighbours(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, uid, score, rank): the nearest of (uid, vector) to a stated set of their own (query_id, vector), without itself."""
    near = knn(vectors, queries, limit + 1).where("query_id <> uid").drop("rank")
    return ranked(near, "score", limit, "query_id")


def ivf_index(vectors: DataFrame, lists: int | None = None, most_sample: int = 20_000, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Every row of (uid, vector) with the number of its list, written by list, and the lists' centres.

    Centres come from k-means on a sample of at most about ``most_sample`` rows; the root of the number of
    rows, from 4 to 256, says how many. Null and zero vectors are in no list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = vectors.select("uid", normalised("vector").alias("vector")).where(F.exists("vector", lambda x: x != 0))
    n = some.count()
    lists = lists or max(4, min(256, int(n**0.5)))
    part = some.sample(min(1.0, most_sample / n), seed) if n > most_sample else some
    sample = part.select(array_to_vector("vector").alias("features"))
    centres = np.array(KMeans(k=min(lists, max(n, 2)), seed=seed, maxIter=15, initMode="random").fit(sample).clusterCenters(), np.float64) if n > 1 else np.zeros((1, 1))
    index = some.withColumn("list", nearest(centres, 1)(F.col("vector"))[0])
    return cut(index.repartition("list").sortWithinPartitions("list")), centres


def nearest(centres: np.ndarray, most: int) -> object:
    """The numbers of the ``most`` centres next to a vector, the nearest first."""

    def run(batch: pa.Array) -> pa.Array:
        if centres.shape[1] == 1 or not len(batch):
            return pa.array([[0]] * len(batch), pa.list_(pa.int32()))
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argsort(1, kind="stable")[:, :most].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="array<int>")


def enough_probes(index: DataFrame, centres: np.ndarray, recall: float = 0.97, limit: int = 10, most_queries: int = 64, seed: int = 2) -> int:
    """The fewest lists to look into so that ``most_queries`` rows of the index, as queries, find that share of
    the ``limit`` nearest that a scan of all rows finds."""
    asked = cut(index.select(F.col("uid").alias("query_id"), "vector").orderBy(F.xxhash64("uid", F.lit(seed)), "uid").limit(most_queries))
    order = asked.select("query_id", F.posexplode(nearest(centres, len(centres))(F.col("vector"))).alias("place", "list"))
    wanted = knn(index, asked, limit).select("query_id", "uid").join(index.select("uid", "list"), "uid").join(order, ["query_id", "list"])
    counts = {r["place"]: r["count"] for r in wanted.groupBy("place").count().collect()}
    total, found = sum(counts.values()), 0
    for place in sorted(counts):
        found += counts[place]
        if found >= recall * total:
            return place + 1
    return len(centres)


def ivf_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, limit: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, uid, score, rank) among the rows of each query's nearest ``probes`` lists (a quarter of all by default)."""
    probes = probes or max(1, -(-len(centres) // 4))
    asked = queries.select("query_id", normalised("vector").alias("q")).where(F.exists("q", lambda x: x != 0))
    asked = asked.select("query_id", "q", F.explode(nearest(centres, probes)(F.col("q"))).alias("list"))
    return ranked(index.join(asked, "list").select("query_id", "uid", dot("vector", "q").alias("score")), "score", limit, "query_id")


def matched(source: DataFrame, target: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(source_uid, target_uid, score, way): one-to-one matches of two slices (uid, name, vector).

    Equal names match first (each name's first uids); then, among the rest, the most similar pair of a
    source and a target at ``threshold`` or above, again and again: in each round all pairs that are the
    best of both their ends match, so the rounds are few."""
    one = lambda df, end: df.groupBy("name").agg(F.min("uid").alias(f"{end}_uid"))
    found = one(source, "source").join(one(target, "target"), "name").select("source_uid", "target_uid", F.lit(1.0).alias("score"), F.lit("name").alias("way"))
    found = cut(found)
    free = lambda df, end: df.join(found.select(F.col(f"{end}_uid").alias("uid")), "uid", "left_anti").select(F.col("uid").alias(f"{end}_uid"), F.col("vector").alias(f"{end}_vector"))
    pairs = free(source, "source").join(free(target, "target"), dot("source_vector", "target_vector") >= threshold)
    pairs = cut(pairs.select("source_uid", "target_uid", F.round(dot("source_vector", "target_vector"), 9).alias("score")))
    while not pairs.isEmpty():
        best = lambda end, other: pairs.groupBy(end).agg(F.min(F.struct(-F.col("score"), other)).alias("b")).select(end, F.col(f"b.{other}").alias(other))
        both = cut(best("source_uid", "target_uid").join(best("target_uid", "source_uid"), ["source_uid", "target_uid"]))
        if both.isEmpty():  # ties in a circle: the first pair of all
            both = cut(pairs.orderBy(F.desc("score"), "source_uid", "target_uid").select("source_uid", "target_uid").limit(1))
        found = found.unionByName(cut(pairs.join(both, ["source_uid", "target_uid"]).withColumn("way", F.lit("vector"))))
        for end in ("source_uid", "target_uid"):
            pairs = pairs.join(both.select(end), end, "left_anti")
        pairs = cut(pairs)
    return found
