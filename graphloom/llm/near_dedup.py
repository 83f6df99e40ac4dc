"""Near-duplicate detection: fast similarity sketching, banding and exact verification.

Equal sets are one node from the start, so exact copies never meet each other. A node's sketch
fills its coordinates in rounds of hashed placement; the bands of the sketch are its buckets.
In every bucket the best connected node leads, and each other node is verified against the
leader only. Links so found merge nodes; where a bucket still holds several components, its nodes
outside the largest one are verified against all others there, in blocks of bounded size. So no
pair of a bucket is lost, and none within one component is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, kept_in_worker, pieces, share_join, whole, without_rows, written
from .graph import components

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Each text's set of hashed word shingles, sorted. A-Z count as a-z; words are what lies between
    [\\x20\\x09-\\x0D]; a text with fewer words than ``size`` has its whole sequence as one shingle."""
    words = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]
    flat = [w for x in words for w in x]
    h = pd.util.hash_array(np.array(flat + [b""], object), categorize=False)[:-1]
    many = max(len(h) - size + 1, 0)
    joined = np.zeros(many, U)
    for j in range(size):
        joined = mix(joined * U(31) + h[j : j + many] + U(j + 1))
    out, at = [], 0
    for x in words:
        n = len(x)
        if n >= size:
            out.append(np.unique(joined[at : at + n - size + 1]))
        elif n:
            one = np.zeros(1, U)
            for j in range(n):
                one = mix(one * U(31) + h[at + j] + U(j + 1))
            out.append(mix(one + U(n)))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of ``t`` coordinates for each (non-empty) set.

    Round i places every element in one bin, by its hash of that round in the first ``t`` rounds and
    in bin i - t after; a bin keeps the smallest (round, hash). A set is done when no bin is empty,
    after 2t rounds at the latest. Equal coordinates estimate the Jaccard similarity.
    """
    empty = np.iinfo(np.uint64).max
    out = np.full((len(sets), t), empty, U)
    sizes = np.array([len(x) for x in sets])
    element, owner = np.concatenate([*sets, np.zeros(0, U)]), np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(element):
            break
        h = mix(element ^ mix(np.array([i + 1], U)))
        bins = (h >> U(32)).astype(np.int64) * t >> 32 if i < t else np.full(len(element), i - t)
        np.minimum.at(flat, owner * t + bins, (U(i) << U(32)) | (h & U(0xFFFFFFFF)))
        if i == 0 or i % 2 or len(element) < 100_000:
            open_ = (out == empty).any(1)
            keep = open_[owner]
            if not keep.all():
                element, owner = element[keep], owner[keep]
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """The buckets of each sketch: a hash of every ``rows`` coordinates and their place."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    out = np.broadcast_to(mix(np.arange(t // rows, dtype=U) + U(77)), (n, t // rows)).copy()
    for j in range(rows):
        out = mix(out * U(31) + parts[:, :, j])
    return out.view(np.int64)


def fingerprint(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def similar(n: np.ndarray | int, m: np.ndarray | int, both: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """100 * intersection >= percent * union."""
    return 100 * both >= percent * (n + m - both)


ROW = ["k1", "k2"]
BUCKETS = 1 << 20


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, __text): the rows with a key of their own, which needs no unique ids."""
    return docs.select(whole(F.col(id_col).cast("string")).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(id_col).alias("id"), F.col(text_col).alias("__text"))


def only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among ``wanted``'s: a first sieve by hash, broadcast as at most BUCKETS
    numbers however many are wanted, so that few others reach the shuffle of the exact join."""
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    return rows.join(F.broadcast(wanted.select(number(F.col(key)).alias("__n")).distinct()), number(F.col(key)) == F.col("__n"), "left_semi")


def nodes_of(docs: DataFrame, id_col: str, text_col: str, size: int, coordinates: int, rows: int) -> DataFrame:
    """(k1, k2, id, n, node, buckets), one row per document; node and buckets are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("near_dedup", object)
        for batch in batches:
            texts = [x or "" for x in batch.column("__text").to_pylist()]
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], size)
                full = [i for i, x in enumerate(sets) if len(x)]
                own: list = [None] * len(sets)
                if full:
                    for i, x in zip(full, bands(sketches([sets[i] for i in full], coordinates), rows), strict=True):
                        own[i] = x
                columns = [*(batch.column(c).slice(a, b - a) for c in ("k1", "k2", "id")), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) if len(x) else None for x in sets], pa.binary()), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "id", "n", "node", "buckets"])

    kind = dict(docs.dtypes)[id_col]
    return keyed(docs, id_col, text_col).mapInArrow(run, f"k1 string, k2 long, id {kind}, n long, node binary, buckets array<long>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """(node, items) for the ``wanted`` rows (k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], size)
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "items"])

    rows = only(keyed(docs, id_col, text_col), "k2", wanted).join(wanted.select(*ROW), ROW, "left_semi")
    return rows.select("__text").mapInArrow(run, "node binary, items array<long>").dropDuplicates(["node"])


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(U), column.offsets.to_numpy()
    return [flat[i - ends[0] : j - ends[0]] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def verified(rows: DataFrame, sets: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Links (a, b) among the rows of each group (g1, g2, g3): those of side 0, held in memory and
    of bounded number, against those of side 1, which stream past. Sides of one label, or of labels
    that links of the same group have joined already, are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, root = None, None, {}

        def top(x: bytes) -> bytes:
            while (y := root.get(x, x)) != x:
                x = y
            return x

        left: list[tuple[bytes, bytes, np.ndarray]] = []
        for batch in batches:
            a, b = [], []
            for g1, g2, g3, side, node, label, items in zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "g3", "side", "node", "label")), arrays(batch.column("items")), strict=True):
                if (g1, g2, g3) != group:
                    group, held, root, left = (g1, g2, g3), None, {}, []
                if side == 0:
                    left.append((node, label, items.copy()))
                    continue
                if not left:
                    continue
                if held is None:  # where each item stands among the left sets
                    every, owner = np.concatenate([x for _, _, x in left]), np.repeat(np.arange(len(left)), [len(x) for _, _, x in left])
                    order = np.argsort(every, kind="stable")
                    held = every[order], owner[order], np.array([len(x) for _, _, x in left])
                lo, hi = np.searchsorted(held[0], items), np.searchsorted(held[0], items, "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
                both = np.bincount(held[1][at], minlength=len(left))
                for i in np.flatnonzero(similar(held[2], len(items), both, percent)):
                    other, its, _ = left[i]
                    if other != node and (p := top(its)) != (q := top(label)):
                        root[q] = p
                        a.append(other)
                        b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    ready = rows.join(sets, "node").repartition(partitions, "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "side", "node")
    return ready.select("g1", "g2", "g3", "side", "node", "label", "items").mapInArrow(run, "a binary, b binary")


def chunk(key: str, many: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(5)), F.greatest(many, F.lit(1)))


def links_of(hits: DataFrame, sets: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(node, label) of all nodes that a chain of verified links joins to another; hits: (bucket, node, size)."""
    score = hits.groupBy("node").agg(F.sum("size").alias("score"))
    top = hits.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("top"), F.max("size").alias("n"))
    leaders = written(top.select("bucket", F.col("top.node").alias("leader"), "n"), "leaders")
    pairs = written(share_join(hits.select("bucket", "node"), leaders, "bucket", "n").where("node != leader").select("leader", "node").distinct(), "pairs")
    # a leader of very many is met by 256 of them at a time
    many = written(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).withColumn("many", F.ceil(F.col("n") / 256)), "many")
    right = share_join(pairs, many, "leader", "n").select(F.col("leader").alias("g1"), chunk("node", F.col("many")).alias("g2"), F.lit(0).cast("long").alias("g3"), F.lit(1).alias("side"), "node", F.col("node").alias("label"))
    left = many.select(F.col("leader").alias("g1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("g2"), F.lit(0).cast("long").alias("g3"), F.lit(0).alias("side"), F.col("leader").alias("node"), F.col("leader").alias("label"))
    first = components(verified(left.unionByName(right), sets, percent, partitions))
    # buckets with more than one component: all that isn't of the largest meets all others
    placed = written(hits.join(first, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "placed")
    parts = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64("node", F.lit(i)) % (1 << 40)).alias(f"mark{i}") for i in (1, 2)])
    mixed = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size"), F.sum("mark1").alias("mark1"), F.sum("mark2").alias("mark2"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
    # of buckets with the same nodes one is enough
    mixed = mixed.groupBy("size", "mark1", "mark2", "top").agg(F.min("bucket").alias("bucket")).select("bucket", "size", F.col("top.label").alias("main"), (F.col("size") - F.col("top.n")).alias("others"))
    mixed = written(mixed.withColumns({"lefts": F.ceil(F.col("others") / 256), "rights": F.ceil(F.col("size") / 1024)}), "mixed")
    if mixed.isEmpty():
        return first
    rest = share_join(placed, mixed, "bucket", "size").withColumn("aside", F.col("label") != F.col("main"))
    key = F.col("bucket").cast("string").cast("binary").alias("g1")
    blocks = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rest.where("aside").select(key, chunk("node", F.col("lefts")).alias("g2"), blocks("rights").alias("g3"), F.lit(0).alias("side"), "node", "label")
    right = rest.select(key, blocks("lefts").alias("g2"), chunk("node", F.col("rights")).alias("g3"), F.lit(1).alias("side"), "node", "label")
    more = written(verified(left.unionByName(right), sets, percent, partitions), "more_links")
    if more.isEmpty():
        return first
    of = lambda side: first.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    upper = components(joined.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    # what the second links touch, and what the first had joined to it
    named = first.unionByName(upper.select("node", F.col("node").alias("label")).join(first, "node", "left_anti"))
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    root = written(sizes.join(upper.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left"), "roots")
    return share_join(written(named, "named"), root, "label", "n").select("node", F.coalesce("root", "label").alias("label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, coordinates: int = 192, rows: int = 6) -> DataFrame:
    """(k1, k2, id, n, component_id, kept), one row per document; see near_dedup."""
    spark = docs.sparkSession
    arrow_batches(spark)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own = written(nodes_of(docs.select(id_col, text_col), id_col, text_col, size, coordinates, rows), "nodes")
    full = own.where("n > 0")
    # one row for each distinct set: its smallest id, and one of its rows
    groups = full.groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("k1", "k2")).alias("row"), F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "groups")
    exploded = groups.select("node", F.explode("buckets").alias("bucket"))
    shared = written(exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    hits = written(share_join(exploded, shared, "bucket", "size").select("node", "bucket", "size"), "hits")
    wanted = groups.join(hits.select("node").distinct(), "node", "left_semi").select("row.k1", "row.k2")
    sets = written(sets_of(docs.select(id_col, text_col), id_col, text_col, size, written(wanted, "wanted")), "sets")
    labels = written(links_of(hits, sets, percent, partitions), "components")
    lows = written(groups.select("node", "low").join(labels, "node"), "lows")
    lowest = written(lows.groupBy("label").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")), "lowest")
    found = share_join(lows, lowest, "label", "n").select("node", "component_id")
    named = groups.select("node", "low", "n").join(found, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"), F.col("n").alias("copies"))
    joined = share_join(full, written(named, "named"), "node", "copies").select("k1", "k2", "id", "n", "component_id")
    joined = joined.unionByName(own.where("n = 0").select("k1", "k2", "id", "n", F.col("id").alias("component_id")))
    component = F.col("component_id")
    return joined.select("k1", "k2", "id", "n", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, coordinates: int = 192, rows: int = 6) -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept.

    Documents whose shingle sets have 100 * intersection >= ``percent`` * union are linked;
    component_id is the smallest id that links reach, kept is whether that is the row's own. A pair at
    a similarity of 0.8 shares one of the 32 bands of 6 coordinates but for 6 in 100,000; what shares
    a band is decided on the full sets. Null and empty texts have no shingles and no links. A null id
    loses against any other; rows that repeat an id and a text stay or go together. Other columns are
    not read. An empty table gives no rows.
    """
    out = near_groups(docs, id_col, text_col, size, percent, coordinates, rows)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows that near_dedup keeps, with the input's columns."""
    gone = near_groups(docs, id_col, text_col, size, percent).where(~F.col("kept")).select("k1", "k2")
    return without_rows(docs, written(gone, "gone"), id_col, text_col)
