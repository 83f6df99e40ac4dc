"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a temporary folder serves a ``local[...]`` session only;
    a cluster without the setting is an error, as executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share_join(rows: DataFrame, side: DataFrame, key: str, n: str, how: str = "inner", heavy: int = 1024) -> DataFrame:
    """``rows`` joined to ``side``, which has one row for each ``key`` and in ``n`` how many of the rows have it.

    Keys with more than 1/heavy of all those rows, of which there are fewer than ``heavy``, are part of the
    plan and meet by a broadcast; the others by a shuffle, so that no key brings more than that share to one
    task. Both are read twice where there are such keys, so they should be written tables.
    """
    total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) * heavy > total
    keys = [r[0] for r in side.where(hot).select(key).collect()]
    if not keys:
        return rows.join(side, key, how)
    few = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return rows.where(few).join(F.broadcast(side.where(hot)), key).unionByName(rows.where(~few).join(side.where(~hot), key, how))


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in, as both agree there."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Bytes of an Arrow batch (a longer row stands alone). All operators have this one bound, so that a plan
#: runs under it whichever operator was called last; a session's own smaller bound stays.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, for executors with little memory."""
    now = re.match(r"(\d+)b?$", spark.conf.get(BATCH_CONF))
    if not now or int(now[1]) <= 0 or int(now[1]) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


_KEPT: dict[str, object] = {}


def kept_in_worker(key: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from one task to the next. Workers live on and serve other operators'
    tasks too: one operator's things are kept at a time, those of the one before go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]  # type: ignore[return-value]


def of_texts(run: Callable[[Iterator[list[str]]], Iterator[pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column of type ``kind`` from a text column (null: empty), by a function from lists of texts to
    arrays of as many values in all.

    Only the texts go to Python; the rows' other columns stay in the JVM. The function is marked so that
    the optimiser never copies it into a filter above, where it would run twice.
    """

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run([x or "" for x in batch.to_pylist()] for batch in batches)
        pa.default_memory_pool().release_unused()

    each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, returnType=kind).asNondeterministic()


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The input's rows, with its columns, whose key (k1: the id as text, k2: the text's hash) isn't in ``gone``."""
    a, b = unused(docs, "__k1"), unused(docs, "__k2")
    rows = docs.withColumns({a: whole(F.col(f"`{id_col}`").cast("string")), b: F.xxhash64(F.col(f"`{text_col}`"))})
    return rows.join(gone.select(F.col("k1").alias(a), F.col("k2").alias(b)), [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def with_last(docs: DataFrame, **columns: Column) -> DataFrame:
    """The input's columns and new ones after them; columns of the same names are replaced."""
    fresh = {x.lower() for x in columns}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in fresh], *[x.alias(c) for c, x in columns.items()])


def unused(docs: DataFrame, name: str) -> str:
    """The name, or one like it that no column of ``docs`` has."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def pieces(texts: list[str], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's texts that hold about ``most_chars`` together; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most_chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)
