"""Packs documents' token ids into rows of a fixed width: best fit, longest first.

A document longer than a row is cut into whole rows and a rest, so no token is lost. Each task
packs blocks of bounded size: items go by falling length into the open row with the least room
that still holds them, found in a segment tree over capacities. Blocks are independent, so
nothing is shuffled; the price is at most a few rows with room left at the end of each block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, kept_in_worker, pieces, shared_folder


#: Types of document ids.
_ID = {"bigint": pa.int64(), "string": pa.string()}


class CapacityTree:
    """Counts of open rows by the room they have left; finds the least room of at least a size."""

    def __init__(self, most: int) -> None:
        self.n = 1 << most.bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, room: int, by: int) -> None:
        i = room + self.n
        while i:
            self.count[i] += by
            i >>= 1

    def best(self, size: int) -> int:
        """The least room of at least ``size`` that a row has, or -1."""
        count, i = self.count, size + self.n
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.n:
                    i *= 2
                    if not count[i]:
                        i += 1
                return i - self.n
            i >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of item numbers; every item is placed. Equal sizes go in their given order, and among
    rows with equal room the one that got it last is taken."""
    tree, rows = CapacityTree(width), []
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.best(sizes[i])
        if room < 0:
            row, room = len(rows), width
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if left := room - sizes[i]:
            by_room.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def segments(n: int, width: int) -> list[tuple[int, int]]:
    """A document's cuts: whole rows, then the rest."""
    return [(i, min(i + width, n)) for i in range(0, n, width)]


@dataclass(frozen=True)
class RankTokenizer:
    """Byte-level merge ranks from a file, loaded once on the driver."""

    ranks: dict[bytes, int]
    pattern: str
    end: int
    key: str

    @staticmethod
    def load(path: str, pattern: str) -> RankTokenizer:
        raw = open(path, "rb").read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        return RankTokenizer(ranks, pattern, len(ranks), hashlib.sha256(raw + pattern.encode()).hexdigest())


def _encoding(t: RankTokenizer) -> tiktoken.Encoding:
    return kept_in_worker(f"packing {t.key}", lambda: tiktoken.Encoding("own", pat_str=t.pattern, mergeable_ranks=t.ranks, special_tokens={}))


SCHEMA = "block string, row long, n_tokens int, doc_ids array<{id}>, doc_starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def packed_block(name: str, ids: list[np.ndarray], docs: list, width: int, end: int, kind: str = "bigint") -> pa.RecordBatch:
    """Packs one block of documents; empty places hold the end id, at positions of their own from 0."""
    items = [(d, a, b) for d, own in enumerate(ids) for a, b in segments(len(own), width)]
    rows = best_fit_decreasing([b - a for _, a, b in items], width)
    matrix, places = np.full((len(rows), width), end, np.uint16 if end < 1 << 16 else np.uint32), np.zeros((len(rows), width), np.int32)
    lengths, held, starts, used = [], [], [], []
    for r, row in enumerate(rows):
        at, cuts = 0, [0]
        for i in row:
            d, a, b = items[i]
            matrix[r, at : at + b - a] = ids[d][a:b]
            places[r, at : at + b - a] = np.arange(b - a)
            at += b - a
            cuts.append(at)
        places[r, at:] = np.arange(width - at)
        lengths.append(cuts)
        held.append([docs[items[i][0]] for i in row])
        starts.append([items[i][1] for i in row])
        used.append(at)
    columns = [pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(used, pa.int32()), pa.array(held, pa.list_(_ID[kind])), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([x.tobytes() for x in places], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "row", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "input_ids", "position_ids"])


def pack(docs: DataFrame, tokenizer: RankTokenizer, width: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 4_000_000) -> DataFrame:
    """One row per packed row: block, row, n_tokens, doc_ids and doc_starts (of each segment:
    its document and the place of its first token there), cu_seqlens (0, then the running ends),
    input_ids (``width`` unsigned little-endian numbers, 16 bits if the vocabulary allows, else 32;
    the end id fills what is left) and position_ids (32 bits, from 0 anew in each segment).

    Every document ends with the end id, so a null or empty text is that one token. Rows that
    repeat are packed each; a null id stays null. Ids are strings, or else whole numbers. Other columns are not read. Blocks hold
    ``block_tokens`` tokens or one document, which bounds memory. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, made = _encoding(shared.value), shared.value.end, 0
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list = []
        held = 0
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            numbers = batch.column(0).to_pylist()
            for a, b in pieces(texts):
                for n, x in zip(numbers[a:b], own.encode_ordinary_batch(texts[a:b], num_threads=1), strict=True):
                    x.append(end)
                    ids.append(np.array(x, np.uint32))
                    names.append(n)
                    held += len(x)
                    if held >= block_tokens:
                        yield packed_block(f"{part:06d}-{made:05d}", ids, names, width, end, kind)
                        ids, names, held, made = [], [], 0, made + 1
        if ids:
            yield packed_block(f"{part:06d}-{made:05d}", ids, names, width, end, kind)

    return docs.select(F.col(id_col).cast(kind), text_col).mapInArrow(run, SCHEMA.format(id=kind))


def _place(width: int) -> type:
    """Positions in files have 16 bits where all of a row's fit."""
    return np.uint16 if width <= 1 << 16 else np.int32


def write_packed(packed: DataFrame, folder: str | None = None) -> str:
    """Writes the packed rows as files of each block, side by side below ``folder`` (a shared one
    by default): ids.bin and positions.bin (matrices; positions of 16 bits up to a width of 65,536, else 32), cu_seqlens.bin (32 bits each, row after row),
    rows.bin (the number of cu_seqlens entries of each row) and docs.bin (of each row: its number in
    its block, then its segments' starts and document ids, 64 bits each, or for ids that are strings
    their lengths in bytes and after them the bytes, then a byte each, 1 for an id that isn't null; then the length of the block's name, 32 bits, and the name). Returns the folder.

    Blocks are written again whole if a task is repeated, under a name of that attempt; the
    manifest in ``folder``/manifest lists those that count.
    """
    folder = folder or shared_folder(packed.sparkSession)
    text = dict(packed.dtypes)["doc_ids"] == "array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        store.create_dir(name, recursive=True)
        rows = 0
        with store.open_output_stream(f"{name}/ids.bin") as ids, store.open_output_stream(f"{name}/positions.bin") as places, store.open_output_stream(f"{name}/cu_seqlens.bin") as cuts, store.open_output_stream(f"{name}/rows.bin") as sizes, store.open_output_stream(f"{name}/docs.bin") as held:
            for batch in batches:
                for a, b, c, block, row, docs, starts in zip(*(batch.column(x).to_pylist() for x in ("input_ids", "position_ids", "cu_seqlens", "block", "row", "doc_ids", "doc_starts")), strict=True):
                    ids.write(a)
                    one = np.frombuffer(b, np.int32)
                    places.write(one.astype(_place(len(one))).tobytes())
                    cuts.write(np.array(c, np.int32).tobytes())
                    sizes.write(np.array([len(c)], np.int32).tobytes())
                    names = [x.encode() for x in docs if isinstance(x, str)]
                    numbers = [len((x or "").encode()) for x in docs] if text else [x or 0 for x in docs]
                    held.write(np.array([row, *starts, *numbers], np.int64).tobytes() + b"".join(names) + bytes(x is not None for x in docs))
                    held.write(np.array([len(block.encode())], np.int32).tobytes() + block.encode())
                    rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([rows], pa.int64())], ["part", "rows"])

    packed.mapInArrow(run, "part string, rows long").write.parquet(f"{folder}/manifest")
    return folder


def read_packed(spark: SparkSession, folder: str, width: int, id_bytes: int = 2) -> DataFrame:
    """(part, row, ids, positions, cu_seqlens) of files that write_packed wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = {x: store.open_input_stream(f"{root}/{part}/{x}.bin") for x in ("ids", "positions", "cu_seqlens", "rows")}
                for row in range(rows):
                    n = int(np.frombuffer(read["rows"].read(4), np.int32)[0])
                    ids = np.frombuffer(read["ids"].read(width * id_bytes), np.uint16 if id_bytes == 2 else np.uint32).astype(np.int32)
                    one = [[part], [row], [ids], [np.frombuffer(read["positions"].read(width * np.dtype(_place(width)).itemsize), _place(width)).astype(np.int32)], [np.frombuffer(read["cu_seqlens"].read(4 * n), np.int32)]]
                    kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], ["part", "row", "ids", "positions", "cu_seqlens"])

    return spark.read.parquet(f"{folder}/manifest").mapInArrow(run, "part string, row long, ids array<int>, positions array<int>, cu_seqlens array<int>")


def read_packed_rows(spark: SparkSession, folder: str, width: int, id_bytes: int = 2, batch_rows: int = 64, id_type: str = "bigint") -> DataFrame:
    """The rows of pack(), with all its columns (document ids of ``id_type``, bigint or string), from files that write_packed wrote; a file that ends early is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = {"block": pa.string(), "row": pa.int64(), "n_tokens": pa.int32(), "doc_ids": pa.list_(_ID[id_type]), "doc_starts": pa.list_(pa.int64()), "cu_seqlens": pa.list_(pa.int32()), "input_ids": pa.binary(), "position_ids": pa.binary()}
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = {x: store.open_input_stream(f"{root}/{part}/{x}.bin", buffer_size=1 << 20) for x in ("ids", "positions", "cu_seqlens", "rows", "docs")}

                def take(name: str, size: int, read: dict = read, part: str = part) -> bytes:
                    data = read[name].read(size)
                    if len(data) != size:
                        raise ValueError(f"{part}/{name}.bin is cut short")
                    return data

                rows = []
                for _ in range(n):
                    m = int(np.frombuffer(take("rows", 4), np.int32)[0])
                    cuts = np.frombuffer(take("cu_seqlens", 4 * m), np.int32)
                    row, *held = np.frombuffer(take("docs", 8 * (2 * m - 1)), np.int64).tolist()
                    names = [take("docs", x).decode() for x in held[m - 1 :]] if id_type == "string" else held[m - 1 :]
                    docs = [x if there else None for x, there in zip(names, take("docs", m - 1), strict=True)]
                    block = take("docs", int(np.frombuffer(take("docs", 4), np.int32)[0])).decode()
                    rows.append((block, row, int(cuts[-1]), docs, held[: m - 1], cuts, take("ids", width * id_bytes), np.frombuffer(take("positions", width * np.dtype(_place(width)).itemsize), _place(width)).astype(np.int32).tobytes()))
                    if len(rows) == batch_rows:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return spark.read.parquet(f"{folder}/manifest").mapInArrow(run, SCHEMA.format(id=id_type))
