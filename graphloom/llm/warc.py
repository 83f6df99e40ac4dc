"""Web archives in Zstandard: a dictionary in a leading skippable frame, then one frame a record.

The writer decides by a small shuffle of digests which pages repeat another's payload and writes
those as revisits; the reader streams each archive frame by frame and checks every record's
version, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, share_join, shared_folder, whole, written

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PAGE, NO_PAGE = "urn:page:", "urn:nopage"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str | None) -> str:
    """A page's id, whatever its text, as a name without blanks and brackets; that of a page without id is NO_PAGE."""
    return NO_PAGE if page is None else PAGE + quote(page, safe="")


def page_of(fields: dict, key: str) -> str | None:
    """The id that record_id made a name of."""
    name = fields.get(key, "")[1:-1]
    return unquote(name.removeprefix(PAGE)) if name.startswith(PAGE) else None


def record(page: str | None, url: str, payload: bytes, refers: str | None, date: str) -> bytes:
    """A response, or if ``refers`` is given a revisit, whose block is the response's head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers is not None else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "urn:none"
    fields = {"WARC-Type": "revisit" if refers is not None else "response", "WARC-Record-ID": f"<{record_id(page)}>", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http;msgtype=response"}
    if refers is not None:
        fields |= {"WARC-Refers-To": f"<{record_id(refers)}>", "WARC-Profile": PROFILE}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return text.encode() + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes], size: int = 32_768) -> bytes:
    """A trained dictionary, or where samples are too few or too alike to train one, their own end."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) + b'<!DOCTYPE html><html><head><meta charset="utf-8"><title></title></head><body><p></p></body></html>')[-size:]


def archive_head(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def read_dictionary(source: BinaryIO) -> zstandard.ZstdCompressionDict:
    """From the leading skippable frame; its content may itself be compressed."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    data = source.read(size)
    if len(data) != size:
        raise ValueError("the dictionary frame is cut short")
    if data[:4] == struct.pack("<I", FRAME_MAGIC):
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def frames(source: BinaryIO, dictionary: zstandard.ZstdCompressionDict, chunk: int = 1 << 17) -> Iterator[bytes]:
    """The content of one frame after another; a frame that ends early is an error."""
    decoder, rest = zstandard.ZstdDecompressor(dict_data=dictionary), b""
    while rest or (rest := source.read(chunk)):
        one, out = decoder.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := source.read(chunk)):
                raise ValueError("the last frame is cut short")
        yield b"".join(out)


def parsed(data: bytes) -> dict:
    """A record's fields and, under "problem", the first rule that it breaks (or None)."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("Content-Length", "")
    block = rest[: int(size)] if size.isdecimal() else b""
    http, split, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length: *(\d+)", http)
    out = {"fields": fields, "payload": payload, "payload_bytes": int(length[1]) if length else None}
    missing = [x for x in REQUIRED if not fields.get(x)]
    revisit = fields.get("WARC-Type") == "revisit"
    rules = (
        ("version", found and re.fullmatch(r"WARC/1\.[01]", lines[0])),
        (f"missing {', '.join(missing)}", not missing),
        ("content length", size.isdecimal() and len(rest) == int(size) + 4 and rest.endswith(b"\r\n\r\n")),
        ("record id", re.fullmatch(r"<[^<>\s]+>", fields.get("WARC-Record-ID", ""))),
        ("date", re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", fields.get("WARC-Date", ""))),
        ("block digest", fields.get("WARC-Block-Digest") in (None, f"sha1:{base32_sha1(block)}")),
        ("http head", split and length),
        ("payload length", revisit or length and len(payload) == int(length[1])),
        ("payload digest", revisit or fields.get("WARC-Payload-Digest") in (None, f"sha1:{base32_sha1(payload)}")),
        ("refers to nothing", not revisit or fields.get("WARC-Refers-To")),
    )
    return out | {"problem": next((name for name, ok in rules if not ok), None)}


def write_warc(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2026-01-01T00:00:00Z", archive_bytes: int = 64_000_000, sample_rows: int = 400, sample_chars: int = 20_000) -> DataFrame:
    """Writes archives into the shared folder and returns their manifest (path, records).

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is
    a response and the others revisit it; a null html is an empty payload. Rows that repeat the
    smallest id are responses too, and so is a row without an id. The dictionary is trained on
    ``sample_chars`` of ``sample_rows`` pages (a bound, for compression only). Ids are whole numbers or
    strings; other types are refused. An archive is named after the attempt
    that wrote it, and only the manifest's count, so a repeated task does no harm. An empty table
    gives an empty manifest.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    folder = f"{shared_folder(spark)}/warc"
    if dict(pages.dtypes)[id_col] not in ("string", "tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be a whole number or a string")
    rows = pages.select(F.col(id_col).alias("page"), whole(url_col).alias("url"), whole(html_col).alias("html"))
    digest = F.sha1("html").alias("digest")
    seen = written(rows.where(F.octet_length("html") >= min_bytes).select("page", digest), "digests")
    first = written(seen.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "first")
    # only the repeats, each once, meet the pages
    repeats = share_join(seen, first, "digest", "n").where(F.col("page") != F.col("first")).groupBy("page", "digest").agg(F.min("first").alias("refers"))
    samples = [x.html.encode() for x in rows.select(F.substring("html", 1, sample_chars).alias("html")).limit(sample_rows).collect()]
    dictionary = spark.sparkContext.broadcast(dictionary_of(samples))
    planned = rows.withColumn("digest", digest).join(repeats, ["page", "digest"], "left").select(F.col("page").cast("string"), "url", "html", F.col("refers").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary.value))
        context, made, out, size, names, counts = TaskContext.get(), 0, None, 0, [], []
        for batch in batches:
            for page, url, html, refers in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if out is None:
                    names.append(f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst")
                    counts.append(0)
                    out, size, made = store.open_output_stream(names[-1]), 0, made + 1
                    out.write(archive_head(dictionary.value))
                data = packer.compress(record(page, url, html.encode(), refers, date))
                out.write(data)
                counts[-1] += 1
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    manifest = planned.mapInArrow(run, "path string, records long").withColumn("folder", F.lit(folder))
    return written(manifest, "manifest")


RECORDS = "page_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary, problem string"


def read_warc(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of the archives of a manifest (path, records, folder), one row each; ids are of ``id_type``.

    payload is the response's content, null for a revisit; payload_bytes is what the HTTP head
    says, payload_digest the bare base32 SHA-1. "problem" names the first rule that a record
    breaks, null for a sound one; an archive that lacks its dictionary, is cut short or holds
    another number of records than the manifest says fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, records, folder in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                got, rows, held = 0, [], 0
                with store.open_input_stream(path) as source:
                    for data in frames(source, read_dictionary(source)):
                        r = parsed(data)
                        f = r["fields"]
                        revisit = f.get("WARC-Type") == "revisit"
                        rows.append((page_of(f, "WARC-Record-ID"), f.get("WARC-Type"), page_of(f, "WARC-Refers-To"), f.get("WARC-Target-URI"), r["payload_bytes"], f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), None if revisit else r["payload"], r["problem"]))
                        got += 1
                        held += len(data)
                        if held > 4_000_000:
                            yield as_batch(rows)
                            rows, held = [], 0
                if got != records:
                    raise ValueError(f"{path} holds {got} records instead of {records}")
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    dealt = manifest.select("path", "records", "folder").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return dealt.mapInArrow(run, RECORDS).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
