"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; then each record is a frame of its own,
compressed with that dictionary.  The dictionary is built from the payloads of
the archive's own records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.zdict import build_dictionary, load_dictionary
from loomwork.workspace import Workspace

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_TAG = 0x6C6F6F6D7761
_NULL_TAG = _TAG + 1
#: More payloads than this cannot each hold as large a share of the rows.
_HOT = 4096


def record_uuid(page_id: int | None) -> str:
    """A version-8 UUID that holds a page id (or none) reversibly."""
    n = 0 if page_id is None else page_id & (1 << 64) - 1
    tag = _NULL_TAG if page_id is None else _TAG
    return str(uuid.UUID(int=tag << 80 | 8 << 76 | (n >> 52) << 64 | 0b10 << 62 | n & (1 << 52) - 1))


def page_of(record_id: str) -> int | None:
    x = uuid.UUID(record_id.removeprefix("<urn:uuid:").removesuffix(">")).int
    if x >> 80 == _NULL_TAG:
        return None
    n = (x >> 64 & 0xFFF) << 52 | x & (1 << 52) - 1
    return n - (1 << 64) if n >> 63 else n


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no body but its payload's digest and length."""
    body = b"" if revisit else payload
    uri = "".join(c for c in (url or "urn:none") if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_uuid(page_id)}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_uuid(first)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def archive(records: list[bytes], dictionary_bytes: int, level: int) -> bytes:
    """The archive's bytes: a dictionary of its own records, then a frame a record.

    Few or small records get a smaller dictionary, or one that is raw content."""
    raw = build_dictionary(records, dictionary_bytes, 512)
    packed = zstandard.ZstdCompressor(level=level).compress(raw)
    zstd = zstandard.ZstdCompressor(level=level, dict_data=load_dictionary(raw), write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(zstd.compress, records)])


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order; frames may or may not give their size."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    zstd = zstandard.ZstdDecompressor(dict_data=load_dictionary(raw))
    rest = memoryview(data)[8 + n :]
    while len(rest):
        one = zstd.decompressobj()
        got = one.decompress(rest)
        yield got
        rest = rest[len(rest) - len(one.unused_data) :]


def write_archives(
    pages: DataFrame,
    work: Workspace,
    min_revisit_bytes: int = 0,
    archive_bytes: int = 8 << 20,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> DataFrame:
    """Write a record per row and return the archives (name, data, records), rows of a
    written table; ``files.put_out`` makes files of them.

    Input: page_id, url, html.  Rows with equal payloads (by SHA-256) of at least
    ``min_revisit_bytes``: that with the smallest page_id is the response, the
    others revisit it.  Archives hold about ``archive_bytes`` of payload; all of an
    archive's records go into its dictionary.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("key", F.sha2("payload", 256))
    ids = rows.select("page_id", "key", F.length("payload").cast("long").alias("n"))
    total, count = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    copies = work.save(
        ids.where(F.col("n") >= min_revisit_bytes)
        .groupBy("key")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
        .where("c > 1"),
        "copies",
    )
    # payloads of more than count / _HOT rows are fewer than _HOT, so their list is broadcast;
    # their rows match nothing in the second join and are spread there by page
    is_hot = F.col("c") * _HOT > count
    hot = F.broadcast(copies.where(is_hot).select(F.col("key").alias("hot"), F.col("first").alias("hot_first")))
    cold = copies.where(~is_hot).select(F.col("key").alias("cold"), F.col("first").alias("cold_first"))
    spread = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    marked = rows.join(hot, F.col("key") == F.col("hot"), "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("key")).otherwise(spread))
    marked = marked.join(cold, F.col("key") == F.col("cold"), "left").withColumn("first", F.coalesce("hot_first", "cold_first"))
    marked = marked.select("page_id", "url", "payload", "first", F.expr("first IS NOT NULL AND NOT page_id <=> first").alias("revisit"))
    parts = max(1, -(-(total + 512 * count) // (4 * archive_bytes)))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, size, part, seq = [], 0, TaskContext.get().partitionId(), 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({"name": [f"part-{part:07d}-{seq:05d}.warc.zst"], "data": [archive(own, dictionary_bytes, level)], "records": [len(own)]})

        for frame in frames:
            for page, url, payload, first, revisit in frame.itertuples(index=False):
                page, first = (None if x is None else int(x) for x in (page, first))
                own.append(record(page, url, payload, digest(payload), first, bool(revisit)))
                size += len(own[-1])
                if size >= archive_bytes:
                    yield close()
                    own, size, seq = [], 0, seq + 1
        if own:
            yield close()

    dealt = marked.repartition(parts, F.xxhash64("page_id", "url")).sortWithinPartitions("page_id", "url")
    # ids go as text, for a null among integers would turn the others into floats
    dealt = dealt.select(
        F.col("page_id").cast("string").alias("page_text"), "url", "payload", F.col("first").cast("string").alias("first_text"), "revisit"
    )
    return work.save(dealt.mapInPandas(write, "name string, data binary, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch["name"].to_pylist(), batch["data"], strict=True):
                rows = []
                for data in records_of(raw.as_py()):
                    fields, body = parse(data)
                    kind, sha1 = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(body) != sha1:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    first = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(fields["warc-record-id"]), int(fields["x-payload-length"]), sha1, kind, first))
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return archives.select("name", "data").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_archive(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives and read them back.

    One row per input row.  A null html is an empty payload; a null url is written
    as ``urn:none``; a null page_id stays null and is never the one referred to,
    unless it is alone.  Rows that repeat the smallest page_id of their copies are
    all responses.  An empty table gives an empty result.
    """
    return read_archives(write_archives(pages, Workspace(pages.sparkSession, "warc"), min_revisit_bytes))
