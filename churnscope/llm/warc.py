"""WARC: dictionary-compressed writer and reader.

``write_warc`` stores one record per row in ``.warc.zst`` files: a Zstandard
dictionary is built from records of the input, embedded in a leading
skippable frame (magic 0x184D2A5D) of every file, and each record is one
Zstandard frame of its own compressed with it, so any record can be read from
its offset.  Of rows with equal payloads the one with the largest id is a
``response`` record and the others are ``revisit`` records without payload
that name it (payloads below ``min_revisit_bytes`` are all responses).

Plan: digests are computed in the JVM and grouped (partial aggregation, so a
payload shared by a third of the rows costs a row for each map task); only
digests with two or more rows are joined back, on rows without payload.  One
more shuffle brings the small (id, refers to) rows to the payloads by id.
Tasks stream their rows into files of ``roll_bytes`` in the shared folder,
under names no other attempt uses; the returned index lists the files of
attempts that succeeded, so a lost executor only leaves unlisted files.

Edge cases: null payloads are empty payloads; a null url becomes
``urn:page:<id>``; rows with the same id and payload are all responses (or
all revisits) alike; a null id is written as ``null`` and counts as the
smallest; an empty table writes no file; if there is too little to train a
dictionary on, files have no leading frame.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.session import ensure_checkpoint_dir, stash

DICT_MAGIC = 0x184D2A5D
#: Rows, bytes of one row and bytes of dictionary that the training sees at most.
DICT_ROWS, DICT_ROW_BYTES, DICT_BYTES = 400, 16384, 65536
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
WARC_DATE = "2000-01-01T00:00:00Z"  # the input has no time of capture
MIN_REVISIT_BYTES = 0

INDEX_SCHEMA = "path string, offset long, length long, page_id long"
RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, "
                 "record_type string, refers_to long, payload binary")


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary bytes (none for too few samples); samples that training rejects, because they are
    too much alike, are themselves the content of the dictionary."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:min(size, total // 8)]


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers: int | None,
                 revisit: bool, date: str = WARC_DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and drops the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "null" if page_id is None else page_id
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{name}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response whose payload misses its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(value: str | None) -> int | None:
        value = value and value.removeprefix("<urn:page:").removesuffix(">")
        return None if value in (None, "null", "None") else int(value)

    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
            "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": page(fields.get("WARC-Refers-To")),
            "payload": payload if kind == "response" else None}


class WarcFile:
    """Appends records to one file of a store."""

    def __init__(self, folder: str, dictionary: bytes):
        self.path = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.warc.zst"
        store, where = pafs.FileSystem.from_uri(self.path)
        self.out, self.at = store.open_output_stream(where, compression=None), 0
        self.packer = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        if dictionary:
            self._put(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at, len(data)

    def add(self, record: bytes) -> tuple[int, int]:
        return self._put(self.packer.compress(record))


def read_records(path: str) -> Iterator[bytes]:
    """The records of a file, streamed: memory is a read block and a record."""
    store, where = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(where, compression=None) as src:
        data = src.read(8)
        known = None
        if len(data) == 8 and struct.unpack("<II", data)[0] == DICT_MAGIC:
            size = struct.unpack("<II", data)[1]
            known, data = zstandard.ZstdCompressionDict(src.read(size)), b""
        unpacker = zstandard.ZstdDecompressor(dict_data=known)
        while data or (data := src.read(READ_BYTES)):
            frame, parts = unpacker.decompressobj(), []
            while not frame.eof:
                if not data and not (data := src.read(READ_BYTES)):
                    raise ValueError(f"{path} ends within a record")
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else b""
            yield b"".join(parts)


def write_warc(df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url",
               payload_column: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES,
               roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives below ``folder``; returns their index (one row per record)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("page_id"),
                     F.col(url_column).cast("string").alias("url"),
                     F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"))
    slim = rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"),
                       F.octet_length("payload").alias("n"))
    shared = stash(slim.where(F.col("n") >= min_revisit_bytes).groupBy("digest")
                   .agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
                   .where("copies > 1").select("digest", "first"), "warc-shared")
    marks = (slim.where(F.col("n") >= min_revisit_bytes).join(shared, "digest")
             .where(~F.col("page_id").eqNullSafe(F.col("first")))
             .select("page_id", "digest", "first").distinct())
    total = df.count()
    step = max(1, total // DICT_ROWS)
    sample = (rows.where(F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0)
              .select("page_id", "url", F.substring("payload", 1, DICT_ROW_BYTES).alias("payload"))
              .limit(2 * DICT_ROWS).collect())
    dictionary = train_dictionary([record_bytes(r.page_id, r.url, bytes(r.payload), None, False)
                                   for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index = None, []

        def close() -> pa.RecordBatch:
            out.out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([out.path] * len(index), pa.string()),
                 *(pa.array(list(x), pa.int64()) for x in zip(*index))],
                ["path", "offset", "length", "page_id"])

        for batch in batches:
            for page_id, url, payload, first, hit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = WarcFile(folder, dictionary)
                index.append((*out.add(record_bytes(page_id, url, payload, first, hit)), page_id))
                if out.at >= roll_bytes:
                    yield close()
                    out, index = None, []
        if out is not None:
            yield close()

    full = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    mark = marks.withColumnRenamed("page_id", "_id").withColumnRenamed("digest", "_digest")
    joined = full.join(mark, F.col("page_id").eqNullSafe(F.col("_id"))
                       & (F.col("digest") == F.col("_digest")), "left")
    store, where = pafs.FileSystem.from_uri(folder)
    store.create_dir(where, recursive=True)
    return stash(joined.select("page_id", "url", "payload", "first",
                               F.col("_digest").isNotNull().alias("hit"))
                 .mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read_warc(paths: DataFrame) -> DataFrame:
    """The records of the files named in column ``path``, one row per record."""
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, held = [], 0
                for data in read_records(path):
                    found.append(parse_record(data))
                    held += len(data)
                    if held > READ_BYTES * 8:
                        yield pack(found)
                        found, held = [], 0
                if found:
                    yield pack(found)

    return paths.select("path").mapInArrow(run, RECORD_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "warc", uuid.uuid4().hex)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write the archives of ``df`` to the shared folder and read them back."""
    paths = write_warc(df, archive_folder(df.sparkSession), **options).select("path").distinct()
    return read_warc(paths.repartition(max(1, paths.count())))  # a task for each file
