"""WARC archives compressed record by record with a dictionary of their own (.warc.zst), and their reader.

A task writes one archive: it holds back records up to a sample bound, trains a Zstandard dictionary on the payloads
it holds, puts it into a leading skippable frame and compresses every record by itself with it, so that any record
can be read alone. Of records with equal payloads one is a response with the payload; the others are revisits that
name it. Which one is found by an aggregate over payload digests before anything is written.

The files go to a folder of any file system that pyarrow knows by its URI, under names of the task attempt that wrote
them; the manifest, a table written by Spark, names the files that count. A task that is repeated leaves a file that
no manifest names.

Edge cases: a null payload is empty; payloads under `least_bytes` are all responses; a null page_id is larger than any
other; rows that repeat both page_id and payload are all responses; few or tiny records give an archive without a
dictionary. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import materialize, scratch_path

SKIPPABLE = 0x184D2A5D  # the magic number of a dictionary frame, a fixed value
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # what a task trains its dictionary on, at most, and holds back until then
LEAST_RECORDS, LEAST_BYTES = 8, 8 << 10  # the trainer finds nothing in less
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("dictionary_bytes", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_DATE = "1970-01-01T00:00:00Z"  # the table has no capture time


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page's id: the same page, the same record."""
    value = 1 << 64 if page_id is None else page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(value >> 62) << 64 | 8 << 76 | 2 << 62 | value & (1 << 62) - 1)}>"


def page_of(name: str) -> int | None:
    """The inverse of `record_id`."""
    whole = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    value = ((whole >> 64) & 0xFFF) << 62 | whole & (1 << 62) - 1
    return None if value >> 64 else value - (1 << 64 if value >> 63 else 0)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has no block; the length of its payload stands in a header of its own."""
    target = "".join(c for c in url or "" if c >= " ")
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[:int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and base32_sha1(block) != digest:
        raise ValueError(f"payload and digest differ in {fields['WARC-Record-ID']}")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
            "payload": block}


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of an eighth of the samples, DICTIONARY_BYTES at most; None for fewer than LEAST_RECORDS or LEAST_BYTES."""
    total = sum(map(len, samples))
    if len(samples) < LEAST_RECORDS or total < LEAST_BYTES:
        return None
    size = min(DICTIONARY_BYTES, total // 8)
    try:
        return zstandard.train_dictionary(size, samples, level=3, k=min(512, size // 4), d=8)
    except zstandard.ZstdError:  # samples without anything in common
        return None


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def write_archive(records: Iterator[tuple], sink) -> tuple[int, int, int]:
    """Records (as the arguments of `record_bytes`) to an open sink: the number of records, of bytes, and of the dictionary's bytes."""
    held, samples, size, count, written, known = [], [], 0, 0, 0, 0
    compressor = None

    def put(data: bytes) -> None:
        nonlocal written
        sink.write(data)
        written += len(data)

    def start() -> None:
        nonlocal compressor, known
        dictionary = train(samples)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        if dictionary:
            known = len(dictionary.as_bytes())
            put(dictionary_frame(dictionary))
        for data in held:
            put(compressor.compress(data))
        held.clear()

    for record in records:
        data = record_bytes(*record)
        count += 1
        if compressor is None:
            held.append(data)
            if size < SAMPLE_BYTES:
                samples.append(data[:64 << 10])
            size += len(data)
            if size < SAMPLE_BYTES:
                continue
            start()
        else:
            put(compressor.compress(data))
    if compressor is None:
        start()
    return count, written, known


def read_archive(source, block: int = 1 << 20) -> Iterator[dict]:
    """The records of an open archive, one frame at a time."""
    data, dictionary = source.read(8), None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:])[0]
        frame = b""
        while len(frame) < size:
            frame += source.read(size - len(frame))
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(frame))
        data = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    current, parts = None, []
    while True:
        if not data:
            data = source.read(block)
            if not data:
                break
        if current is None:
            current = decompressor.decompressobj()
        parts.append(current.decompress(data))
        data = b""
        if current.eof:
            yield parse_record(b"".join(parts))
            data, current, parts = current.unused_data, None, []
    if current is not None:
        raise ValueError("the archive ends inside a record")


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages with payload and `refers_to` (the response's page_id, null for a response) and `revisit`."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha1("payload")
    first = materialize(rows.groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                        .filter(F.col("n") > 1).select("digest", "first"), "first-pages")
    # the hash table is built from the narrow side, so that payloads needn't be sorted
    joined = rows.withColumn("digest", digest).join(first.hint("shuffle_hash"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("payload") >= least_bytes)
    return joined.select("page_id", "url", "payload", again.alias("revisit"), F.when(again, F.col("first")).alias("refers_to"))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of `decided` as archives, one for each partition; the manifest (path, records, bytes, dictionary_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for r in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                        page_id, url, payload, revisit, refers_to = r
                        yield page_id, url, payload, base32_sha1(payload), refers_to, revisit

        records_ = rows()
        first = next(records_, None)
        if first is None:
            return
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
        fs, path = _filesystem(name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path, compression=None) as sink:
            count, written, known = write_archive((r for some in ((first,), records_) for r in some), sink)
        yield pa.record_batch([pa.array([name]), pa.array([count]), pa.array([written]), pa.array([known])], schema=_MANIFEST)

    return materialize(records.mapInArrow(run, "path string, records long, bytes long, dictionary_bytes long"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in a manifest; without `payloads`, that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _filesystem(name)
                with fs.open_input_stream(path, compression=None) as source:
                    held: list[dict] = []
                    for record in read_archive(source):
                        if not payloads:
                            record["payload"] = None
                        held.append(record)
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write all pages as archives, in the shared folder unless one is named, and read the archives back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read(write(decided(pages, least_bytes), folder), payloads=False).drop("payload")
