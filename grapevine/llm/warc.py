"""WARC archives whose records are compressed one by one with a dictionary of their own.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds a Zstandard
dictionary built from records of this archive; every record after it is a frame of its own, so any
record can be read from its offset once the dictionary is known. Of pages with equal payloads of
``REVISIT_BYTES`` or more, the one with the largest id is a response and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.operators import skew
from grapevine.session import Workspace

REVISIT_BYTES = 1000
DICTIONARY_MAGIC = 0x184D2A5D  # a fixed value of the format
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20  # of an archive's first records, that its dictionary is built from
ARCHIVE_BYTES = 64 << 20  # payload bytes after which the next archive is begun
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

Record = tuple[int | None, str | None, bytes, str, int | None]  # page id, url, payload, SHA-1, response it revisits


def digested(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null html: empty) and its SHA-1 in hex."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))


def with_responses(pages: DataFrame) -> DataFrame:
    """Pages as ``digested`` gives them, with ``refers_to``: the response a page revisits, else null.

    A row that repeats the largest id is a response like it. Pages without id never are the
    response if another page has one.
    """
    large = F.octet_length("payload") >= REVISIT_BYTES
    slim = pages.where(large).select("page_id", "digest")
    found = slim.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    # Small pages match nothing: they are dealt out by what they are instead of meeting under a common digest.
    alone = F.concat_ws(" ", F.lit("small"), "page_id", "url")
    # So are pages with a payload of very many, whose digests are sent to all tasks: one for every HOT_ROWS pages at most.
    common = found.where(F.col("n") >= skew.HOT_ROWS).select(F.col("digest").alias("key"), F.struct("response").alias("common"))
    rare = found.where(F.col("n") < skew.HOT_ROWS).select(F.col("digest").alias("key"), "response")
    keyed = pages.withColumn("key", F.when(large, F.col("digest")).otherwise(alone)).join(F.broadcast(common), "key", "left")
    dealt = keyed.withColumn("key", F.when(F.col("common").isNotNull(), alone).otherwise(F.col("key")))
    joined = dealt.join(rare, "key", "left").withColumn("response", F.coalesce("common.response", "response"))
    same = F.col("page_id").eqNullSafe(F.col("response"))
    return joined.withColumn("refers_to", F.when(large & ~same, F.col("response"))).drop("key", "common", "response")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with its HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "%%%02X" % ord(m[0]), url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "none" else int(found)


def parsed(record: bytes) -> dict:
    """What a record says of its page. A response's digest and size are those of the payload it holds."""
    head, _, block = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    refers_to = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to,
    }


def dictionary_of(records: list[bytes]):
    """A dictionary from some records, or none where they are too few or too short for one."""
    import zstandard

    # The library wants a good multiple of the dictionary's size to learn from.
    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 10)
    if len(records) < 8 or size < 256:
        return None
    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(out, records: Iterator[bytes], waiting: list[bytes]) -> tuple[int, int]:
    """Writes records as one archive, ``waiting`` being the first, which its dictionary is built from.

    Gives back the number of records and the bytes written.
    """
    import zstandard

    dictionary = dictionary_of(waiting)
    raw = dictionary.as_bytes() if dictionary else b""
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    # Content size and checksum stand in each frame, so a cut or damaged one is found on reading.
    compressor = zstandard.ZstdCompressor(LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    n, size = 0, 8 + len(raw)
    for part in (waiting, records):
        for record in part:
            frame = compressor.compress(record)
            out.write(frame)
            n, size = n + 1, size + len(frame)
    return n, size


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one after the other, from a file object."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    raw = source.read(size)
    options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    decompressor = zstandard.ZstdDecompressor(**options)
    frame, pending = decompressor.decompressobj(), source.read(1 << 20)
    record: list[bytes] = []
    while pending:
        record.append(frame.decompress(pending))
        if frame.eof:
            yield b"".join(record)
            pending, record = frame.unused_data, []
            frame = decompressor.decompressobj()
            pending = pending or source.read(1 << 20)
        else:
            pending = source.read(1 << 20)
            if not pending:
                raise ValueError("an archive ends within a record")


def _file_system(folder: str):
    """The file system of the shared folder, and the folder's path in it.

    Spark's names of S3 are not pyarrow's, which finds its own credentials (environment, profile or role).
    """
    from pyarrow import fs

    folder = re.sub(r"^s3[an]://", "s3://", folder)
    return fs.FileSystem.from_uri(folder if re.match(r"\w+://|\w+:/", folder) else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str, workspace: Workspace) -> DataFrame:
    """Writes pages (``page_id``, ``url``, ``payload``, ``digest``, ``refers_to``) to archives below a shared folder.

    Gives a table of the archives: ``path``, ``records``, ``bytes``. A task that runs again writes
    archives of another name; those of attempts that failed are in no table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        rows = _records(batches)
        record = next(rows, None)
        while record is not None:
            waiting, begun, size = [], record, 0

            def more(first: bytes | None) -> Iterator[bytes]:
                nonlocal record, size
                while first is not None and size < ARCHIVE_BYTES:
                    size += len(first)
                    yield first
                    first = next(rows, None)
                record = first

            source = more(begun)
            for own in source:
                waiting.append(own)
                if size >= SAMPLE_BYTES:
                    break
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(path) as out:
                n, written = write_archive(out, source, waiting)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([n]), pa.array([written])], names=["path", "records", "bytes"]
            )

    slim = pages.select("page_id", "url", "payload", "digest", "refers_to")
    return workspace.keep(slim.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
        for row in zip(*columns, strict=True):
            yield record_bytes(*[value.as_py() for value in row])


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Pages of the archives in a table of ``write_archives``: what each record says of its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path) as source:
                    rows: list[dict] = []
                    for record in read_archive(source):
                        rows.append(parsed(record))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, _PAGE)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _PAGE)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, schema)


_PAGE = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64())]
)


def archived(pages: DataFrame, workspace: Workspace) -> DataFrame:
    """Writes every page to archives in the workspace and reads them back: a row per page.

    Null html is an empty payload; a page without id is archived without one. No page, no archive.
    Payloads of any length are written whole. Only ``page_id``, ``url`` and ``html`` are read; other
    columns may be called anything.
    """
    folder = workspace.path("archives")
    archives = write_archives(with_responses(digested(pages)), folder, workspace)
    return read_archives(archives, folder)
