"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Each writing task makes one archive below a shared folder, first under a name of its own attempt, then moved to its
place, so a repeated task leaves one whole file. The reader decodes record by record and checks headers and lengths.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.plans.registry import table
from clearwake.session import cut_lineage, scratch_path

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC, DICTIONARY_MAGIC = b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Shorter payloads are stored again rather than referred to.
MIN_REVISIT_BYTES = 1000
#: A dictionary is trained on the first records of its archive.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8 << 20, 64 << 10
LEVEL = 3
#: A longer record counts as broken.
MAX_RECORD_BYTES = 1 << 30
_READ = 1 << 20
_DATE = "2024-01-01T00:00:00Z"


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, digest`` and ``refers_to`` (null for responses).

    Of equal payloads of ``min_bytes`` or more the largest page_id is the response; rows that repeat it are responses
    too. A null page_id is a response only where all equal payloads have none. A null html is empty.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    # groups of one need no record of who stands for them
    shared = (
        hashed.where(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    refers = F.when(F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return hashed.join(shared, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _one_line(text: str | None) -> str:
    return re.sub(r"[\r\n\x00]", " ", text or "")


def _record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Identified-Page: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _archive(records: Iterator[bytes], out) -> tuple[int, int]:
    """Write an archive; returns records and bytes."""
    first, size = [], 0
    for record in records:
        first.append(record)
        size += len(record)
        if len(first) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    dictionary = b""
    try:
        if len(first) >= 8:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, first).as_bytes()
    except zstandard.ZstdError:
        pass  # too little or too uniform to train on: the frame is there, but empty
    written = out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary) or 8 + len(dictionary)
    compressor = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    )
    count = 0
    for source in (first, records):
        for record in source:
            frame = compressor.compress(record)
            out.write(frame)
            count, written = count + 1, written + len(frame)
    return count, written


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``with_roles`` as archives in ``folder``; returns ``path, records, bytes`` per archive.

    ``folder`` is a path or URI that all executors reach. A task without rows writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, html, digest, refers = (batch.column(c)[i] for c in range(5))
                    yield _record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers.as_py())

        source = rows()
        head = next(source, None)
        if head is None:
            return
        system, base = _file_system(folder)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}.warc.zst"
        draft = f"{name}.{context.taskAttemptId()}"
        with system.open_output_stream(draft, compression=None) as out:
            count, size = _archive((r for part in ((head,), source) for r in part), out)
        system.move(draft, name)
        yield pa.RecordBatch.from_pydict(
            {"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [count], "bytes": [size]}
        )

    system, base = _file_system(folder)
    system.create_dir(base, recursive=True)
    rows = records.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")
    return cut_lineage(rows.mapInArrow(run, "path string, records bigint, bytes bigint"))


def _frames(source) -> Iterator[bytes | str]:
    """Decoded records of an archive, or a message where it is broken; nothing follows a message."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        yield "no leading dictionary frame"
        return
    size = struct.unpack("<I", head[4:])[0]
    dictionary = source.read(size)
    if len(dictionary) < size:
        yield "dictionary is cut off"
        return
    try:
        if dictionary.startswith(ZSTD_MAGIC):
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        if dictionary and not dictionary.startswith(DICTIONARY_MAGIC):
            yield "not a dictionary"
            return
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        pending = source.read(_READ)
        while pending:
            one, parts, total = decoder.decompressobj(), [], 0
            while True:
                part = one.decompress(pending)
                parts.append(part)
                total += len(part)
                if total > MAX_RECORD_BYTES:
                    yield "record is too long"
                    return
                if one.eof:
                    pending = one.unused_data or source.read(_READ)
                    break
                pending = source.read(_READ)
                if not pending:
                    yield "frame is cut off"
                    return
            yield b"".join(parts)
    except zstandard.ZstdError as error:
        yield f"broken frame: {error}"


def parse_record(record: bytes) -> dict:
    """Fields of one record; ``error`` says what is wrong with it."""
    row = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "error"))
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    row["record_type"], row["url"] = fields.get("WARC-Type"), fields.get("WARC-Target-URI")
    if not gap or lines[0] != VERSION:
        return row | {"error": "no WARC header"}
    missing = [name for name in REQUIRED if name not in fields]
    if missing:
        return row | {"error": f"missing {missing[0]}"}
    length = fields["Content-Length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        return row | {"error": "length differs from Content-Length"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = re.search(rb"\r\nContent-Length: ([0-9]+)", http)
    if not gap or not stated:
        return row | {"error": "no HTTP header"}
    kind, digest = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "")
    page, refers = fields.get("WARC-Identified-Page", ""), re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get("WARC-Refers-To", ""))
    row |= {
        "page_id": int(page) if page else None,
        "payload_bytes": int(stated[1]),
        "payload_digest": digest.removeprefix("sha1:"),
        "refers_to": int(refers[1]) if refers else None,
    }
    if kind == "response":
        if len(payload) != int(stated[1]):
            return row | {"error": "payload is not of the stated length"}
        if digest != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            return row | {"error": "payload differs from its digest"}
        return row | {"payload": payload}
    if kind != "revisit" or payload or not refers:
        return row | {"error": "neither a response nor a whole revisit"}
    return row


_FIELDS = (
    "path string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint,"
    " url string, payload binary, error string"
)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives named in ``path``, read one by one; ``error`` is null for good ones.

    A broken archive gives what could be read and a row with the error.
    """
    schema = pa.schema(
        [("path", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _file_system(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as source:
                    for record in _frames(source):
                        row = parse_record(record) if isinstance(record, bytes) else {"error": record}
                        size += len(record) if payloads else 200
                        rows.append({"path": path, **row, "payload": row.get("payload") if payloads else None})
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.select("path").mapInArrow(run, _FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    written = write_archives(with_roles(pages), scratch_path(spark, "warc"))
    return read_archives(written.where(F.col("records") > 0), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM r
"""
