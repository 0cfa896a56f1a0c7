"""Web archives of one Zstandard frame a record, with the dictionary in a leading skippable frame: writer, reader and checks."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import drop, new_path, written

#: Frames with this magic number are skipped by readers that don't know them; here it holds the archive's dictionary.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: Payload bytes of one archive, and of the sample and size of its dictionary.
ARCHIVE, SAMPLE, DICTIONARY = 16 << 20, 1 << 20, 1 << 14
EMPTY_END = b"\r\n\r\n"
FEED = 1 << 16


class InvalidArchive(ValueError):
    """An archive or record that breaks the format; the message names the place."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or, with refers_to, a revisit that has the same HTTP head and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + EMPTY_END


def pack(records: list[bytes]) -> bytes:
    """An archive: its dictionary, trained on a bounded sample of its records, then one frame for each record. Too few records to train on: no dictionary."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE:
            break
        sample.append(r[: SAMPLE // 8])
        size += len(sample[-1])
    try:
        d = zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except zstandard.ZstdError:
        d = b""
    z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(d)) + d if d else b"", *map(z.compress, records)])


def _skipped(data: bytes, at: int) -> int:
    """Where the skippable frame at `at` ends."""
    size = struct.unpack("<I", data[at + 4 : at + 8].ljust(4, b"\xff"))[0]
    if at + 8 + size > len(data):
        raise InvalidArchive(f"the skippable frame at {at} is cut short")
    return at + 8 + size


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each frame. The first skippable frame's dictionary, which may be compressed itself, serves all."""
    at, dictionary = 0, None
    if data[:4] == struct.pack("<I", SKIPPABLE):
        at = _skipped(data, 0)
        raw = data[8:at]
        try:
            dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
        except zstandard.ZstdError as e:
            raise InvalidArchive(f"the dictionary: {e}") from e
    z = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if 0x184D2A50 <= struct.unpack("<I", data[at : at + 4].ljust(4, b"\0"))[0] <= 0x184D2A5F:
            at = _skipped(data, at)
            continue
        if data[at : at + 4] != ZSTD_MAGIC:
            raise InvalidArchive(f"no frame at {at}")
        one, out, fed = z.decompressobj(), [], at
        try:
            while not one.eof and fed < len(data):
                out.append(one.decompress(data[fed : fed + FEED]))
                fed = min(len(data), fed + FEED)
        except zstandard.ZstdError as e:
            raise InvalidArchive(f"frame at {at}: {e}") from e
        if not one.eof:
            raise InvalidArchive(f"the frame at {at} is cut short")
        yield at, b"".join(out)
        at = fed - len(one.unused_data)


def _number(text: str | bytes, what: str) -> int:
    digits = text.strip()
    if not digits.isdigit() or not digits.isascii():
        raise InvalidArchive(f"{what} is no number: {text[:60]!r}")
    return int(digits)


def _page(fields: dict[str, str], name: str) -> int | None:
    inside = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    return (-1 if inside[0] == "-" else 1) * _number(inside.removeprefix("-"), name) if inside else None


def parse(raw: bytes) -> dict:
    """A record's fields, after checks of its version, headers, lengths and digest."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise InvalidArchive(f"a head that is no UTF-8: {e}") from e
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise InvalidArchive("no WARC head")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise InvalidArchive(f"no header: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise InvalidArchive(f"no {name}")
    length = _number(fields["content-length"], "content-length")
    if len(rest) != length + len(EMPTY_END) or rest[length:] != EMPTY_END:
        raise InvalidArchive(f"a block of {length} bytes is announced, and {len(rest) - len(EMPTY_END)} are there")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [_number(x.split(b":", 1)[1], "the HTTP length") for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise InvalidArchive("no HTTP head with a length")
    kind, told = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != sizes[0] or digest(payload) != told:
            raise InvalidArchive("the payload is not what its length and digest say")
    elif kind != "revisit" or payload or _page(fields, "warc-refers-to") is None:
        raise InvalidArchive(f"not a response or revisit: {kind}")
    return {"page_id": _page(fields, "warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": sizes[0], "payload_digest": told, "record_type": kind, "refers_to": _page(fields, "warc-refers-to"), "payload": payload if kind == "response" else None}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, part = TaskContext.get(), 0
        records, size = [], 0

        def flush() -> pa.RecordBatch:
            # The name is this attempt's own, and only the rows of the attempt that Spark commits are read.
            name = f"{root}/{context.partitionId():05d}-{part:05d}-{uuid.uuid4().hex}.warc.zst"
            body = pack(records)
            with store.open_output_stream(name, compression=None) as f:
                f.write(body)
            return pa.RecordBatch.from_pylist([{"path": name, "n_records": len(records), "n_bytes": len(body)}])

        for batch in batches:
            for a in range(0, len(batch), 256):
                for r in batch.slice(a, 256).to_pylist():
                    records.append(record(r["page_id"], r["url"], r["payload"], r["first_id"] if r["revisit"] else None))
                    size += len(r["payload"])
                    if size >= ARCHIVE:
                        yield flush()
                        records, size, part = [], 0, part + 1
        if records:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write a record for every page into archives in a shared folder; the result lists the archives (folder, path, n_records, n_bytes).

    Of pages with equal payloads of at least `least` bytes, that with the smallest page_id is a response, the others
    revisit it; smaller payloads are all responses. Payloads are shuffled once, by digest; a digest that many pages have
    is counted by partial aggregation, and its join can be split.

    Null html: an empty payload. Null page_id: a revisit of the smallest page_id with its payload, and where there is
    none, a response. Rows that repeat the smallest page_id are all responses. Null url: no such header. An empty table
    gives no archive. Only page_id, url and html are read. `folder` is a URI that pyarrow can open on every executor.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    body = F.coalesce(F.encode(pages["html"], "UTF-8"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), body.alias("payload"), F.sha2(body, 256).alias("same"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("same").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    firsts = written(firsts, "warc-firsts")  # a table: then Spark can split the pages of a frequent payload
    joined = rows.join(firsts, "same", "left").withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    listed = joined.select("page_id", "url", "payload", "first_id", "revisit").mapInArrow(_writer(folder), "path string, n_records bigint, n_bytes bigint")
    out = written(listed.withColumn("folder", F.lit(folder)), "warc-list")
    drop(firsts)
    return out


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives, every one checked; an invalid one raises InvalidArchive, with its archive and place.

    `archives` has folder, path and n_records, as write_archives() lists them; a null in one of these raises an error. An
    archive that is listed twice is read twice; other columns are not read. An empty list gives no rows.
    """
    n = max(1, archives.count())

    def records_of(r: dict) -> Iterator[dict]:
        store, _ = fs.FileSystem.from_uri(r["folder"])
        with store.open_input_stream(r["path"], compression=None) as f:
            data = f.read()
        at, seen = 0, 0
        try:
            for at, raw in frames(data):
                row = parse(raw)
                if not with_payload:
                    del row["payload"]
                seen += 1
                yield row
        except InvalidArchive as e:
            raise InvalidArchive(f"{r['path']}, record {seen}, at {at} or after: {e}") from e
        if seen != r["n_records"]:
            raise InvalidArchive(f"{r['path']} has {seen} records instead of {r['n_records']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                for row in records_of(r):
                    rows.append(row)
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = [("page_id", pa.int64(), "bigint"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "bigint"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "bigint"), ("payload", pa.binary(), "binary")][: 7 if with_payload else 6]
    schema = pa.schema([(a, b) for a, b, _ in kinds])
    return archives.select("folder", "path", "n_records").repartition(min(n, 4096)).mapInArrow(run, ", ".join(f"{a} {c}" for a, _, c in kinds))
