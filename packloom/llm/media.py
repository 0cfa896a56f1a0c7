"""Media columns: lossless media forms of byte payloads, and signature sniffing of media in any bytes."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packloom.llm import text as T

UNIT, FILL = 576, b"\xff"
RATE = 8000
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
#: Magic bytes and the kind that they announce.
SIGNATURES = {PNG_HEAD: "image/png", b"RIFF": "audio/wav", b"BM": "image/bmp", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"\xff\xd8\xff": "image/jpeg", b".snd": "audio/basic"}
KINDS = ("audio/wav", "image/bmp", "image/png")
#: What media are embedded in: a head of a message part, which has magic bytes of no media, its end, and an icon.
PART, PART_END = b"--part\r\nContent-Type: %s\r\nX-Note: BMW, RIFF, .snd\r\n\r\n", b"\r\n--part--\r\n"
ICON = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 128, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + bytes([2, 2, 76, 1, 0]) + b";"


# --- forms


def to_wav(samples: bytes) -> bytes:
    """8-bit mono sound; a RIFF chunk has an even size."""
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def to_bmp(samples: bytes) -> bytes:
    """8-bit grey, UNIT wide, top row first."""
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 14 + 40 + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + len(samples), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, UNIT, -(len(samples) // UNIT), 1, 8, 0, len(samples), 2835, 2835, 256, 0) + palette + samples


def to_png(samples: bytes) -> bytes:
    """8-bit grey, UNIT wide, no filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    lines = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


FORMS = {"audio/wav": to_wav, "image/bmp": to_bmp, "image/png": to_png}

# --- validators: the length of the media that starts at `at`, or 0


def _png(d: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, i)
        if i + 12 + size > len(d) or first != (kind == b"IHDR") or zlib.crc32(memoryview(d)[i + 4 : i + 8 + size]) != struct.unpack_from(">I", d, i + 8 + size)[0]:
            return 0
        i, first = i + 12 + size, False
        if kind == b"IEND":
            return i - at if size == 0 else 0
    return 0


def _wav(d: bytes, at: int) -> int:
    if len(d) < at + 12 or d[at + 8 : at + 12] != b"WAVE":
        return 0
    end, i, seen = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12, set()
    if end > len(d):
        return 0
    while i + 8 <= end:
        kind, size = struct.unpack_from("<4sI", d, i)
        seen.add(kind)
        i += 8 + size + size % 2
    return end - at if i == end and {b"fmt ", b"data"} <= seen else 0


def _bmp(d: bytes, at: int) -> int:
    if len(d) < at + 54:
        return 0
    size, a, b, start, head, width, height, planes, bits, packing = struct.unpack_from("<IHHIIiiHHI", d, at + 2)
    if a or b or head < 40 or head > 124 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packing or width <= 0 or not height or at + size > len(d):
        return 0
    return size if start >= 14 + head and size >= start + (width * bits + 31) // 32 * 4 * abs(height) else 0


def _gif(d: bytes, at: int) -> int:
    if len(d) < at + 14:
        return 0
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    i = at + 13 + table(d[at + 10])
    while i < len(d):
        if d[i] == 0x3B:
            return i + 1 - at
        if d[i] == 0x2C and i + 10 < len(d):
            i += 11 + table(d[i + 9])
        elif d[i] == 0x21:
            i += 2
        else:
            return 0
        while i < len(d) and d[i]:
            i += 1 + d[i]
        i += 1
    return 0


def _jpeg(d: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(d) and d[i] == 0xFF:
        if d[i + 1] in (0xFF, 0x00) or 0xD0 <= d[i + 1] <= 0xD8:
            return 0
        size = struct.unpack_from(">H", d, i + 2)[0]
        if size < 2:
            return 0
        if d[i + 1] == 0xDA:
            i += 2 + size
            while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d) and (d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7):
                i += 2
            if i < 0 or i + 1 >= len(d):
                return 0
            if d[i + 1] == 0xD9:
                return i + 2 - at
        else:
            i += 2 + size
    return 0


def _au(d: bytes, at: int) -> int:
    if len(d) < at + 24:
        return 0
    start, size, coding, rate, channels = struct.unpack_from(">IIIII", d, at + 4)
    return start + size if 24 <= start <= 1 << 16 and 1 <= coding <= 27 and 1000 <= rate <= 400_000 and 1 <= channels <= 32 and size != 0xFFFFFFFF and at + start + size <= len(d) else 0


VALIDATORS = {"image/png": _png, "audio/wav": _wav, "image/bmp": _bmp, "image/gif": _gif, "image/jpeg": _jpeg, "audio/basic": _au}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> tuple[int, list[tuple[int, int, str]]]:
    """How many signatures the bytes have, and (start, length, kind) of all media that validators confirm, none inside another."""
    hits, found, upto = 0, [], 0
    for end, (n, kind) in _automaton().iter(blob.decode("latin-1")):
        hits += 1
        start = end + 1 - n
        if start >= upto and (size := VALIDATORS[kind](blob, start)):
            found.append((start, size, kind))
            upto = start + size
    return hits, found


def samples(media: bytes, kind: str) -> bytes:
    """The 8-bit samples of media in one of the FORMS."""
    if kind == "audio/wav":
        i = 12
        while True:
            name, size = struct.unpack_from("<4sI", media, i)
            if name == b"data":
                return media[i + 8 : i + 8 + size]
            i += 8 + size + size % 2
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    if kind == "image/png":
        i, body, width = 8, [], 0
        while i < len(media):
            size, name = struct.unpack_from(">I4s", media, i)
            if name == b"IHDR":
                width = struct.unpack_from(">I", media, i + 8)[0]
            elif name == b"IDAT":
                body.append(media[i + 8 : i + 8 + size])
            i += 12 + size
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
        if lines[:, 0].any():
            raise ValueError("filtered lines")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no samples of {kind}")


def embedded(form: bytes, declared: str, way: int) -> bytes:
    """A media file as a column of raw bytes may hold it: by itself, as a part of a message, or in such a part between icons."""
    part = PART % declared.encode() + form + PART_END
    return (form, part, ICON + part + ICON)[way]


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared and media: every text as samples in a media form, whose kind its checksum picks.

    The payload is the UTF-8 text with bytes 255 up to a positive multiple of UNIT. `declared` is what a careless producer
    says: the true kind for half of the payloads, another for the rest. Two thirds of the media are embedded in other
    bytes; these too are chosen by checksum, so that equal texts have equal media. Null text: empty, so UNIT bytes 255. Rows are
    independent; an empty table gives no rows; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.blocks(batches):
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                payload = data[a:b].tobytes()
                payload += FILL * ((-len(payload)) % UNIT if payload else UNIT)
                check = zlib.crc32(payload)
                declared = KINDS[(check + check % 2) % 3]
                rows.append((int(b - a), declared, embedded(FORMS[KINDS[check % 3]](payload), declared, check // 6 % 3)))
            n, declared, media = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(declared), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    rows = docs.select(docs["doc_id"], docs["text"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, declared string, media binary")


def features(media: DataFrame) -> DataFrame:
    """From stored(): the kind that sniffing proves, in place of the declared one, and features of the samples that are read back.

    Of the media that are carved from a row's bytes the largest is its own (ties: the first); it must be in one of FORMS.
    media_bytes and media_sha256 are those of the carved file. Rows whose bytes hold no valid media, null ones too, raise
    an error, since stored() always writes some. Rows that repeat give equal results; an empty table gives no rows; other
    columns are not read. feature is "kind;declared;start;signatures;media found;sum of samples;samples above 127".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.blocks(batches, "media"):
            rows = []
            for a, b, declared in zip(offsets[:-1], offsets[1:], batch.column(2).to_pylist(), strict=True):
                blob = data[a:b].tobytes()
                hits, found = sniff(blob)
                if not found:
                    raise ValueError("no valid media")
                start, size, kind = max(found, key=lambda x: (x[1], -x[0]))
                own = blob[start : start + size]
                payload = samples(own, kind)
                x = np.frombuffer(payload, np.uint8)
                told = "declared" if declared == kind else f"corrected from {declared}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(own), hashlib.sha256(own).hexdigest(), f"{kind};{told};{start};{hits};{len(found)};{int(x.sum(dtype=np.int64))};{int((x > 127).sum())}"))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
