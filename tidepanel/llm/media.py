"""Media columns: signature sniffing, structural validation, type correction and carving.

An Aho-Corasick automaton finds every magic number in one pass; a validator of
the format then walks the structure from there and yields its length, so that
chance matches in other data are refused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import sliced

# --- fixed values: signatures (bytes, offset of the signature in the file, format)
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
]
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
# ---


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (size,) = struct.unpack_from(">I", b, pos)
        kind, end = b[pos + 4 : pos + 8], pos + 12 + size
        if end > len(b) or (first and kind != b"IHDR"):
            return None
        if zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return "image/png", end - at
        pos, first = end, False
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xD9:
            return "image/jpeg", pos + 2 - at
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            pos += 2
            continue
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2:
            return None
        pos += 2 + size
        if mark == 0xDA:  # entropy-coded data runs to the next real marker
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
    return ("image/jpeg", pos + 2 - at) if b[pos : pos + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return "image/gif", pos + 1 - at
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(b):
            pos += 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 54 > len(b):
        return None
    size, spare, start, head, wide, high, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if spare or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or head < 40 or packed or wide <= 0 or not high:
        return None
    row = (wide * bits + 31) // 32 * 4
    if start < 14 + head or start + row * abs(high) != size or at + size > len(b):
        return None
    return "image/bmp", size


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b) or (kind := RIFF_KINDS.get(b[at + 8 : at + 12])) is None:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    pos = at + 12
    if at + size > len(b):
        return None
    while pos + 8 <= at + size:
        pos += 8 + (n := struct.unpack_from("<I", b, pos + 4)[0]) + (n & 1)
    return (kind, size) if pos in (at + size, at + size + 1) else None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        n = b[pos + 26]
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
    return ("audio/ogg", pos - at) if at < pos <= len(b) else None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    pos, seen = at, set()
    while pos + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if size == 1 and pos + 16 <= len(b):  # the length follows in 64 bits
            size = struct.unpack_from(">Q", b, pos + 8)[0]
            size = size if size >= 16 else 0
        elif size == 0:  # to the end
            size = len(b) - pos
        if size < 8 or pos + size > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        pos += size
    return ("video/mp4", pos - at) if b"moov" in seen else None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp,
    "riff": _riff, "audio/ogg": _ogg, "video/mp4": _mp4,
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, shift, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic) + shift, kind))
    found.make_automaton()
    return found


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media in ``data``, outermost first; none for NULL or empty data.

    What lies inside media that were found already belongs to them.
    """
    out: list[tuple[str, int, int]] = []
    end = 0
    for last, (back, kind) in _automaton().iter((data or b"").decode("latin-1")):
        at = last + 1 - back
        if at >= end and (found := VALIDATORS[kind](data, at)):
            out.append((found[0], at, found[1]))
            end = at + found[1]
    return out


def wrap(payload: bytes) -> tuple[str, bytes]:
    """(type, media) that holds a payload of a positive multiple of 64 bytes as 8-bit samples.

    The format follows from the payload alone: WAV, BMP or PNG.
    """
    kind, rows = zlib.crc32(payload) % 3, len(payload) // 64
    if kind == 0:
        fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
        body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload
        return "audio/wav", struct.pack("<4sI", b"RIFF", len(body)) + body
    if kind == 1:
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        head = struct.pack("<IiiHHIIiiII", 40, 64, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
        start = 14 + len(head) + len(grey)
        return "image/bmp", struct.pack("<2sIII", b"BM", start + len(payload), 0, start) + head + grey + payload
    lines = bytearray(65 * rows)
    for i in range(64):
        lines[i + 1 :: 65] = payload[i::64]

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", 64, rows, 8, 0, 0, 0, 0)
    return "image/png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(lines), 1)) + chunk(b"IEND", b"")


def unwrap(kind: str, media: bytes) -> bytes:
    """The samples of media that ``wrap`` made."""
    if kind == "audio/wav":
        return media[media.index(b"data") + 8 :]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    pos, packed = 8, []
    while (name := media[pos + 4 : pos + 8]) != b"IEND":
        size = struct.unpack_from(">I", media, pos)[0]
        if name == b"IDAT":
            packed.append(media[pos + 8 : pos + 8 + size])
        pos += size + 12
    lines = zlib.decompress(b"".join(packed))
    out = bytearray(len(lines) // 65 * 64)
    for i in range(64):
        out[i::64] = lines[i + 1 :: 65]
    return bytes(out)


def sniff_column(df: DataFrame, data: str = "data", declared: str | None = None, types: str = "media") -> DataFrame:
    """``df`` plus ``media``: array of (type, offset, length, bytes) of all media found, ``declared_ok`` and ``corrected``.

    ``declared_ok`` tells whether the declared type is that of media at offset 0
    (NULL without a declared type); ``corrected`` is the type at offset 0, or
    else the declared one.  NULL and empty data give an empty array.  Columns of
    the three names are replaced; ``types`` must not name a column that is read.
    """
    if {types, "declared_ok", "corrected"} & {data, declared}:
        raise ValueError(f"{types}, declared_ok and corrected are written: read data and declared types from other columns")
    schema = f"{types} array<struct<type:string,offset:bigint,length:bigint,bytes:binary>>, declared_ok boolean, corrected string"
    fields = df.drop(types, "declared_ok", "corrected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))
        for batch in sliced(batches, data):
            values = batch.column(data).to_pylist()
            said = batch.column(declared).to_pylist() if declared else [None] * len(values)
            found = [sniff(v) for v in values]
            media = [[{"type": t, "offset": a, "length": n, "bytes": v[a : a + n]} for t, a, n in f] for v, f in zip(values, found, strict=True)]
            ok = [None if s is None else bool(f) and f[0][1] == 0 and f[0][0] == s for s, f in zip(said, found, strict=True)]
            true = [f[0][0] if f and f[0][1] == 0 else s for s, f in zip(said, found, strict=True)]
            columns = [*batch.columns, pa.array(media, kind), pa.array(ok, pa.bool_()), pa.array(true, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, types, "declared_ok", "corrected"])

    from pyspark.sql.types import StructType

    return fields.mapInArrow(run, StructType(fields.schema.fields + StructType.fromDDL(schema).fields))


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media, sniffs the stored bytes and reads them back.

    Texts are UTF-8, NULL as empty, padded by NUL bytes to a positive multiple
    of 64.  The declared type is left open; sniffing settles it.  Repeated rows
    give equal results, an empty table none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                raw = (value.as_py() or "").encode() if value.is_valid else b""
                kept = max(64, (len(raw) + 63) // 64 * 64)
                _, media = wrap(raw + bytes(kept - len(raw)))
                kind, at, size = sniff(media)[0]
                back = unwrap(kind, media[at : at + size])
                zeros = len(back) - len(back.rstrip(b"\0"))
                mean = sum(back) / len(back)
                row = (
                    len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                    hashlib.sha256(media).hexdigest(), f"{kind};samples={len(back)};mean={mean:.6f};peak={max(back)};tail0={zeros}",
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    id_kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        run,
        f"doc_id {id_kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string",
    )
