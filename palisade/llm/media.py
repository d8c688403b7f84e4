"""Media columns: signature sniffing over binary columns.

An Aho-Corasick automaton finds every magic number in the bytes; a format validator then walks the structure behind
each hit and confirms its lengths.  The medium that starts at byte 0 corrects the declared type; confirmed media
further in are carved (offset, length, type).  A hit without valid structure is no medium, so text that happens to
hold two magic letters stays text.

Defined cases: null bytes are empty; nothing recognised: the declared type stays (``application/octet-stream`` if it
is null); a truncated medium is not confirmed; media inside an already confirmed medium at a later offset are carved
too; repeated rows each give a row; extra columns pass through ``inspect``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import lean, table

UNKNOWN = "application/octet-stream"
BLOCK = 192
RATE = 8000


def _png(b: bytes, at: int) -> int:
    i = at + 8
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or (i == at + 8) != (kind == b"IHDR") or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        i += 12 + n
        if kind == b"IEND":
            return i - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags, i = b[at + 10], at + 13
    i += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 <= len(b):
            f = b[i + 9]
            i += 10 + (3 << ((f & 7) + 1) if f & 0x80 else 0) + 1
        else:
            return 0
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind, n = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if not 0xC0 <= kind <= 0xFE or n < 2:
            return 0
        i += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    n, zero, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    return n if zero == 0 and head in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= start <= n <= len(b) - at and w > 0 and h else 0


def _riff_size(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    n = struct.unpack_from("<I", b, at + 4)[0] + 8
    return n if 12 <= n <= len(b) - at else 0


def wav_data(b: bytes, at: int = 0) -> tuple[int, int] | None:
    """Start and length of the samples of the WAV file at ``at``."""
    end, i, fmt = at + _riff_size(b, at), at + 12, False
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, i)
        if i + 8 + n > end:
            return None
        fmt |= kind == b"fmt " and n >= 16
        if kind == b"data" and fmt:
            return i + 8, n
        i += 8 + n + n % 2
    return None


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    n = _riff_size(b, at)
    if not n:
        return None
    form = b[at + 8 : at + 12]
    if form == b"WAVE" and wav_data(b, at):
        return "audio/wav", n
    if form == b"WEBP" and b[at + 12 : at + 16] in (b"VP8 ", b"VP8L", b"VP8X"):
        return "image/webp", n
    return None


def _zip(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    version, flags, method = struct.unpack_from("<HHH", b, at + 4)
    if version > 63 or method not in (0, 8, 9, 12, 14, 93, 95):
        return 0
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        piece = b[at:]
        while piece and not d.eof:
            d.decompress(piece, 1 << 20)
            piece = d.unconsumed_tail
    except zlib.error:
        return 0
    return len(b) - at - len(d.unused_data) if d.eof else 0


def _pdf(b: bytes, at: int) -> int:
    if at + 8 > len(b) or not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    # Up to the last end mark before the next file; incremental updates bring several, each with its cross-reference.
    stop, out = b.find(b"%PDF-", at + 5), 0
    stop, i = stop if stop >= 0 else len(b), at
    while (ref := b.find(b"startxref", i, stop)) >= 0 and (end := b.find(b"%%EOF", ref, stop)) >= 0 and b[ref + 9 : end].strip().isdigit():
        i, out = end + 5, end + 5 - at
    return out


def _of(kind: str, length: Callable[[bytes, int], int]) -> Callable[[bytes, int], tuple[str, int] | None]:
    return lambda b, at: (kind, n) if (n := length(b, at)) else None


#: Magic numbers of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": _of("image/png", _png),
    b"GIF87a": _of("image/gif", _gif),
    b"GIF89a": _of("image/gif", _gif),
    b"\xff\xd8\xff": _of("image/jpeg", _jpeg),
    b"BM": _of("image/bmp", _bmp),
    b"RIFF": _riff,
    b"PK\x03\x04": _of("application/zip", _zip),
    b"\x1f\x8b\x08": _of("application/gzip", _gzip),
    b"%PDF-": _of("application/pdf", _pdf),
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, check in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), check))
    a.make_automaton()
    return a


def found_media(a: ahocorasick.Automaton, b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed medium, by offset."""
    out = []
    for end, (n, check) in a.iter(b.decode("latin-1")):
        if got := check(b, end + 1 - n):
            out.append((end + 1 - n, got[1], got[0]))
    return sorted(out)


def inspect(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """``df`` with ``detected`` (the corrected type), ``corrected`` and ``embedded`` (array<struct<offset,length,type>>)."""
    names, fields = df.columns, df.schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "detected string, corrected boolean, embedded array<struct<offset:long,length:long,type:string>>"])
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            types, fixed, inner = [], [], []
            for data, said in zip(b[media], b[declared], strict=True):
                said, hits = said.as_py() or UNKNOWN, found_media(a, data.as_py() or b"")
                top = hits[0][2] if hits and hits[0][0] == 0 else said
                types.append(top)
                fixed.append(top != said)
                inner.append([{"offset": o, "length": n, "type": t} for o, n, t in hits if o])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(inner, kind)], [*names, "detected", "corrected", "embedded"])

    return df.mapInArrow(run, schema)


def carve(inspected: DataFrame, media: str = "media") -> DataFrame:
    """One row for each embedded medium: the columns but the medium and ``embedded``, then offset, type and bytes."""
    rows = inspected.withColumn("__e", F.explode("embedded"))
    piece = F.substring(F.col(media), (F.col("__e.offset") + 1).cast("int"), F.col("__e.length").cast("int"))
    kept = [c for c in inspected.columns if c not in (media, "embedded")]
    return rows.select(*kept, F.col("__e.offset").alias("offset"), F.col("__e.type").alias("type"), piece.alias("bytes"))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """``payload`` as 8-bit mono samples."""
    pad = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + pad


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text, padded with spaces to blocks, as a WAV file of no known type."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t.as_py() or "").encode() for t in b["text"]]
            files = [wav(r + b" " * (max(BLOCK, -(-len(r) // BLOCK) * BLOCK) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array([None] * len(raw), pa.string()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, media binary")


def read_back(inspected: DataFrame) -> DataFrame:
    """The digests of what the stored media hold, and their features."""
    kind = inspected.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names[2:]]
            for data, found, inner in zip(b["media"], b["detected"].to_pylist(), b["embedded"].to_pylist(), strict=True):
                data = data.as_py()
                if found != "audio/wav":
                    raise ValueError(f"stored as audio/wav, read back as {found}")
                at, n = wav_data(data)
                p = data[at : at + n]
                a = np.frombuffer(p, np.uint8)
                level = int(np.abs(a.astype(np.int16) - 128).sum()) * 1000 // n
                feature = f"{found};{RATE}Hz;1x8bit;samples={n};level={level};low={a.min()};high={a.max()};turns={int(np.count_nonzero(np.diff(a)))};embedded={len(inner)}"
                for c, v in zip(cols, (n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return inspected.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(inspect(store_texts(table(spark, sf_dir, "documents"))))
