"""Media columns: signature sniffing, validation, type correction, carving.

One Aho-Corasick automaton finds all magic bytes of a stored value in one pass over its bytes; a format's validator then walks the
structure at each hit (chunk and segment lengths, check sums where the format has them) and returns the length of the medium or
nothing. A medium that starts at byte 0 and is whole corrects the declared type; whole media further inside are carved as (offset,
length, type), outermost first, those within a carved one not again.

`stored` keeps a text losslessly as 8-bit mono samples in a RIFF/WAVE value: UTF-8 bytes and spaces up to a positive multiple of
192, with the unpadded length in a chunk of its own. `examined` reads stored values back and gives what it finds.

Defined cases: null and empty text: 192 spaces and n_bytes 0. Null media: no type, nothing carved, no payload. Broken or unknown
media keep their declared type and are marked not valid. Equal texts give equal values; repeated rows equal rows. Whole values are
read whatever their length (one at a time); a payload of 4 GiB or more, which RIFF can't hold, raises. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNIT, RATE = 192, 8000
#: Magic bytes, where they stand in the medium, and the type they speak for.
SIGNATURES = [
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"BM", 0, "image/bmp"),
    (b"ftyp", 4, "video/mp4"),
    (b"OggS", 0, "audio/ogg"),
    (b"fLaC", 0, "audio/flac"),
]


# ---------------------------------------------------------------- validators: (value, start) -> length or 0


def riff(v: bytes, at: int) -> int:
    if v[at + 8 : at + 12] != b"WAVE":
        return 0
    (n,) = struct.unpack_from("<I", v, at + 4)
    end, pos, seen = at + 8 + n, at + 12, set()
    if end > len(v):
        return 0
    while pos + 8 <= end:
        (size,) = struct.unpack_from("<I", v, pos + 4)
        seen.add(v[pos : pos + 4])
        pos += 8 + size + size % 2
    return end - at if pos == end and {b"fmt ", b"data"} <= seen else 0


def png(v: bytes, at: int) -> int:
    pos = at + 8
    while pos + 12 <= len(v):
        (size,) = struct.unpack_from(">I", v, pos)
        if pos + 12 + size > len(v) or struct.unpack_from(">I", v, pos + 8 + size)[0] != zlib.crc32(v[pos + 4 : pos + 8 + size]):
            return 0
        kind = v[pos + 4 : pos + 8]
        if pos == at + 8 and kind != b"IHDR":
            return 0
        pos += 12 + size
        if kind == b"IEND":
            return pos - at
    return 0


def gif(v: bytes, at: int) -> int:
    if at + 13 > len(v):
        return 0
    flags, pos = v[at + 10], at + 13
    pos += 3 << ((flags & 7) + 1) if flags & 128 else 0

    def blocks(p: int) -> int:
        while p < len(v) and v[p]:
            p += v[p] + 1
        return p + 1

    while pos < len(v):
        if v[pos] == 0x3B:
            return pos + 1 - at
        if v[pos] == 0x21:
            pos = blocks(pos + 2)
        elif v[pos] == 0x2C and pos + 10 <= len(v):
            flags = v[pos + 9]
            pos = blocks(pos + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return 0
    return 0


def jpeg(v: bytes, at: int) -> int:
    """Segments with their lengths; after the head of a scan its data, in which only escaped bytes and restarts follow an 0xFF, up to the next segment."""
    pos, scans = at + 2, 0
    while pos + 2 <= len(v) and v[pos] == 0xFF:
        mark = v[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at if scans else 0
        if not 0xC0 <= mark <= 0xFE or 0xD0 <= mark <= 0xD8 or pos + 4 > len(v):
            return 0
        (size,) = struct.unpack_from(">H", v, pos + 2)
        pos += 2 + size
        if size < 2 or pos > len(v):
            return 0
        if mark == 0xDA:
            scans += 1
            while (pos := v.find(b"\xff", pos)) >= 0 and pos + 1 < len(v) and (v[pos + 1] == 0 or 0xD0 <= v[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return 0
    return 0


class Places:
    """Where marks stand in a value: each mark is searched for once, however many media are tried."""

    def __init__(self, v: bytes):
        self.v, self.known = v, {}

    def after(self, mark: bytes, at: int) -> int:
        if mark not in self.known:
            self.known[mark] = [m.start() for m in re.finditer(re.escape(mark), self.v)]
        own = self.known[mark]
        i = bisect_left(own, at)
        return own[i] if i < len(own) else -1


def pdf(v: bytes, at: int, places: Places) -> int:
    if not v[at + 5 : at + 6].isdigit():
        return 0
    end = places.after(b"%%EOF", at)
    return end + 5 - at if 0 <= places.after(b"startxref", at) < end else 0


def zipped(v: bytes, at: int, places: Places) -> int:
    end = places.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(v):
        return 0
    size, start, note = struct.unpack_from("<IIH", v, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(v) and v[at + start : at + start + 4] == b"PK\x01\x02" else 0


def gzipped(v: bytes, at: int) -> int:
    try:
        d = zlib.decompressobj(31)
        for pos in range(at, len(v), 1 << 16):
            d.decompress(v[pos : pos + (1 << 16)])
            if d.eof:
                return min(pos + (1 << 16), len(v)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return 0


def bmp(v: bytes, at: int) -> int:
    if at + 30 > len(v):
        return 0
    size, spare, start, head = struct.unpack_from("<IIII", v, at + 2)
    planes = struct.unpack_from("<H", v, at + 26)[0]
    return size if spare == 0 and planes == 1 and head in (40, 108, 124) and 14 + head <= start <= size <= len(v) - at else 0


def mp4(v: bytes, at: int) -> int:
    pos, kinds = at, set()
    while pos + 8 <= len(v):
        (size,) = struct.unpack_from(">I", v, pos)
        kind = v[pos + 4 : pos + 8]
        if size < 8 or pos + size > len(v) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"wide", b"uuid", b"sidx", b"styp", b"meta"):
            break
        kinds.add(kind)
        pos += size
    return pos - at if {b"ftyp", b"moov"} <= kinds else 0


def ogg(v: bytes, at: int) -> int:
    pos = at
    while v[pos : pos + 4] == b"OggS" and pos + 27 <= len(v) and v[pos + 4] == 0:
        n = v[pos + 26]
        end = pos + 27 + n + sum(v[pos + 27 : pos + 27 + n])
        if end > len(v):
            return 0
        last, pos = v[pos + 5] & 4, end
        if last:
            return pos - at
    return 0


def _crc(bits: int, poly: int) -> list[int]:
    """Remainders of all bytes, most significant bit first."""
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & mask
        out.append(r)
    return out


CRC8, CRC16 = _crc(8, 0x07), _crc(16, 0x8005)


def flac_head(v: bytes, pos: int) -> int:
    """Length of a frame's head at pos, 0 if there is none: mark, number, sizes and the check byte must fit."""
    if pos + 6 > len(v) or v[pos] != 0xFF or v[pos + 1] & 0xFC != 0xF8 or v[pos + 2] >> 4 == 0 or v[pos + 2] & 15 == 15 or v[pos + 3] & 1:
        return 0
    lead = v[pos + 4]
    n = 1 if lead < 0x80 else next((k for k in range(2, 8) if lead >> (7 - k) & 1 == 0), 8)
    n += {6: 1, 7: 2}.get(v[pos + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(v[pos + 2] & 15, 0) + 4
    if pos + n >= len(v):
        return 0
    check = 0
    for x in v[pos : pos + n]:
        check = CRC8[check ^ x]
    return n + 1 if check == v[pos + n] else 0


def flac(v: bytes, at: int) -> int:
    """Blocks of metadata with their lengths, then frames, each from a head that fits to the first place where its check sum comes out and a
    frame follows or none does; frames are no shorter than the stream says."""
    pos, least = at + 4, 0
    while True:
        if pos + 4 > len(v):
            return 0
        last, size = v[pos] >> 7, int.from_bytes(v[pos + 1 : pos + 4], "big")
        if pos == at + 4:
            if v[pos] & 127 or size != 34 or pos + 38 > len(v):
                return 0
            least = int.from_bytes(v[pos + 8 : pos + 11], "big")
        pos += 4 + size
        if last:
            break
    end = 0
    while n := flac_head(v, pos):
        check, found = 0, 0
        for i in range(pos, len(v)):
            check = (check << 8 & 0xFFFF) ^ CRC16[check >> 8 ^ v[i]]
            if not check and i + 1 - pos >= max(least, n + 2):
                found = found or i + 1
                if flac_head(v, i + 1):
                    found = i + 1
                    break
        if not found:
            return 0
        pos = end = found
    return end - at if end else 0


VALIDATORS = {"audio/wav": riff, "image/png": png, "image/gif": gif, "image/jpeg": jpeg, "application/pdf": pdf, "application/zip": zipped, "application/gzip": gzipped, "image/bmp": bmp, "video/mp4": mp4, "audio/ogg": ogg, "audio/flac": flac}
#: Formats whose end is a mark somewhere behind.
SEARCHING = {"application/pdf", "application/zip"}
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, back, kind in SIGNATURES:
            a.add_word(magic.decode("latin-1"), (len(magic), back, kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def media_in(v: bytes) -> list[tuple[int, int, str]]:
    """All whole media of a value: (offset, length, type), by offset; those within an embedded one aren't listed, those within one at 0 are."""
    out, free, places = [], 0, Places(v)
    for end, (n, back, kind) in sorted(automaton().iter(v.decode("latin-1")), key=lambda x: x[0] - x[1][0] + 1 - x[1][1]):
        at = end - n + 1 - back
        if at < free or at < 0:
            continue
        try:
            length = VALIDATORS[kind](v, at, places) if kind in SEARCHING else VALIDATORS[kind](v, at)
        except (struct.error, IndexError):
            length = 0
        if length:
            out.append((at, length, kind))
            free = at + length if at else 1
    return out


def wave(payload: bytes, n: int) -> bytes:
    """RIFF/WAVE with 8-bit mono samples, and the unpadded length in `olen`."""
    if len(payload) >= 2**32 - 64:
        raise ValueError("RIFF holds less than 4 GiB")
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    own = struct.pack("<4sIQ", b"olen", 8, n)
    body = b"WAVE" + fmt + own + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def samples(v: bytes) -> tuple[bytes, int | None, int, int]:
    """(samples, unpadded length, rate, bits) of a whole RIFF/WAVE value."""
    (n,) = struct.unpack_from("<I", v, 4)
    pos, data, own, rate, bits = 12, b"", None, 0, 0
    while pos + 8 <= 8 + n:
        kind, (size,) = v[pos : pos + 4], struct.unpack_from("<I", v, pos + 4)
        if kind == b"fmt ":
            rate, bits = struct.unpack_from("<I", v, pos + 12)[0], struct.unpack_from("<H", v, pos + 22)[0]
        elif kind == b"olen":
            (own,) = struct.unpack_from("<Q", v, pos + 8)
        elif kind == b"data":
            data = v[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    return data, own, rate, bits


def stored(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, declared, media."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                out.append(wave(raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([declared] * len(out), pa.string()), pa.array(out, pa.binary())], ["doc_id", "declared", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, declared string, media binary")


EXAMINED = "doc_id long, declared string, media_type string, corrected boolean, valid boolean, media_bytes long, media_sha256 string, carved array<struct<offset:long,length:long,kind:string>>, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _features(kind: str | None, payload: bytes, rate: int, bits: int, carved: int) -> str:
    """Type, rate, bits, frames; mean, root mean square and zero crossings about the middle of the range; number of embedded media."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"{kind};rate={rate};bits={bits};frames={len(x)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};carved={carved}"


def examined(media: DataFrame) -> DataFrame:
    """What sniffing finds in each value of `media` (doc_id, declared, media), and the payload's digests where it is a RIFF/WAVE value."""

    def one(declared, v):
        if v is None:
            return (declared, None, False, False, None, None, [], None, None, None, None, None)
        found = media_in(v)
        whole = next((m for m in found if m[0] == 0 and m[1] == len(v)), None)
        kind = whole[2] if whole else declared
        carved = [{"offset": a, "length": n, "kind": k} for a, n, k in found if (a, n, k) != whole]
        head = (declared, kind, whole is not None and kind != declared, whole is not None, len(v), hashlib.sha256(v).hexdigest(), carved)
        if not whole or kind != "audio/wav":
            return (*head, None, None, None, None, None)
        data, own, rate, bits = samples(v)
        return (*head, own, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), _features(kind, data, rate, bits, len(carved)) if data else None)

    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())])), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["declared", "media_type", "corrected", "valid", "media_bytes", "media_sha256", "carved", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def run(batches):
        for batch in batches:
            rows = [one(d, v.as_py()) for d, v in zip(batch.column("declared").to_pylist(), batch.column("media"), strict=True)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return media.select("doc_id", "declared", "media").mapInArrow(run, EXAMINED)
