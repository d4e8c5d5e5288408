"""Media columns: what kind of media a binary value really is, and which media lie inside it.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. Each find is then put to its
format's validator, which reads the structure that follows (chunk lists, segment chains, page headers, trailers) and
says how long the object is; what a validator doesn't confirm is no medium. The object at byte 0 decides the type,
whatever was declared; the others are carved out as embedded media.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick, table, texts

# The magic bytes of the formats and how far into an object they stand.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"WAVE": ("audio/wav", 8),
    b"WEBP": ("image/webp", 8),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("application/ogg", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"ftyp": ("video/mp4", 4),
}


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + n
        if end > len(b) or first != (kind == b"IHDR") or first and n != 13:
            return 0
        if binascii.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data up to a marker that is neither stuffed nor a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at if frame else 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7 or b[p + 1] == 0xFF:
                    p += 2 - (b[p + 1] == 0xFF)
                    continue
                break
            else:
                return 0
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 * 2 ** ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 * 2 ** ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, spare, data, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26) if head >= 16 else (1, 1)
    ok = spare == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= data <= size <= len(b) - at
    return size if ok and planes == 1 and bits in (1, 4, 8, 16, 24, 32) else 0


def _riff(b: bytes, at: int) -> int:
    if at < 0 or b[at : at + 4] != b"RIFF":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        seen.add(kind)
        p += 8 + n + (n & 1)
    need = {b"fmt ", b"data"} if b[at + 8 : at + 12] == b"WAVE" else seen & {b"VP8 ", b"VP8L", b"VP8X"}
    return end - at if seen and need and need <= seen and p in (end, end + 1) else 0


def _flac(b: bytes, at: int) -> int:
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind & 0x7F or n != 34) or p + 4 + n > len(b):
            return 0
        p, first = p + 4 + n, False
        if kind & 0x80:  # frames have no length of their own: up to the value's end, if one begins here
            return len(b) - at if b[p : p + 1] == b"\xff" and p + 1 < len(b) and b[p + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(b: bytes, at: int) -> int:
    p, pages = at, 0
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b) or p + 27 + n > len(b):
            break
        last, p, pages = b[p + 5] & 4, end, pages + 1
        if last:
            break
    return p - at if pages else 0


def _pdf(b: bytes, at: int) -> int:
    stop = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    return end + 5 - at if end > 0 and b[at + 5 : at + 6].isdigit() and b.find(b"startxref", at, end) > 0 else 0


def _zip(b: bytes, at: int) -> int:
    if at + 30 > len(b) or struct.unpack_from("<H", b, at + 4)[0] > 63:
        return 0
    p = at
    while (p := b.find(b"PK\x05\x06", p)) > 0 and p + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, p + 12)
        if at + start + size == p and b[at + start : at + start + 4] == b"PK\x01\x02" and p + 22 + note <= len(b):
            return p + 22 + note - at
        p += 4
    return 0


def _mp4(b: bytes, at: int) -> int:
    p, boxes = at, 0
    while 0 <= p and p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if boxes == 0 and (kind != b"ftyp" or n > 4096 or n % 4) or n < 8 or p + n > len(b) or not kind.isalnum():
            break
        p, boxes = p + n, boxes + 1
    return p - at if boxes >= 2 else 0


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff, "image/webp": _riff, "audio/flac": _flac, "application/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "video/mp4": _mp4}


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, (kind, before) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind, before))
    a.make_automaton()
    return a


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media in value, by offset; none begins inside another."""
    found, free = [], 0
    hits = sorted({(end + 1 - n - before, kind) for end, (n, kind, before) in automaton().iter(value.decode("latin-1"))})
    for at, kind in hits:
        if at >= free and (n := VALIDATORS[kind](value, at)):
            found.append((kind, at, n))
            free = at + n
    return found


SNIFFED = "id long, declared string, type string, corrected boolean, media_bytes long, embedded array<struct<type:string,offset:long,bytes:long,sha256:string>>"


def _sniff(batches):
    for batch in batches:
        rows = []
        for key, value, declared in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = sniff(value or b"")
            own = found[0] if found and found[0][1] == 0 else None
            kind = own[0] if own else "application/octet-stream"
            inner = [{"type": k, "offset": at, "bytes": n, "sha256": hashlib.sha256(value[at : at + n]).hexdigest()} for k, at, n in found if at]
            rows.append({"id": key, "declared": declared, "type": kind, "corrected": declared != kind, "media_bytes": own[2] if own else 0, "embedded": inner})
        inner = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("declared", pa.string()), ("type", pa.string()), ("corrected", pa.bool_()), ("media_bytes", pa.int64()), ("embedded", inner)]))


def sniff_media(media: DataFrame, id_col: str, bytes_col: str, declared_col: str) -> DataFrame:
    """(id, declared, type, corrected, media_bytes, embedded) of every row of media.

    type: what the bytes at offset 0 prove to be, else application/octet-stream; corrected: it isn't what was declared
    (a null declaration counts as another type). media_bytes: that object's length, 0 if none. embedded: the confirmed
    media that begin after byte 0, outside any other, by offset. Null and empty values hold no media. Rows don't depend
    on one another; repeated rows give repeated results, an empty table none; other columns are not looked at.
    """
    bounded_batches(media.sparkSession)
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{bytes_col}`").cast("binary").alias("value"), F.col(f"`{declared_col}`").cast("string").alias("declared")]
    return media.select(cols).mapInArrow(_sniff, SNIFFED)


RATE, FRAME = 16_000, 192


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as unsigned 8-bit mono samples in a RIFF/WAVE file."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono RIFF/WAVE file; ValueError if it is none."""
    p, rate = 12, 0
    while media[:4] == b"RIFF" and p + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, p + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return media[p + 8 : p + 8 + n], rate
        p += 8 + n + (n & 1)
    raise ValueError("no samples")


STORED = "id long, n_bytes long, declared string, media binary"


def _store(batches):
    for batch in batches:
        ids, n, media = batch.column(0).to_pylist(), [], []
        for text in texts(batch.column(1)).cast(pa.large_binary()).to_pylist():
            n.append(len(text))
            media.append(to_wav(text + b" " * (FRAME * max(1, -(-len(text) // FRAME)) - len(text))))
        kinds = pa.array(["application/octet-stream"] * len(ids), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), kinds, pa.array(media, pa.binary())], names=["id", "n_bytes", "declared", "media"])


def store_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each whole text's UTF-8, filled with spaces to a positive multiple of FRAME bytes,
    as the samples of an 8-bit WAV file that is declared as nothing in particular. Null counts as empty."""
    bounded_batches(documents.sparkSession)
    return pick(documents, id_col, text_col).mapInArrow(_store, STORED)


READ = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, type string, embedded long"


def _features(batches):
    import numpy as np

    for batch in batches:
        rows = []
        for key, n, declared, media in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = sniff(media)
            kind, at, size = found[0] if found and found[0][1] == 0 else ("application/octet-stream", 0, len(media))
            payload, rate = from_wav(media[at : at + size])
            wave = np.frombuffer(payload, np.uint8)
            turns = int(np.count_nonzero((wave[1:] >= 128) != (wave[:-1] >= 128)))
            level = int(wave.sum(dtype=np.int64))
            feature = f"{kind};rate={rate};frames={len(wave) // FRAME};low={int(wave.min())};high={int(wave.max())};sum={level};turns={turns}"
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, declared, kind, len(found) - (at == 0 and kind != "application/octet-stream")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in READ.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_features(stored: DataFrame) -> DataFrame:
    """The columns of READ for every row of store_texts(): the type that the stored bytes prove to have, the samples
    read back from them, their digests, and a feature string (least, greatest and summed sample, crossings of the
    middle). Equal texts give equal values."""
    return stored.mapInArrow(_features, READ)


def mime_of_extension(path: Column) -> Column:
    """The type that a file name claims, for a declared_col; null if its ending says nothing."""
    # The usual file endings of the formats.
    claims = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp", "flac": "audio/flac", "ogg": "application/ogg", "pdf": "application/pdf", "zip": "application/zip", "mp4": "video/mp4"}
    ending, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit(None).cast("string")
    for k, v in claims.items():
        out = F.when(ending == k, v).otherwise(out)
    return out


def op7_media_columns(spark, sf_dir):
    stored = store_texts(table(spark, sf_dir, "documents"))
    return read_features(stored).withColumnRenamed("id", "doc_id")
