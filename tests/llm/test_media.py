import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from sparklake.llm import media as m
from sparklake.llm.queries import QUERIES


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def ogg(last=4):
    return b"OggS\0" + bytes([last]) + b"\0" * 20 + b"\x01\x03abc"


SAMPLES = {
    "image/png": png(),
    "image/gif": b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;",
    "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\x12\xff\0\x34\xff\xd9",
    "audio/wav": m.to_wav(b"12345"),
    "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
    "application/ogg": ogg(),
    "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF",
    "application/zip": zipped(),
    "video/mp4": struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + struct.pack(">I4s", 12, b"mdat") + b"1234",
    "audio/flac": b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8rest",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_signatures(kind):
    b = SAMPLES[kind]
    assert m.sniff(b) == [(kind, 0, len(b))]
    assert [(k, a) for k, a, _ in m.sniff(b"junk" * 3 + b)] == [(kind, 12)]
    if kind not in ("audio/flac", "application/pdf"):
        assert m.sniff(b + b"tail")[0] == (kind, 0, len(b))
    assert not [x for x in m.sniff(b[: len(b) // 2]) if x[0] == kind]


def test_magic_alone_proves_nothing():
    assert m.sniff(b"BMW and %PDF- and GIF89a and RIFF....WAVE PK\x03\x04 ftyp OggS fLaC \xff\xd8\xff \x89PNG\r\n\x1a\n") == []
    assert m.sniff(b"") == []


def test_types_are_corrected_and_media_carved(spark):
    wav, p = SAMPLES["audio/wav"], SAMPLES["image/png"]
    rows = [(1, p, "image/jpeg", "x"), (2, wav + b"..." + p, "audio/wav", None), (3, None, None, None), (4, b"", "image/png", ""), (5, b"just text", "application/octet-stream", "t"), (1, p, "image/jpeg", "x")]
    df = spark.createDataFrame(rows, "k long, b binary, t string, type string")
    got = {r.id: r for r in m.sniff_media(df, "k", "b", "t").collect()}
    assert (got[1].type, got[1].corrected, got[1].media_bytes) == ("image/png", True, len(p))
    assert not got[2].corrected and [(e.type, e.offset, e.bytes, e.sha256) for e in got[2].embedded] == [("image/png", len(wav) + 3, len(p), hashlib.sha256(p).hexdigest())]
    assert got[3].corrected and got[4].corrected and not got[5].corrected and got[5].media_bytes == 0
    assert m.sniff_media(df, "k", "b", "t").count() == 6 and m.sniff_media(df.limit(0), "k", "b", "t").count() == 0
    names = spark.createDataFrame([("a/b.JPG",), ("x",), (None,)], "n string")
    assert [r[0] for r in names.select(m.mime_of_extension(names.n)).collect()] == ["image/jpeg", None, None]


def test_wav_round_trip():
    for payload in (b"", b"a", bytes(range(256))):
        assert m.from_wav(m.to_wav(payload)) == (payload, m.RATE)
    for bad in (b"", b"RIFF", m.to_wav(b"x")[:40]):
        with pytest.raises(ValueError, match="no samples"):
            m.from_wav(bad)


def test_query(spark, sf_dir, texts_by_id):
    rows = QUERIES["op7_media_columns"](spark, sf_dir).collect()
    assert len(rows) == len(texts_by_id)
    for r in rows:
        raw = texts_by_id[r.doc_id].encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        stored = m.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.type, r.declared) == (len(stored), hashlib.sha256(stored).hexdigest(), "audio/wav", "application/octet-stream")


def test_odd_rows(odd, none):
    rows = m.read_features(m.store_texts(odd)).collect()
    assert len(rows) == odd.count() and m.read_features(m.store_texts(none)).count() == 0
    by = {r.id: r for r in rows}
    assert by[3].payload_bytes == 192 and by[3].n_bytes == 0 and by[3].feature == by[4].feature and by[1].feature == by[2].feature
