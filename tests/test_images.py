import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import images as I
from quillspark.functions.images import header, image_facts, sniffed


def png(*chunks, color=2):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 640, 480, 8, color, 0, 0, 0)) + b"".join(chunk(*c) for c in chunks) + chunk(b"IEND", b"")


def jpeg(*segments, end=b"\xff\xd9", parts=3):
    seg = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + b"".join(seg(*s) for s in segments) + seg(0xC0, struct.pack(">BHHB", 8, 300, 400, parts) + b"\0" * 9) + b"\xff\xda" + end


def webp(*chunks):
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


GIF = b"GIF89a" + struct.pack("<HHBBB", 10, 20, 0, 0, 0) + b"\x21\xf9\x04\x01\0\0\0\0" + (b"\x2c" + b"\0" * 9 + b"\x02\x01\x00\x00") * 2 + b"\x3b"
EXIF = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"


@pytest.mark.parametrize(
    ("raw", "facts"),
    [
        (png(), {"format": "png", "width": 640, "height": 480, "has_alpha": False, "animated": False}), (png((b"tRNS", b"\0")), {"has_alpha": True}), (png((b"acTL", struct.pack(">II", 3, 0))), {"animated": True, "frames": 3}),
        (png()[:-6], {"error": "truncated"}), (jpeg(), {"format": "jpeg", "width": 400, "height": 300, "color_model": "ycc"}), (jpeg((0xE1, EXIF)), {"orientation": 6, "has_exif": True}), (jpeg((0xDB, b"\0" + b"\x01" * 64)), {"quality": 99}),
        (jpeg((0xE2, b"MPF\0")), {"multi_image": True}), (jpeg((0xEE, b"Adobe" + b"\0" * 6 + b"\x02"), parts=4), {"color_model": "ycck"}), (jpeg(end=b""), {"error": "truncated"}),
        (GIF, {"format": "gif", "width": 10, "height": 20, "frames": 2, "animated": True, "has_alpha": True}), (webp((b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 40))), {"width": 30, "height": 40, "lossless": False}),
        (webp((b"VP8L", b"\x2f" + struct.pack("<I", 29 | 39 << 14 | 1 << 28))), {"width": 30, "height": 40, "lossless": True, "has_alpha": True}), (webp((b"VP8X", bytes([2, 0, 0, 0]) + b"\x09\0\0\x13\0\0"), (b"ANMF", b"\0" * 16)), {"width": 10, "height": 20, "animated": True}),
        (b"", {"error": "empty"}), (b"text", {"error": "not-an-image"}),
    ],
)
def test_headers(raw, facts):
    got = header(raw)
    assert {k: got.get(k) for k in facts} == facts


def test_column(spark):
    df = spark.createDataFrame([(0, bytearray(png())), (1, None), (2, bytearray(GIF)), (3, bytearray(b"%PDF-1.7"))], "id int, b binary")
    got = df.select("id", image_facts("b").alias("i"), sniffed(F.col("b")).alias("s")).orderBy("id").collect()
    assert [(r["i"]["width"], r["i"]["error"], r["s"]) for r in got] == [(640, None, "png"), (None, "empty", None), (10, None, "gif"), (None, "not-an-image", "pdf")]


def test_sniffed_formats(spark):
    """Each container tells its own kinds apart; texts go by opening and extension."""
    box = lambda brand, more=b"": b"\x00\x00\x00\x18ftyp" + brand + b"\x00\x00\x00\x00" + more
    cases = [
        (box(b"mif1", b"avif"), "a.avif", "avif"), (box(b"heic"), "a.heic", "heic"), (box(b"qt  "), "a.mov", "mov"), (box(b"M4A "), "a.m4a", "m4a"), (box(b"3gp4"), "a.3gp", "3gp"), (box(b"M4V "), "a.m4v", "m4v"), (box(b"isom"), "a.mp4", "mp4"),
        (b"\x00\x00\x00\x08moov", "a.mov", "mov"), (b"\x1a\x45\xdf\xa3....webm", "a.webm", "webm"), (b"\x1a\x45\xdf\xa3....matroska", "a.mkv", "mkv"), (b"OggS" + b"\x00" * 24 + b"\x80theora", "a.ogv", "ogv"), (b"OggS" + b"\x00" * 24 + b"OpusHead", "a.opus", "opus"),
        (b"OggS" + b"\x00" * 24 + b"vorbis", "a.ogg", "ogg"), (b"FLV\x01", "a.flv", "flv"), (b"G" + b"\x00" * 187 + b"G", "a.ts", "mpegts"), (b"\xff\xfb\x90", "a.mp3", "mp3"), (b"OTTO", "a.otf", "otf"), (b"\x00\x01\x00\x00", "a.ttf", "ttf"),
        (b"PK\x03\x04", "a.odt", "odt"), (b"PK\x03\x04", "a.zip", "zip"), (b"ab\x01", "a.txt", "binary"), (b" <svg>", "a", "svg"), (b"<?xml?><svg>", "b.xml", "svg"), (b"WEBVTT\n", "x.txt", "vtt"), (b"body {}", "a.css", "css"), (b"<!DOCTYPE html>", "x", "html"), (b"", "x", "txt"),
    ]
    df = spark.createDataFrame([(i, bytearray(b), p) for i, (b, p, _) in enumerate(cases)], "i int, b binary, p string")
    fmt = I.content_format(F.col("b"), F.col("p"))
    got = df.select("i", fmt.alias("f"), I.kind_of(fmt).alias("k"), I.extension_matches(F.col("p"), fmt).alias("m")).orderBy("i").collect()
    assert [r["f"] for r in got] == [c[2] for c in cases]
    assert {r["m"] for r in got[:18]} == {True} and got[20]["m"] is None and got[24]["m"] is None and all(r["k"] for r in got)
    assert df.filter("i = 6").select(I.extension_matches(F.lit("x.png"), F.lit("mp4")).alias("m")).first()["m"] is False


def test_screenshot_rules(spark):
    png = lambda w, h: bytes.fromhex("89504E470D0A1A0A0000000D49484452") + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    cases = [(png(1280, 720), None), (png(600, 338), None), (png(599, 337), "not-16-9"), (png(1281, 720), "too-large"), (png(1000, 720), "not-16-9"), (png(1000, 0), "not-16-9"), (b"GIF89a", "not-png")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    assert [r["x"] for r in df.select("i", I.screenshot_problem(F.col("b")).alias("x")).orderBy("i").collect()] == [c[1] for c in cases]


def test_quality_rounds_halves_up():
    assert I._quality(bytes([43] * 63 + [57])) == 63 and I._quality(bytes([1] * 64)) == 99 and I._quality(bytes([255] * 64)) == 11
