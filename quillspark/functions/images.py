"""Facts from image headers: a column of bytes to a column of structs. A file that can't be read gives an error, never an exception."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from .paths import extname

_KINDS = {"format": StringType(), "width": IntegerType(), "height": IntegerType(), "bit_depth": IntegerType(), "color_model": StringType(), "has_alpha": BooleanType(), "animated": BooleanType(), "frames": IntegerType(), "multi_image": BooleanType(), "progressive": BooleanType(), "lossless": BooleanType(), "orientation": IntegerType(), "quality": IntegerType(), "has_icc": BooleanType(), "has_exif": BooleanType(), "has_xmp": BooleanType(), "error": StringType()}
IMAGE = StructType([StructField(k, v) for k, v in _KINDS.items()])


def _orientation(tiff: bytes) -> int | None:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return None
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(n):
        tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * i)
        if tag == 0x112:
            return value if 1 <= value <= 8 else None
    return None


def _quality(table: bytes) -> int:
    """The quality at which the standard luma table, 3688 in sum at 50, has this sum."""
    share = sum(table) / 3688
    return max(1, min(100, math.floor((100 - 50 * share if share <= 1 else 50 / share) + 0.5)))


def _jpeg(b: bytes) -> dict:
    out = {"format": "jpeg", "has_alpha": False, "animated": False, "multi_image": False, "has_icc": False, "has_exif": False, "has_xmp": False}
    at, adobe = 2, None
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return out | {"error": "bad-marker"}
        mark = b[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 1:
            at += 1 if mark == 0xFF else 2
            continue
        if mark in (0xD9, 0xDA):
            break
        (size,) = struct.unpack_from(">H", b, at + 2)
        body = b[at + 4 : at + 2 + size]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            depth, height, width, parts = struct.unpack_from(">BHHB", body)
            out |= {"bit_depth": depth, "height": height, "width": width, "progressive": mark in (0xC2, 0xC6, 0xCA, 0xCE), "lossless": mark in (0xC3, 0xC7, 0xCB), "color_model": {1: "gray", 3: "ycc", 4: "cmyk"}.get(parts)}
        elif mark == 0xDB and body[:1] == b"\0" and "quality" not in out:
            out["quality"] = _quality(body[1:65])
        elif mark == 0xE1 and body.startswith(b"Exif\0"):
            out |= {"has_exif": True, "orientation": _orientation(body[6:])}
        elif mark == 0xE1 and body.startswith(b"http://ns.adobe.com/"):
            out["has_xmp"] = True
        elif mark == 0xE2:
            out["has_icc"] |= body.startswith(b"ICC_PROFILE\0")
            out["multi_image"] |= body.startswith(b"MPF\0")
        elif mark == 0xEE and body.startswith(b"Adobe") and len(body) >= 12:
            adobe = body[11]
        at += 2 + size
    if adobe == 2 and out.get("color_model") == "cmyk":
        out["color_model"] = "ycck"
    if "width" not in out:
        return out | {"error": "no-frame-header"}
    return out if b.rfind(b"\xff\xd9", max(0, len(b) - 4096)) >= 0 else out | {"error": "truncated"}


def _png(b: bytes) -> dict:
    out = {"format": "png", "lossless": True, "animated": False, "multi_image": False, "has_icc": False, "has_exif": False, "has_xmp": False}
    at, ended = 8, False
    while at + 12 <= len(b) and not ended:
        (size,) = struct.unpack_from(">I", b, at)
        kind, body = b[at + 4 : at + 8], b[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color = struct.unpack_from(">IIBB", body)
            out |= {"width": width, "height": height, "bit_depth": depth, "has_alpha": color in (4, 6), "color_model": {0: "gray", 2: "rgb", 3: "palette", 4: "gray", 6: "rgb"}.get(color), "progressive": body[12] == 1}
        elif kind == b"tRNS":
            out["has_alpha"] = True
        elif kind == b"acTL":
            out |= {"animated": True, "frames": struct.unpack_from(">I", body)[0]}
        elif kind == b"iCCP":
            out["has_icc"] = True
        elif kind == b"eXIf":
            out |= {"has_exif": True, "orientation": _orientation(body)}
        elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp"):
            out["has_xmp"] = True
        ended = kind == b"IEND"
        at += 12 + size
    return out if ended and at <= len(b) else out | {"error": "truncated"}


def _gif(b: bytes) -> dict:
    width, height, flags = struct.unpack_from("<HHB", b, 6)
    out = {"format": "gif", "width": width, "height": height, "bit_depth": 8, "color_model": "palette", "lossless": True, "has_alpha": False, "multi_image": False}
    at, frames = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0

    def blocks(at: int) -> int:
        while b[at]:
            at += b[at] + 1
        return at + 1

    while b[at] != 0x3B:
        if b[at] == 0x21:
            if b[at + 1] == 0xF9:
                out["has_alpha"] |= bool(b[at + 3] & 1)
            at = blocks(at + 2)
        elif b[at] == 0x2C:
            frames, own = frames + 1, b[at + 9]
            at = blocks(at + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
        else:
            return out | {"error": "bad-block"}
    return out | {"frames": frames, "animated": frames > 1}


def _webp(b: bytes) -> dict:
    out = {"format": "webp", "bit_depth": 8, "color_model": "rgb", "animated": False, "multi_image": False, "has_alpha": False, "lossless": False, "has_icc": False, "has_exif": False, "has_xmp": False}
    at, frames, end = 12, 0, min(len(b), 8 + struct.unpack_from("<I", b, 4)[0])
    while at + 8 <= end:
        kind, (size,) = b[at : at + 4], struct.unpack_from("<I", b, at + 4)
        body = b[at + 8 : at + 8 + size]
        if kind == b"VP8X":
            flags = body[0]
            wide = lambda k: int.from_bytes(body[k : k + 3], "little") + 1  # noqa: B023, E731
            out |= {"width": wide(4), "height": wide(7), "has_icc": bool(flags & 32), "has_alpha": bool(flags & 16), "has_exif": bool(flags & 8), "has_xmp": bool(flags & 4), "animated": bool(flags & 2)}
        elif kind == b"VP8 " and "width" not in out:
            width, height = struct.unpack_from("<HH", body, 6)
            out |= {"width": width & 0x3FFF, "height": height & 0x3FFF}
        elif kind == b"VP8L":
            bits = int.from_bytes(body[1:5], "little")
            out["lossless"] = True
            out["has_alpha"] |= bool(bits >> 28 & 1)
            out.setdefault("width", (bits & 0x3FFF) + 1), out.setdefault("height", (bits >> 14 & 0x3FFF) + 1)
        frames += kind == b"ANMF"
        at += 8 + size + size % 2
    if frames:
        out["frames"] = frames
    return out if at <= len(b) and "width" in out else out | {"error": "truncated"}


def header(b: bytes | None) -> dict:
    if not b:
        return {"error": "empty"}
    try:
        if b.startswith(b"\xff\xd8\xff"):
            return _jpeg(b)
        if b.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png(b)
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return _gif(b)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
    except (struct.error, IndexError):
        return {"error": "truncated"}
    return {"error": "not-an-image"}


@F.pandas_udf(IMAGE)
def image_facts(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(b) for b in content], columns=list(_KINDS)).astype(object).where(lambda d: d.notna(), None)


def _first(rules: list[tuple[Column, str]]) -> Column:
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def sniffed(content: Column) -> Column:
    """The format that a file's first 512 bytes show, or null."""
    head = F.substring(content, 1, 512)
    starts = lambda h: head.startswith(F.lit(bytes.fromhex(h)))
    at = lambda k, h: F.substring(head, k + 1, len(h) // 2) == F.lit(bytes.fromhex(h))
    text = lambda k, n: F.decode(F.substring(head, k + 1, n), "ISO-8859-1")
    riff, box, brand = starts("52494646"), text(4, 4), text(8, 4)
    media = _first([
        (text(8, 64).rlike("avif|avis"), "avif"), (brand.isin("heic", "heix", "mif1", "msf1", "heis"), "heic"), (brand == "qt  ", "mov"), (brand.isin("M4A ", "M4B "), "m4a"),
        (brand.startswith("3g"), "3gp"), (brand.isin("M4V ", "M4VH", "M4VP"), "m4v"), (F.lit(True), "mp4"),
    ])
    second = F.conv(F.hex(F.substring(head, 2, 1)), 16, 10).cast("int")
    mpeg_audio = starts("FF") & (second.bitwiseAND(0xE0) == 0xE0) & (second.bitwiseAND(6) != 0)
    rules = [
        (starts("FFD8FF"), "jpeg"), (starts("89504E470D0A1A0A"), "png"), (starts("474946383761") | starts("474946383961"), "gif"), (riff & at(8, "57454250"), "webp"), (riff & at(8, "41564920"), "avi"), (riff & at(8, "57415645"), "wav"),
        (box == "ftyp", media), (box.isin("moov", "mdat", "wide", "free", "skip", "pnot"), "mov"),
        (starts("1A45DFA3"), F.when(F.contains(text(0, 64), F.lit("webm")), "webm").otherwise("mkv")),
        (starts("4F676753"), F.when(F.contains(text(0, 128), F.lit("theora")), "ogv").when(F.contains(text(0, 128), F.lit("OpusHead")), "opus").otherwise("ogg")),
        (starts("464C56"), "flv"), (starts("000001BA"), "mpeg"), (starts("47") & at(188, "47"), "mpegts"), (starts("3026B2758E66CF11A6D900AA0062CE6C"), "asf"),
        (starts("494433") | mpeg_audio, "mp3"), (starts("664C6143"), "flac"), (starts("464F524D") & (at(8, "41494646") | at(8, "41494643")), "aiff"),
        (starts("424D"), "bmp"), (starts("00000100"), "ico"), (starts("49492A00") | starts("4D4D002A"), "tiff"), (starts("255044462D"), "pdf"), (starts("774F4646"), "woff"), (starts("774F4632"), "woff2"), (starts("4F54544F"), "otf"), (starts("00010000"), "ttf"), (starts("504B0304"), "zip"),
    ]
    return _first(rules)


#: The kind of each format, and the formats that an extension may hold.
KINDS = {
    "image": ("jpeg", "png", "gif", "webp", "avif", "heic", "bmp", "ico", "tiff", "svg"), "video": ("avi", "mov", "3gp", "m4v", "mp4", "webm", "mkv", "ogv", "flv", "mpeg", "mpegts", "asf"),
    "audio": ("wav", "m4a", "opus", "ogg", "mp3", "flac", "aiff"), "document": ("pdf", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub"), "font": ("woff", "woff2", "otf", "ttf"), "archive": ("zip",),
    "text": ("html", "css", "js", "json", "xml", "dtd", "srt", "vtt", "txt", "csv"), "unknown": ("binary",),
}
TEXT_EXTENSIONS = {"html": "html", "htm": "html", "xhtml": "html", "css": "css", "js": "js", "mjs": "js", "json": "json", "xml": "xml", "xsd": "xml", "dtd": "dtd", "srt": "srt", "vtt": "vtt", "txt": "txt", "md": "txt", "csv": "csv"}
EXTENSION_FORMATS = {
    "jpg": ("jpeg",), "jpeg": ("jpeg",), "jpe": ("jpeg",), "png": ("png",), "apng": ("png",), "gif": ("gif",), "webp": ("webp",), "avif": ("avif",), "heic": ("heic",), "svg": ("svg",), "bmp": ("bmp",), "ico": ("ico",),
    "tif": ("tiff",), "tiff": ("tiff",), "mp4": ("mp4", "m4v", "mov", "3gp"), "m4v": ("mp4", "m4v", "mov"), "mov": ("mov", "mp4", "m4v"), "webm": ("webm", "mkv"), "mkv": ("mkv", "webm"), "ogv": ("ogv",),
    "ogg": ("ogg", "ogv", "opus"), "oga": ("ogg", "opus"), "opus": ("opus", "ogg"), "avi": ("avi",), "flv": ("flv",), "mpg": ("mpeg", "mpegts"), "mpeg": ("mpeg", "mpegts"), "ts": ("mpegts",), "wmv": ("asf",),
    "3gp": ("3gp", "mp4"), "mp3": ("mp3",), "m4a": ("m4a", "mp4"), "aac": ("aac", "mp3"), "wav": ("wav",), "flac": ("flac",), "aif": ("aiff",), "aiff": ("aiff",), "pdf": ("pdf",), "woff": ("woff",), "woff2": ("woff2",),
    "ttf": ("ttf",), "otf": ("otf",), "zip": ("zip",),
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def content_format(content: Column, path: Column) -> Column:
    """The format of an entry: by its first bytes; for texts by what they open with, then by the extension; binary if it holds control bytes."""
    ext, magic = extname(path), sniffed(content)
    head = F.substring(content, 1, 512)
    binary = F.decode(head, "ISO-8859-1").rlike("[\\x00-\\x08]")
    start = F.lower(F.ltrim(F.regexp_replace(F.decode(F.substring(head, 1, 256), "ISO-8859-1"), "^\u00ef\u00bb\u00bf|^\\s+", "")))
    office = (magic == "zip") & ext.isin("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")
    svg = start.startswith("<svg") | (start.startswith("<?xml") & F.contains(start, F.lit("<svg"))) | ((ext == "svg") & start.startswith("<"))
    page = start.startswith("<!doctype html") | start.startswith("<html")
    return F.when(office, ext).when(magic.isNotNull(), magic).when(binary, "binary").when(svg, "svg").when(start.startswith("webvtt"), "vtt").otherwise(F.coalesce(_lookup(TEXT_EXTENSIONS, ext), F.when(page, "html").otherwise("txt")))


def kind_of(fmt: Column) -> Column:
    """image, video, audio, document, font, archive, text or unknown."""
    return _first([(fmt.isin(*formats), kind) for kind, formats in KINDS.items()])


def extension_matches(path: Column, fmt: Column) -> Column:
    """Whether an entry's extension fits its format; null for texts and for extensions that promise nothing."""
    tests = [(extname(path) == e, fmt.isin(*formats)) for e, formats in EXTENSION_FORMATS.items()]
    return F.when(kind_of(fmt) == "text", None).otherwise(_first(tests))


def screenshot_problem(content: Column) -> Column:
    """Why an image can't be a package's thumbnail; null if it can: a PNG of at most 1280 x 720 and 8 MiB, near 16:9, at least 600 wide."""
    png = content.startswith(F.lit(bytes.fromhex("89504E470D0A1A0A0000000D49484452"))) & (F.octet_length(content) >= 24)
    side = lambda k: F.conv(F.hex(F.substring(content, k, 4)), 16, 10).cast("long")
    width, height = side(17), side(21)
    fits = (width >= 600) & (height > 0) & (F.abs(width / F.nullif(height, F.lit(0)) - 16 / 9) < 0.05)
    return _first([(F.octet_length(content) > 8 << 20, "too-many-bytes"), (~png, "not-png"), ((width > 1280) | (height > 720), "too-large"), (~F.coalesce(fits, F.lit(False)), "not-16-9")])
