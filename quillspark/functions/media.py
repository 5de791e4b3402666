"""Decisions on media resources, as columns: a reason to skip, or the values of the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded

#: Quality, WebP quality and longest side of each preset; audio kb/s.
IMAGE_PRESETS = {"conservative": (90, 90, 2560), "balanced": (82, 82, 1920), "aggressive": (72, 75, 1600)}
AUDIO_PRESETS = {"conservative": 192, "balanced": 128, "aggressive": 96}
LOSSLESS_AUDIO = ("wav", "aiff", "flac")
LOSSY_CODECS = {"mp3": "mp3", "m4a": "aac", "webm": "opus", "ogg": "opus", "opus": "opus"}
SAMPLE_RATES = (48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000)
LOSSY_HEADROOM = 1.4


def _first(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; unknown counts as not holding."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def long_side(width: Column, height: Column, most: int, fixed: Column) -> Column:
    """The factor by which an image shrinks; null if it keeps its size."""
    side = F.greatest(width, height)
    return F.when((side > most) & ~fixed, most / side)


def image_skip(image: Column, preset: str = "balanced", png: bool = True, force: bool = False, encoders: tuple[str, ...] = ("jpeg", "png", "webp"), most_bytes: int | None = 256 << 20, most_pixels: int | None = 100_000_000) -> Column:
    """Why an image stays as it is; null if it is encoded anew. A limit of None doesn't bind.

    image: struct format, size, width, height, animated, multi_image, color_model, bit_depth, lossless, quality, extension_matches, fixed_size, error.
    """
    i = lambda name: image[name]
    quality, _, side = IMAGE_PRESETS[preset]
    keeps = long_side(i("width"), i("height"), side, i("fixed_size")).isNull() & F.lit(not force)
    return _first(
        (F.lit(not encoders), "engine-unavailable"),
        (i("format") == "svg", "vector-image"),
        (~i("format").isin("jpeg", "png", "webp"), "unsupported-format"),
        (i("error").isNotNull() | (F.coalesce(i("width") * i("height"), F.lit(0)) == 0), "corrupt"),
        (i("extension_matches").eqNullSafe(False), "extension-mismatch"),
        (i("animated"), "animated"),
        (i("multi_image"), "multi-image"),
        (i("color_model").isin("cmyk", "ycck"), "cmyk"),
        (i("bit_depth") > 8, "high-bit-depth"),
        (F.lit(False) if most_bytes is None else i("size") > most_bytes, "exceeds-size-limit"),
        (F.lit(False) if most_pixels is None else i("width").cast("long") * i("height") > most_pixels, "exceeds-resolution-limit"),
        (~i("format").isin(*(encoders or ("",))), "engine-capability"),
        ((i("format") == "png") & F.lit(not png), "png-disabled"),
        ((i("format") == "jpeg") & keeps & (i("quality") <= quality + 2), "already-efficient"),
        ((i("format") == "webp") & ~F.coalesce(i("lossless"), F.lit(False)) & keeps, "already-efficient"),
    )


def image_estimate(image: Column, preset: str = "balanced") -> Column:
    """A rough size after encoding."""
    jpeg, webp, _ = IMAGE_PRESETS[preset]
    lossy = F.when(image["format"] == "jpeg", jpeg / 100).when((image["format"] == "webp") & ~F.coalesce(image["lossless"], F.lit(False)), webp / 100)
    return rounded(image["size"] * F.when(lossy.isNull(), 0.9).otherwise(F.least(F.lit(0.95), lossy)))


def audio_rate(channels: Column, opus: Column, kbps: int) -> Column:
    """The target kb/s: half for one channel, and for Opus half of that."""
    mono = F.coalesce(channels, F.lit(2)) <= 1
    return F.when(opus, F.when(mono, max(32, int(kbps / 4 + 0.5))).otherwise(max(48, int(kbps / 2 + 0.5)))).otherwise(F.when(mono, max(64, int(kbps / 2 + 0.5))).otherwise(kbps))


def sample_rate(source: Column, opus: Column) -> Column:
    fits = F.filter(F.array(*[F.lit(r) for r in SAMPLE_RATES]), lambda r: r <= F.coalesce(source, F.lit(44100)))
    return F.when(opus, 48000).otherwise(F.coalesce(F.get(fits, 0), F.lit(8000)))


def audio_skip(audio: Column, preset: str = "balanced", force: bool = False, available: bool = True, most_bytes: int = 8 << 30, most_seconds: int = 21_600) -> Column:
    """Why an audio file stays as it is; audio: struct format, size, codec, n_video, n_audio, duration, channels, bit_rate (bits/s)."""
    a = lambda name: audio[name]
    codec = F.create_map(*[F.lit(x) for p in LOSSY_CODECS.items() for x in p])
    lossy, known = F.element_at(codec, a("format")), a("duration") > 0
    opus = lossy.eqNullSafe("opus")
    bits = F.coalesce(a("bit_rate"), F.when(known, a("size") * 8 / a("duration")))
    return _first(
        (F.lit(not available), "engine-unavailable"),
        (lossy.isNull() & ~a("format").isin(*LOSSLESS_AUDIO), "unsupported-format"),
        (a("size") > most_bytes, "exceeds-size-limit"),
        (a("n_video") > 0, "has-video"),
        (a("n_audio") == 0, "no-audio-stream"),
        (a("n_audio") > 1, "multiple-audio-streams"),
        (~F.coalesce(known, F.lit(False)) & ~(opus & (a("codec") == "opus")), "unknown-duration"),
        (known & (a("duration") > most_seconds), "exceeds-duration-limit"),
        (lossy.isNotNull() & (a("codec") != lossy), "unsupported-format"),
        (lossy.isNotNull() & F.lit(not force) & (bits / 1000 < audio_rate(a("channels"), opus, AUDIO_PRESETS[preset]) * LOSSY_HEADROOM), "already-efficient"),
    )


def pdf_skip(pdf: Column, available: bool = True, most_bytes: int = 512 << 20) -> Column:
    """Why a PDF stays as it is; pdf: struct size, inspected, encrypted, signed."""
    return _first((F.lit(not available), "engine-unavailable"), (pdf["size"] > most_bytes, "exceeds-size-limit"), (~pdf["inspected"], "not-inspected"), (pdf["encrypted"], "encrypted"), (pdf["signed"], "signed"))


def video_bytes(size: Column, width: Column, height: Column, fps: Column, seconds: Column, crf: int, audio_kbps: Column) -> Column:
    """A rough size after encoding at crf, from bits per pixel; never above the old size."""
    per_pixel = 0.1 * 0.89 ** (crf - 18)
    bits = F.lit(per_pixel) * width * height * F.coalesce(fps, F.lit(25.0)) * seconds + audio_kbps * 1000 * seconds
    return F.least(size, rounded(bits / 8))


def verdict(complete: Column, errors: Column, warnings: Column) -> Column:
    return F.when(~complete, "unusable").when(errors > 0, "invalid").when(warnings > 0, "valid-with-warnings").otherwise("valid")


def reference_diagnostic(status: Column, lenient: Column, dynamic: Column) -> Column:
    """The diagnostic code that a resolved or unresolved reference gives; null for none."""
    return (
        F.when(dynamic, F.when(status == "resolved", "dynamic-reference"))
        .when(status == "missing", "missing-resource")
        .when(status == "ambiguous", "ambiguous-reference")
        .when(status == "unmapped", "asset-uri-unmapped")
        .when(status == "external", "external-reference")
        .when(status == "unresolvable", "root-relative-reference")
        .when((status == "resolved") & (lenient == "stale-editor-path"), "stale-editor-path")
        .when((status == "resolved") & (lenient == "multiple-prefixes"), "ambiguous-reference")
        .when((status == "resolved") & lenient.isNotNull(), "lenient-resolution")
    )
