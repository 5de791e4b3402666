"""Facts from probe output, and what becomes of a film: a reason to skip, or the values of the job. Streams stay arrays of structs; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import _first
from .text import rounded

_TEXT = "index codec_type codec_name codec_tag_string profile width height pix_fmt field_order avg_frame_rate r_frame_rate duration bit_rate nb_frames channels sample_rate sample_aspect_ratio color_transfer bits_per_raw_sample".split()
RAW = (
    "format struct<format_name string, duration string, bit_rate string, size string>, chapters array<map<string, string>>, streams array<struct<"
    + ", ".join(f"{n}: string" for n in _TEXT)
    + ", tags: map<string, string>, disposition: map<string, string>, side_data_list: array<map<string, string>>>>"
)
#: Bits per pixel below which a preset leaves a film alone; containers, and audio codecs that each carries over.
EFFICIENT = {"conservative": 0.05, "balanced": 0.08, "aggressive": 0.12}
MP4_FAMILY = ("mp4", "m4v", "mov", "3gp")
COPIED = {"mp4": ("aac", "mp3"), "webm": ("opus", "vorbis")}
MODERN = ("h264", "hevc", "vp9", "av1")


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def rational(c: Column) -> Column:
    """A number like 30000/1001; null unless it is above zero."""
    parts = F.split(c, "/")
    over = F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))
    return F.when(c.rlike("^-?\\d+/\\d+$"), F.when(over > 0, over)).otherwise(_number(c))


def rotation(deg: Column) -> Column:
    """An angle as 0 to 359 degrees."""
    return F.pmod(rounded(deg), F.lit(360)).cast("int")


def _stream(s: Column) -> Column:
    kind = F.when(s["codec_type"].isin("video", "audio", "subtitle", "data", "attachment"), s["codec_type"]).otherwise("unknown")
    turns = F.filter(F.transform(F.coalesce(s["side_data_list"], F.array().cast("array<map<string,string>>")), lambda d: _number(d["rotation"])), lambda r: r.isNotNull())
    side, tag = F.coalesce(F.try_element_at(turns, F.lit(-1)), F.lit(0.0)), _number(s["tags"]["rotate"])
    return F.struct(
        F.coalesce(s["index"].try_cast("int"), F.lit(-1)).alias("index"), kind.alias("type"), F.coalesce(F.nullif(s["codec_name"], F.lit("")), F.lit("unknown")).alias("codec"), s["codec_tag_string"].alias("codec_tag"),
        rotation(F.when((side == 0) & tag.isNotNull(), -tag).otherwise(side)).alias("rotation"), F.coalesce(s["disposition"]["attached_pic"] == "1", F.lit(False)).alias("attached_pic"),
        F.coalesce((s["tags"]["alpha_mode"] == "1") | (s["tags"]["ALPHA_MODE"] == "1"), F.lit(False)).alias("alpha_mode"), s["width"].try_cast("int").alias("width"), s["height"].try_cast("int").alias("height"),
        s["pix_fmt"].alias("pix_fmt"), s["field_order"].alias("field_order"), F.coalesce(rational(s["avg_frame_rate"]), rational(s["r_frame_rate"])).alias("frame_rate"), _number(s["duration"]).alias("duration"),
        _number(s["bit_rate"]).alias("bit_rate"), s["channels"].try_cast("int").alias("channels"), s["sample_rate"].try_cast("int").alias("sample_rate"), s["sample_aspect_ratio"].alias("sample_aspect_ratio"),
        s["color_transfer"].alias("color_transfer"), s["bits_per_raw_sample"].try_cast("int").alias("bits_per_raw_sample"), s["tags"]["language"].alias("language"),
    )


def probe(json: Column) -> Column:
    """Probe output as a struct: format, duration, bit_rate, chapters, streams; null if it isn't JSON or names neither format nor stream."""
    raw = F.from_json(json, RAW)
    streams = F.transform(F.coalesce(raw["streams"], F.from_json(F.lit('{"streams":[]}'), RAW)["streams"]), _stream)
    known = F.coalesce(raw["format"]["format_name"], F.lit("")) != ""
    made = F.struct(raw["format"]["format_name"].alias("format"), _number(raw["format"]["duration"]).alias("duration"), _number(raw["format"]["bit_rate"]).alias("bit_rate"), F.coalesce(F.size(raw["chapters"]), F.lit(0)).alias("chapters"), streams.alias("streams"))
    return F.when(known | (F.size(raw["streams"]) > 0), made)


def pictures(p: Column) -> Column:
    """The video streams that aren't cover art."""
    return F.filter(p["streams"], lambda s: (s["type"] == "video") & ~s["attached_pic"])


def effective_duration(p: Column) -> Column:
    """The container's duration, else the longest stream's."""
    return F.when(p["duration"] > 0, p["duration"]).otherwise(F.array_max(F.transform(p["streams"], lambda s: s["duration"])))


def has_alpha(fmt: Column) -> Column:
    return F.coalesce(fmt.rlike("^(yuva|rgba|bgra|argb|abgr|gbrap|ya|pal8)") | F.contains(fmt, F.lit("a64")) | (fmt == "ayuv64le"), F.lit(False))


def high_bit_depth(s: Column) -> Column:
    return F.coalesce(s["bits_per_raw_sample"] > 8, F.lit(False)) | F.coalesce(s["pix_fmt"].rlike("(p9|p10|p12|p14|p16|48|64)(le|be)?$"), F.lit(False))


def hdr(s: Column) -> Column:
    return F.coalesce(s["color_transfer"].isin("smpte2084", "arib-std-b67"), F.lit(False))


def sample_aspect(sar: Column) -> Column:
    """The width of a pixel by its height; 1 if it isn't known."""
    a, b = (F.regexp_extract(F.coalesce(sar, F.lit("")), "^(\\d+):(\\d+)$", k).try_cast("double") for k in (1, 2))
    return F.when((a > 0) & (b > 0), a / b).otherwise(1.0)


def target_size(width: Column, height: Column, most: int | None) -> Column:
    """A struct width, height: even, within most on the short side and 16:9 of it on the long one."""
    even = lambda n: F.greatest(F.lit(2), 2 * rounded(n / 2)).cast("long")
    down = lambda n: (n - n % 2).cast("long")
    if most is None:
        return F.struct(down(width).alias("width"), down(height).alias("height"))
    scale = F.least(F.lit(1.0), most / F.least(width, height), int(most * 16 / 9 + 0.5) / F.greatest(width, height))
    return F.struct(F.when(scale == 1, down(width)).otherwise(even(width * scale)).alias("width"), F.when(scale == 1, down(height)).otherwise(even(height * scale)).alias("height"))


def duration_tolerance(fps: Column) -> Column:
    return F.greatest(F.lit(0.25), F.coalesce(F.when(fps > 0, 3 / fps), F.lit(0.0)))


def container(fmt: Column) -> Column:
    return F.when(fmt == "mov", "mov").when(fmt.isin(*MP4_FAMILY), "mp4").when(fmt == "webm", "webm")


def audio_plan(s: Column, box: Column, encoders: tuple[str, ...], kbps: int = 128) -> Column:
    """How an audio stream goes on: a struct action (copy or encode), codec, kbps; null if it can't."""
    webm = box == "webm"
    codec = F.when(webm, "opus").otherwise("aac")
    copied = F.when(webm, s["codec"].isin(*COPIED["webm"])).otherwise(s["codec"].isin(*COPIED["mp4"]))
    able = F.when(webm, F.lit("libopus" in encoders)).otherwise(F.lit("aac" in encoders)) & (F.coalesce(s["channels"], F.lit(2)) <= 8)
    rate = F.greatest(F.lit(64), F.least(F.lit(kbps), F.coalesce(rounded(s["bit_rate"] / 1000), F.lit(kbps))))
    return F.when(copied, F.struct(F.lit("copy").alias("action"), s["codec"].alias("codec"), F.lit(None).cast("long").alias("kbps"))).when(able, F.struct(F.lit("encode").alias("action"), codec.alias("codec"), rate.cast("long").alias("kbps")))


def video_skip(fmt: Column, size: Column, p: Column, preset: str = "balanced", enabled: bool = True, force: bool = False, encoders: tuple[str, ...] = ("libx264", "libvpx-vp9", "aac", "libopus"), slow: tuple[str, ...] = (), drop_data: bool = False, most_short: int | None = 1080, most_bytes: int = 8 << 30, most_seconds: int = 21_600, most_pixels: int = 100_000_000) -> Column:
    """Why a film stays as it is; null if it is encoded anew. p: a probe. The first rule that fits decides."""
    box, seen = container(fmt), pictures(p)
    v, length = F.get(seen, F.lit(0)), effective_duration(p)
    encoder = F.when(box == "webm", "libvpx-vp9").otherwise("libx264")
    others = F.filter(p["streams"], lambda s: s["index"] != v["index"])
    any_of = lambda test: F.exists(others, test)
    chapter = lambda s: (p["chapters"] > 0) & (s["codec"] == "bin_data") & F.coalesce(s["codec_tag"] == "text", F.lit(False))
    turned = v["rotation"].isin(90, 270)
    square = rounded(v["width"] * sample_aspect(v["sample_aspect_ratio"]))
    shown_w, shown_h = F.when(turned, v["height"]).otherwise(square), F.when(turned, square).otherwise(v["height"])
    wanted = target_size(shown_w, shown_h, most_short)
    scales = (wanted["width"] != shown_w) | (wanted["height"] != shown_h)
    rate = F.coalesce(v["bit_rate"], p["bit_rate"] * 0.9, size * 8 / length)
    per_pixel = F.when(v["frame_rate"] > 0, rate / (square * v["height"] * v["frame_rate"]))
    subtitle = F.when(box == "webm", "webvtt").otherwise("mov_text")
    return _first(
        (F.lit(not enabled), "video-disabled"),
        (F.lit(not encoders), "engine-unavailable"),
        (box.isNull(), "unsupported-container"),
        (size > most_bytes, "exceeds-size-limit"),
        (F.exists(p["streams"], lambda s: (s["type"] == "video") & s["attached_pic"]), "attached-picture"),
        (F.size(seen) == 0, "no-video-stream"),
        (F.size(seen) > 1, "multiple-video-streams"),
        (has_alpha(v["pix_fmt"]) | v["alpha_mode"], "alpha-channel"),
        (hdr(v), "hdr"),
        (high_bit_depth(v), "high-bit-depth"),
        (~F.coalesce(v["field_order"], F.lit("")).isin("", "progressive", "unknown"), "interlaced"),
        (v["rotation"] % 90 != 0, "unsupported-rotation"),
        (F.coalesce(v["width"] * v["height"], F.lit(0)) == 0, "no-video-stream"),
        (F.coalesce(length, F.lit(0.0)) <= 0, "unknown-duration"),
        (length > most_seconds, "exceeds-duration-limit"),
        (v["width"].cast("long") * v["height"] > most_pixels, "exceeds-resolution-limit"),
        (~encoder.isin(*(encoders or ("",))), "engine-capability"),
        (encoder.isin(*(slow or ("",))) & F.lit(not force), "engine-capability"),
        (any_of(lambda s: (s["type"] == "audio") & audio_plan(s, box, encoders).isNull()), "unsupported-audio"),
        (any_of(lambda s: (s["type"] == "subtitle") & (s["codec"] != subtitle)), "unsupported-subtitle"),
        (any_of(lambda s: s["type"].isin("data", "attachment", "unknown") & ~chapter(s)) & F.lit(not drop_data), "unsupported-data-stream"),
        (F.lit(not force) & ~scales & v["codec"].isin(*MODERN) & (per_pixel < EFFICIENT[preset]), "already-efficient"),
    )


def video_problems(expected: Column, p: Column) -> Column:
    """What is wrong with an encoded film, as names; expected: struct codec, width, height, duration, frame_rate, audio (array of codec), subtitles, chapters."""
    v = F.get(pictures(p), F.lit(0))
    turned = v["rotation"].isin(90, 270)
    w, h = F.when(turned, v["height"]).otherwise(v["width"]), F.when(turned, v["width"]).otherwise(v["height"])
    audio = F.transform(F.filter(p["streams"], lambda s: s["type"] == "audio"), lambda s: s["codec"])
    drift = F.abs(v["frame_rate"] - expected["frame_rate"]) / expected["frame_rate"]
    length = effective_duration(p)
    tests = [
        (F.size(pictures(p)) != 1, "video-streams"), (v["codec"] != expected["codec"], "video-codec"), ((w != expected["width"]) | (h != expected["height"]), "size"), (~v["pix_fmt"].eqNullSafe("yuv420p") & v.isNotNull(), "pixel-format"),
        (drift > 0.01, "frame-rate"), (length.isNull() | (F.abs(length - expected["duration"]) > duration_tolerance(expected["frame_rate"])), "duration"), (F.size(audio) != F.size(expected["audio"]), "audio-streams"),
        ((F.size(audio) == F.size(expected["audio"])) & (audio != expected["audio"]), "audio-codec"), (F.size(F.filter(p["streams"], lambda s: s["type"] == "subtitle")) != expected["subtitles"], "subtitle-streams"), (p["chapters"] != expected["chapters"], "chapters"),
    ]
    return F.filter(F.array(*[F.when(test, name) for test, name in tests]), lambda x: x.isNotNull())
