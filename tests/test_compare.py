import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import values as V
from quillspark.functions import video as W
from quillspark.operators import compare as C
from quillspark.operators import diagnostics as N
from quillspark.operators import summary as Y
from quillspark.sources import zip as Z


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def table(spark, shape, *data):
    return spark.createDataFrame(list(data), shape)


FOUND = "package_id string, code string, resource string, location string, message string"


def test_validations(spark):
    entry = "package_id string, path string, entry_index long, crc32 long, size long"
    before = table(spark, entry, ("p", "a", 0, 1, 1), ("p", "b", 1, 2, 2), ("p", "c", 2, 3, 3), ("q", "a", 0, 1, 1), ("q", "b", 1, 1, 1))
    after = table(spark, entry, ("p", "new/a", 0, 9, 1), ("p", "c", 1, 3, 3), ("p", "x", 2, 5, 5), ("q", "b", 0, 1, 1), ("q", "a", 1, 7, 1))
    renames = table(spark, "package_id string, old string, new string", ("p", "a", "new/a"))
    removed, added = table(spark, "package_id string, path string", ("p", "b")), table(spark, "package_id string, path string, entry_index long", ("p", "x", 0))
    planned = table(spark, "package_id string, path string", ("p", "a"))
    was = table(spark, FOUND, ("p", "extension-mismatch", "a", None, "m"), ("p", "missing-resource", "z", "1", "m"))
    now = table(spark, FOUND, ("p", "extension-mismatch", "new/a", None, "n"), ("p", "missing-resource", "b", "1", "m"), ("p", "external-reference", "e", "1", "m"), ("q", "missing-resource", "z", "1", "m"))
    ref = "package_id string, entry string, value string, kind string, status string"
    refs_was = table(spark, ref, ("p", "i", "a", "explicit", "resolved"), ("p", "b", "a", "explicit", "resolved"), ("q", "i", "a", "explicit", "resolved"))
    refs_now = table(spark, ref, ("p", "i", "new/a", "explicit", "resolved"), ("q", "i", "a", "explicit", "missing"))
    got = {(r["package_id"], r["name"]): r["ok"] for r in C.validations(before, after, refs_was, refs_now, was, now, renames, removed, added, planned).collect()}
    names = ("entry-set", "unchanged-entries-preserved", "no-new-problems", "references-still-resolve")
    assert got == {("p", n): True for n in names} | {("q", n): False for n in names}
    assert rows(C.regressions(was, now, renames, removed), "package_id", "resource") == [("q", "z")]
    assert rows(C.lost_references(refs_was, refs_now), "package_id", "value") == [("q", "a")]


def test_sequences_and_folders(spark):
    place = "package_id string, path string, place long"
    one = table(spark, place, ("p", "a", 0), ("p", "b", 1), ("q", "a", 0), ("r", "a", 0), ("s", "a", 0))
    two = table(spark, place, ("p", "a", 5), ("p", "b", 9), ("q", "b", 0), ("r", "a", 0), ("r", "b", 1))
    assert rows(C.same_sequence(one, two), "package_id", "same") == [("p", True), ("q", False), ("r", False), ("s", False)]
    paths = lambda *x: table(spark, "package_id string, path string", *[("p", v) for v in x])
    gone = C.emptied_directories(paths("a/", "a/b/", "c/", "d/"), paths("a/b/x", "c/y"), paths("a/z", "d/w"))
    assert rows(gone, "path") == [("a/b/",), ("c/",)]


def test_same_resolution(spark):
    kind = "struct<status: string, target: string, lenient: string, candidates: array<string>>"
    pairs = [(("missing", None, None, ["a", "b"]), ("missing", None, None, ["b", "a"])), (("resolved", "a", None, None), ("resolved", "a", None, [])), (("resolved", "a", None, None), ("resolved", "a", "case", None)), (("resolved", "a", None, None), ("resolved", "b", None, None))]
    df = table(spark, f"before {kind}, after {kind}", *pairs)
    assert [r[0] for r in df.select(C.same_resolution()).collect()] == [True, True, False, False]


def test_nested_edits(spark):
    """Against the rules applied one edit after the other."""
    r, data, want = random.Random(6), [], {}
    for e in range(200):
        some = sorted({(s, s + r.randrange(0, 9), r.choice(["", "", "x", "y"])) for s in (r.randrange(30) for _ in range(r.randrange(1, 6)))}, key=lambda x: (x[0], -x[1], x[2]))
        kept, out = [], []
        for s, t, v in some:
            last = kept[-1] if kept else None
            if last and s >= last[0] and t <= last[1] and (last[2] == "" or last == (s, t, v)):
                out.append("covered")
            elif last and s < last[1]:
                out = None  # the rest isn't defined
                break
            else:
                out.append("kept")
                kept.append((s, t, v))
        data += [("p", f"e{e}", *x) for x in some]
        want[f"e{e}"] = out
    got = {}
    for x in C.nested_edits(table(spark, "package_id string, entry string, start long, end long, value string", *data)).collect():
        got.setdefault(x["entry"], []).append((x["start"], -x["end"], x["value"], x["verdict"]))
    for e, out in want.items():
        verdicts = [v for *_, v in sorted(got[e])]
        assert verdicts == out if out is not None else "overlap" in verdicts, (e, sorted(got[e]))


def test_plans_of_broken_references(spark):
    ref = "package_id string, ref_id long, status string, form string, target string, candidates array<string>, value string"
    refs = table(spark, ref, ("p", 1, "missing", "relative", None, ["a", "content/resources/b"], "v"), ("p", 2, "unresolvable", "local-file", None, None, "C:\\x"), ("p", 3, "unresolvable", "root-relative", None, None, "/x"), ("p", 4, "resolved", "relative", "a", ["a", "c"], "a"), ("p", 5, "unmapped", "asset-uri", None, None, "asset://x"))
    broken = refs.filter(C.is_broken(F.col("status"), F.col("form"))).select("ref_id", C.unlink_key(F.col("status"), F.col("candidates"), F.col("value")).alias("key"))
    assert rows(broken, "ref_id", "key") == [(1, "content/resources/b"), (2, "C:\\x"), (5, "asset://x")]
    assert rows(C.references_by_target(refs), "ref_id", "path") == [(1, "a"), (1, "content/resources/b"), (4, "a"), (4, "c")]
    removals = table(spark, "package_id string, key string, action string, entry string", ("p", "k", "element", "b"), ("p", "k", "value", "a"), ("p", "k", "value", "a"))
    assert rows(C.unlinks(removals), "key", "references", "element", "attribute", "value", "entries") == [("k", 3, 1, 0, 2, ["a", "b"])]
    changes = table(spark, "package_id string, path string", ("p", "a"), ("p", "none"))
    assert rows(C.rewritten_counts(refs, changes), "path", "references") == [("a", 1), ("none", 0)]
    skips = table(spark, "package_id string, kind string, path string, reason string", ("p", "b", "y", "r"), ("p", "a", "y", "r"), ("p", "b", "y", "r"), ("p", "z", "x", "r"))
    assert rows(C.distinct_skips(skips), "place", "path", "kind") == [(1, "x", "z"), (2, "y", "a"), (3, "y", "b")]


def test_reference_diagnostics(spark):
    shape = "package_id string, ref_id long, kind string, representation string, form string, status string, target string, lenient string, percent_encoded boolean, candidates array<string>"
    row = lambda i, status, kind="explicit", rep="published", form="relative", target=None, lenient=None, coded=False, c=None: ("p", i, kind, rep, form, status, target, lenient, coded, c)
    refs = [
        row(1, "missing", c=["x"]), row(2, "missing", rep="runtime", c=["x"]), row(3, "missing", form="stale-editor-path", c=["x"]), row(4, "ambiguous"), row(5, "unmapped"), row(6, "external"), row(7, "unresolvable"), row(8, "ignored"),
        row(9, "resolved", target="t", lenient="case", coded=True), row(10, "resolved", target="t", lenient="multiple-prefixes"), row(11, "resolved", target="t", lenient="stale-editor-path"), row(12, "resolved", target="t"), row(13, "resolved", kind="dynamic", target="t", coded=True), row(14, "missing", kind="dynamic"),
    ]
    got = rows(N.reference_diagnostics(table(spark, shape, *refs)), "ref_id", "code", "severity", "resource")
    want = [
        (1, "missing-resource", "error", "x"), (2, "missing-resource", "warning", "x"), (3, "missing-resource", "warning", "x"), (4, "ambiguous-reference", "warning", None), (5, "asset-uri-unmapped", "warning", None), (6, "external-reference", "info", None), (7, "root-relative-reference", "warning", None),
        (9, "lenient-resolution", "warning", "t"), (9, "percent-encoded-reference", "info", "t"), (10, "ambiguous-reference", "info", "t"), (11, "stale-editor-path", "info", "t"), (13, "dynamic-reference", "info", "t"),
    ]
    assert got == sorted(want, key=repr)
    codes = spark.createDataFrame([("zip-limit",), ("limit-exceeded",), ("odd",)], "e string")
    assert [r[0] for r in codes.select(N.fatal_code(F.col("e"))).collect()] == ["zip-limit", "zip-limit", "zip-structure"]


ENTRY = "package_id string, path string, is_directory boolean, size long, kind string, format string, extension_matches boolean"


def test_package_diagnostics_and_summary(spark):
    r = "content/resources/"
    entries = table(
        spark, ENTRY, ("p", "index.html", False, 5, "text", "html", None), ("p", "screenshot.png", False, 5, "image", "jpeg", False), ("p", f"{r}a.png", False, 7, "image", "jpeg", False), ("p", f"{r}app/x.js", False, 1, "text", "js", None), ("p", f"{r}20240101000000ABCDEF/o.png", False, 2, "image", "png", True),
        ("p", f"{r}d/", True, 0, "unknown", "directory", None), ("q", f"{r}v.webm", False, 300 << 20, "video", "webm", True),
    )
    doc = "package_id string, kind string, seq long, id string, name string, type string"
    content = table(spark, doc, ("p", "page", 0, "1", "P", None), ("p", "component", 1, "2", None, "text"), ("p", "component", 2, "3", None, ""), ("p", "property", 3, "pp_title", "T", None), ("p", "property", 4, "pp_title", "U", None), ("p", "property", 5, "pp_screenshot", "data", None), ("p", "resource", 6, "odeId", "X", None))
    twins = table(spark, "package_id string, duplicate_group long, path string", ("p", 1, "b"), ("p", 1, "a"))
    listed = table(spark, "package_id string, path string", ("p", "index.html"), ("p", "gone"))
    got = rows(N.package_diagnostics(entries, content, twins, listed), "package_id", "code", "resource")
    assert got == sorted([("p", "screenshot-invalid", "screenshot.png"), ("p", "pp-screenshot-duplicate", None), ("q", "limits-host-policy", None), ("p", "duplicate-content", "a"), ("p", "opaque-bundle", f"{r}app/"), ("p", "extension-mismatch", f"{r}a.png"), ("p", "legacy-resource-folders", None), ("p", "manifest-stale", "libs/elpx-manifest.js")], key=repr)
    assert rows(Y.totals(entries), "package_id", "entries", "files", "uncompressed_bytes", "user_asset_bytes", "image_bytes", "video_bytes") == [("p", 6, 5, 20, 10, 9, 0), ("q", 1, 1, 300 << 20, 300 << 20, 0, 300 << 20)]
    s = {x["package_id"]: x for x in Y.package_summary(entries, content).collect()}
    assert (s["p"]["title"], s["p"]["ode_id"], s["p"]["pages"], s["p"]["components"], s["p"]["types"], s["p"]["legacy_folders"], s["p"]["has_screenshot"], s["p"]["has_manifest"]) == ("T", "X", 1, 2, {"text": 1, "unknown": 1}, 1, True, False)
    assert s["q"]["pages"] == 0 and not s["q"]["has_published_html"]
    refs = table(spark, "package_id string, target string, status string, representation string", ("p", f"{r}a.png", "resolved", "editable"), ("p", f"{r}a.png", "resolved", "runtime"), ("p", f"{r}app/x.js", "resolved", "published"), ("p", "index.html", "resolved", "editable"))
    assert rows(Y.one_sided(entries, refs), "path", "code") == [(f"{r}a.png", "reference-editable-only"), (f"{r}app/x.js", "reference-published-only")]
    probes = table(spark, "package_id string, path string, n_video long, n_audio long", ("q", f"{r}v.webm", 0, 1))
    images = table(spark, "package_id string, path string, width int", ("p", f"{r}a.png", 9))
    inv = {x["path"]: x for x in Y.inventory(entries, twins, images, probes).collect()}
    assert inv[f"{r}v.webm"]["kind"] == "audio" and inv[f"{r}a.png"]["image"]["width"] == 9 and inv["index.html"]["image"] is None
    every = Y.failed_carry(table(spark, "package_id string", ("p",), ("broken",)), Y.totals(entries), ["entries"])
    assert rows(every, "package_id", "entries", "ok") == [("broken", 0, False), ("p", 6, True)]


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column).first()[0]


@pytest.mark.parametrize(
    ("made", "out"),
    [
        (lambda c: V.escaped_json(c, True, True), 'a\\"\\\\\\/\\u00e9\\ud83d\\ude00\\n'), (lambda c: V.escaped_json(c), 'a\\"\\\\/é😀\\n'), (lambda c: V.escaped_css(c, None), 'a\\22 \\\\/é😀\\a '), (lambda c: V.escaped_css(c, '"'), 'a\\"\\\\/é😀\\a '),
        (lambda c: V.escaped_html_attribute(c, None), 'a&#34;\\/é😀&#10;'), (lambda c: V.escaped_xml_attribute(c, '"'), 'a&quot;\\/é😀&#10;'), (lambda c: V.encoded_component(c), "a%22%5C%2F%C3%A9%F0%9F%98%80%0A"), (lambda c: V.encoded_path(c, F.lit(False)), "a%22%5C/é😀%0A"),
        (lambda c: V.encoded_path(c, F.lit(True)), "a%22%5C/%C3%A9%F0%9F%98%80%0A"),
    ],
)
def test_escapes(spark, made, out):
    assert value(spark, made(F.col("v")), v='a"\\/é😀\n') == out


def test_targets_and_names(spark):
    at = lambda source, target: value(spark, V.relative_to(F.col("s"), F.col("t")), s=source, t=target)
    assert [at(*x) for x in (("html/a.html", "html/b.png"), ("html/x/a.html", "html/b.png"), ("a.html", "html/b.png"), ("html/a.html", "b.png"), ("a/b/c.html", "a/x/b/d"), ("a/b/c", "a"))] == ["b.png", "../b.png", "html/b.png", "../b.png", "../x/b/d", "../../a"]
    new = lambda v, form, editable, target, rule="": value(spark, V.retargeted(F.col("v"), F.col("f"), F.col("r"), F.col("e"), F.lit("html/a.html"), F.col("t")), v=v, f=form, r=rule, e=editable, t=target)
    assert new("x.png?v=1", "relative", False, "content/resources/a b.png") == "../content/resources/a%20b.png?v=1" and new("q?v", "relative", False, "html/n.png", "literal-special") == "n.png"
    assert new("%C3%A9.png", "relative", False, "html/ñ.png") == "%C3%B1.png" and new("e.png", "relative", False, "html/ñ.png") == "ñ.png"
    assert new("resources/x#f", "resources-legacy", True, "content/resources/y.png") == "resources/y.png#f" and new("x", "relative", True, "custom/y.png") == "{{context_path}}/custom/y.png"
    assert new("x", "relative", True, "custom/a b.png") is None and new("x", "context-path", True, "a&amp;b") is None and new("x", "asset-uri", True, "a") is None and new("/x", "root-relative", False, "a") is None
    size = lambda n: value(spark, V.format_bytes(F.col("n")), n=n)
    assert [size(n) for n in (0, 1023, 1024, -1536, 5 << 20, 3 << 30, 2 << 40, 5000 << 40)] == ["0 B", "1023 B", "1.0 KiB", "-1.5 KiB", "5.0 MiB", "3.0 GiB", "2.0 TiB", "5000.0 TiB"]
    assert [value(spark, V.optimized_name(F.col("n")), n=n) for n in ("a.elpx", "a.b.ZIP", "x")] == ["a_optimized.elpx", "a.b_optimized.elpx", "x_optimized.elpx"]
    assert [value(spark, V.with_extension(F.col("n"), "mp3"), n=n) for n in ("a/b.wav", "a.x/b")] == ["a/b.mp3", "a.x/b.mp3"]
    assert [value(spark, V.is_pdf_a1(F.col("n")), n=bytearray(n)) for n in (b"%PDF <pdfaid:part>1<", b'pdfaid:part = "1"', b"pdfaid:part>2<", b"")] == [True, True, False, False]
    assert [value(spark, V.looks_percent_encoded(F.col("n")), n=n) for n in ("a%20b", "ab", "a/%20", "%")] == [True, False, False, True]
    kind = lambda p, role, fmt="x": value(spark, V.scannable(F.col("p"), F.col("r"), F.col("f")), p=p, r=role, f=fmt)
    assert [kind("index.html", "page"), kind("theme/a.css", "runtime"), kind("c/a.htm", "user-asset"), kind("c/a.svg", "user-asset", "svg"), kind("a.css", "other")] == ["html", "css", "html", "html", None]
    keep = lambda p, role, n: value(spark, V.retained(F.col("p"), F.col("r"), F.col("n"), 100, 1000), p=p, r=role, n=n)
    assert [keep("index.html", "page", 100), keep("index.html", "page", 101), keep("content.xml", "package", 1), keep("c/a.png", "user-asset", 1000), keep("screenshot.png", "package", 1), keep("c/a.mp4", "user-asset", 1)] == [True, False, False, True, True, False]


def film(*streams, duration="10", chapters=0):
    import json

    v = {"index": 0, "codec_type": "video", "codec_name": "mpeg4", "width": 640, "height": 360, "pix_fmt": "yuv420p", "avg_frame_rate": "30000/1001", "bit_rate": "900000"}
    return json.dumps({"format": {"format_name": "mov", "duration": duration}, "chapters": [{}] * chapters, "streams": [{**v, **s} if i == 0 else {"index": i, **s} for i, s in enumerate(streams or ({},))]})


@pytest.mark.parametrize(
    ("fmt", "json", "out"),
    [
        ("mp4", film(), None), ("mkv", film(), "unsupported-container"), ("mp4", film({}, {"codec_type": "video", "disposition": {"attached_pic": 1}}), "attached-picture"), ("mp4", film({"codec_type": "audio"}), "no-video-stream"), ("mp4", film({}, {"codec_type": "video"}), "multiple-video-streams"),
        ("mp4", film({"tags": {"alpha_mode": "1"}}), "alpha-channel"), ("mp4", film({"color_transfer": "arib-std-b67"}), "hdr"), ("mp4", film({"pix_fmt": "yuv420p10le"}), "high-bit-depth"), ("mp4", film({"field_order": "tt"}), "interlaced"), ("mp4", film({"tags": {"rotate": "45"}}), "unsupported-rotation"),
        ("mp4", film({"width": 0}), "no-video-stream"), ("mp4", film(duration="0"), "unknown-duration"), ("mp4", film(duration="90000"), "exceeds-duration-limit"), ("mp4", film({"width": 20000, "height": 20000}), "exceeds-resolution-limit"), ("mp4", film({}, {"codec_type": "audio", "codec_name": "pcm", "channels": 9}), "unsupported-audio"),
        ("mp4", film({}, {"codec_type": "audio", "codec_name": "pcm", "channels": 2}), None), ("mp4", film({}, {"codec_type": "subtitle", "codec_name": "webvtt"}), "unsupported-subtitle"), ("webm", film({}, {"codec_type": "subtitle", "codec_name": "webvtt"}), None), ("mp4", film({}, {"codec_type": "data", "codec_name": "x"}), "unsupported-data-stream"),
        ("mp4", film({}, {"codec_type": "data", "codec_name": "bin_data", "codec_tag_string": "text"}, chapters=1), None), ("mp4", film({"codec_name": "h264", "bit_rate": "100000"}), "already-efficient"), ("mp4", film({"codec_name": "h264", "bit_rate": "100000", "height": 2160, "width": 3840}), None),
    ],
)
def test_video_skip(spark, fmt, json, out):
    films = spark.createDataFrame([(fmt, json)], "f string, j string").select("f", W.probe(F.col("j")).alias("p")).repartition(1)
    assert films.select(W.video_skip(F.col("f"), F.lit(1000), F.col("p"))).first()[0] == out


def test_probe_helpers(spark):
    p = spark.createDataFrame([(film({"tags": {"rotate": "90"}, "sample_aspect_ratio": "4:3", "duration": "7.5"}, duration=""),), ("no",), ("{}",)], "j string").select(W.probe(F.col("j")).alias("p")).collect()
    s = p[0]["p"]["streams"][0]
    assert (s["rotation"], s["type"], s["width"], round(s["frame_rate"], 3)) == (270, "video", 640, 29.97) and p[1]["p"] is None and p[2]["p"] is None
    got = spark.createDataFrame([(film({"duration": "7.5"}, duration=""),)], "j string").select(W.probe(F.col("j")).alias("p")).repartition(1).select(W.effective_duration(F.col("p")))
    assert got.first()[0] == 7.5
    rational = spark.createDataFrame([("30000/1001",), ("0/0",), ("25",), ("-1/2",), (None,)], "r string").select(W.rational(F.col("r")).alias("x"))
    assert [None if r["x"] is None else round(r["x"], 2) for r in rational.collect()] == [29.97, None, 25.0, None, None]
    size = lambda w, h, most: tuple(value(spark, W.target_size(F.col("w"), F.col("h"), most), w=w, h=h))
    assert [size(3840, 2160, 1080), size(641, 361, 1080), size(2160, 3840, 720), size(5000, 600, 1080), size(641, 361, None)] == [(1920, 1080), (640, 360), (720, 1280), (1920, 230), (640, 360)]
    want = F.struct(F.lit("h264").alias("codec"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.lit(10.0).alias("duration"), F.lit(30.0).alias("frame_rate"), F.array(F.lit("aac")).alias("audio"), F.lit(0).alias("subtitles"), F.lit(0).alias("chapters"))
    good = film({"codec_name": "h264"}, {"codec_type": "audio", "codec_name": "aac"})
    films = spark.createDataFrame([(good,), (film(duration="11"),)], "j string").select(W.probe(F.col("j")).alias("p")).repartition(1).select(W.video_problems(want, F.col("p")).alias("x"))
    assert sorted(r["x"] for r in films.collect()) == [[], ["video-codec", "duration", "audio-streams"]]


def stored(descriptor=None, comment=b"", local_size=None):
    """An archive of one stored entry, with or without a data descriptor of the given shape."""
    data, name = b"hello", b"a.txt"
    crc, flags = zlib.crc32(data), 8 if descriptor else 0
    told = (0, 0, 0) if descriptor else (crc, len(data), len(data) if local_size is None else local_size)
    local = struct.pack("<4s5H3I2H", b"PK\3\4", 20, flags, 0, 0, 0, *told, len(name), 0) + name + data + (descriptor(crc, len(data)) if descriptor else b"")
    central = struct.pack("<4s6H3I5H2I", b"PK\1\2", 20, 20, flags, 0, 0, 0, crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, 0) + name
    return local + central + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 1, 1, len(central), len(local), len(comment)) + comment


@pytest.mark.parametrize(
    ("raw", "problem"),
    [
        (stored(), None), (stored(comment=b"say PK\5\6 again, and more than twenty-two bytes"), None), (stored() + b"junk", "trailing-data"), (stored()[:-3], "truncated"), (stored(local_size=9), "local-header-differs"),
        (stored(lambda c, n: b"PK\7\x08" + struct.pack("<3I", c, n, n)), None), (stored(lambda c, n: struct.pack("<3I", c, n, n)), None), (stored(lambda c, n: b"PK\7\x08" + struct.pack("<I2Q", c, n, n)), None), (stored(lambda c, n: b"PK\7\x08" + struct.pack("<3I", c + 1, n, n)), "descriptor-differs"),
    ],
)
def test_archive_records(spark, raw, problem):
    got = Z.zip_entries(spark.createDataFrame([("p", bytearray(raw))], "package_id string, content binary")).collect()
    assert [r["problem"] for r in got] == [problem]
