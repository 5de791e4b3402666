import pytest
from pyspark.sql import functions as F

from quillspark.functions import media as M
from quillspark.functions import paths as P
from quillspark.functions import text as T


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("raw", "form"),
    [
        ("", "empty"), ("  ", "empty"), ("#top", "fragment"), ("{{context_path}}/a.png", "context-path"), ("{{context_path}}/content/resources/a.png", "context-path"),
        ("asset://x/y", "asset-uri"), ("data:image/png;base64,AA", "data-uri"), ("file:///c", "local-file"), ("mailto:a@b", "pseudo"), ("https://a.b/c", "absolute-url"),
        ("C:\\\\x", "local-file"), ("//cdn/x", "protocol-relative"), ("/x", "root-relative"), ("resources/a", "relative"), ("sms:1", "pseudo"), ("exe-node:1", "pseudo"), ("C:x", "absolute-url"), ('\\"https://a\\"', "absolute-url"), ('"{{context_path}}/a"', "context-path"), ('"a.png"', "relative"), ("a/b.png", "relative"), ("\u00a0/x\ufeff", "root-relative"),
    ],
)
def test_link_form(spark, raw, form):
    assert value(spark, P.link_form(F.col("v")), v=raw) == form


def test_editable_link_form(spark):
    form = lambda v: value(spark, P.link_form(F.col("v"), F.lit(True)), v=v)
    assert [form(v) for v in ("resources/a", "files/tmp/x/a.png", "files/tmp/a", "a")] == ["resources-legacy", "stale-editor-path", "relative", "relative"]


@pytest.mark.parametrize(
    ("folder", "path", "out"),
    [("", "a/b", "a/b"), ("x/y", "../a", "x/a"), ("x", "../../a", None), ("x", "./a//b", "x/a/b"), ("", "..", None), ("a/b", "../..", ""), ("x", "..", "")],
)
def test_normalized(spark, folder, path, out):
    assert value(spark, P.normalized(F.col("f"), F.col("p")), f=folder, p=path) == out


@pytest.mark.parametrize(("raw", "out"), [("a%20b", "a b"), ("a+b", "a+b"), ("%zz", None), ("%FF", None), ("%C3%B1", "ñ"), ("plain", "plain")])
def test_percent_decoded(spark, raw, out):
    assert value(spark, P.percent_decoded(F.col("v")), v=raw) == out


def test_path_parts(spark):
    got = value(spark, F.array(P.basename(F.col("p")), P.dirname(F.col("p")), P.extname(F.col("p")), P.extname(F.lit(".hidden"))), p="a/b/c.TAR.Gz")
    assert got == ["c.TAR.Gz", "a/b", "gz", ""]
    assert value(spark, P.ancestors(F.col("p")), p="a/b/c") == ["a/", "a/b/"]
    assert value(spark, P.entry_role(F.col("p")), p="html/x.html") == "page"
    assert value(spark, P.legacy_folder(F.col("p")), p="content/resources/20240101120000ABC123/x.png") == "20240101120000ABC123"


@pytest.mark.parametrize(("name", "problem"), [("", "empty"), ("a\x01", "control-character"), ("a\\b", "backslash"), ("/a", "absolute"), ("c:x", "drive"), ("a//b", "empty-segment"), ("a/../b", "dot-segment"), ("a/b", None), ("a/", None)])
def test_name_problem(spark, name, problem):
    assert value(spark, P.name_problem(F.col("p")), p=name) == problem


@pytest.mark.parametrize(("raw", "out"), [("Año Nuevo (1)", "ano-nuevo-1"), ("Straße", "strasse"), ("Ærø", "aero"), ("--A__b--", "a-b"), ("łódź", "lodz")])
def test_slug(spark, raw, out):
    assert value(spark, T.slug(F.col("v")), v=raw) == out
    assert value(spark, T.slug(F.col("v")), v=out) == out  # once is enough


def test_rounding_and_lines(spark):
    assert value(spark, F.array(T.rounded(F.lit(-2.5)), T.rounded(F.lit(2.5)))) == [-2, 3]
    assert value(spark, T.line_of(F.col("t"), F.lit(4)), t="a\nb\nc") == 3
    assert value(spark, T.newlines(F.col("t")), t="a\r\nb\rc") == "a\nb\nc"


def image(**own):
    base = {"format": "jpeg", "size": 1000, "width": 800, "height": 600, "animated": False, "multi_image": False, "color_model": "rgb", "bit_depth": 8, "lossless": False, "quality": 95, "extension_matches": None, "fixed_size": False, "error": None} | own
    kinds = {"extension_matches": "boolean", "error": "string", "quality": "int"}
    return F.struct(*[F.lit(v).cast(kinds[k]).alias(k) if k in kinds else F.lit(v).alias(k) for k, v in base.items()])


@pytest.mark.parametrize(
    ("own", "reason"),
    [
        ({}, None), ({"format": "svg"}, "vector-image"), ({"format": "bmp"}, "unsupported-format"), ({"error": "cut"}, "corrupt"), ({"width": 0}, "corrupt"), ({"extension_matches": False}, "extension-mismatch"),
        ({"animated": True}, "animated"), ({"multi_image": True}, "multi-image"), ({"color_model": "cmyk"}, "cmyk"), ({"bit_depth": 16}, "high-bit-depth"), ({"size": 300 << 20}, "exceeds-size-limit"),
        ({"width": 20_000, "height": 9000}, "exceeds-resolution-limit"), ({"quality": 84}, "already-efficient"), ({"quality": 84, "width": 4000}, None), ({"quality": 84, "width": 4000, "fixed_size": True}, "already-efficient"),
        ({"format": "webp"}, "already-efficient"), ({"format": "webp", "lossless": True}, None), ({"quality": None}, None),
    ],
)
def test_image_decisions(spark, own, reason):
    assert value(spark, M.image_skip(image(**own))) == reason


def test_audio_values(spark):
    rate = lambda c, o: value(spark, M.audio_rate(F.lit(c), F.lit(o), 128))
    assert [rate(2, False), rate(1, False), rate(2, True), rate(1, True)] == [128, 64, 64, 32]
    assert [value(spark, M.sample_rate(F.lit(r), F.lit(False))) for r in (96000, 44100, 30000, 100)] == [48000, 44100, 24000, 8000]


@pytest.mark.parametrize(("status", "lenient", "code"), [("missing", None, "missing-resource"), ("resolved", None, None), ("resolved", "case", "lenient-resolution"), ("resolved", "multiple-prefixes", "ambiguous-reference"), ("external", None, "external-reference")])
def test_reference_diagnostics(spark, status, lenient, code):
    assert value(spark, M.reference_diagnostic(F.lit(status), F.lit(lenient).cast("string"), F.lit(False))) == code
