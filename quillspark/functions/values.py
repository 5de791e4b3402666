"""Column builders for writing values back: escaping, encoding, new targets in a reference's own form, and names of outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import CONTEXT, dirname, extname

_CONTROL = [chr(c) for c in range(0x20)]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def by_characters(text: Column, change) -> Column:
    """text with change(character) for each of its characters."""
    return F.array_join(F.transform(F.split(text, ""), change), "")


def percent(text: Column) -> Column:
    """Every byte of the text as a percent code."""
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "%$1")


def looks_percent_encoded(value: Column) -> Column:
    """Only what a component encoder emits, and a percent sign among it."""
    return value.rlike("^[A-Za-z0-9\\-_.!~*'()%]*%[A-Za-z0-9\\-_.!~*'()%]*\\z")


def encoded_component(text: Column) -> Column:
    return by_characters(text, lambda c: F.when(c.rlike("^[A-Za-z0-9\\-_.!~*'()]?\\z"), c).otherwise(percent(c)))


def encoded_path(path: Column, escape_wide: Column) -> Column:
    """A path for a URL; characters beyond ASCII are escaped only where escape_wide holds."""
    safe = "^[A-Za-z0-9\\-_.~!$&'()*+,;=:@/]?\\z"
    return by_characters(path, lambda c: F.when(c.rlike(safe) | (~escape_wide & c.rlike("^[^\\x00-\\x7F]$")), c).otherwise(percent(c)))


def escaped_json(text: Column, slashes: bool = False, ascii_only: bool = False) -> Column:
    """For the inside of a JSON string; slashes and ascii_only follow the document's style."""
    names = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    code = [(c, names.get(c, f"\\u{ord(c):04x}")) for c in [*_CONTROL, "\u2028", "\u2029"]]
    out = _replaced(text, [("\\", "\\\\"), ('"', '\\"'), *code, *[("/", "\\/")] * slashes])
    if not ascii_only:
        return out
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(....)", "\\\\u$1")
    return by_characters(out, lambda c: F.when(c.rlike("^[^\\x00-\\x7F]$"), units(c)).otherwise(c))


def escaped_css(text: Column, quote: str | None) -> Column:
    """For a CSS url() or string in this quote, or in none."""
    out = _replaced(text, [("\\", "\\\\"), ("\n", "\\a ")])
    if quote:
        return F.replace(out, F.lit(quote), F.lit("\\" + quote))
    bare = by_characters(F.replace(text, F.lit("\\"), F.lit("\\\\")), lambda c: F.when(c == "\n", F.lit("\\a ")).when(c.rlike("^[\\s\"'()]$"), F.concat(F.lit("\\"), F.lower(F.ltrim(F.hex(F.encode(c, "UTF-16BE")), F.lit("0"))), F.lit(" "))).otherwise(c))
    return bare


def escaped_html(text: Column) -> Column:
    """For a text node, of HTML or XML."""
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escaped_html_attribute(text: Column, quote: str | None) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    if quote:
        return F.replace(out, F.lit(quote), F.lit("&quot;" if quote == '"' else "&#39;"))
    return by_characters(out, lambda c: F.when(c.rlike("^[\\s\"'=<>`]$"), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))


def escaped_xml_attribute(text: Column, quote: str) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"), (quote, "&quot;" if quote == '"' else "&apos;")])


def in_cdata(text: Column) -> Column:
    """The text as it stands, null where a CDATA section can't hold it."""
    return F.when(~F.contains(text, F.lit("]]>")), text)


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, "\\.[^./]*$", ""), F.lit(f".{ext}"))


def relative_to(source: Column, target: Column) -> Column:
    """target seen from the folder of source: up to the common folder, then down."""
    folder = F.when(F.contains(source, F.lit("/")), F.split(dirname(source), "/")).otherwise(F.array().cast("array<string>"))
    to = F.split(target, "/")
    most = F.least(F.size(folder), F.size(to) - 1)
    steps = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    common = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n == k) & (F.get(folder, k) == F.get(to, k)), n + 1).otherwise(n))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(folder) - common), F.slice(to, common + 1, F.size(to))), "/")


def retargeted(value: Column, form: Column, lenient: Column, editable: Column, source: Column, target: Column) -> Column:
    """The value that points to target in the reference's own form; null where there is none."""
    suffix = F.when(lenient.eqNullSafe("literal-special"), "").otherwise(F.regexp_extract(value, "^[^?#]*((?:[?#].*)?)$", 1))
    # What ends a placeholder, or would be read as a character reference, can't stand in one.
    plain = ~target.rlike("[\\s\"'<>\\\\]") & ~target.rlike("&(?:#|[A-Za-z])")
    legacy = (form == "resources-legacy") & target.startswith("content/resources/")
    placed = F.when(legacy, F.concat(F.lit("resources/"), F.regexp_replace(target, "^content/resources/", ""), suffix)).when(form.isin("context-path", "resources-legacy", "relative"), F.concat(F.lit(f"{CONTEXT}/"), target, suffix))
    seen = F.concat(encoded_path(relative_to(source, target), value.rlike("%[89A-Fa-f][0-9A-Fa-f]")), suffix)
    return F.when(editable, F.when(plain, placed)).when(form == "relative", seen)


def format_bytes(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB"), even: bool = False) -> Column:
    """Binary units with one decimal; plain bytes without. Ties of the decimal go away from zero, or with even to the even digit, as C's printf has them."""
    size = F.abs(n)
    sign = F.when(n < 0, "-").otherwise("")
    out = F.when(size < 1024, F.concat(sign, size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        share = size / float(1024**k)
        text = F.concat(sign, F.format_string("%.1f", F.bround(share, 1) if even else share), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == units[-1] else out.when(size < 1024 ** (k + 1), text)
    return out


def is_pdf_a1(content: Column) -> Column:
    """Whether a PDF's metadata declares part 1 of the archive standard."""
    return F.decode(content, "ISO-8859-1").rlike("pdfaid:part\\s*(?:=\\s*[\"']\\s*1\\s*[\"']|>\\s*1\\s*<)")


def optimized_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, "(?i)\\.(?:elpx|elp|zip)$", ""), F.lit("_optimized.elpx"))


def scannable(path: Column, role: Column, fmt: Column) -> Column:
    """html or css for entries whose references are read; null for others."""
    ext = extname(path)
    return F.when(role == "page", "html").when((ext == "css") & role.isin("runtime", "user-asset"), "css").when((role == "user-asset") & (ext.isin("html", "htm", "xhtml") | (fmt == "svg")), "html")


def retained(path: Column, role: Column, size: Column, most_text: int, most_image: int) -> Column:
    """Whether an entry's bytes are kept for later steps: texts with references and inspected images, within their limits. A filter before anything is inflated."""
    ext = extname(path)
    text = (path != "content.xml") & ((role == "page") | path.isin("search_index.js", "libs/elpx-manifest.js") | ((ext == "css") & role.isin("runtime", "user-asset")) | ((role == "user-asset") & ext.isin("html", "htm", "xhtml", "svg")))
    image = ((role == "user-asset") | (path == "screenshot.png")) & ext.isin("jpg", "jpeg", "jpe", "png", "webp", "gif", "apng")
    return (text & (size <= most_text)) | (image & (size <= most_image))
