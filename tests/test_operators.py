import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import links as L
from quillspark.operators import relations as R
from quillspark.sources import zip as Z
from quillspark.streaming import arrivals


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def resolved(spark):
    names = ["a/one.png", "a/Two.png", "b/two.png", "c/ñu.png", "x/three four.png", "deep/only.mp3", "a/q?x=1", "m/same.png", "n/same.png"]
    entries = spark.createDataFrame([("p", n) for n in names] + [("other", "a/gone.png")], "package_id string, path string")
    asks = {
        "exact": (["a/one.png"], "", False), "encoded": (["x/three%20four.png"], "", False), "case": (["A/ONE.png"], "", False), "slashes": (["a//one.png"], "", False), "back": (["a\\one.png"], "", False),
        "composed": (["c/n\u0303u.png"], "", False), "literal": (["a/q"], "?x=1", False), "several": (["none.png", "m/same.png", "n/same.png"], "", False), "name": (["z/only.mp3"], "", True), "no-name": (["z/only.mp3"], "", False),
        "ambiguous": (["z/same.png"], "", True), "missing": (["nope.png"], "", True), "elsewhere": (["a/gone.png"], "", False), "first": (["b/two.png", "A/one.PNG"], "", False),
    }
    refs = spark.createDataFrame([("p", k, *v) for k, v in asks.items()], "package_id string, ref_id string, candidates array<string>, suffix string, by_name boolean")
    return {r["ref_id"]: (r["status"], r["target"], r["lenient"]) for r in L.resolve(refs, L.entry_keys(entries)).collect()}


@pytest.mark.parametrize(
    ("ref", "out"),
    [
        ("exact", ("resolved", "a/one.png", None)), ("encoded", ("resolved", "x/three four.png", None)), ("case", ("resolved", "a/one.png", "case")), ("slashes", ("resolved", "a/one.png", "double-slash")),
        ("back", ("resolved", "a/one.png", "backslash")), ("composed", ("resolved", "c/ñu.png", "unicode")), ("literal", ("resolved", "a/q?x=1", "literal-special")), ("several", ("resolved", "m/same.png", "multiple-prefixes")),
        ("name", ("resolved", "deep/only.mp3", "basename")), ("no-name", ("missing", None, None)), ("ambiguous", ("ambiguous", None, None)), ("missing", ("missing", None, None)), ("elsewhere", ("missing", None, None)),
        ("first", ("resolved", "b/two.png", None)),
    ],
)
def test_resolve(resolved, ref, out):
    assert resolved[ref] == out


def test_duplicates_usage_and_differences(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "")], "id long, text string")
    assert [(r["copies"], r["keep"], r["size"]) for r in R.exact_duplicates(docs, "id", "text").collect()] == [(2, 1, 1)]
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert rows(R.usage(key(1, 2, 3), key(1, 1), key(1, 2), "k"), "k", "usage") == [(1, "used"), (2, "uncertain"), (3, "unreferenced")]
    assert rows(R.difference(key(1, 2, 2), key(2, 3), ["k"]), "k", "change") == [(1, "resolved"), (3, "introduced")]


def test_listings(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 9, None)], "g string, i long, size long")
    assert rows(R.collapsed(df, "g", "size", "i"), "g", "n", "size") == [("a", 5, 10), ("b", 1, None)]
    assert rows(R.largest(df, "g", "size", "i", 2), "g", "i") == [("a", 3), ("a", 4), ("b", 9)]
    assert rows(R.within_limit(df, "g", "i", "size", 3), "i", "within")[:4] == [(0, True), (1, True), (2, True), (3, False)]


def test_spliced(spark):
    edits = F.array(F.struct(F.lit(4).alias("start"), F.lit(4).alias("end"), F.lit("+").alias("value")), F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("").alias("value")))
    assert spark.range(1).select(R.spliced(F.lit("abcdef"), edits)).first()[0] == "cd+ef"


def archive(files, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            with z.open(zipfile.ZipInfo(name), "w", **how) as f:
                f.write(data)
    return out.getvalue()


def read(spark, *raws):
    return spark.createDataFrame([(str(i), bytearray(r)) for i, r in enumerate(raws)], "package_id string, content binary")


def test_zip_reading(spark):
    good = archive([("content.xml", b"<ode/>"), ("a/ñ.txt", "é".encode() * 500), ("a/", b"")])
    wide = archive([("content.xml", b"x" * 10)], force_zip64=True)
    archives = read(spark, good, wide, b"nothing", good[:-5], good + b"tail", b"")
    entries = Z.zip_entries(archives)
    assert rows(entries.filter("package_id < '2'"), "package_id", "path", "uncompressed_size", "problem") == [("0", "a/", 0, None), ("0", "a/ñ.txt", 1000, None), ("0", "content.xml", 6, None), ("1", "content.xml", 10, None)]
    assert {r["package_id"]: r["problem"] for r in entries.filter("package_id >= '2'").collect()} == {"2": "not-a-zip", "3": "truncated", "4": "trailing-data", "5": "not-a-zip"}
    assert rows(Z.zip_contents(archives, entries), "path", "problem") == [("a/ñ.txt", None), ("content.xml", None), ("content.xml", None)]
    assert rows(Z.detect_packages(entries.filter("package_id < '2'")), "kind") == [("elpx",), ("elpx",)]


def test_zip_problems(spark):
    twice = archive([("a.txt", b"1"), ("A.TXT", b"2"), ("n\u0303.txt", b"3"), ("ñ.txt", b"4"), ("a.txt/in", b"5"), ("../up", b"6")])
    broken = bytearray(archive([("x", b"hello hello")]))
    broken[broken.find(b"hello")] ^= 1
    coded = bytearray(archive([("x", b"1")]))
    struct.pack_into("<H", coded, coded.find(b"PK\1\2") + 8, 1)
    archives = read(spark, twice, bytes(broken), bytes(coded))
    entries = Z.zip_entries(archives)
    got = {(r["package_id"], r["path"], r["problem"]) for r in Z.zip_problems(entries).collect()}
    assert {("0", "A.TXT", "same-but-for-case"), ("0", "ñ.txt", "same-after-composition"), ("0", "a.txt/in", "inside-a-file"), ("0", "../up", "dot-segment"), ("2", "x", "encrypted")} <= got
    assert rows(Z.zip_contents(archives, entries).filter("problem IS NOT NULL"), "package_id", "problem") == [("1", "crc-differs")]


def test_packed_archives_open_elsewhere(spark, tmp_path):
    files = spark.createDataFrame([("p", 1, "b.txt", bytearray(b"two")), ("p", 0, "content.xml", bytearray(b"<ode/>")), ("q", 0, "ü.png", None)], "package_id string, entry_index long, path string, content binary")
    made = {r["package_id"]: r["content"] for r in Z.packed(files).collect()}
    with zipfile.ZipFile(io.BytesIO(made["p"])) as z:
        assert z.namelist() == ["content.xml", "b.txt"] and z.testzip() is None
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.zip").write_bytes(made["p"])
    arrivals.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/q.zip").write_bytes(made["q"])
    arrivals.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "kind", "entries", "problems") == [("elpx", 2, 0), ("unknown-zip", 1, 0)]


def test_quoted_strings_of_all_scripts(spark, tmp_path):
    from quillspark.plans import queries

    code = '''a = "x"; b = 'it "is"'; c = `t
u "v"`; d = "e\\"s'c"; f = ""; g = 'h\\\\'; don't("k");'''
    long = "\\n" * 20_000
    got = L.quoted_strings(spark.createDataFrame([(1, code), (2, f'"{long}"'), (3, None)], "id long, code string"), "id", "code").orderBy("id", "ordinal").collect()
    assert [r["value"] for r in got] == ["x", 'it "is"', 't\nu "v"', 'e\\"s\'c', "", "h\\\\", "k", long]
    pages = [(1, """<script>a("x", 'y')</script><p title="no"><SCRIPT type="module">b(`z`)</SCRIPT >"""), (2, "<p>'none'</p>")]
    table = spark.createDataFrame(pages, "page_id long, html string")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    found = L.scripts(table, "page_id", "html")
    assert [tuple(r) for r in L.quoted_strings(found, "page_id", "script").select("page_id", "value").orderBy("value").collect()] == [(1, "x"), (1, "y"), (1, "z")]
    assert rows(queries.QUERIES["template_scan"](spark, str(tmp_path)), "page_id", "strings") == [(1, 3)]


def test_json_strings_at_any_depth(spark):
    from quillspark.operators import scan as S

    nest = lambda n: "[" * n + '"s"' + "]" * n
    texts = ['{"a":{"b":{"c":{"d":{"e":["v",{"f":"w"}]}}}}}', nest(256), nest(257), nest(200_000), '"root"', '{"k":"1","k":"2"}', '["\\ud800", NaN]', '["\\ud800é", ' + "1" * 5000 + "]", None, "{"]
    got = {}
    for i, path, value in S.json_strings(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "id", "j").collect():
        got.setdefault(i, []).append((path, value))
    assert got == {0: [("$.a.b.c.d.e[0]", "v"), ("$.a.b.c.d.e[1].f", "w")], 1: [("$" + "[0]" * 256, "s")], 2: [("$" + "[0]" * 256, None)], 3: [("$", None)], 4: [("$", "root")], 5: [("$.k", "1"), ("$.k", "2")], 7: [("$[0]", "�é")]}


def test_resolve_all_links_by_brute_force(spark, tmp_path):
    """Links with accents, dots, digits, slashes, percent codes and suffixes all have a row, by the rule that finds it."""
    import unicodedata
    from urllib.parse import unquote

    from quillspark.plans import queries

    names = ["blue green", "Red 7", "a b c", "x b c", "solo", "one two"]
    links = ["/blue/green", "/BLUE/green", "/blue%2Fgreen?x=1#y", "/blue//green", "/blue\\green", "/für", "/the,", "/a.b", "/red/7", "/the", "/The", "/THE", "/z/solo", "/z/c", "one/two", "/of", "/naïf/one", "/东京", "/one/two#" + "f" * 11_000, "//host/p", "http://h/p", "#top", "", "mailto:x@y"]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, " ".join(f'<a href="{v}">' for v in links))], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    entries = {n.lower().replace(" ", "/") for n in names} | {"THE"}
    nfc = lambda v: unicodedata.normalize("NFC", v)

    def brute(v):
        if v.startswith(("//", "http:")):
            return "external", None, None
        whole = v.removeprefix("/")
        raw = whole.split("?")[0].split("#")[0]
        dec = unquote(raw)
        tries = [(None, [e for e in entries if e == dec]), ("literal-special", [e for e in entries if raw != whole and e == whole])]
        for x in (raw, dec):
            once = x
            while "//" in once:
                once = once.replace("//", "/")
            tries += [("double-slash", [e for e in entries if once != x and e == once]), ("backslash", [e for e in entries if "\\" in x and e == x.replace("\\", "/")])]
        tries += [("unicode", [e for e in entries if nfc(e) in (nfc(raw), nfc(dec))]), ("case", [e for e in entries if e.lower() in (nfc(raw).lower(), nfc(dec).lower())])]
        tries.append(("basename", [e for e in entries if e.split("/")[-1] == nfc(dec).split("/")[-1]]))
        rule, hit = next(((r, h) for r, h in tries if h), (None, []))
        return ("resolved", hit[0], rule) if len(hit) == 1 else ("ambiguous" if hit else "missing", None, None)

    got = {r["value"]: (r["status"], r["target"], r["lenient"]) for r in queries.QUERIES["resolve_all_links"](spark, str(tmp_path)).collect()}
    assert got == {v: brute(v) for v in links if v and v[0] != "#" and not v.startswith("mailto")}
    assert {x[2] for x in got.values()} >= {"case", "double-slash", "backslash", "basename", None}


def _resolved(value, editable, source, files):
    """A plain version of the rules, for a small list of files."""
    import re
    import unicodedata
    import urllib.parse

    def decoded(c):
        if "%" not in c or re.search("%(?![0-9A-Fa-f]{2})", c):
            return c
        try:
            return urllib.parse.unquote_to_bytes(c).decode()
        except UnicodeDecodeError:
            return c

    nfc = lambda x: unicodedata.normalize("NFC", x)
    base = lambda x: x.rsplit("/", 1)[-1]
    user = [f for f in files if f.startswith(("content/resources/", "custom/")) and not f.startswith(("content/css/", "content/img/"))]

    def lookup(candidates, suffix, by_name):
        dec = [decoded(c) for c in candidates]
        coded = dec != list(candidates)
        hits = list(dict.fromkeys(c for c in dec if c in files))
        if hits:
            return "resolved", hits[0], "multiple-prefixes" if len(hits) > 1 else None, coded
        tries = [
            ("literal-special", lambda c: [c + suffix] if suffix and c + suffix in files else []), ("double-slash", lambda c: [d] if (d := re.sub("/{2,}", "/", c)) != c and d in files else []),
            ("backslash", lambda c: [d] if (d := c.replace("\\", "/")) != c and d in files else []), ("unicode", lambda c: [f for f in files if nfc(f) == nfc(c) and f != c]), ("case", lambda c: [f for f in files if nfc(f).lower() == nfc(c).lower() and f != c]),
        ]
        for rule, find in tries:
            for c in [*candidates, *dec]:
                if found := find(c):
                    return ("resolved", found[0], rule, coded) if len(found) == 1 else ("ambiguous", None, None, False)
        if by_name and base(dec[0]):
            found = [f for f in user if nfc(base(f)) == nfc(base(dec[0]))]
            if found:
                return ("resolved", found[0], "basename", False) if len(found) == 1 else ("ambiguous", None, None, False)
        return "missing", None, None, coded

    def seen(path):
        out = []
        for part in path.split("/"):
            if part == "..":
                if not out:
                    return None
                out.pop()
            elif part != ".":
                out.append(part)
        return "/".join(out)

    v = (value or "").strip("\ufeff \t\n\r\u00a0")
    context = "{{context_path}}"
    if not v or v.startswith("#"):
        return "ignored", None, None, False
    if v.startswith(context):
        rest = re.sub("^/+", "", v[len(context) :])
        if not rest:
            return "ignored", None, None, False
        path, suffix = re.match("([^?#]*)(.*)", rest).groups()
        return lookup([path] if path.startswith("content/resources/") else [path, f"content/{path}", f"content/resources/{path}", f"resources/{path}"], suffix, True)
    bare = re.sub(r"""(?:\\?["'])+$""", "", re.sub(r"""^(?:\\?["'])+""", "", v))
    if bare != v and re.match("[a-zA-Z][a-zA-Z0-9+.-]*:|//", bare):
        return "external", None, None, False
    if bare != v and bare.startswith(context):
        inner = _resolved(re.sub(r"\\+$", "", bare), editable, source, files)
        return (*inner[:2], "escaped-quotes", inner[3]) if inner[0] == "resolved" else inner
    drive = re.match(r"[a-zA-Z]:[\\/]", v)
    if (scheme := re.match("([a-zA-Z][a-zA-Z0-9+.-]*):", v)) and not drive:
        s = scheme[1].lower()
        return {"asset": "unmapped", "data": "ignored", "file": "unresolvable", "mailto": "ignored", "sms": "ignored"}.get(s, "external"), None, None, False
    if drive or v.startswith("\\\\"):
        return "unresolvable", None, None, False
    if v.startswith("/"):
        return "external" if v.startswith("//") else "unresolvable", None, None, False
    path, suffix = re.match("([^?#]*)(.*)", v).groups()
    if editable and path.startswith("resources/"):
        return lookup([f"content/{path}", path], suffix, True)
    if editable and (m := re.match("files/tmp/(?:[^/]+/)*?([^/]+/[^/]+)$", path)):
        got = lookup([f"content/resources/{m[1]}"], suffix, False)
        return (*got[:2], "stale-editor-path", got[3]) if got[0] == "resolved" else got
    at = seen(("" if editable or "/" not in source else source.rsplit("/", 1)[0] + "/") + path)
    if at is None:
        return "unresolvable", None, None, False
    if not editable and (at == "" or at.endswith("/")):
        return ("resolved", at + "index.html", None, False) if at + "index.html" in files else ("ignored", None, None, False)
    return lookup([at], suffix, False)


def test_resolve_references_equals_the_plain_rules(spark):
    files = ["index.html", "html/a.html", "html/sub/index.html", "content/resources/one.png", "content/resources/x/one.png", "content/resources/ñ.png", "content/resources/two words.mp3", "custom/Logo.PNG", "custom/only.gif", "content/one.png", "resources/old.png", "content/resources/old.png", "html/q?v=1", "A.txt", "a.TXT", "content/resources/50%.png"]
    values = [
        None, "", " ", "#top", "{{context_path}}", "{{context_path}}/", "{{context_path}}/content/resources/one.png?v=1", "{{context_path}}/one.png", "{{context_path}}/x/one.png", "{{context_path}}/nope/only.gif", "{{context_path}}//logo.png", "{{context_path}}/zz/one.png", "{{context_path}}/none.png#f",
        '"{{context_path}}/content/resources/one.png"', '\\"{{context_path}}/content/resources/one.png\\\\"', "'https://a.org'", "https://a.org/x", "mailto:a@b", "sms:1", "asset://x/one.png", "data:,x", "file:///c", "C:\\x.png", "c:x", "\\\\srv\\x", "//cdn/x.js", "/abs.png",
        "resources/old.png", "resources/x/one.png", "resources/zz/only.gif", "files/tmp/a/b/x/one.png", "files/tmp/x/one.png", "files/tmp/one.png", "../content/resources/one.png", "../../up.png", "a.html", "./sub/", "sub/", "sub", "", "..", "../", "../index.html?x", "content/resources/n\u0303.png", "../content/resources/n%CC%83.png",
        "content/resources/two%20words.mp3", "content/resources/%C3%B1.png", "content/resources/50%.png", "content/resources/%ZZ.png", "content//resources/one.png", "content\\resources\\one.png", "CUSTOM/logo.png", "q?v=1", "html/q?v=1", "a.txt", "../a.txt", "A.TXT", "x.png",
    ]
    refs = [("p", i, v, e, s) for i, (v, e, s) in enumerate((v, e, s) for v in values for e, s in ((True, "content.xml"), (False, "html/x.html"), (False, "index.html")))]
    df = spark.createDataFrame(refs, "package_id string, ref_id long, value string, editable boolean, source string").repartition(3)
    entries = spark.createDataFrame([("p", f) for f in files] + [("q", "nope.png")], "package_id string, path string")
    got = {r["ref_id"]: (r["status"], r["target"], r["lenient"], r["percent_encoded"]) for r in L.resolve_references(df, entries).collect()}
    want = {i: _resolved(v, e, s, files) for _, i, v, e, s in refs}
    assert {i: (refs[i][2:], got.get(i), w) for i, w in want.items() if got.get(i) != w} == {}


def test_more_candidates_than_any_bound(spark):
    refs = spark.createDataFrame([("p", 1, [f"no{i}.png" for i in range(2500)] + ["yes.png"], "", False)], "package_id string, ref_id long, candidates array<string>, suffix string, by_name boolean")
    entries = spark.createDataFrame([("p", "yes.png")], "package_id string, path string")
    assert L.resolve(refs, L.entry_keys(entries)).first()["target"] == "yes.png"
