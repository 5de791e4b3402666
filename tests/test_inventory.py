from quillspark.operators import inventory as I
from quillspark.operators import scan as S
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_usage_classes(spark):
    paths = ["content.xml", "content/resources/a.png", "content/resources/b.png", "content/resources/c.png", "content/resources/app/index.html", "content/resources/app/x.png", "custom/y.css", "content/resources/favicon.ico", "content/resources/d.png", "content/resources/e.png", "content/resources/old/FavIcon.jpeg", "content/resources/apple-touch-icon.png"]
    entries = spark.createDataFrame([("p", i, x) for i, x in enumerate(paths)], "package_id string, entry_index long, path string")
    refs = [("p", 0, "content.xml", "content/resources/a.png", "resolved", False, None), ("p", 1, "x.js", "content/resources/b.png", "resolved", True, None), ("p", 2, "content.xml", None, "missing", False, ["lost/c.png"]), ("p", 3, "content.xml", None, "ambiguous", False, ["content/resources/d.png", "content/resources/b.png"])]
    got = I.classify_usage(entries, spark.createDataFrame(refs, "package_id string, ordinal long, source string, target string, status string, dynamic boolean, candidates array<string>"))
    usage = {r["path"].rsplit("/", 1)[-1]: (r["usage"], r["reasons"]) for r in got.collect()}
    assert usage["content.xml"][0] == "not-applicable" and usage["a.png"][0] == "used" and usage["e.png"] == ("unreferenced", None)
    assert usage["b.png"] == ("uncertain", ["dynamic-reference", "ambiguous-reference", "same-name-as-missing"]) and usage["c.png"] == ("uncertain", ["same-name-as-missing"])
    assert {usage[k][0] for k in ("index.html", "x.png", "y.css", "favicon.ico", "FavIcon.jpeg")} == {"protected"} and usage["apple-touch-icon.png"][0] == "unreferenced"


def test_keep_and_names(spark):
    df = spark.createDataFrame([(1, "bb", 2), (1, "a", 2), (1, "c", 1), (2, "z", 0)], "g long, path string, references long")
    assert rows(I.keep_of_group(df, ["g"]).filter("place = 1"), "g", "keep") == [(1, "a"), (2, "z")]
    names = spark.createDataFrame([("Año Nuevo (2).PNG",), ("a - copy (1).mp3",), ("???",), ("x.tar.gz",)], "p string")
    assert [r[0] for r in names.select(I.clean_name(F.col("p"))).collect()] == ["ano-nuevo.png", "a.mp3", "archivo", "x-tar.gz"]
    names = spark.createDataFrame([("Copia de Foto Clase (2).JPG",), ("informe.pdf.pdf",), ("foto.JPG..pdf",), ("tema.1.pdf",), ("Copy of Copia de x (2) [3] - copia 4.png",), ("(2).png",), ("x..png",), ("Kopie",)], "p string")
    assert [r[0] for r in names.select(I.clean_name(F.col("p"))).collect()] == ["foto-clase.jpg", "informe.pdf", "foto.pdf", "tema-1.pdf", "x.png", "2.png", "x.png", "kopie"]


def test_free_names(spark):
    wanted = spark.createDataFrame([("p", 0, "a.png"), ("p", 1, "A.png"), ("p", 2, "a-2.png"), ("p", 3, "b.png"), ("q", 0, "a.png")], "package_id string, ordinal long, name string")
    taken = spark.createDataFrame([("p", "B.png")], "package_id string, name string")
    got = {(r[0], r[1]): r[2] for r in I.free_names(wanted, taken).select("package_id", "ordinal", "final").collect()}
    assert got == {("p", 0): "a.png", ("p", 1): "A-3.png", ("p", 2): "a-2.png", ("p", 3): "b-2.png", ("q", 0): "a.png"}
    many = spark.createDataFrame([("p", i, "x.png") for i in range(300)], "package_id string, ordinal long, name string")
    held = spark.createDataFrame([("p", f"X-{n}.png") for n in (2, 3, 7, 400)], "package_id string, name string")
    names = [r[0] for r in I.free_names(many, held).orderBy("ordinal").select("final").collect()]
    assert names[:5] == ["x.png", "x-4.png", "x-5.png", "x-6.png", "x-8.png"] and len(set(names)) == 300 and names[-1] == "x-303.png"


def test_plan_is_the_same_in_any_order(spark):
    a = spark.createDataFrame([("p", "recompress-image", "x.png", 100, 60), ("p", "recompress-image", "y.png", 50, 80)], "package_id string, op string, path string, size long, estimate long")
    b = spark.createDataFrame([("p", "remove-unused", "z.png", 10, None)], a.schema)
    one, two = (I.plan_summary(I.plan(x)).first() for x in ((a, b), (b, a.orderBy(F.desc("path")))))
    assert one == two and one["saving"] == 50 and one["operations"] == 3


def test_scanners(spark):
    css = spark.createDataFrame([(1, "@import 'a.css'; /* url(no) */ p{background:url( \"b c.png\" )} i{src:url(d.woff)} q{x:URL('e')}")], "id long, css string")
    assert rows(S.css_references(css, "id", "css"), "kind", "ordinal", "value") == [("import", 0, "a.css"), ("url", 0, "b c.png"), ("url", 1, "d.woff"), ("url", 2, "e")]
    sets = spark.createDataFrame([("a.png 1x, b,c.png 2x,d.png",), ("",)], "s string")
    assert [r[0] for r in sets.select(S.srcset_urls(F.col("s"))).collect()] == [["a.png", "b,c.png", "d.png"], []]
    docs = spark.createDataFrame([(1, '{"a": "x", "b": [1, "y", {"c": "z"}]}'), (2, "no json")], "id long, j string")
    assert rows(S.json_strings(docs, "id", "j"), "id", "path", "value") == [(1, "$.a", "x"), (1, "$.b[1]", "y"), (1, "$.b[2].c", "z")]


def test_manifest(spark):
    texts = spark.createDataFrame([('/* made */ window.m = {"version": 1, "files": ["a", "b"], "projectTitle": "T"};',), ("alert(1)",)], "t string")
    got = [r["manifest"] for r in S.manifest(texts, "t").collect()]
    assert got[0]["files"] == ["a", "b"] and got[1] is None
    listed = spark.createDataFrame([("p", "b", 0), ("p", "gone", 1), ("p", "a", 2)], "package_id string, path string, ordinal long")
    final = spark.createDataFrame([("p", "a", 0), ("p", "new", 1), ("p", "b", 2)], "package_id string, path string, entry_index long")
    assert S.manifest_order(listed, final).first()["files"] == ["b", "a", "new"]
