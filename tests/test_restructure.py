from pyspark.sql import functions as F

from quillspark.operators import links as L
from quillspark.operators import restructure as S


def test_verified_moves(spark):
    files = ["html/a.html", "html/b.png", "html/sub/c.html", "content/resources/20240101000000ABCDEF/one.png", "content/resources/20240101000000ABCDEF/two x.png", "content/resources/three.png", "content/resources/x/One.png"]
    entries = spark.createDataFrame([(p, f) for p in ("p", "q", "r") for f in files], "package_id string, path string")
    old = "content/resources/20240101000000ABCDEF/"
    values = [("../content/resources/20240101000000ABCDEF/one.png?v=1", False, "html/a.html"), ("{{context_path}}/content/resources/20240101000000ABCDEF/one.png", True, "content.xml"), ("{{context_path}}/" + old + "two x.png", True, "content.xml"), ("b.png", False, "html/a.html"), ("../content/resources/new.png", False, "html/a.html"), ("https://x/y", False, "html/a.html")]
    refs = spark.createDataFrame([(p, i, *v) for p in ("p", "q", "r") for i, v in enumerate(values)], "package_id string, ref_id long, value string, editable boolean, source string")
    found = L.resolve_references(refs, entries)
    moves = [
        ("p", old + "one.png", "content/resources/one.png"), ("p", old + "two x.png", "content/resources/two x.png"),  # the second can't stand in a placeholder
        ("q", old + "one.png", "content/resources/new.png"),  # a missing reference would find it
        ("q", "content/resources/three.png", "content/resources/four.png"),
        ("r", old + "one.png", "content/resources/THREE.png"), ("r", "content/resources/x/One.png", "content/resources/six.png"),  # the first is another's name
    ]
    kept, failed = S.verified_moves(found, entries, spark.createDataFrame(moves, "package_id string, old string, new string"))
    assert sorted((r["package_id"], r["new"]) for r in kept.collect()) == [("p", "content/resources/one.png"), ("q", "content/resources/four.png"), ("r", "content/resources/six.png")]
    assert sorted((r["package_id"], r["reason"]) for r in failed.collect()) == [("p", "not-expressible"), ("q", "captures-reference"), ("r", "name-taken")]
    none = moves[:0]
    kept, failed = S.verified_moves(found, entries, spark.createDataFrame(none, "package_id string, old string, new string"))
    assert kept.isEmpty() and failed.isEmpty()


def test_blocked(spark):
    inventory = spark.createDataFrame(
        [("p", "a", "used", None, None), ("p", "b", "protected", ["x"], None), ("p", "c", "used", ["x"], None), ("p", "d", "unreferenced", ["x"], False), ("p", "e", "used", None, True), ("p", "f", "used", None, None), ("p", "g", "used", None, None), ("p", "h", "used", None, None), ("p", "i", "uncertain", None, None)],
        "package_id string, path string, usage string, reasons array<string>, extension_matches boolean",
    )
    refs = [(1, "explicit", "resolved", "a", None, None, True), (2, "dynamic", "resolved", "e", None, None, True), (3, "explicit", "ambiguous", None, None, ["f", "zz"], True), (4, "explicit", "resolved", "g", "case", None, False), (5, "explicit", "resolved", "h", None, None, False), (6, "explicit", "resolved", "h", "case", None, True)]
    got = S.blocked(inventory, spark.createDataFrame([("p", *r) for r in refs], "package_id string, ref_id long, kind string, status string, target string, lenient string, candidates array<string>, rewritable boolean"), spark.createDataFrame([("p", "zz")], "package_id string, path string"))
    assert {r["path"]: r["reason"] for r in got.select("path", F.col("reason")).collect()} == {"b": "protected", "c": "also-weakly-referenced", "d": "extension-mismatch", "e": "referenced-from-code", "f": "referenced-ambiguously", "g": "lenient-reference", "h": "not-rewritable", "i": "uncertain"}
