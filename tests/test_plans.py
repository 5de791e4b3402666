import pytest

from quillspark.plans import options as O
from quillspark.plans import validate as V


def test_options():
    assert O.options().max_side == 1920 and O.options(preset="aggressive").crf == 28 and O.options(preset="aggressive", crf=20).crf == 20
    assert O.options(crf=20).digest() == O.options(crf=20).digest() != O.options(crf=21).digest()
    for bad in ({"crf": 50}, {"preset": "odd"}, {"nothing": 1}, {"force": 1}, {"crf": True}, {"jpeg_quality": "80"}):
        with pytest.raises(ValueError):
            O.options(**bad)
    assert O.options(max_side=None).max_side is None and O.limits(O.BROWSER, entries=5).entries == 5
    with pytest.raises(ValueError):
        O.limits(entries=0)


def test_validation(spark):
    found = spark.createDataFrame(
        [("a", 0, "missing-resource", "error", "x", None, "m"), ("a", 1, "missing-resource", "error", "x", None, "m"), ("a", 2, "gap", "warning", None, None, "g"), ("b", 0, "zip-names", "fatal", None, None, "f"), ("c", 0, "note", "info", None, None, "n")],
        "package_id string, ordinal long, code string, severity string, resource string, location string, message string",
    )
    once = V.distinct_diagnostics(found)
    assert once.count() == 4 and [r["code"] for r in V.in_order(once).filter("package_id = 'a'").orderBy("place").collect()] == ["missing-resource", "gap"]
    got = {r["package_id"]: r for r in V.summaries(spark.createDataFrame([(x,) for x in "abcd"], "package_id string"), once).collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {"a": "invalid", "b": "unusable", "c": "valid", "d": "valid"}
    assert got["a"]["checks"]["local-references"] == "failed" and got["b"]["checks"]["local-references"] == "not-run" and got["b"]["stopped_by"] == "zip-names" and got["d"]["error"] == 0
