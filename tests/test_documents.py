import pytest

from quillspark.sources import documents as D

ODE = """<?xml version="1.0"?><!DOCTYPE ode SYSTEM "content.dtd"><ode xmlns="http://x"><odeProperties><odeProperty><key>pp_title</key><value>T &amp; U</value></odeProperty></odeProperties>
<odeNavStructures><odeNavStructure><odePageId>p1</odePageId><odeParentPageId/><pageName>One</pageName><odePagStructures><odePagStructure><odeBlockId>b1</odeBlockId><blockName>B</blockName>
<odeComponents><odeComponent><odeIdeviceId>c1</odeIdeviceId><odeIdeviceTypeName>text</odeIdeviceTypeName><htmlView><![CDATA[<img src="a.png">]]></htmlView><jsonProperties>{"a":1}</jsonProperties></odeComponent>
<odeComponent><odeIdeviceId>c1</odeIdeviceId></odeComponent></odeComponents></odePagStructure></odePagStructures></odeNavStructure>
<odeNavStructure><odePageId>p2</odePageId><odeParentPageId>gone</odeParentPageId></odeNavStructure></odeNavStructures></ode>"""


@pytest.fixture(scope="module")
def content(spark):
    raws = [ODE, "<ode>", "<html/>", '<!DOCTYPE ode [<!ENTITY a "b">]><ode>&a;</ode>', "<ode/>", "<ode>" + "<x>" * 600 + "</x>" * 600 + "</ode>"]
    return D.content_rows(spark.createDataFrame([(str(i), bytearray(r.encode())) for i, r in enumerate(raws)], "package_id string, content binary"))


def test_content_rows(content):
    got = [(r["kind"], r["id"], r["parent_id"], r["page_id"], r["name"], r["type"], r["html_view"]) for r in content.filter("package_id = '0' AND seq >= 0").orderBy("seq").collect()]
    assert got == [
        ("property", "pp_title", None, None, "T & U", None, None), ("page", "p1", None, None, "One", None, None), ("block", "b1", "p1", "p1", "B", None, None),
        ("component", "c1", "b1", "p1", None, "text", '<img src="a.png">'), ("component", "c1", "b1", "p1", None, None, None), ("page", "p2", "gone", None, None, None, None),
    ]
    assert {r["package_id"]: r["problem"] for r in content.filter("problem IS NOT NULL").collect()} == {"1": "not-well-formed", "2": "not-ode", "3": "entity-declaration", "5": "too-deep"}


def test_structure_problems(content):
    got = {(r["package_id"], r["seq"], r["problem"]) for r in D.structure_problems(content).collect()}
    assert {("0", 4, "repeated-id"), ("0", 4, "missing-type"), ("0", 5, "unknown-parent"), ("4", None, "no-pages"), ("2", None, "not-ode")} <= got and ("0", 3, "repeated-id") not in got


def test_html_fields(spark):
    html = '<base href="no"><a href="x?a=1&amp;b=2" onclick="go(\'y.png\')">t</a>\n<img SRC=z.png srcset="a 1x, b 2x"><style>p{}</style><script>var u="<a href=q>";</script><param name="movie" value="m.swf"><param name="w" value="n"><!-- <a href="c"> -->'
    got = [(r["tag"], r["field"], r["value"], r["line"]) for r in D.html_fields(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html").orderBy("ordinal").collect()]
    assert got == [("a", "href", "x?a=1&b=2", 1), ("a", "onclick", "go('y.png')", 1), ("img", "src", "z.png", 2), ("img", "srcset", "a 1x, b 2x", 2), ("style", "#text", "p{}", 2), ("script", "#text", 'var u="<a href=q>";', 2), ("param", "value", "m.swf", 2)]
