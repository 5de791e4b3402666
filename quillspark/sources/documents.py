"""Content documents and pages as rows: small parsers in tasks, everything that compares rows in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.links import URL_ATTRIBUTES, URL_PARAMS

COMPONENT = "package_id string, kind string, seq long, id string, parent_id string, page_id string, name string, type string, html_view string, json_properties string, problem string"
_COMPONENT = [f.strip().split(" ")[0] for f in COMPONENT.split(",")]

#: Fixed values of the format: element -> (kind, id, parent, name, type).
ELEMENTS = {
    "odeNavStructure": ("page", "odePageId", "odeParentPageId", "pageName", None),
    "odePagStructure": ("block", "odeBlockId", None, "blockName", None),
    "odeComponent": ("component", "odeIdeviceId", None, None, "odeIdeviceTypeName"),
    "odeProperty": ("property", "key", None, "value", None),
    "odeResource": ("resource", "key", None, "value", None),
}


class _Refused(Exception):
    pass


def _document(raw: bytes, most_depth: int) -> Iterator[dict]:
    """Rows of a content document in document order; a row with a problem if it isn't well formed or declares entities."""
    parser, stack, rows, path = expat.ParserCreate(namespace_separator=None), [], [], []

    def refuse(*_):
        raise _Refused("entity-declaration")

    def start(name: str, _: dict) -> None:
        path.append(name)
        if len(path) > most_depth:
            raise _Refused("too-deep")
        if len(path) == 1 and name != "ode":
            raise _Refused("not-ode")
        if name in ELEMENTS:
            row = {"kind": ELEMENTS[name][0], "seq": len(rows)}
            row["page_id"] = next((s for s in reversed(stack) if s["kind"] == "page"), None)
            row["up"] = stack[-1] if stack else None
            rows.append(row)
            stack.append(row)

    def text(data: str) -> None:
        if stack and path[-1] not in ELEMENTS:
            stack[-1].setdefault(f"_{path[-1]}", []).append(data)

    def end(name: str) -> None:
        path.pop()
        if name in ELEMENTS:
            stack.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, text, refuse
    try:
        parser.Parse(raw, True)
    except expat.ExpatError:
        return iter([{"problem": "not-well-formed"}])
    except _Refused as e:
        return iter([{"problem": str(e)}])
    out = [{"kind": "document", "seq": -1, "page_id": None, "up": None, "parent": None}]
    for row in rows:
        _, id_, parent, name, type_ = next(v for v in ELEMENTS.values() if v[0] == row["kind"])
        get = lambda field, row=row: "".join(row.get(f"_{field}", [])) if field and f"_{field}" in row else None
        row |= {"id": get(id_), "name": get(name), "type": get(type_), "html_view": get("htmlView"), "json_properties": get("jsonProperties"), "parent": get(parent)}
        out.append(row)
    return ({**r, "page_id": r["page_id"]["id"] if r["page_id"] else None, "parent_id": r["parent"] if r["kind"] == "page" else r["up"]["id"] if r["up"] else None, "problem": None} for r in out)


def content_rows(contents: DataFrame, most_depth: int = 512) -> DataFrame:
    """The document itself (seq -1), then pages, blocks, components, properties and resources of content documents (package_id, content), in document order.

    A document that isn't well formed, isn't an ode document, is nested too deep or declares entities gives one row with a problem.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(_document(raw.as_py() or b"", most_depth))
                yield pa.RecordBatch.from_arrays([pa.array([package if f == "package_id" else r.get(f) for r in found], pa.int64() if f == "seq" else pa.string()) for f in _COMPONENT], names=_COMPONENT)

    return contents.select("package_id", "content").mapInArrow(rows, COMPONENT)


def structure_problems(rows: DataFrame) -> DataFrame:
    """(package_id, seq, problem): missing and repeated ids, unknown parent pages, documents without pages."""
    parts = rows.filter("kind IN ('page', 'block', 'component')")
    say = lambda df, what: df.select("package_id", "seq", F.lit(what).alias("problem"))
    again = F.row_number().over(Window.partitionBy("package_id", "id").orderBy("seq")) > 1
    pages = parts.filter("kind = 'page'")
    known = pages.select("package_id", F.col("id").alias("parent_id"))
    orphans = pages.filter("coalesce(parent_id, '') <> ''").join(known, ["package_id", "parent_id"], "left_anti")
    none = rows.groupBy("package_id").agg(F.count_if(F.col("kind") == "page").alias("n"), F.count("problem").alias("broken"), F.lit(None).cast("long").alias("seq")).filter("n = 0 AND broken = 0")
    named = parts.filter("coalesce(id, '') <> ''").withColumn("again", again)
    out = [say(parts.filter("coalesce(id, '') = ''"), "missing-id"), say(named.filter("again"), "repeated-id"), say(orphans, "unknown-parent"), say(none, "no-pages"), say(parts.filter("kind = 'component' AND coalesce(type, '') = ''"), "missing-type"), rows.filter("problem IS NOT NULL").select("package_id", "seq", "problem")]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


class _Attributes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str, int, int]] = []
        self.inside: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        line, column = self.getpos()
        names = {k: v for k, v in attrs}
        for k, v in attrs:
            if v is None or tag == "base" and k == "href":
                continue
            if k in URL_ATTRIBUTES or k in ("srcset", "style") or k.startswith("on") or tag == "param" and k == "value" and (names.get("name") or "").lower() in URL_PARAMS:
                self.found.append((tag, k, v, line, column))
        self.inside = tag if tag in ("style", "script") else None

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        self.inside = None

    def handle_data(self, data: str) -> None:
        if self.inside and data.strip():
            line, column = self.getpos()
            self.found.append((self.inside, "#text", data, line, column))


FIELD = "tag string, field string, ordinal long, value string, line long, column long"


def html_fields(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """Every attribute and text that can hold references: id, tag, field (attribute, or #text of style and script), ordinal, value (decoded), line, column."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tool = _Attributes()
                tool.feed(text.as_py() or "")
                tool.close()
                for k, (tag, field, value, line, column) in enumerate(tool.found):
                    for c, v in zip(out, (key, tag, field, k, value, line, column), strict=True):
                        c.append(v)
            kinds = (batch.schema.types[0], pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[id_col, "tag", "field", "ordinal", "value", "line", "column"])

    return pages.select(id_col, html).mapInArrow(rows, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, {FIELD}")
