"""Reference scanners for text layers that regular expressions can express: style sheets, source sets, JSON values, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.paths import trimmed

CSS_URL = "(?i)url\\(\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'()\\s]*))\\s*\\)"
CSS_IMPORT = "(?i)@import\\s+(?:\"([^\"]*)\"|'([^']*)')"


def _any_group(text: Column, pattern: str, groups: int) -> Column:
    """Every match's one non-empty group, in order."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    if groups == 1:
        return found[0]
    return F.transform(F.arrays_zip(*[f.alias(f"g{k}") for k, f in enumerate(found)]), lambda m: F.concat(*[F.coalesce(m[f"g{k}"], F.lit("")) for k in range(groups)]))


def css_references(sheets: DataFrame, id_col: str, css: str) -> DataFrame:
    """One row per url() and @import outside of comments: id, kind, ordinal (within the kind), value."""
    bare = F.regexp_replace(css, "(?s)/\\*.*?\\*/", " ")
    kinds = F.array(F.struct(F.lit("url").alias("kind"), _any_group(bare, CSS_URL, 3).alias("v")), F.struct(F.lit("import").alias("kind"), _any_group(bare, CSS_IMPORT, 2).alias("v")))
    return sheets.select(id_col, F.explode(kinds).alias("k")).select(id_col, "k.kind", F.posexplode("k.v").alias("ordinal", "value"))


def srcset_urls(value: Column) -> Column:
    """The URLs of a source set, in order. A comma inside a URL stays; one at its end parts candidates."""
    candidates = F.regexp_extract_all(value, F.lit("[\\s,]*([^\\s,](?:\\S*[^\\s,])?)(?:\\s+[^\\s,()]+)*\\s*(?:,|$)"), F.lit(1))
    return F.filter(candidates, lambda c: c != "")


#: Objects and arrays are walked to this depth.
JSON_DEPTH = 256


class _Pairs(tuple):
    """The members of a JSON object, repeated keys included."""


def _refuse(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def _json_walk(text: str) -> Iterator[tuple[str, str | None]]:
    """(path, value) of each string, in order; (path, None) of an object or array that is nested too deep."""
    skip = lambda _: None
    try:
        root = json.loads(text, object_pairs_hook=_Pairs, parse_int=skip, parse_float=skip, parse_constant=_refuse)
    except RecursionError:
        yield "$", None
        return
    except ValueError:
        return
    left = [("$", 1, root)]
    while left:
        at, depth, v = left.pop()
        if isinstance(v, str):
            yield at, v
        elif isinstance(v, (_Pairs, list)) and depth > JSON_DEPTH:
            yield at, None
        elif isinstance(v, _Pairs):
            left.extend((f"{at}.{k}", depth + 1, x) for k, x in reversed(v))
        elif isinstance(v, list):
            left.extend((f"{at}[{k}]", depth + 1, v[k]) for k in reversed(range(len(v))))


def _whole(text: str | None) -> str | None:
    """text with U+FFFD for each half of a surrogate pair, which Arrow can't hold."""
    return text if text is None or text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_strings(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every string value of a JSON text with its path, to a depth of 256; texts that aren't JSON give none.

    An object or array beyond the depth gives one row with its path and a null value; a text too deep to be parsed, with the path "$".
    """

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, _whole(at), _whole(v)) for i, t in enumerate(batch.column(1).to_pylist()) if t is not None for at, v in _json_walk(t)]
            places, paths, values = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[id_col, "path", "value"])

    taken = rows.select(id_col, F.col(text).alias("text"))
    return taken.mapInArrow(walk, StructType([taken.schema[0], StructField("path", StringType()), StructField("value", StringType())]))


MANIFEST = "version double, files array<string>, projectTitle string"


def manifest(rows: DataFrame, text: str) -> DataFrame:
    """rows with a struct column manifest: the object assigned after comments; null if there is none."""
    body = F.regexp_extract(F.regexp_replace(text, "(?s)/\\*.*?\\*/|(?m)^\\s*//[^\\n]*$", ""), "(?s)^\\s*[\\w.$ \\t]+=\\s*(\\{.*\\})\\s*;?\\s*$", 1)
    return rows.withColumn("manifest", F.when(body != "", F.from_json(body, MANIFEST)))


def manifest_order(listed: DataFrame, final: DataFrame) -> DataFrame:
    """Final entries (package_id, path, entry_index) in the manifest's order: those that it listed first, then new ones."""
    known = listed.groupBy("package_id", "path").agg(F.min("ordinal").alias("ordinal"))
    place = F.struct(F.col("ordinal").isNull().alias("new"), F.coalesce("ordinal", "entry_index").alias("at"))
    return final.join(known, ["package_id", "path"], "left").groupBy("package_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "path"))), lambda x: x["path"]).alias("files"))


__all__ = ["css_references", "json_strings", "manifest", "manifest_order", "srcset_urls", "trimmed"]
