"""Diagnostics as rows: those of references, those of packages, and the catalogue that gives each code its severity and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import entry_role
from . import summary
from .inventory import ACTIVE, NO_BUNDLE

#: Code, severity, category.
CATALOGUE = """
not-a-zip fatal unsupported-format
legacy-elp fatal unsupported-format
not-an-elpx fatal unsupported-format
zip-structure fatal structure
zip-security fatal security
zip-unsupported fatal unsupported-format
zip-limit fatal security
zip-integrity fatal integrity
zip-name-encoding info information
zip-case-collision warning structure
zip-unaccounted-bytes info structure
zip-archive-comment info information
content-xml-invalid fatal structure
xml-security fatal security
content-xml-not-ode fatal structure
ode-structure error structure
ode-missing-nav warning structure
ode-duplicate-id warning structure
ode-orphan-page warning structure
json-properties-malformed warning structure
content-dtd-missing info structure
screenshot-invalid warning integrity
pp-screenshot-duplicate info information
missing-resource error missing-resource
lenient-resolution warning ambiguous-reference
ambiguous-reference warning ambiguous-reference
asset-uri-unmapped warning ambiguous-reference
stale-editor-path info ambiguous-reference
root-relative-reference warning ambiguous-reference
external-reference info external-reference
dynamic-reference info ambiguous-reference
percent-encoded-reference info information
reference-editable-only info information
reference-published-only info information
extension-mismatch warning unsupported-format
unsupported-media info unsupported-format
manifest-invalid warning packaging
manifest-stale warning packaging
duplicate-content info information
legacy-resource-folders info information
opaque-bundle info information
media-probe-failed warning processing
media-engine-unavailable info processing
processing-failed warning processing
limits-host-policy warning packaging
output-regression fatal integrity
"""
_ROWS = [line.split() for line in CATALOGUE.split("\n") if line]
#: Errors that keep their own code as a fatal diagnostic; a limit becomes zip-limit, any other the fallback.
FATAL = ("zip-structure", "zip-security", "zip-unsupported", "zip-limit", "zip-integrity", "content-xml-invalid", "xml-security", "legacy-elp", "not-a-zip")


def _map(column: int) -> Column:
    return F.create_map(*[F.lit(x) for r in _ROWS for x in (r[0], r[column])])


def severity_of(code: Column) -> Column:
    return F.try_element_at(_map(1), code)


def category_of(code: Column) -> Column:
    return F.try_element_at(_map(2), code)


def fatal_code(error: Column, fallback: str = "zip-structure") -> Column:
    """The code of the fatal diagnostic that an error becomes."""
    return F.when(error.isin(*FATAL), error).when(error == "limit-exceeded", "zip-limit").otherwise(fallback)


def reference_diagnostics(refs: DataFrame) -> DataFrame:
    """One row per diagnostic of resolved references (package_id, ref_id, kind, representation, form, status, target, lenient, percent_encoded, candidates): code, severity, category, resource.

    A reference gives at most two: what its status tells, and that a resolved value is percent-encoded. Dynamic ones only tell where they resolve.
    """
    none = F.lit(None).cast("string")
    row = lambda code, resource=none, severity=none: F.struct(F.lit(code).alias("code"), resource.alias("resource"), severity.alias("own"))
    status, target = F.col("status"), F.col("target")
    soft = F.when((F.col("form") == "stale-editor-path") | (F.col("representation") == "runtime"), "warning")
    main = (
        F.when(F.col("kind") == "dynamic", F.when((status == "resolved") & target.isNotNull(), row("dynamic-reference", target)))
        .when(status == "missing", row("missing-resource", F.get("candidates", F.lit(0)), soft))
        .when(status == "ambiguous", row("ambiguous-reference"))
        .when(status == "unmapped", row("asset-uri-unmapped"))
        .when(status == "external", row("external-reference"))
        .when(status == "unresolvable", row("root-relative-reference"))
        .when((status == "resolved") & (F.col("lenient") == "stale-editor-path"), row("stale-editor-path", target))
        .when((status == "resolved") & (F.col("lenient") == "multiple-prefixes"), row("ambiguous-reference", target, F.lit("info")))
        .when((status == "resolved") & F.col("lenient").isNotNull(), row("lenient-resolution", target))
    )
    coded = F.when((F.col("kind") != "dynamic") & (status == "resolved") & F.col("percent_encoded"), row("percent-encoded-reference", target))
    found = refs.select("package_id", "ref_id", F.explode(F.filter(F.array(main, coded), lambda d: d.isNotNull())).alias("d"))
    code = F.col("d.code")
    return found.select("package_id", "ref_id", code.alias("code"), F.coalesce("d.own", severity_of(code)).alias("severity"), category_of(code).alias("category"), F.col("d.resource").alias("resource"))


def _say(rows: DataFrame, code: str, resource: Column | None = None) -> DataFrame:
    return rows.select("package_id", F.lit(code).alias("code"), (F.lit(None).cast("string") if resource is None else resource).alias("resource"))


def package_diagnostics(entries: DataFrame, rows: DataFrame, duplicates: DataFrame, listed: DataFrame) -> DataFrame:
    """Diagnostics of whole packages: package_id, code, resource, severity, category.

    entries: package_id, path, is_directory, size, kind, format, extension_matches. rows: the document's (see content_rows). duplicates: package_id,
    duplicate_group, path. listed: package_id, path of the download manifest, where there is one.
    """
    files = entries.filter("NOT is_directory")
    user = files.filter(entry_role(F.col("path")) == "user-asset")
    shot = files.filter("path = 'screenshot.png' AND format <> 'png'")
    copied = rows.filter("kind = 'property' AND id = 'pp_screenshot' AND length(name) > 0").select("package_id").distinct()
    over = summary.totals(entries).filter("over_hosted_limits")
    groups = duplicates.groupBy("package_id", "duplicate_group").agg(F.min("path").alias("path"))
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    bundles = user.filter(F.col("path").rlike(ACTIVE) & F.contains("path", F.lit("/"))).select("package_id", folder.alias("path")).distinct().filter(~F.col("path").rlike(NO_BUNDLE))
    with_list = listed.select("package_id").distinct()
    both = listed.select("package_id", "path").distinct().join(files.select("package_id", "path", F.lit(True).alias("here")), ["package_id", "path"], "full").join(with_list, "package_id", "left_semi")
    listed_rows = listed.select("package_id", "path", F.lit(True).alias("named")).distinct()
    stale = both.join(listed_rows, ["package_id", "path"], "left").filter("here IS NULL OR named IS NULL").select("package_id").distinct()
    parts = [
        _say(shot, "screenshot-invalid", F.col("path")), _say(copied, "pp-screenshot-duplicate"), _say(over, "limits-host-policy"), _say(groups, "duplicate-content", F.col("path")),
        _say(bundles, "opaque-bundle", F.col("path")), _say(user.filter("NOT extension_matches"), "extension-mismatch", F.col("path")), _say(summary.legacy_counts(entries), "legacy-resource-folders"),
        _say(stale, "manifest-stale", F.lit("libs/elpx-manifest.js")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"severity": severity_of(F.col("code")), "category": category_of(F.col("code"))})
