"""Column builders for package paths and reference values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that belong to the runtime, and files that belong to the package format.
RUNTIME_PREFIXES = ("theme/", "libs/", "idevices/", "content/css/", "content/img/")
PACKAGE_FILES = ("content.xml", "content.dtd", "screenshot.png", "search_index.js", "libs/elpx-manifest.js")
PSEUDO_SCHEMES = ("exe-node", "exe-package", "javascript", "mailto", "tel", "sms", "about", "blob", "geo")
CONTEXT = "{{context_path}}"

#: White space in the wide sense: Unicode spaces and the byte order mark.
_SPACE = "[\\s\\x{FEFF}]+"


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder with no slash at its end; empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extname(path: Column) -> Column:
    """The lower-case extension without its dot; a dot that opens the name is none."""
    return F.lower(F.regexp_extract(basename(path), "^.+\\.([^.]*)$", 1))


def path_part(value: Column) -> Column:
    """A reference value without query and fragment."""
    return F.regexp_extract(value, "^([^?#]*)", 1)


def suffix_part(value: Column) -> Column:
    """Query and fragment of a reference value."""
    return F.regexp_extract(value, "^[^?#]*(.*)$", 1)


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"(?U)^{_SPACE}|{_SPACE}$", "")


def percent_decoded(value: Column) -> Column:
    """Decoded once; null if malformed or not UTF-8. A plus sign stays one."""
    out = F.try_url_decode(F.regexp_replace(value, "\\+", "%2B"))
    return F.when(F.contains(out, F.lit("�")) & ~F.contains(value, F.lit("�")) & ~F.contains(F.upper(value), F.lit("%EF%BF%BD")), None).otherwise(out)


def normalized(folder: Column, path: Column) -> Column:
    """path seen from folder, with . and .. resolved; null above the root."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(a: Column, s: Column) -> Column:
        up = F.when(F.size(a["at"]) > 0, F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0)))).otherwise(a["at"])
        return (
            F.when(s.isin("", "."), a)
            .when(s == "..", F.struct(up.alias("at"), (a["ok"] & (F.size(a["at"]) > 0)).alias("ok")))
            .otherwise(F.struct(F.concat(a["at"], F.array(s)).alias("at"), a["ok"].alias("ok")))
        )

    joined = F.when(folder == "", path).otherwise(F.concat_ws("/", folder, path))
    return F.aggregate(F.split(joined, "/"), start, step, lambda a: F.when(a["ok"], F.array_join(a["at"], "/")))


def ancestors(path: Column) -> Column:
    """Every folder above a path, outermost first, each with its slash."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))


def entry_role(path: Column) -> Column:
    """package, page, runtime, user-asset or other; the first rule that fits."""
    runtime = F.lit(False)
    for p in RUNTIME_PREFIXES:
        runtime = runtime | path.startswith(p)
    return (
        F.when(path.isin(*PACKAGE_FILES), "package")
        .when((path == "index.html") | path.rlike("^html/[^/]+\\.html?$"), "page")
        .when(runtime, "runtime")
        .when(path.startswith("content/resources/") | path.startswith("custom/"), "user-asset")
        .otherwise("other")
    )


def legacy_folder(path: Column) -> Column:
    """The editor's folder name in a path of the old layout, else empty."""
    return F.regexp_extract(path, "^content/resources/([0-9]{14}[A-Z0-9]{6})/[^/]+$", 1)


def display_name(path: Column) -> Column:
    """The last segment, control characters as underscores, 255 characters at most."""
    return F.substring(F.regexp_replace(basename(path), "[\\x00-\\x1F\\x7F]", "_"), 1, 255)


def name_problem(path: Column, most_depth: int = 64) -> Column:
    """Why a package can't hold an entry of this name; null if it can."""
    segments = F.split(F.regexp_replace(path, "/$", ""), "/")
    return (
        F.when(path == "", "empty")
        .when(path.rlike("[\\x00-\\x1F\\x7F]"), "control-character")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(F.size(segments) > most_depth, "too-deep")
        .when(F.exists(segments, lambda s: s == ""), "empty-segment")
        .when(F.exists(segments, lambda s: s.isin(".", "..")), "dot-segment")
    )


def unquoted(value: Column) -> Column:
    """A value without the quotes, plain or escaped, that are left around it."""
    return F.regexp_replace(F.regexp_replace(value, "^(?:\\\\?[\"'])+", ""), "(?:\\\\?[\"'])+$", "")


def link_form(value: Column, editable: Column | None = None) -> Column:
    """The form of a reference value; the first rule that fits. editable: the value stands in the editor's data, not in a file."""
    v = trimmed(value)
    bare = unquoted(v)
    wrapped, edit = bare != v, F.lit(False) if editable is None else editable
    drive = v.rlike("^[A-Za-z]:[\\\\/]")
    scheme = F.when(drive, "").otherwise(F.lower(F.regexp_extract(v, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
    return (
        F.when(v == "", "empty")
        .when(v.startswith("#"), "fragment")
        .when(v.startswith(CONTEXT), "context-path")
        .when(wrapped & bare.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), "absolute-url")
        .when(wrapped & bare.startswith(CONTEXT), "context-path")
        .when(scheme == "asset", "asset-uri")
        .when(scheme == "data", "data-uri")
        .when(scheme == "file", "local-file")
        .when(scheme.isin(*PSEUDO_SCHEMES), "pseudo")
        .when(scheme != "", "absolute-url")
        .when(drive | v.startswith("\\\\"), "local-file")
        .when(v.startswith("//"), "protocol-relative")
        .when(v.startswith("/"), "root-relative")
        .when(edit & v.startswith("resources/"), "resources-legacy")
        .when(edit & path_part(v).rlike(STALE), "stale-editor-path")
        .otherwise("relative")
    )


#: A path of the editor's upload folder; its last folder and name.
STALE = "^files/tmp/(?:[^/]+/)*?([^/]+/[^/]+)$"


def from_folder(folder: Column, path: Column) -> Column:
    """folder (empty, or with its slash) and path joined, . and .. resolved, empty segments kept; null above the root."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(a: Column, s: Column) -> Column:
        size = F.size(a["at"])
        up = F.struct(F.slice(a["at"], F.lit(1), F.greatest(size - 1, F.lit(0))).alias("at"), (a["ok"] & (size > 0)).alias("ok"))
        return F.when(s == ".", a).when(s == "..", up).otherwise(F.struct(F.concat(a["at"], F.array(s)).alias("at"), a["ok"].alias("ok")))

    return F.aggregate(F.split(F.concat(folder, path), "/"), start, step, lambda a: F.when(a["ok"], F.array_join(a["at"], "/")))
