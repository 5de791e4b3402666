"""References: finding them in text, classifying them, and resolving them to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import CONTEXT, STALE, basename, dirname, entry_role, from_folder, link_form, path_part, percent_decoded, suffix_part, trimmed, unquoted
from ..functions.text import composed

#: Attributes that hold one URL, and the names of <param> elements whose value is one.
URL_ATTRIBUTES = ("src", "href", "poster", "data", "background", "longdesc", "xlink:href", "lowsrc", "dynsrc", "manifest", "codebase", "archive")
URL_PARAMS = ("movie", "src", "url", "filename", "file", "video", "audio", "flashvars")
ATTRIBUTE = "(?is)(?<![\\w:.-])(?:" + "|".join(URL_ATTRIBUTES) + ")\\s*=\\s*([\"'])(.*?)\\1"
PLACEHOLDER = "\\{\\{context_path\\}\\}/[^\"'<>\\s\\\\]+"
#: Escapes stay as they are; only a template's string holds bare line ends.
QUOTED = "(?s)" + "|".join(f"{q}((?:[^{q}\\\\{end}]++|\\\\.)*+){q}" for q, end in (('"', "\\n"), ("'", "\\n"), ("`", "")))
SCRIPT = "(?is)<script\\b[^>]*>(.*?)</script\\s*>"


def attribute_links(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """One row per quoted URL attribute of the raw text: id, ordinal, value (trimmed), form."""
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ATTRIBUTE), F.lit(2))).alias("ordinal", "raw"))
    return found.select(id_col, "ordinal", trimmed(F.col("raw")).alias("value")).withColumn("form", link_form(F.col("value")))


def placeholders(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every context placeholder with its path, up to a quote, angle bracket, space or backslash."""
    return texts.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(0))).alias("ordinal", "value"))


def quoted_strings(texts: DataFrame, id_col: str, code: str) -> DataFrame:
    """Every quoted string of a script (double, single or backward quotes, escapes inside), in order of its opening."""
    found = F.regexp_extract_all(F.col(code), F.lit(QUOTED), F.lit(0))
    return texts.select(id_col, F.posexplode(found).alias("ordinal", "value")).withColumn("value", F.expr("substr(value, 2, length(value) - 2)"))


def scripts(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """One row per script of a page: id, script_ordinal, script."""
    return pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(SCRIPT), F.lit(1))).alias("script_ordinal", "script"))


def entry_keys(entries: DataFrame, fallback: Column | None = None) -> DataFrame:
    """entries (package_id, path) as lookup keys: exact, composed, lower-case, and base name for the rows where fallback holds."""
    path = composed(F.col("path"))
    names = F.when(F.lit(True) if fallback is None else fallback, basename(path))
    kinds = F.array(F.struct(F.lit("exact").alias("kind"), F.col("path").alias("key")), F.struct(F.lit("unicode").alias("kind"), path.alias("key")), F.struct(F.lit("case").alias("kind"), F.lower(path).alias("key")), F.struct(F.lit("basename").alias("kind"), names.alias("key")))
    return entries.select("package_id", "path", F.explode(kinds).alias("k")).select("package_id", "path", "k.kind", "k.key").filter("key IS NOT NULL")


#: Rules in the order in which they are tried.
RULES = ("exact", "literal-special", "double-slash", "backslash", "unicode", "case", "basename")


def resolve(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """refs (package_id, ref_id, candidates, suffix, by_name) with status, target, rule and candidates found.

    One equi-join on (package, kind of key, key); a window keeps what the first rule, and in it the first candidate, finds. Several exact
    candidates resolve to the first, marked multiple-prefixes; several entries under another rule are ambiguous; the base name
    serves only where by_name holds. Repeated refs give repeated rows only if their ref_id differs.
    """
    tried = refs.select("package_id", "ref_id", "suffix", "by_name", F.posexplode("candidates").alias("at", "raw")).withColumn("decoded", F.coalesce(percent_decoded(F.col("raw")), F.col("raw")))

    def ask(rule: str, kind: str, key: Column, late: bool = False, when: Column | None = None, own: Column | None = None) -> Column:
        wanted = F.when(F.lit(True) if when is None else when, key)
        place = F.struct(F.lit(RULES.index(rule)).alias("rule"), F.lit(late).alias("late"), F.col("at").alias("at"))
        return F.struct(place.alias("place"), F.lit(kind).alias("kind"), wanted.alias("key"), (F.lit(None).cast("string") if own is None else own).alias("own"))

    raw, decoded = F.col("raw"), F.col("decoded")
    asks = [ask("exact", "exact", decoded), ask("literal-special", "exact", F.concat(raw, F.col("suffix")), when=F.col("suffix") != "")]
    for late, v in ((False, raw), (True, decoded)):
        slashes, turned = F.regexp_replace(v, "/{2,}", "/"), F.regexp_replace(v, "\\\\", "/")
        asks += [ask("double-slash", "exact", slashes, late, slashes != v), ask("backslash", "exact", turned, late, turned != v)]
        asks += [ask("unicode", "unicode", composed(v), late, own=v), ask("case", "case", F.lower(composed(v)), late, own=v)]
    asks.append(ask("basename", "basename", basename(composed(decoded)), when=F.col("by_name") & (F.col("at") == 0) & (basename(decoded) != "")))
    wanted = tried.select("package_id", "ref_id", F.explode(F.array(*asks)).alias("a")).select("package_id", "ref_id", "a.*").filter("key IS NOT NULL").distinct()
    hits = wanted.join(keys, ["package_id", "kind", "key"]).filter("own IS NULL OR path <> own")
    # What decides: of exact matches all together, else the first rule and in it the first candidate that finds something.
    exact = F.col("place.rule") == 0
    group = F.when(~exact, F.col("place"))
    grouped = hits.withColumn("group", group).groupBy("package_id", "ref_id", "group").agg(F.min(F.struct("place", "path")).alias("one"), F.array_sort(F.collect_set(F.struct("place", "path"))).alias("all"))
    least = F.struct(F.coalesce("group.rule", F.lit(-1)).alias("r"), F.coalesce("group.late", F.lit(False)).alias("l"), F.coalesce("group.at", F.lit(-1)).alias("a"))
    found = grouped.groupBy("package_id", "ref_id").agg(F.min(F.struct(least.alias("least"), "one", "all")).alias("f"))
    found = found.select("package_id", "ref_id", F.get(F.array(*[F.lit(r) for r in RULES]), F.col("f.one.place.rule")).alias("rule"), F.col("f.one.path").alias("path"), F.array_distinct(F.transform("f.all", lambda x: x["path"])).alias("found"))
    asked = tried.groupBy("package_id", "ref_id").agg(F.bool_or(raw != decoded).alias("encoded"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "decoded"))), lambda x: x["decoded"])).alias("asked"))
    first = F.col("rule") == "exact"
    many = F.size("found") > 1
    status = F.when(F.col("rule").isNull(), "missing").when(many & ~first, "ambiguous").otherwise("resolved")
    lenient = F.when(F.col("status") != "resolved", None).when(first, F.when(many, "multiple-prefixes")).otherwise(F.col("rule"))
    out = refs.join(asked, ["package_id", "ref_id"], "left").join(found, ["package_id", "ref_id"], "left").withColumn("status", status)
    return out.withColumns({
        "target": F.when(F.col("status") == "resolved", F.col("path")), "lenient": lenient,
        "percent_encoded": F.coalesce("encoded", F.lit(False)) & (F.col("status") != "ambiguous") & ~F.coalesce(F.col("rule") == "basename", F.lit(False)),
        "found": F.when(F.col("status") == "missing", F.col("asked")).when(many, F.col("found")),
    }).drop("path", "rule", "encoded", "asked")


def reference_candidates(value: Column, editable: Column, source: Column) -> Column:
    """A struct for a reference value: form, status (null if a lookup decides), candidates, suffix, by_name, rule (of a lenient form), is_folder.

    editable values name entries from the package's root and through placeholders; the others stand in the file source and are seen from its folder.
    """
    v, form = trimmed(value), link_form(value, editable)
    held = F.when(v.startswith(CONTEXT), v).otherwise(F.regexp_replace(unquoted(v), "\\\\+$", ""))
    rest = F.regexp_replace(held.substr(F.lit(len(CONTEXT) + 1), F.length(held)), "^/+", "")
    placed, path = path_part(rest), path_part(v)
    whole = F.array(placed, F.concat(F.lit("content/"), placed), F.concat(F.lit("content/resources/"), placed), F.concat(F.lit("resources/"), placed))
    folder = F.when(editable | ~F.contains(source, F.lit("/")), "").otherwise(F.concat(dirname(source), F.lit("/")))
    seen = from_folder(folder, path)
    is_folder = (form == "relative") & ~editable & ((seen == "") | seen.endswith("/"))
    candidates = (
        F.when(form == "context-path", F.when(placed.startswith("content/resources/"), F.array(placed)).otherwise(whole))
        .when(form == "resources-legacy", F.array(F.concat(F.lit("content/"), path), path))
        .when(form == "stale-editor-path", F.array(F.concat(F.lit("content/resources/"), F.regexp_extract(path, STALE, 1))))
        .when(form == "relative", F.array(F.when(is_folder, F.concat(seen, F.lit("index.html"))).otherwise(seen)))
    )
    status = (
        F.when(form.isin("empty", "fragment", "data-uri", "pseudo") | ((form == "context-path") & (rest == "")), "ignored")
        .when(form == "asset-uri", "unmapped")
        .when(form.isin("absolute-url", "protocol-relative"), "external")
        .when(form.isin("local-file", "root-relative") | ((form == "relative") & seen.isNull()), "unresolvable")
    )
    suffix = F.when(form == "context-path", suffix_part(rest)).when(form == "fragment", v).when(form.isin("resources-legacy", "stale-editor-path", "relative"), suffix_part(v)).otherwise("")
    rule = F.when(form == "stale-editor-path", form).when((form == "context-path") & ~v.startswith(CONTEXT), "escaped-quotes")
    return F.struct(
        form.alias("form"), status.alias("status"), F.when(status.isNull(), candidates).alias("candidates"), suffix.alias("suffix"),
        form.isin("context-path", "resources-legacy").alias("by_name"), rule.alias("rule"), F.coalesce(is_folder, F.lit(False)).alias("is_folder"),
    )


def resolve_references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """refs (package_id, ref_id, value, editable, source, ...) with form, status, target, lenient, percent_encoded, candidates, suffix.

    entries: package_id, path of the files. The base name serves for user assets only. A link to a folder is one to its index page, or
    ignored. ref_id must be unique in its package; null values count as empty.
    """
    c = refs.withColumn("c", reference_candidates(F.coalesce("value", F.lit("")), F.col("editable"), F.coalesce("source", F.lit(""))))
    ids, none = ["package_id", "ref_id"], F.lit(None).cast("string")
    asked = c.filter("c.status IS NULL AND NOT c.is_folder").select(*ids, "c.candidates", "c.suffix", "c.by_name")
    user = entry_role(F.col("path")) == "user-asset"
    looked = resolve(asked, entry_keys(entries, user)).select(*ids, "status", "target", "lenient", "percent_encoded", F.col("found").alias("candidates"), F.when(F.col("lenient") == "literal-special", "").otherwise(F.col("suffix")).alias("suffix"))
    folders = c.filter("c.is_folder").select(*ids, F.col("c.candidates")[0].alias("path"), "c.suffix").join(entries.select("package_id", "path", F.lit(True).alias("here")).distinct(), ["package_id", "path"], "left")
    folders = folders.select(*ids, F.when(F.col("here"), "resolved").otherwise("ignored").alias("status"), F.when(F.col("here"), F.col("path")).alias("target"), none.alias("lenient"), F.lit(False).alias("percent_encoded"), F.lit(None).cast("array<string>").alias("candidates"), "suffix")
    settled = c.filter("c.status IS NOT NULL").select(*ids, "c.status", none.alias("target"), none.alias("lenient"), F.lit(False).alias("percent_encoded"), F.lit(None).cast("array<string>").alias("candidates"), "c.suffix")
    out = c.select(*refs.columns, F.col("c.form").alias("form"), F.col("c.rule").alias("rule")).join(looked.unionByName(folders).unionByName(settled), ids)
    # Only a placeholder or an upload path that resolves tells of its lenient form.
    return out.withColumn("lenient", F.when((F.col("status") == "resolved") & F.col("rule").isNotNull(), F.col("rule")).otherwise(F.col("lenient"))).drop("rule")


__all__ = ["attribute_links", "entry_keys", "path_part", "placeholders", "quoted_strings", "reference_candidates", "resolve", "resolve_references", "scripts", "suffix_part"]
