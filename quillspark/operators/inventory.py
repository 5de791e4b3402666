"""What becomes of a package's entries: usage classes, duplicates to merge, names, and the plan of changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import ancestors, basename, entry_role
from ..functions.text import slug

#: Names of site icons, which browsers find without a reference; what makes a folder a bundle, and folders that never are.
FAVICON = "(?i)(?:^|/)favicon\\.(?:ico|png|svg|gif|jpe?g|webp)$"
ACTIVE = "(?i)\\.(?:html?|xhtml|js|mjs|swf|json|xml)$"
NO_BUNDLE = "^(?:content/resources/|custom/|content/resources/[0-9]{14}[A-Z0-9]{6}/)$"


def classify_usage(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """entries (package_id, path, entry_index) with role, strong, reasons, bundle and usage; the first rule that fits decides.

    refs: package_id, ordinal, source, target, status, dynamic, candidates. A resolved explicit reference is strong. Dynamic, ambiguous and missing references
    are weak: they protect what they may mean, missing ones every user asset of the same base name. Files under a folder that
    holds pages or scripts are protected as a whole.
    """
    keys = ["package_id", "path"]
    strong = refs.filter("status = 'resolved' AND NOT dynamic").groupBy("package_id", F.col("target").alias("path")).agg(F.count("*").alias("strong"), F.array_sort(F.collect_set("source")).alias("sources"))
    weak = refs.filter("status = 'resolved' AND dynamic").select("package_id", F.col("target").alias("path"), "ordinal", F.lit("dynamic-reference").alias("reason"))
    several = refs.filter("status = 'ambiguous'").select("package_id", F.explode("candidates").alias("path"), "ordinal", F.lit("ambiguous-reference").alias("reason"))
    named = refs.filter("status IN ('missing', 'ambiguous')").select("package_id", F.explode("candidates").alias("c"), "ordinal").select("package_id", basename(F.col("c")).alias("name"), "ordinal")
    assets = entries.select("package_id", "path", basename(F.col("path")).alias("name")).filter(entry_role(F.col("path")) == "user-asset")
    by_name = assets.join(named, ["package_id", "name"]).select("package_id", "path", "ordinal", F.lit("same-name-as-missing").alias("reason"))
    first = weak.unionByName(several).unionByName(by_name).groupBy(*keys, "reason").agg(F.min("ordinal").alias("ordinal"))
    reasons = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reason"))), lambda r: r["reason"]).alias("reasons"))
    # A prefix join as an equi-join: every folder above an entry against the folders that hold active content.
    folder = F.element_at(ancestors(F.col("path")), -1)
    active = entries.filter((entry_role(F.col("path")) == "user-asset") & F.col("path").rlike(ACTIVE)).select("package_id", folder.alias("above"), "entry_index").filter(~F.col("above").rlike(NO_BUNDLE))
    bundles = active.groupBy("package_id", "above").agg(F.min("entry_index").alias("found"))
    inside = entries.select("package_id", "path", F.explode(ancestors(F.col("path"))).alias("above")).join(bundles, ["package_id", "above"])
    bundle = inside.groupBy(*keys).agg(F.min_by("above", "found").alias("bundle"))
    out = entries.withColumn("role", entry_role(F.col("path"))).join(strong, keys, "left").join(reasons, keys, "left").join(bundle, keys, "left").fillna(0, ["strong"])
    usage = (
        F.when(F.col("role") != "user-asset", "not-applicable").when(F.col("strong") > 0, "used").when(F.col("bundle").isNotNull(), "protected").when(F.col("path").startswith("custom/"), "protected")
        .when(F.col("reasons").isNotNull(), "uncertain").when(F.col("path").rlike(FAVICON), "protected").otherwise("unreferenced")
    )
    return out.withColumn("usage", usage)


def keep_of_group(members: DataFrame, by: list[str]) -> DataFrame:
    """Of each group (path, references) the member that stays: most references, then the shortest path, then the least; the others name it, with place 2.

    The least is aggregated before it is joined back, so a group of many copies is never sorted in one task.
    """
    least = F.min(F.struct((-F.col("references")).alias("r"), F.length("path").alias("n"), F.col("path").alias("keep")))
    kept = members.groupBy(*by).agg(least.alias("least")).select(*by, F.col("least.keep").alias("keep"))
    return members.join(kept, by).withColumn("place", F.when(F.col("path") == F.col("keep"), 1).otherwise(2))


#: Marks that copying leaves on a name, and extensions of known formats that are dropped inside one.
COPY_PREFIX = "(?i)^(?:copia\\s+de|copy\\s+of|kopie\\s+von|copie\\s+de)\\s+"
COPY_SUFFIX = "(?i)(?:\\s*[-–—_]\\s*|\\s+)(?:copia|copy|kopie|copie)(?:\\s*\\(?\\d+\\)?)?$"
NUMBER_SUFFIX = "\\s*[(\\[]\\d+[)\\]]$"
INNER_EXTENSION = "(?i)(?:\\s*\\.+\\s*(?:pdf|jpe?g|png|gif|webp|svg|bmp|tiff?|heic|mp3|mp4|m4a|m4v|wav|aiff?|flac|ogg|oga|ogv|opus|webm|mov|avi|docx?|xlsx?|pptx?|odt|ods|odp|rtf|txt|html?|zip))+$"


def _without_marks(stem: Column) -> Column:
    """stem without copy marks, taken off as often as there are any: 255 characters, a name's most, hold no more than 85."""

    def once(s: Column) -> Column:
        for pattern in (COPY_PREFIX, COPY_SUFFIX, NUMBER_SUFFIX):
            s = F.regexp_replace(s, pattern, "")
        return F.trim(s)

    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(85), F.floor(F.length(stem) / 3).cast("int") + 1)), F.trim(stem), lambda s, _: F.when(once(s) == s, s).otherwise(once(s)))


def clean_name(path: Column) -> Column:
    """A base name as a slug with its extension in lower case; copy marks and inner extensions go; archivo if nothing is left."""
    name = basename(path)
    parts = "^(.*?[^.\\s])\\s*\\.+([A-Za-z0-9]{1,8})$"
    ext = F.lower(F.regexp_extract(F.trim(name), parts, 2))
    stem = F.when(ext != "", F.regexp_replace(F.regexp_extract(F.trim(name), parts, 1), INNER_EXTENSION, "")).otherwise(name)
    made, whole = slug(_without_marks(stem)), slug(stem)
    return F.concat(F.when(made != "", made).when(whole != "", whole).otherwise("archivo"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (package_id, ordinal, name) with final: name, or name-2, name-3, ... with numbers that are free, whatever the case.

    In each package the first row of a name that nothing holds keeps it. The others of a stem and extension get, in their order, the numbers from 2 on that
    neither taken nor wanted holds: a stem's numbers are one sequence without the held ones, so no row waits for another.
    """
    parts = lambda c: (F.regexp_extract(c, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(c, "(\\.[^.]*)$", 1))
    stem, ext = parts(F.col("name"))
    rows = wanted.withColumns({"stem": stem, "ext": ext, "slot": F.lower("name")})
    held = taken.select("package_id", F.lower("name").alias("slot")).distinct()
    first = F.row_number().over(Window.partitionBy("package_id", "slot").orderBy("ordinal")) == 1
    marked = rows.join(held.withColumn("is_held", F.lit(True)), ["package_id", "slot"], "left").withColumn("own", F.col("is_held").isNull() & first)
    # Held numbers of each stem: names of the form stem-n.ext that are taken, or that a row keeps.
    names = held.unionByName(marked.filter("own").select("package_id", "slot")).distinct()
    base, tail = parts(F.col("slot"))
    numbered = names.select("package_id", F.regexp_extract(base, "^(.*)-([1-9][0-9]{0,8})$", 1).alias("low_stem"), tail.alias("low_ext"), F.regexp_extract(base, "^(.*)-([1-9][0-9]{0,8})$", 2).try_cast("long").alias("n")).filter("n >= 2")
    used = numbered.groupBy("package_id", "low_stem", "low_ext").agg(F.array_sort(F.collect_set("n")).alias("used"))
    later = marked.filter("NOT own").withColumns({"low_stem": F.lower("stem"), "low_ext": F.lower("ext")})
    later = later.withColumn("k", F.row_number().over(Window.partitionBy("package_id", "low_stem", "low_ext").orderBy("ordinal")))
    # The k-th number from 2 that isn't held: each held one at or below the running number moves it on by one.
    number = F.aggregate(F.coalesce("used", F.array().cast("array<bigint>")), (F.col("k") + 1).cast("long"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    made = later.join(used, ["package_id", "low_stem", "low_ext"], "left").select("package_id", "ordinal", "name", F.concat("stem", F.lit("-"), number.cast("string"), "ext").alias("final"))
    return marked.filter("own").select("package_id", "ordinal", "name", F.col("name").alias("final")).unionByName(made)


def plan(parts: Iterable[DataFrame]) -> DataFrame:
    """Operations (package_id, op, path, size, estimate) of all parts, in the plan's order."""
    out = None
    for p in parts:
        p = p.select("package_id", F.concat_ws(":", "op", "path").alias("id"), "op", "path", "size", "estimate")
        out = p if out is None else out.unionByName(p)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy("id")))


def plan_summary(operations: DataFrame) -> DataFrame:
    """Per package: operations, estimated saving, and a hash that changes with any of them."""
    line = F.to_json(F.struct("id", "size", "estimate"))
    return operations.groupBy("package_id").agg(
        F.count("*").alias("operations"),
        F.sum(F.greatest(F.col("size") - F.coalesce("estimate", F.lit(0)), F.lit(0))).alias("saving"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("plan_hash"),
    )
