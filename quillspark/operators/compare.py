"""A package before and after: what came, what went, what no longer resolves, and whether the change is worth keeping. Everything is a join or a window by package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import ancestors

#: Diagnostics that tell of a regression where only the changed package has them; operations that are wanted whatever they save.
REGRESSIONS = ("missing-resource", "ambiguous-reference", "lenient-resolution", "asset-uri-unmapped", "content-xml-invalid", "ode-structure", "json-properties-malformed", "screenshot-invalid", "extension-mismatch", "manifest-invalid")
STRUCTURAL = ("move-resource", "rename-resource", "remove-missing-reference", "replace-screenshot")


def under_old_names(rows: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    """rows with a path column put back to the name before renames (package_id, old, new)."""
    back = renames.select("package_id", F.col("new").alias(column), F.col("old").alias("_old"))
    return rows.join(back, ["package_id", column], "left").withColumn(column, F.coalesce("_old", column)).drop("_old").select(*rows.columns)


def regressions(before: DataFrame, after: DataFrame, renames: DataFrame, removed: DataFrame, keys: tuple[str, ...] = ("code", "resource", "location")) -> DataFrame:
    """Diagnostics of after (package_id, code, resource, ...) that tell of a regression: not in before under the old name, nor about a removed path."""
    some = after.filter(F.col("code").isin(*REGRESSIONS)).join(removed.select("package_id", F.col("path").alias("resource")), ["package_id", "resource"], "left_anti")
    named = under_old_names(some, renames, "resource").select("package_id", *keys)
    known = before.select("package_id", *keys).distinct().alias("b")
    same = F.col("a.package_id") == F.col("b.package_id")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return named.alias("a").join(known, same, "left_anti")


def lost_references(before: DataFrame, after: DataFrame) -> DataFrame:
    """References of after (package_id, entry, value, status) that don't resolve, though the same value of the same entry did."""
    held = before.filter("status = 'resolved'").select("package_id", "entry", "value").distinct()
    return after.filter("status <> 'resolved'").join(held, ["package_id", "entry", "value"], "left_semi")


def resolved_count(refs: DataFrame, removed: DataFrame) -> DataFrame:
    """Per package: resolved, its explicit references that resolve, those in removed entries left out."""
    kept = refs.join(removed.select("package_id", F.col("path").alias("entry")), ["package_id", "entry"], "left_anti")
    return kept.groupBy("package_id").agg(F.count_if((F.col("kind") == "explicit") & (F.col("status") == "resolved")).alias("resolved"))


def changed_entries(before: DataFrame, after: DataFrame, renames: DataFrame, planned: DataFrame) -> DataFrame:
    """Per package: changed, entries of other content than under their old name, and unexpected, those of them that planned (package_id, path) doesn't name."""
    old = before.select("package_id", "path", F.col("crc32").alias("_crc"), F.col("size").alias("_size"))
    both = under_old_names(after.select("package_id", "path", "crc32", "size"), renames, "path").join(old, ["package_id", "path"])
    marked = both.join(planned.select("package_id", "path", F.lit(True).alias("_planned")).distinct(), ["package_id", "path"], "left")
    differs = (F.col("crc32") != F.col("_crc")) | (F.col("size") != F.col("_size"))
    return marked.groupBy("package_id").agg(F.count_if(differs).alias("changed"), F.count_if(differs & F.col("_planned").isNull()).alias("unexpected"))


def same_sequence(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per package: same, whether the paths of both (package_id, path, place) agree in their order. Only neighbours in rank meet; no list is gathered."""
    at = F.row_number().over(Window.partitionBy("package_id").orderBy("place", "path"))
    one, two = (df.select("package_id", at.alias("rank"), F.col("path").alias(name)) for df, name in ((expected, "one"), (actual, "two")))
    both = one.join(two, ["package_id", "rank"], "full")
    return both.groupBy("package_id").agg(F.bool_and(F.col("one").eqNullSafe(F.col("two"))).alias("same"))


def expected_entries(before: DataFrame, renames: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The paths (package_id, path, place) that a change leads to: those kept, under their new names, then those added."""
    kept = before.join(removed.select("package_id", "path"), ["package_id", "path"], "left_anti").join(renames.select("package_id", F.col("old").alias("path"), "new"), ["package_id", "path"], "left")
    place = lambda late, at: F.struct(F.lit(late).alias("late"), F.col(at).alias("at")).alias("place")
    return kept.select("package_id", F.coalesce("new", "path").alias("path"), place(False, "entry_index")).unionByName(added.select("package_id", "path", place(True, "entry_index")))


def same_resolution(a: str = "before", b: str = "after") -> Column:
    """Whether two resolutions (structs status, target, lenient, candidates) agree; candidates as a set."""
    of = lambda s, f: F.col(f"{s}.{f}")
    listed = lambda s: F.array_sort(F.coalesce(of(s, "candidates"), F.array().cast("array<string>")))
    return of(a, "status").eqNullSafe(of(b, "status")) & of(a, "target").eqNullSafe(of(b, "target")) & of(a, "lenient").eqNullSafe(of(b, "lenient")) & (listed(a) == listed(b))


def emptied_directories(directories: DataFrame, changed: DataFrame, final: DataFrame) -> DataFrame:
    """Directories (package_id, path, with its slash) above a changed file under which no final file lies."""
    above = lambda df: df.select("package_id", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    keys = ["package_id", "path"]
    return directories.join(above(changed), keys, "left_semi").join(above(final), keys, "left_anti")


def net_benefit(packages: DataFrame, results: DataFrame) -> DataFrame:
    """packages (package_id, size_before, size_after) with delivered: optimized, or original where nothing was applied, or nothing saved and nothing moved."""
    applied = F.col("status") == "applied"
    done = results.groupBy("package_id").agg(F.count_if(applied).alias("applied"), F.bool_or(applied & F.col("op").isin(*STRUCTURAL)).alias("structural"))
    out = packages.join(done, "package_id", "left").fillna(0, ["applied"]).fillna(False, ["structural"])
    keep = (F.col("applied") == 0) | ((F.col("size_after") >= F.col("size_before")) & ~F.col("structural"))
    return out.withColumn("delivered", F.when(keep, "original").otherwise("optimized"))


def rewritten_counts(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (package_id, path) with references: how many resolved references a move or merge of the path rewrites."""
    n = refs.filter("status = 'resolved'").groupBy("package_id", F.col("target").alias("path")).agg(F.count("*").alias("references"))
    return changes.join(n, ["package_id", "path"], "left").fillna(0, ["references"])


def references_by_target(refs: DataFrame) -> DataFrame:
    """(package_id, path, ref_id): each reference under its target and under every other candidate, once."""
    every = F.array_distinct(F.filter(F.concat(F.array("target"), F.coalesce("candidates", F.array().cast("array<string>"))), lambda c: c.isNotNull()))
    return refs.select("package_id", "ref_id", F.explode(every).alias("path"))


def is_broken(status: Column, form: Column) -> Column:
    """Whether a reference's target can't exist in the package."""
    return status.isin("missing", "unmapped") | ((status == "unresolvable") & (form == "local-file"))


def unlink_key(status: Column, candidates: Column, value: Column) -> Column:
    """The missing file that a broken reference means: its place among the resources if a candidate names one, else the first candidate, else the value."""
    named = F.when(status == "missing", candidates)
    return F.coalesce(F.get(F.filter(named, lambda c: c.startswith("content/resources/")), F.lit(0)), F.get(named, F.lit(0)), value)


def unlinks(removals: DataFrame) -> DataFrame:
    """Per package and missing file of removals (package_id, key, action, entry): references, how many go by each action, and the entries."""
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ("element", "attribute", "value")]
    return removals.groupBy("package_id", "key").agg(F.count("*").alias("references"), *counts, F.array_sort(F.collect_set("entry")).alias("entries"))


def distinct_skips(skips: DataFrame) -> DataFrame:
    """Skips (package_id, kind, path, reason) once each, with their place by path and kind."""
    once = skips.select("package_id", "kind", "path", "reason").distinct()
    return once.withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy("path", "kind", "reason")))


def nested_edits(edits: DataFrame) -> DataFrame:
    """Edits (package_id, entry, start, end, value) with verdict: kept, covered (inside a removal, or a repeat), or overlap.

    In the order of starts, longer ones first, an edit either opens a stretch that no earlier one reaches, or lies with that stretch's first.
    """
    order = Window.partitionBy("package_id", "entry").orderBy("start", F.desc("end"), "value")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("start") > reach) | ((F.col("start") == reach) & (F.col("end") > F.col("start")))
    marked = edits.withColumn("stretch", opens.cast("int")).withColumn("stretch", F.sum("stretch").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("package_id", "entry", "stretch").orderBy("start", F.desc("end"), "value")
    first, k = F.first(F.struct("start", "end", "value")).over(own), F.row_number().over(own)
    seen = marked.withColumns({"lead": first, "k": k})
    inside = F.col("end") <= F.col("lead.end")
    repeat = (F.col("start") == F.col("lead.start")) & (F.col("end") == F.col("lead.end")) & (F.col("value") == F.col("lead.value"))
    verdict = F.when(F.col("k") == 1, "kept").when(inside & ((F.col("lead.value") == "") | repeat), "covered").when(F.col("start") >= F.col("lead.end"), "kept").otherwise("overlap")
    return seen.withColumn("verdict", verdict).drop("stretch", "lead", "k")


def validations(before: DataFrame, after: DataFrame, before_refs: DataFrame, after_refs: DataFrame, before_found: DataFrame, after_found: DataFrame, renames: DataFrame, removed: DataFrame, added: DataFrame, planned: DataFrame) -> DataFrame:
    """(package_id, name, ok) of the checks that compare a changed package with the one before: entry-set, unchanged-entries-preserved, no-new-problems, references-still-resolve.

    before, after: entries (package_id, path, entry_index, crc32, size). A package that has no row in a check passes it.
    """
    packages = before.select("package_id").distinct()
    none = removed.limit(0)
    sets = same_sequence(expected_entries(before, renames, removed, added), after.select("package_id", "path", F.struct(F.lit(False).alias("late"), F.col("entry_index").alias("at")).alias("place")))
    kept = changed_entries(before, after, renames, planned).select("package_id", (F.col("unexpected") == 0).alias("ok"))
    new = regressions(before_found, after_found, renames, removed).select("package_id").distinct().withColumn("ok", F.lit(False))
    lost = lost_references(before_refs, after_refs).select("package_id").distinct().withColumn("lost", F.lit(True))
    was, now = resolved_count(before_refs, removed).withColumnRenamed("resolved", "was"), resolved_count(after_refs, none).withColumnRenamed("resolved", "now")
    refs = packages.join(was, "package_id", "left").join(now, "package_id", "left").join(lost, "package_id", "left").fillna(0, ["was", "now"])
    refs = refs.select("package_id", (F.col("lost").isNull() & (F.col("now") >= F.col("was"))).alias("ok"))
    out = None
    for name, part in (("entry-set", sets.withColumnRenamed("same", "ok")), ("unchanged-entries-preserved", kept), ("no-new-problems", new), ("references-still-resolve", refs)):
        rows = packages.join(part, "package_id", "left").select("package_id", F.lit(name).alias("name"), F.coalesce("ok", F.lit(True)).alias("ok"))
        out = rows if out is None else out.unionByName(rows)
    return out
