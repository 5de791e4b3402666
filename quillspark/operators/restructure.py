"""Moves of entries that keep every reference: planned at once, checked by resolving all references against the names to come, until none fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import composed
from ..functions.values import retargeted
from ..sources.scratch import settled
from .compare import same_resolution
from .links import resolve_references


def blocked(inventory: DataFrame, refs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Why an entry can't be moved or merged: package_id, path, reason (the first that holds); entries that can be have no row.

    inventory: package_id, path, usage, reasons, extension_matches. refs: package_id, ref_id, kind, status, target, lenient, candidates, rewritable.
    """
    every = F.array_distinct(F.filter(F.concat(F.array("target"), F.coalesce("candidates", F.array().cast("array<string>"))), lambda c: c.isNotNull()))
    by = refs.select("package_id", "ref_id", "kind", "status", "target", "lenient", "rewritable", F.explode(every).alias("path"))
    bad = (
        F.when(F.col("kind") != "explicit", "referenced-from-code")
        .when((F.col("status") != "resolved") | (F.col("target") != F.col("path")), "referenced-ambiguously")
        .when(F.col("lenient").isNotNull(), "lenient-reference")
        .when(~F.col("rewritable"), "not-rewritable")
    )
    first = by.withColumn("bad", bad).filter("bad IS NOT NULL").groupBy("package_id", "path").agg(F.min_by("bad", "ref_id").alias("bad"))
    out = inventory.join(excluded.select("package_id", "path", F.lit(True).alias("out")).distinct(), ["package_id", "path"], "left").join(first, ["package_id", "path"], "left")
    weak = (F.col("usage") == "used") & (F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0)
    reason = (
        F.when(F.col("out"), "excluded").when(F.col("usage") == "protected", "protected").when(F.col("usage") == "uncertain", "uncertain").when(weak, "also-weakly-referenced")
        .when(F.col("extension_matches").eqNullSafe(False), "extension-mismatch").otherwise(F.col("bad"))
    )
    return out.select("package_id", "path", reason.alias("reason")).filter("reason IS NOT NULL")


def _colliding(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves whose new name another entry will have, whatever the case; of several that want one name, all but the first."""
    future = entries.join(moves.withColumnRenamed("old", "path"), ["package_id", "path"], "left").select("package_id", F.col("path").alias("old"), F.coalesce("new", "path").alias("name"), F.col("new").isNotNull().alias("moved"))
    place = F.row_number().over(Window.partitionBy("package_id", F.lower(composed(F.col("name")))).orderBy("moved", "old"))
    return future.withColumn("place", place).filter("place > 1 AND moved").select("package_id", "old", F.lit("name-taken").alias("reason"))


def verified_moves(refs: DataFrame, entries: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of moves (package_id, old, new) those that can all be kept together, and the others with a reason: package_id, old, reason.

    refs: package_id, ref_id, value, editable, source and their resolution (see resolve_references); entries: package_id, path of the files. A moved
    target must be reached exactly by the rewritten value; every other reference must resolve as before. A new name that captures a reference
    fails its move; where no name is to blame, all moves of the package fail. Each round only drops moves, so it ends; packages without failures
    change no more.
    """
    known = settled(refs.select("package_id", "ref_id", "value", "editable", "source", "form", "status", "target", "lenient", "candidates"))
    left, failed = settled(moves.select("package_id", "old", "new").distinct()), None
    while True:
        lost = settled(_failures(known, entries, left))
        if lost.isEmpty():
            break
        failed = lost if failed is None else failed.unionByName(lost)
        left = settled(left.join(lost, ["package_id", "old"], "left_anti"))
    none = left.limit(0).select("package_id", "old", F.lit("").alias("reason"))
    return left, none if failed is None else failed


def _failures(refs: DataFrame, entries: DataFrame, moves: DataFrame) -> DataFrame:
    future = entries.join(moves.withColumnRenamed("old", "path"), ["package_id", "path"], "left").select("package_id", F.coalesce("new", "path").alias("path"))
    named = refs.join(moves.select("package_id", F.col("old").alias("target"), F.col("new").alias("goal")), ["package_id", "target"], "left")
    follows = (F.col("status") == "resolved") & F.col("goal").isNotNull()
    made = retargeted(F.col("value"), F.col("form"), F.col("lenient"), F.col("editable"), F.col("source"), F.col("goal"))
    # A value that can't be written fails here; the rest is resolved once more, against the names to come.
    asked = settled(named.withColumn("follows", follows).withColumn("now", F.when(follows, made).otherwise(F.col("value"))))
    mute = asked.filter("follows AND now IS NULL").select("package_id", F.col("target").alias("old"), F.lit("not-expressible").alias("reason"))
    some = asked.filter("NOT (follows AND now IS NULL)").join(moves.select("package_id").distinct(), "package_id", "left_semi")
    was: Column = F.struct("status", "target", "lenient", "candidates").alias("before")
    again = resolve_references(some.select("package_id", "ref_id", F.col("now").alias("value"), "editable", "source", "follows", "goal", was), future)
    again = settled(again.withColumn("after", F.struct("status", "target", "lenient", "candidates")))
    missed = again.filter("follows AND NOT (status = 'resolved' AND target <=> goal AND lenient IS NULL)").select("package_id", F.col("before.target").alias("old"), F.lit("not-reached").alias("reason"))
    other = again.filter(~F.col("follows") & ~same_resolution())
    seen = F.filter(F.concat(F.array("target"), F.coalesce("candidates", F.array().cast("array<string>"))), lambda c: c.isNotNull())
    culprits = other.select("package_id", "ref_id", F.explode(seen).alias("new")).join(moves, ["package_id", "new"]).select("package_id", "ref_id", "old")
    blamed = culprits.select("package_id", "old", F.lit("captures-reference").alias("reason"))
    stray = other.join(culprits.select("package_id", "ref_id").distinct(), ["package_id", "ref_id"], "left_anti").select("package_id").distinct()
    whole = moves.join(stray, "package_id", "left_semi").select("package_id", "old", F.lit("changes-references").alias("reason"))
    every = mute.unionByName(missed).unionByName(blamed).unionByName(whole).unionByName(_colliding(entries, moves))
    return every.groupBy("package_id", "old").agg(F.min("reason").alias("reason"))
