"""Packages in sum: totals, summaries, and entries joined with what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import entry_role, legacy_folder

#: Import limits of hosted editors, in bytes an entry, bytes in all, and entries.
HOSTED = (200 << 20, 500 << 20, 10_000)


def totals(entries: DataFrame) -> DataFrame:
    """Per package of entries (package_id, path, is_directory, size, kind): entries, files, bytes in all and of user assets, images, videos and audio, and whether hosted editors would refuse it."""
    user = (entry_role(F.col("path")) == "user-asset") & ~F.col("is_directory")
    size = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0))
    return entries.groupBy("package_id").agg(
        F.count("*").alias("entries"), F.count_if(~F.col("is_directory")).alias("files"), size(~F.col("is_directory")).alias("uncompressed_bytes"), size(user).alias("user_asset_bytes"),
        *[size(user & (F.col("kind") == k)).alias(f"{k}_bytes") for k in ("image", "video", "audio")], F.coalesce(F.max(F.when(~F.col("is_directory"), F.col("size"))), F.lit(0)).alias("largest"),
    ).withColumn("over_hosted_limits", (F.col("largest") > HOSTED[0]) | (F.col("uncompressed_bytes") > HOSTED[1]) | (F.col("entries") > HOSTED[2]))


def legacy_counts(entries: DataFrame) -> DataFrame:
    """Per package with files in folders of the old layout: legacy_folders, legacy_files."""
    held = entries.filter("NOT is_directory").withColumn("folder", legacy_folder(F.col("path"))).filter("folder <> ''")
    return held.groupBy("package_id").agg(F.count_distinct("folder").alias("legacy_folders"), F.count("*").alias("legacy_files"))


def package_summary(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Per package: what it holds, by its entries and its document's rows (package_id, kind, seq, id, name, type): counts, types, title, ids, and which files exist."""
    has = lambda p: F.bool_or(F.col("path") == p)
    files = entries.groupBy("package_id").agg(has("screenshot.png").alias("has_screenshot"), has("libs/elpx-manifest.js").alias("has_manifest"), has("search_index.js").alias("has_search_index"), has("index.html").alias("has_published_html"))
    first = lambda kind, key: F.min_by(F.when((F.col("kind") == kind) & (F.col("id") == key), F.col("name")), F.when((F.col("kind") == kind) & (F.col("id") == key), F.col("seq")))
    of = rows.groupBy("package_id").agg(
        F.count_if(F.col("kind") == "page").alias("pages"), F.count_if(F.col("kind") == "component").alias("components"), first("property", "pp_title").alias("title"), first("resource", "odeId").alias("ode_id"),
        F.coalesce(first("resource", "exe_version"), first("resource", "eXeVersion")).alias("exe_version"),
    )
    kinds = rows.filter("kind = 'component'").groupBy("package_id", F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    types = kinds.groupBy("package_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    return files.join(of, "package_id", "left").join(types, "package_id", "left").join(legacy_counts(entries), "package_id", "left").fillna(0, ["pages", "components", "legacy_folders", "legacy_files"])


def one_sided(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """User assets that only the editor's data, or only the published pages refer to: package_id, path, code. Stylesheets of the runtime count as neither."""
    by = refs.filter("status = 'resolved' AND representation <> 'runtime'").groupBy("package_id", F.col("target").alias("path")).agg(
        F.bool_and(F.col("representation").isin("editable", "search-index")).alias("edited_only"), F.bool_or(F.col("representation").isin("editable", "search-index")).alias("edited"), F.bool_or(F.col("representation") == "published").alias("published"),
    )
    has_pages = entries.groupBy("package_id").agg(F.bool_or(F.col("path") == "index.html").alias("has_pages"))
    user = entries.filter(~F.col("is_directory") & (entry_role(F.col("path")) == "user-asset")).select("package_id", "path")
    code = F.when(F.col("edited_only") & F.col("has_pages"), "reference-editable-only").when(F.col("published") & ~F.col("edited"), "reference-published-only")
    return user.join(by, ["package_id", "path"]).join(has_pages, "package_id").select("package_id", "path", code.alias("code")).filter("code IS NOT NULL")


def inventory(entries: DataFrame, duplicates: DataFrame, images: DataFrame, probes: DataFrame) -> DataFrame:
    """entries (package_id, path, kind, ...) with duplicate_group, image and media (structs of what images and probes know); a film without a picture stream is audio."""
    keys = ["package_id", "path"]
    known = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    out = entries.join(duplicates.select(*keys, "duplicate_group"), keys, "left").join(known(images, "image"), keys, "left").join(known(probes, "media"), keys, "left")
    silent = (F.col("kind") == "video") & (F.col("media.n_video") == 0) & (F.col("media.n_audio") > 0)
    return out.withColumn("kind", F.when(silent, "audio").otherwise(F.col("kind")))


def failed_carry(packages: DataFrame, summed: DataFrame, numbers: list[str]) -> DataFrame:
    """Every package with its sums; those that couldn't be analysed have zeros, and ok false."""
    return packages.select("package_id").join(summed.withColumn("ok", F.lit(True)), "package_id", "left").fillna(0, numbers).fillna(False, ["ok"])
