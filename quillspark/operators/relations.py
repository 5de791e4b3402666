"""Inventory operators: usage, duplicates, limits, listings, differences, edits."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_duplicates(rows: DataFrame, id_col: str, content: str) -> DataFrame:
    """Groups of equal content: content_sha256, size, copies, keep (least id). A cheap key, size and crc, is grouped before any hash is made."""
    sized = rows.select(id_col, content, F.octet_length(content).cast("long").alias("size"), F.crc32(F.col(content).cast("binary")).alias("crc"))
    several = sized.groupBy("size", "crc").agg(F.count("*").alias("n")).filter("n > 1").select("size", "crc")
    hashed = sized.join(several, ["size", "crc"]).select(id_col, "size", F.sha2(F.col(content).cast("binary"), 256).alias("content_sha256"))
    return hashed.groupBy("content_sha256", "size").agg(F.count("*").alias("copies"), F.min(id_col).alias("keep")).filter("copies > 1")


def usage(targets: DataFrame, strong: DataFrame, weak: DataFrame, key: str) -> DataFrame:
    """targets with strong and weak counts and a class: used, uncertain or unreferenced. References are counted before the join."""
    s = strong.groupBy(key).agg(F.count("*").alias("strong"))
    w = weak.groupBy(key).agg(F.count("*").alias("weak"))
    out = targets.join(s, key, "left").join(w, key, "left").fillna(0, ["strong", "weak"])
    return out.withColumn("usage", F.when(F.col("strong") > 0, "used").when(F.col("weak") > 0, "uncertain").otherwise("unreferenced"))


def overlaps(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Per group: rows that start before the one before them ends, and the sum of the gaps."""
    w = Window.partitionBy(by).orderBy(start, end)
    before = F.lag(end).over(w)
    return rows.withColumn("before", before).groupBy(by).agg(F.count_if(F.col(start) < F.col("before")).alias("overlaps"), F.coalesce(F.sum(F.when(F.col(start) > F.col("before"), F.col(start) - F.col("before"))), F.lit(0)).alias("gaps"))


def within_limit(rows: DataFrame, by: str, order: str, size: str, limit: int, span: int = 10_000) -> DataFrame:
    """rows with the running total of size in their group, and whether it still keeps the limit. order is a whole number without repeats.

    Totals of spans of the order are summed up first, so a task holds one span of a group, not the group.
    """
    part = F.expr(f"`{order}` DIV {span}")
    sums = rows.groupBy(by, part.alias("span")).agg(F.sum(size).alias("total"))
    before = sums.select(by, "span", (F.sum("total").over(Window.partitionBy(by).orderBy("span")) - F.col("total")).alias("before"))
    own = Window.partitionBy(by, "span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut_up = rows.withColumn("span", part).withColumn("own", F.sum(size).over(own)).alias("r")
    joined = cut_up.join(before.alias("b"), F.col(f"r.{by}").eqNullSafe(F.col(f"b.{by}")) & F.col("r.span").eqNullSafe(F.col("b.span")))
    out = joined.select("r.*", (F.col("own") + F.col("before")).alias("running")).drop("own", "span")
    return out.withColumn("within", F.col("running") <= limit)


def largest(rows: DataFrame, by: str, size: str, tie: str, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(size), tie))).filter(F.col("place") <= n)


def collisions(rows: DataFrame, by: list[str], key: Column, order: str) -> DataFrame:
    """Rows whose key an earlier row of the group has."""
    w = Window.partitionBy(*by, "collision_key").orderBy(order)
    return rows.withColumn("collision_key", key).withColumn("place", F.row_number().over(w)).filter("place > 1")


def collapsed(rows: DataFrame, by: str, size: str, order: str, most: int = 3) -> DataFrame:
    """Groups of up to most rows as rows; larger ones as one line with a count, and a sum of sizes if all are known."""
    sums = rows.groupBy(by).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.when(F.count(size) == F.count("*"), F.sum(size)).alias("size"))
    few = rows.join(sums.filter(F.col("n") <= most).select(F.col(by).alias("_by")), F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    return few.select(by, F.col(order).alias("first"), F.lit(1).cast("long").alias("n"), F.col(size).alias("size")).unionByName(sums.filter(F.col("n") > most))


def one_sided(one: DataFrame, two: DataFrame, keys: list[str], per_task: int = 4_000_000) -> DataFrame:
    """Keys that only one side has, with their rows there: ones, twos. A null key is no other null key, so it may have both.

    One shuffle and one aggregation, no join. Keys are so narrow that tasks sized by bytes would hold tens of millions; here a task takes about per_task rows.
    """
    rows = one.select(*keys, F.lit(True).alias("_one")).unionByName(two.select(*keys, F.lit(False).alias("_one")))
    sides = rows.repartition(rows.count() // per_task + 1, *keys).groupBy(*keys).agg(F.count_if("_one").alias("ones"), F.count_if(~F.col("_one")).alias("twos"))
    return sides.filter((F.col("ones") == 0) | (F.col("twos") == 0) | reduce(or_, [F.col(k).isNull() for k in keys]))


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: introduced or resolved."""
    change = F.array_compact(F.array(F.when(F.col("ones") > 0, "resolved"), F.when(F.col("twos") > 0, "introduced")))
    return one_sided(before, after, keys).select(*keys, F.explode(change).alias("change"))


def spliced(text: Column, edits: Column) -> Column:
    """text with edits (array of struct start, end, value; offsets from 0, apart from each other) put in."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, e: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["value"]).alias("out"), e["end"].alias("at"))
    return F.aggregate(F.array_sort(edits), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def percent_saved(old: Column, new: Column) -> Column:
    """To one decimal, halves upward; zero for an empty package."""
    return F.when(old == 0, F.lit(0.0)).otherwise(F.floor((old - new) * 1000.0 / old + 0.5) / 10)
