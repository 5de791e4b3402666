"""From diagnostics to verdicts: one aggregation per package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import verdict

SEVERITIES = ("fatal", "error", "warning", "info")
#: Codes that fail a check, in the order of the checks that need the whole analysis.
CHECKS = {
    "ode-structure": ("ode-structure",),
    "local-references": ("missing-resource",),
    "unambiguous-references": ("ambiguous-reference", "lenient-resolution"),
    "download-manifest": ("manifest-invalid", "manifest-stale"),
}


def distinct_diagnostics(found: DataFrame) -> DataFrame:
    """found (package_id, ordinal, code, severity, resource, location, message) without repeats; the first stays."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("package_id", "code", "resource", "location", "message").orderBy("ordinal")
    return found.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def in_order(found: DataFrame) -> DataFrame:
    """With place: by severity, code, resource."""
    from pyspark.sql.window import Window

    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy(rank, "code", F.coalesce("resource", F.lit("")), "ordinal")))


def summaries(packages: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per package: counts by severity, whether it was analysed to its end, the first fatal code, checks and verdict."""

    def has(codes: tuple[str, ...]) -> Column:
        return F.coalesce(F.bool_or(F.col("code").isin(*codes)), F.lit(False))

    fatal = F.col("severity") == "fatal"
    counts = diagnostics.groupBy("package_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        F.min_by(F.when(fatal, F.col("code")), F.when(fatal, F.col("ordinal"))).alias("stopped_by"),
        *[has(codes).alias(name) for name, codes in CHECKS.items()],
    )
    out = packages.select("package_id").join(counts, "package_id", "left").fillna(0, list(SEVERITIES)).fillna(False, list(CHECKS))
    complete = F.col("fatal") == 0
    checks = F.map_from_arrays(F.array(*[F.lit(n) for n in CHECKS]), F.array(*[F.when(~complete, "not-run").when(F.col(f"`{n}`"), "failed").otherwise("passed") for n in CHECKS]))
    return out.select("package_id", *SEVERITIES, "stopped_by", checks.alias("checks"), verdict(complete, F.col("error"), F.col("warning")).alias("verdict"))
