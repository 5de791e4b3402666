"""The corpus pipeline: quality rules, MinHash near-dedup, substring dedup, benchmark decontamination, packing.

Each stage takes the documents that its predecessor kept. All but the last return the columns of documents; rows with null ids or texts pass
through every stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, scratch, table
from quillspark.llm.decontaminate import contamination
from quillspark.llm.minhash import BROADCAST_IDS, near_duplicates
from quillspark.llm.quality import judged
from quillspark.llm.substring import without_duplicates
from quillspark.llm.tokens import PIECE, pack, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """docs without the rows whose keys (null-safe) are in gone; a short list is broadcast, a long one joined by a shuffle."""
    gone = cut(gone.select(*[F.col(k).alias(f"gone_{k}") for k in keys]).distinct())
    same = [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in keys]
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them null and empty texts. Each row is judged alone, with or without an id; repeated rows fare alike."""
    return docs.select(*COLUMNS).filter(judged(F.col("text"))["kept"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 80 % of their five-word shingles the one of the least id stays; of rows that repeat an id and its text, one row.

    Rows that share an id but not the text are documents of their own: each has a key of its own in the operator, and of linked
    ones the one of the least id, then the least text, stays.
    """
    docs = docs.select(*COLUMNS)
    named = docs.filter("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _without(docs, near_duplicates(docs, width=5).filter("NOT kept AND doc_id IS NOT NULL"), "doc_id")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = named.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    once = cut(once.withColumn("row_key", F.monotonically_increasing_id()))
    linked = near_duplicates(once.select(F.col("row_key").alias("doc_id"), "text"), width=5).select(F.col("doc_id").alias("row_key"), "component_id")
    place = F.struct("doc_id", F.xxhash64("text").alias("text_key"), "row_key")
    least = once.join(linked, "row_key").groupBy("component_id").agg(F.min(place).alias("least")).select(F.col("least.row_key").alias("row_key"))
    return once.join(least, "row_key", "left_semi").select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in an earlier document are cut from the later ones; n_chars is counted anew.

    No row goes. A null text stays null; rows without an id, and those whose id also stands with another text, are neither compared nor cut.
    """
    out = without_duplicates(docs, window=50, gram=8, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold benchmark passages go, with an id or without; a clean row that shares the id stays. A null or empty text is clean."""
    gone = contamination(docs, table(spark, sf_dir, "benchmark"), keyed=True).filter("contaminated")
    return _without(docs.select(*COLUMNS, F.xxhash64("text").alias("text_key")), gone, "doc_id", "text_key")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 ids. A null or empty text is its end id alone; rows that repeat an id or have none are documents of their own."""
    return pack(docs, tokenizer_path(), end_id=1).select(*PIECE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the tokenizer of the last stage; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; what a stage returns is written as Parquet and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
