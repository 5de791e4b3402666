"""Benchmark decontamination: a prefix-filtered join of item windows with document words, in DataFrame operations only.

Every window of an item must occur whole, so of its words, ordered by rarity in the corpus, the first one alone is a
necessary prefix: a document holds the window only if it holds that word. Occurrences of the prefix words are joined,
the word's place in the window bounds where the window can lie in the document, and what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: ASCII but letters and digits.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Windows up to this many are broadcast; beyond it the join shuffles.
BROADCAST_WINDOWS = 50_000


def item_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case: all that isn't a word becomes a space, and spaces part the words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BETWEEN + UPPER, " " * len(BETWEEN) + LOWER)
    return F.array_remove(F.split(spaced, " "), "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """One row per distinct window text: win (words joined by a space), len, items (ids as text, sorted)."""
    w = item_words(F.col("text"))
    starts = let(F.size(w), lambda n: F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))).otherwise(F.array().cast("array<int>")))
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), w.alias("w"), F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s"), size).alias("w"))
        .groupBy(F.array_join("w", " ").alias("win"), F.size("w").alias("len"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with the rarest of their words (prefix) and its place in the window (at); ties go to the smaller word."""
    placed = windows.select("win", F.posexplode(F.split("win", " ")).alias("at", "word"))
    vocabulary = placed.select("word").distinct()
    seen = docs.select(F.explode(item_words(F.col("text"))).alias("word"))
    small = windows.count() <= BROADCAST_WINDOWS
    count = seen.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    first = (
        placed.join(count, "word", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p"))
        .select("win", F.col("p.word").alias("prefix"), F.col("p.at").alias("at"))
    )
    return windows.join(first, "win")


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, ratio: int = 20, keyed: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    A word is hit inside any occurrence of a window of size item words (of all words of a shorter item). contaminated:
    n_hit > 0 and ratio * n_hit >= n_words. A null or empty text has no words; an item without words matches nothing; a
    null item_id counts as the id "null". Repeated rows, and rows that share an id, are judged each by its own text; so
    are rows with a null id. Other columns of either table are not read. keyed: also text_key, xxhash64 of the text, which with
    doc_id names the judged rows.
    """
    docs = docs.select("doc_id", "text")
    windows = cut(item_windows(items.select("item_id", "text"), size))
    windows = cut(prefixes(docs, windows))
    if windows.isEmpty():
        windows = windows.limit(0)
    # One more element stands for the text's end: it finds no window, and its place is the number of words.
    rows = (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), item_words(F.col("text")).alias("w"))
        .select("doc_id", "text_key", "w", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "prefix"))
    )
    start = F.col("pos") - F.col("at")
    if windows.count() <= BROADCAST_WINDOWS:
        here = F.array_join(F.slice("w", start + 1, F.col("len")), " ")
        joined = rows.join(F.broadcast(windows), "prefix", "left")
        fits = (start >= 0) & (start + F.col("len") <= F.size("w")) & (here == F.col("win"))
    else:
        # The words around the prefix word travel with it instead of the whole text.
        low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        around = F.when(F.col("prefix").isNotNull(), F.slice("w", low + 1, 2 * size - 1))
        rows = rows.select("doc_id", "text_key", "pos", "prefix", low.alias("low"), around.alias("around"))
        # The ends, which have no word, stay out of the join: they would meet under one key.
        ends = rows.filter("prefix IS NULL").select("*", *[F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in windows.columns if c != "prefix"])
        joined = rows.filter("prefix IS NOT NULL").join(windows, "prefix").unionByName(ends)
        here = F.array_join(F.slice("around", start - F.col("low") + 1, F.col("len")), " ")
        fits = (start >= F.col("low")) & (here == F.col("win"))
    end = F.col("prefix").isNull()
    # No lambda here: the rows that fit nothing end inside the generated code that made them.
    found = joined.filter(end | F.when(F.col("win").isNotNull() & (start >= 0), fits))
    hit = F.when(~end, F.struct(start.alias("s"), F.col("len").alias("n")))
    each = found.groupBy("doc_id", "text_key").agg(
        F.sum(end.cast("long")).alias("copies"),
        F.max(F.when(end, F.col("pos"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.collect_set(F.when(~end, F.col("items"))).alias("lists"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "hits",
        zero,
        lambda a, h: F.struct(F.greatest(a["end"], h["s"] + h["n"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["s"] + h["n"] - F.greatest(a["end"], h["s"]))).alias("n")),
        lambda a: a["n"],
    )
    ids = F.array_sort(F.array_distinct(F.flatten("lists")))
    return (
        each.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), ids.alias("item_ids"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_c"))
        .select("doc_id", *["text_key"] * keyed, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", ((F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
    )


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
