"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with on be at by this are from or "
    "der die und den von zu das mit sich des auf für ist nicht ein als auch es an dem im eine "
    "le la les et des en un une du que est pour qui dans par plus pas au sur ne se ce "
    "el los las y del que por con para como su al lo no de a"
).split()

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes when low * per <= times * value <= high * per; documents under least words aren't judged by it."""

    name: str
    value: str
    times: int = 1
    per: str = "n_words"
    low: float | None = None
    high: float | None = None
    least: int = 0


#: Ratios are kept as products, so that no division rounds.
RULES = (
    Rule("word_length", "word_chars", low=2, high=20),
    Rule("symbols_per_word", "n_symbols", 10, high=1),
    Rule("stop_words", "n_stop_words", 100, low=4, least=30),
    Rule("repeated_lines", "n_dup_lines", 10, "n_lines", high=4),
)
MEASURES = ("n_words", "word_chars", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols")


def _windows(w: Column) -> Column:
    """Every run of WINDOW consecutive words, as text."""
    return F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i, WINDOW), " "))


def _starts(w: Column) -> Column:
    return F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))


def _all_differ(w: Column) -> Column:
    """True only if no window occurs twice. False may also mean that two hashes clash; the texts are compared then."""
    hashes = F.transform(_starts(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(-1, WINDOW - 1)]))
    return let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: the size of the union of their spans."""

    def starts(ordered: Column) -> Column:
        same = lambda k, e: F.coalesce(F.get(ordered, k)["x"] == e["x"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda e, k: same(k - 1, e) | same(k + 1, e)), lambda e: e["i"]))

    def union(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return let(let(ordered, starts), union)


def _of_words(w: Column) -> Column:
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(_all_differ(w), F.lit(0)).otherwise(_covered(_windows(w))).cast("long").alias("n_repeat_words"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def _measures(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    parts = F.struct(let(words(body), _of_words).alias("w"), let(lines, _of_lines).alias("l"), (F.size(F.split(body, SYMBOLS)) - 1).cast("long").alias("n_symbols"))
    return let(parts, lambda p: F.struct(*[p["w"][n].alias(n) for n in MEASURES[:4]], *[p["l"][n].alias(n) for n in MEASURES[4:6]], p["n_symbols"].alias("n_symbols")))


def _passes(rule: Rule, m: Column) -> Column:
    value, per = m[rule.value] * rule.times, m[rule.per]
    tests = [value >= per * F.lit(rule.low)] * (rule.low is not None) + [value <= per * F.lit(rule.high)] * (rule.high is not None)
    return (m["n_words"] < rule.least) | reduce(lambda a, b: a & b, tests)


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures, base_failed, failed_rules and kept: one expression, so that a filter on kept measures a text once."""

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        failed = F.array(*[F.when(~_passes(r, m), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>")
        keep = reduce(lambda a, b: a & b, [_passes(r, m) for r in rules], ~base)
        return F.struct(*[m[n].alias(n) for n in MEASURES], base.alias("base_failed"), F.filter(failed, lambda x: x.isNotNull()).alias("failed_rules"), keep.alias("kept"))

    return let(_measures(text), verdict)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of docs with the measures, base_failed, failed_rules (names, in table order) and kept.

    A null or empty text measures zero everywhere. Only lines that hold a word count. The cost of a text is linear, but for the texts in which
    a window is repeated: theirs are sorted. base_failed: under 10 words, or over 20 % of the words in repeated windows; so a null or empty text
    fails. Each row is judged alone: repeated rows and null ids are kept as they are. Input columns named as a measure are replaced.
    """
    names = (*MEASURES, "base_failed", "failed_rules", "kept")
    out = docs.withColumn("quality_facts", judged(F.col(text), rules))
    return out.withColumns({n: F.col(f"quality_facts.{n}") for n in names}).drop("quality_facts")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept")
