"""Column builders for text, numbers and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset from 0."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def looks_like_html(text: Column) -> Column:
    return text.rlike("<[A-Za-z!/][^>]*>")


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves upward."""
    return F.floor(x + 0.5)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    import unicodedata

    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition, the key under which names count as the same."""
    return text.str.normalize("NFC")


def slug(text: Column, marks: bool = True) -> Column:
    """Lower-case ASCII letters and digits with single hyphens; marks: fold accents first."""
    base = folded(text) if marks else text
    for old, new in (("ß", "ss"), ("[æÆ]", "ae"), ("[øØ]", "o"), ("[łŁ]", "l")):
        base = F.regexp_replace(base, old, new)
    return F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def worth_replacing(old: Column, new: Column, percent: float = 5, least: int = 1024) -> Column:
    saved = old - new
    return (saved >= least) & (saved >= old * percent / 100)


def diagnostic_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def text_kind(text: Column) -> Column:
    """What a text entry is by its first characters."""
    head = F.lower(F.ltrim(F.substring(text, 1, 512)))
    return (
        F.when(head.startswith("<?xml"), "xml")
        .when(head.startswith("<svg"), "svg")
        .when(head.startswith("webvtt"), "vtt")
        .when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
        .when(head.startswith("{") | head.startswith("["), "json")
        .otherwise("txt")
    )
