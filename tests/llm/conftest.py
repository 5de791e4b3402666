import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SILLY = ("words", "n", "kept", "score", "places", "row", "component_id", "win", "prefix", "pos")


def words(seed, n, size=300):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text, copies, near copies, shared passages."""
    base, passage = words(1, 200), words(2, 60)
    near = base[:]
    near[50] = "changed"
    rows = [
        (1, " ".join(base)), (2, None), (3, ""), (4, " \t\n "), (5, " ".join(words(3, 30_000, 5000))), (6, " ".join(base)), (7, " ".join(near)), (7, " ".join(near)),
        (8, " ".join(words(4, 80) + passage + words(5, 40))), (9, "\n".join([*words(6, 30), " ".join(passage), *words(7, 30)])), (10, "One"), (11, "one"), (12, "x " * 120),
        (None, " ".join(base)), (None, None), (13, "É é ß und STRASSE straße"), (14, " ".join(words(8, 25))), (15, "the idiot and the fool of it"), (16, "a  b   c \n \n d  "),
    ]
    return [(i, t, ("en", "de", None)[k % 3], f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns whose names operators use inside."""
    return odd.withColumns({c: F.lit(f"own {c}") for c in SILLY})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
