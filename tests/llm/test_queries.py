import os

import pytest

from quillspark.llm.entry import ORACLE, QUERIES
from tests.oracle import FOLDER, both

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got, want = both(spark, QUERIES[name], ORACLE[name])
    assert got == want


def test_names_of_all_operators():
    assert {n.split("_")[0] for n in QUERIES if n != "pipeline"} == {f"op{k}" for k in range(1, 11)} and "pipeline" in QUERIES
