"""Queries against their SQL on tables made for the case."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import relations as R
from quillspark.plans.queries import QUERIES, SQL
from quillspark.sources import zip as Z

from .oracle import FOLDER, rows


@pytest.fixture
def agrees(spark, tmp_path):
    def check(name, table, shape, data):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, shape).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db = duckdb.connect()
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        assert rows(QUERIES[name](spark, folder).toPandas()) == rows(db.sql(SQL[name]).df())

    return check


def test_encoded_urls_sizes(agrees):
    sizes = [0, 1023, 1024, 1280, 1792, 2304, 2305, 5376, (1 << 20) + 256, 3 << 20]
    agrees("encoded_urls", "pages", "page_id long, url string, html string", [(k, "http://a.b/c d", "x" * n) for k, n in enumerate(sizes)])


def test_image_decisions_of_large_files(agrees):
    agrees("image_decisions", "part", "p_partkey long, p_size int", [(k, n) for k in (1, 268_435, 268_436, 300_001, 1_200_002, 9_000_003, 9_000_000_000) for n in (1, 10, 50, 200)])


def test_net_benefit_at_halves(agrees):
    own = {1: [50.5], 2: [51.5], 3: [49.5], 4: [150.5], 5: [99.5], 6: [50.25, 0.25], 7: [50.49], 8: [50.51], 9: [None], 10: [1050.5, None]}
    agrees("net_benefit", "events", "event_id long, user_id long, event_type string, value double", [(7 * u + k + 1, u, "purchase", v) for u, values in own.items() for k, v in enumerate(values)])


def test_net_benefit_in_any_order(spark, tmp_path):
    """0.7 + 0.1 + 49.7 is 50.5, whose float sum is above or below by the order."""
    values = [(0.7, 0.1, 49.7), (49.7, 0.1, 0.7), (0.1, 49.7, 0.7)]
    spark.createDataFrame([(7 * k + i + 1, k, "purchase", v) for k, vs in enumerate(values) for i, v in enumerate(vs)], "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r["delivered"] for r in QUERIES["net_benefit"](spark, str(tmp_path)).collect()} == {"original"}


def test_manifest_diff_keys(agrees, spark, tmp_path):
    """Repeated keys on both sides, in one aggregation whose tasks grow in number with the rows."""
    for table, column, keys in (("lineitem", "l_orderkey", [1, 1, 2, 3, 3, 3]), ("orders", "o_orderkey", [2, 4, 4, 5])):
        spark.createDataFrame([(k,) for k in keys], f"{column} long").coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    out = QUERIES["manifest_diff"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, "missing"), (3, "missing"), (4, "unlisted"), (4, "unlisted"), (5, "unlisted")]
    assert "Join" not in out._jdf.queryExecution().toString()


def test_one_sided(spark):
    one, two = (spark.createDataFrame([(k, "x") for k in keys], "k long, other string") for keys in ([1, 1, 2, None], [2, 3, None]))
    found = R.one_sided(one, two, ["k"], per_task=2)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, 0), (3, 0, 1), (None, 1, 1)]
    assert "hashpartitioning(k#" in (plan := found._jdf.queryExecution().toString()) and ", 4), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, R.difference(one, two, ["k"]).collect()), key=str) == [(1, "resolved"), (3, "introduced"), (None, "introduced"), (None, "resolved")]


def test_archives_are_packed_once(spark):
    """The plan reads archives and entries that are made, instead of packing for every use."""
    for name in ("zip_roundtrip", "package_inventory"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" not in plan and plan.count("MapInArrow") <= 1


def test_zip_contents_in_slices(spark):
    files = spark.createDataFrame([("p", k, f"{k}.txt", bytearray(b"x" * 100 * k)) for k in range(6)], "package_id string, entry_index long, path string, content binary")
    archives = Z.packed(files)
    for size in (1, 250, 1 << 20):
        found = Z.zip_contents(archives, Z.zip_entries(archives), slice_bytes=size).collect()
        assert sorted((r["path"], len(r["content"]), r["problem"]) for r in found) == [(f"{k}.txt", 100 * k, None) for k in range(6)]


def test_zip_problems_of_one_entry(spark):
    """An entry has each of its problems once, an unreadable archive its own."""
    rows = [("p", 0, "a", 0, 10, 2 << 20, 100, None), ("p", 1, "a", 5, 20, 1, 1, None), ("p", 2, "../A", 30, 40, 1, 1, "encrypted"), ("q", None, None, None, None, None, None, "truncated")]
    entries = spark.createDataFrame(rows, "package_id string, entry_index long, path string, offset long, end long, uncompressed_size long, compressed_size long, problem string").withColumn("is_directory", F.lit(False))
    found = sorted((r["package_id"], r["path"] or "", r["problem"]) for r in Z.zip_problems(entries, most_entries=2, most_bytes=(2 << 20) + 1).collect())
    assert found == [("p", "../A", "dot-segment"), ("p", "../A", "encrypted"), ("p", "../A", "gap"), ("p", "../A", "too-large"), ("p", "../A", "too-many-entries"), ("p", "a", "duplicate-name"), ("p", "a", "overlap"), ("p", "a", "ratio"), ("q", "", "truncated")]
