"""Change-log semantics on literal logs."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import versions as v


def log(spark, rows):
    return spark.createDataFrame([(k, i, x) for i, (k, x) in enumerate(rows)], "key string, seq long, value string")


def found(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_overwrite_and_delete(spark):
    d = log(spark, [("key1", "value1"), ("key1", "value2"), ("key1", "value3")])
    assert found(v.get(d, "key1")) == {"key1": "value3"}
    d = log(spark, [("key1", "a"), ("key1", None), ("nothing", None)])
    assert found(v.scan(d)) == {}
    d = log(spark, [("key1", "a"), ("key1", None), ("key1", "new")])
    assert found(v.scan(d)) == {"key1": "new"}


def test_empty_value_deletes_and_empty_key_is_legal(spark):
    d = log(spark, [("key1", ""), ("", "value")]).withColumn("value", v.erased(F.col("value")))
    assert found(v.scan(d)) == {"": "value"}


@pytest.mark.parametrize(("start", "end", "want"), [("key_03", "key_07", range(3, 7)), ("key_05", None, range(5, 10)), (None, "key_05", range(5)), (None, None, range(10))])
def test_ranges(spark, start, end, want):
    d = log(spark, [(f"key_{i:02}", f"v{i}") for i in range(10)])
    assert found(v.scan(d, start, end)) == {f"key_{i:02}": f"v{i}" for i in want}


def test_tombstones_versions_and_empty_log(spark):
    d = log(spark, [(f"key_{i:02}", "x") for i in range(10)] + [(f"key_{i:02}", None) for i in range(0, 10, 2)])
    assert sorted(found(v.scan(d))) == [f"key_{i:02}" for i in range(1, 10, 2)]
    d = log(spark, [("key1", "v1_1"), ("key2", "v2_1"), ("key1", "v1_2"), ("key3", "v3_1"), ("key2", "v2_2")])
    assert found(v.scan(d)) == {"key1": "v1_2", "key2": "v2_2", "key3": "v3_1"}
    assert found(v.scan(d.limit(0))) == {}


def test_snapshots_see_what_was_there(spark):
    d = log(spark, [("k", "v0"), ("k", "v1"), ("k", None), ("k", "v3")])
    assert [found(v.get(d, "k", before=s)).get("k") for s in range(5)] == [None, "v0", "v1", None, "v3"]


def test_overlay(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    buffer = spark.createDataFrame([("a", "2"), ("b", None), ("d", "1")], "key string, value string")
    assert found(v.overlay(base, buffer)) == {"a": "2", "c": "3", "d": "1"}


def test_compaction_keeps_what_snapshots_need(spark):
    d = log(spark, [("a", "1"), ("b", "1"), ("a", "2"), ("b", None), ("a", None), ("c", "1")])
    assert found(v.compact(d)) == {"c": "1"}
    kept = v.compact(d, retain=3)
    for s in range(3, 7):
        assert found(v.scan(kept, before=s)) == found(v.scan(d, before=s))


def test_random_operations_equal_a_dict(spark):
    random.seed(12345)
    rows, model = [], {}
    for i in range(500):
        key = f"key{random.randrange(50)}"
        if random.random() < 0.3:
            rows.append((key, None))
            model.pop(key, None)
        else:
            rows.append((key, f"value{i}"))
            model[key] = f"value{i}"
    assert found(v.scan(log(spark, rows))) == model


def test_key_bounds_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log(spark, [(f"k{i}", "x") for i in range(10)]).write.parquet(path)
    plan = v.scan_prefix(spark.read.parquet(path), "k1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,k1)" in plan
