"""Stored orders and fingerprints that follow changes."""

import random

import pytest
from pyspark.sql import functions as F

from salesloom.operators import fingerprint as fp
from salesloom.operators.ordering import store_order, stored_page


def test_stored_pages_are_those_of_a_sort(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), i) for i in range(1003)]
    df = spark.createDataFrame(rows, "k int, id int").repartition(6)
    path = store_order(df, [F.col("k").desc_nulls_last(), F.col("id")], str(tmp_path / "o"), rows_per_file=100)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for page, size in ((1, 10), (10, 10), (11, 10), (4, 33), (101, 10), (102, 10), (1, 2000), (2, 1000)):
        got, total = stored_page(spark, path, page, size)
        assert [tuple(r) for r in got.collect()] == want[(page - 1) * size:page * size] and total == 1003
    scan = stored_page(spark, path, 101, 10)[0]._jdf.queryExecution().executedPlan().toString()
    assert "_file" in scan.split("PartitionFilters")[1][:200]
    with pytest.raises(ValueError):
        stored_page(spark, path, 0, 10)
    empty = store_order(df.limit(0), ["id"], str(tmp_path / "e"))
    assert stored_page(spark, empty, 1, 10)[0].collect() == [] and stored_page(spark, empty, 1, 10)[1] == 0


def test_kept_fingerprints_follow_changes(spark):
    rng = random.Random(2)
    schema = "id int, v string, w double"
    rows = [(i, rng.choice([None, "a", "b"]), rng.random()) for i in range(200)] + [(500, "same", 1.0)] * 3
    table = spark.createDataFrame(rows, schema)
    kept = fp.fingerprint_parts(table, "t").unionByName(fp.fingerprint_parts(table.limit(5), "u"))
    changes = spark.createDataFrame([(3, "new", 0.5), (4, None, None), (900, "x", 2.0)], schema)
    after = table.join(changes, "id", "left_anti").unionByName(changes)
    moved = fp.advance(kept, fp.keyed_delta(table, changes, "id", "t"))
    assert fp.verify(moved, {"t": after}).collect() == [] and [r.table for r in fp.verify(kept, {"t": after}).collect()] == ["t"]
    assert dict(fp.as_fingerprints(moved).collect()) == dict(fp.table_fingerprint(after, "t").unionByName(fp.table_fingerprint(table.limit(5), "u")).collect())
    gone = after.filter("id = 500 OR id < 10")
    later = fp.advance(moved, fp.delta(gone, after.limit(0), "t"))
    assert fp.verify(later, {"t": after.filter("NOT (id = 500 OR id < 10)")}).collect() == []
    assert fp.verify(fp.advance(later, fp.delta(table.limit(0), table.limit(0), "t")), {"t": after.filter("NOT (id = 500 OR id < 10)")}).collect() == []
