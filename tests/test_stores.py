"""Merges in place: what is there afterwards, and which files they leave alone."""

from pyspark.sql import functions as F

from ledgerline.operators import stores
from ledgerline.operators import versions as ve


def files_of(spark, store):
    return {r[0] for r in spark.read.parquet(store.path).select(F.input_file_name()).distinct().collect()}


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_merge_rewrites_the_buckets_it_touches(spark):
    old = spark.range(2000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"))
    store = stores.create(old, ["id"], buckets=50)
    before = files_of(spark, store)
    assert len(before) == 50 and rows_of(store.read(spark)) == rows_of(old)
    new = spark.createDataFrame([(5, None, "y"), (6, 9, None), (5000, 1, "z")], "id long, a long, b string")
    touched = store.merge_coalesce(new)
    after = files_of(spark, store)
    assert 0 < len(touched) <= 3 and len(after) == 50 and len(before - after) == len(touched) == len(after - before)
    want = ve.merge_coalesce(old, new, ["id"])
    assert rows_of(store.read(spark)) == rows_of(want)
    store.merge_coalesce(new)  # again, as after a failure
    assert rows_of(store.read(spark)) == rows_of(want)
    store.merge_overwrite(new)
    assert rows_of(store.read(spark)) == rows_of(ve.merge_overwrite(want, new, ["id"]))
    assert store.merge_overwrite(new.limit(0)) == [] and store.read(spark).count() == 2001


def test_versions_are_appended_in_place(spark):
    old = spark.createDataFrame([("k", 1, 0.5), ("k", 2, 0.6), ("j", 1, 0.7)], "key string, version int, value double")
    store = stores.create(old, ["key"], buckets=8)
    store.append_versioned(spark.createDataFrame([("k", 1.0), ("new", 2.0), ("new", 2.0)], "key string, value double"), "version")
    assert sorted(map(tuple, store.read(spark).collect())) == [("j", 1, 0.7), ("k", 1, 0.5), ("k", 2, 0.6), ("k", 3, 1.0), ("new", 1, 2.0)]
