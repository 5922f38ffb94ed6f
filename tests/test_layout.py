"""Bucketed layouts: the same rows, files by bucket, and plans without an exchange."""

from pyspark.sql import functions as F

from ledgerline.fixtures import Tables
from ledgerline.operators import layout
from ledgerline.operators import versions as ve
from ledgerline.plans import QUERIES

SF = "/root/testdata/sf0.001"


def files_of(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_rows_files_and_plans(spark):
    rows = spark.range(3000).select((F.col("id") % 300).cast("string").alias("k"), (F.col("id") % 4).cast("int").alias("v"), F.col("id").alias("_bucket"))
    old = rows.filter("v < 3").unionByName(spark.createDataFrame([(None, 1, 7), (None, 2, 8)], rows.schema))
    made = layout.create(old, ["k"], buckets=6)
    before = files_of(made.read(spark))
    assert len(before) == 6 and rows_of(made.read(spark)) == rows_of(old)
    made.append(rows.filter("v = 3").select("_bucket", "v", "k"))
    both = old.unionByName(rows.filter("v = 3"))
    after = files_of(made.read(spark))
    assert before < after and len(after) <= 12 and rows_of(made.read(spark)) == rows_of(both)
    latest = lambda df: ve.latest(df, ["k"], [F.desc("v"), F.desc("_bucket")])
    assert exchanges(latest(made.read(spark))) == 0 < exchanges(latest(both))
    assert rows_of(latest(made.read(spark))) == rows_of(latest(both))
    packed = made.compact(spark)
    assert len(files_of(packed.read(spark))) == 6 and rows_of(packed.read(spark)) == rows_of(both)
    joined = lambda a, b: a.join(b.groupBy("k").agg(F.max("v").alias("top")).hint("merge"), "k")
    assert exchanges(joined(made.read(spark), packed.read(spark))) == 0
    assert rows_of(joined(made.read(spark), packed.read(spark))) == rows_of(joined(both, both))
    made.drop(spark)
    assert not spark.catalog.tableExists(made.name) and packed.read(spark).count() == both.count()


def test_an_empty_layout(spark):
    none = spark.createDataFrame([], "k string, v int")
    made = layout.create(none, ["k"])
    assert made.read(spark).count() == 0 and made.read(spark).columns == ["k", "v"]
    made.append(spark.createDataFrame([("a", 1)], "k string, v int"))
    assert made.read(spark).count() == 1


def test_queries_on_layouts_exchange_nothing(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        for name in ("layout_line_items", "layout_pivot", "layout_features"):
            assert exchanges(QUERIES[name](spark, SF)) == 0, name
        assert exchanges(QUERIES["compute_features"](spark, SF)) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert Tables(spark, SF).fx_line_items.count() > 0
