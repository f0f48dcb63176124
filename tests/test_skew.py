"""Fragments of hot keys: results equal the plain ones, and no task gets much more than its share."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators.skew import fragment_join, heavy_keys, load_report, lookup_join, per_key, place, plan_loads


@pytest.fixture(scope="module")
def hot(spark):
    return spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("k"), F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))


def test_plan_splits_the_hot_key_and_balances(spark, hot):
    plan = plan_loads(hot, ["k"], 8)
    key, load, at = plan.heavy[0]
    assert key == ("hot",) and load == 10_000 and len(at) >= 3
    assert max(plan.loads) < 1.5 * plan.total / 8
    got = {r.task: r.n_rows for r in load_report(hot, ["k"], 8).collect()}
    assert sum(got.values()) == 30_000 and max(got.values()) < 1.8 * 30_000 / 8


def test_place_moves_rows_where_planned(spark, hot):
    plan = plan_loads(hot, ["k"], 8)
    off = place(hot, plan, ["seq"]).where(F.spark_partition_id() != F.col("__tw_task")).count()
    assert off == 0


def test_per_key_equals_plain(spark, hot):
    aggs = {"n": ("rows", None), "c": ("count", "k"), "s": ("sum", "v"), "lo": ("min", "seq"), "hi": ("max", "seq")}
    got = {tuple(r) for r in per_key(hot, ["k"], aggs, ["seq"]).collect()}
    want = {tuple(r) for r in hot.groupBy("k").agg(F.count(F.lit(1)), F.count("k"), F.sum("v"), F.min("seq"), F.max("seq")).collect()}
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("join", [fragment_join, lambda *a: lookup_join(*a, broadcast_rows=0), lookup_join])
def test_joins_equal_plain(spark, hot, how, join):
    right = spark.createDataFrame([("hot", 1), ("k5", 2), ("k5", 3), (None, 4), ("none", 5)], "k string, w int")
    got = sorted(map(tuple, join(hot, right, ["k"], ["seq"], how).select("seq", *(["w"] if how in ("inner", "left") else [])).collect()), key=repr)
    plain = hot.join(right.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), how)
    assert got == sorted(map(tuple, plain.select("seq", *(["w"] if how in ("inner", "left") else [])).collect()), key=repr)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, seq bigint, tenant string, partition string")
    assert plan_loads(empty, ["k"], 4).heavy == []
    assert per_key(empty, ["k"], {"n": ("rows", None)}, ["seq"]).count() == 0
    assert heavy_keys({"t": empty}, ["tenant", "partition"], 0.05).count() == 0
    assert fragment_join(empty, empty.select("k", F.lit(1).alias("w")), ["k"], ["seq"]).count() == 0


def test_heavy_keys_threshold_is_exclusive_and_counts_nulls(spark):
    rows = [("a", None)] * 5 + [("b", "p")] * 6 + [(None, "q")] * 89
    df = spark.createDataFrame(rows, "tenant string, partition string").withColumn("__task", F.lit(1)).withColumn("n_rows", F.lit("x"))
    got = {(r.field, r.key_value, r.n_rows, r.of_rows) for r in heavy_keys({"t": df}, ["tenant", "partition"], 0.05).collect()}
    assert got == {("tenant", "b", 6, 100), ("partition", "p", 6, 100), ("partition", "q", 89, 100)}


def test_joins_need_no_exchange_but_the_planned_ones(spark, hot):
    right = spark.createDataFrame([("hot", 1), ("k5", 2)], "k string, w int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = fragment_join(hot, right, ["k"], ["seq"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("shufflepartitionidpassthrough") == 2 and "hashpartitioning" not in plan
    assert joined.where("w = 1").count() == 10_000


def test_loads_are_estimated_from_a_sample(spark, hot, monkeypatch):
    from tidewright.operators import skew

    monkeypatch.setattr(skew, "SAMPLE_ROWS", 3000)
    plan = plan_loads(hot, ["k"], 8)
    assert 2000 < plan.total < 4000 and plan.heavy[0][0] == ("hot",) and len(plan.heavy[0][2]) >= 3


def test_wide_sides_are_not_broadcast(spark, monkeypatch):
    from tidewright.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10_000)
    assert skew.is_small(spark.range(100)) and not skew.is_small(spark.range(3).select(F.repeat(F.lit("x"), 9000).alias("x"))) and not skew.is_small(spark.range(11), 10)
