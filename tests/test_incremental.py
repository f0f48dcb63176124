"""Runs take exactly what is new or changed, whatever failed before."""

import threading

from pyspark.sql import functions as F

from tidewright.operators.incremental import IncrementalTarget, beyond_marks, committed_marks

SRC = "partition string, origin string, seq bigint, applied_seq string, __mark int"
TARGET = "id bigint, v bigint, payload string"


def test_marks(spark):
    log = spark.createDataFrame(
        [("committed", "p", "o", 5), ("committed", "p", "o", 3), ("failed", "p", "o", 9), ("running", "p", "x", 4), ("committed", "p", "x", None), ("committed", None, "o", 2)] * 2,
        "status string, partition string, origin string, applied_seq bigint",
    )
    src = spark.createDataFrame([("p", "o", s, "z", 1) for s in (4, 5, 6, 6, None)] + [("p", "x", 1, "z", 1), (None, "o", 2, "z", 1), (None, "o", 3, "z", 1)], SRC)
    got = sorted(map(tuple, beyond_marks(src, committed_marks(log)).select("partition", "origin", "seq", "applied_seq").collect()), key=repr)
    assert got == sorted([("p", "o", 6, "z")] * 2 + [("p", "x", 1, "z"), (None, "o", 3, "z")], key=repr)
    assert beyond_marks(src, committed_marks(log.limit(0))).count() == src.count()
    assert beyond_marks(src.limit(0), committed_marks(log)).count() == 0


def test_runs_failures_and_changes(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), TARGET)
    t = IncrementalTarget(spark, str(tmp_path), ["id"], "v", spark.createDataFrame([], TARGET).schema)
    t.run(df((1, 1, "a"), (1, 1, "a"), (2, 1, "b"), (2, 2, "b2"), (None, 1, "n")))
    assert {tuple(r) for r in t.current().collect()} == {(1, 1, "a"), (2, 2, "b2"), (None, 1, "n")}

    def fail(_):
        raise RuntimeError("lost")

    source = df((1, 1, "a"), (2, 2, "b2"), (3, 1, "c"), (1, 4, "a4"), (None, 1, "n"))
    try:
        t.run(source, fail)
    except RuntimeError:
        pass
    assert t.head()["version"] == 1
    assert {tuple(r) for r in t.pending(source).collect()} == {(3, 1, "c"), (1, 4, "a4")}
    t.run(source, lambda d: d.withColumn("payload", F.upper("payload")))
    assert {tuple(r) for r in t.current().collect()} == {(1, 4, "A4"), (2, 2, "b2"), (3, 1, "C"), (None, 1, "n")}
    assert t.pending(source).count() == 0


def test_concurrent_runs_take_each_record_once(spark, tmp_path):
    schema = spark.createDataFrame([], TARGET).schema
    source = spark.range(50).select(F.col("id"), F.lit(1).cast("bigint").alias("v"), F.lit("x").alias("payload"))
    threads = [threading.Thread(target=lambda: IncrementalTarget(spark, str(tmp_path), ["id"], None, schema).run(source)) for _ in range(2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    t = IncrementalTarget(spark, str(tmp_path), ["id"], None, schema)
    assert t.head()["version"] == 2 and t.rows().count() == 50


def test_streams_take_every_number_once(spark, tmp_path):
    schema = "partition string, origin string, seq bigint"
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    t = IncrementalTarget(spark, str(tmp_path), ["partition", "origin"], "seq", df().schema, every=True)
    t.adopt(df(("p", "o", 3), (None, "o", 1)))
    source = df(*[("p", "o", k) for k in (1, 2, 3, 4, 5, 5)], ("q", "o", 1), ("q", "o", None), (None, "o", 1), (None, "o", 2))
    new = {("p", "o", 4), ("p", "o", 5), ("q", "o", 1), ("q", "o", None), (None, "o", 2)}

    def fail(_):
        raise RuntimeError("lost")

    try:
        t.run(source, fail)
    except RuntimeError:
        pass
    assert {tuple(r) for r in t.published(t.run(source)).collect()} == new
    assert t.published(t.run(source)).count() == 0
    assert {tuple(r) for r in t.published(t.run(source.unionAll(df(("p", "o", 6))))).collect()} == {("p", "o", 6)}
    assert t.held().where("partition = 'p'").first()["__tw_held"] == 6


def test_parts_are_compacted(spark, tmp_path, monkeypatch):
    from tidewright.operators import incremental

    monkeypatch.setattr(incremental, "COMPACT_PARTS", 2)
    t = IncrementalTarget(spark, str(tmp_path), ["id"], "v", spark.createDataFrame([], TARGET).schema)
    for k in range(4):
        t.run(spark.createDataFrame([(1, k, "a"), (k, 1, "b")], TARGET))
    assert len(t.head()["files"]) <= 2 and {tuple(r)[:2] for r in t.current().collect()} == {(0, 1), (1, 3), (2, 1), (3, 1)}
