"""Fates of records against the rule as stated, and aggregates with their edges; the same over a stream."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators.lateness import classify, ordered_aggregates, past_cut_off, period_aggregates
from tidewright.streaming.kslack import period_counts, released

SLOW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
LOG = "node string, seq bigint, event string, partition string, complete_through_ms bigint, at_ms bigint"
REC = "partition string, origin string, seq bigint, ts timestamp, observed_ts timestamp, steps string, __after string"
T0 = dt.datetime(2026, 2, 2, tzinfo=dt.timezone.utc)
ms = lambda m: None if m is None else T0 + dt.timedelta(minutes=m, microseconds=999)
at = lambda m: int((T0 + dt.timedelta(minutes=m)).timestamp() * 1000)
P = st.sampled_from(["p", "q", None])
logs = st.lists(st.tuples(P, st.integers(0, 400), st.integers(0, 400), st.sampled_from(["LakeCommitOk", "LakeCommitOk", "ClaimAdvertise"])), max_size=12)
recs = st.lists(st.tuples(P, st.one_of(st.none(), st.integers(-3000, 400)), st.one_of(st.none(), st.integers(0, 400))), max_size=30)


@SLOW
@given(logs, recs)
def test_fates(spark, log, rec):
    w = spark.createDataFrame([("n", k, e, p, at(c), at(a)) for k, (p, c, a, e) in enumerate(log)], LOG)
    r = spark.createDataFrame([(p, "o", k, ms(t), ms(o), "x", "y") for k, (p, t, o) in enumerate(rec)], REC)
    got = {x.seq: (x.fate, x.release_ms) for x in classify(r, w, F.col("ts"), F.col("observed_ts")).collect()}
    for k, (p, t, o) in enumerate(rec):
        reach = [at(a) for q, c, a, e in log if e == "LakeCommitOk" and q == p and p is not None and t is not None and at(c) >= at(t)]
        release = min(reach, default=None)
        fate = "provisional" if release is None else "rejected" if o is not None and release <= at(o) else "final"
        assert got[k] == (fate, release)
    acks = spark.createDataFrame([], "partition string, node string, seq bigint, max_event_time_ms bigint, complete_through_ms bigint")
    late = {x.seq for x in past_cut_off(r, w, acks).collect()}
    assert late == {k for k, v in got.items() if v[0] == "rejected"}


def test_period_aggregates_count_copies_once(spark):
    w = spark.createDataFrame([("n", 1, "LakeCommitOk", "p", at(59), at(200))], LOG)
    rows = [("p", "o", 1, ms(10), ms(11)), ("p", "o", 1, ms(10), ms(11)), ("p", "o", 2, ms(5), ms(90)), ("p", "o", 3, ms(7), ms(300)), ("p", "o", 4, ms(70), ms(71)), ("p", "o", 5, ms(20), None)]
    r = spark.createDataFrame([(*x, "", "") for x in rows], REC)
    got = [tuple(x) for x in period_aggregates(classify(r, w, F.col("ts"), F.col("observed_ts")), ["partition", "origin", "seq"]).orderBy("period_start_ms").collect()]
    assert got == [("p", at(0), 2, 1, 3, 3, 1, "o/2", "o/5", "final"), ("p", at(60), 1, 0, 1, 0, 0, "o/4", "o/4", "provisional")]


def test_empty(spark):
    w, r = spark.createDataFrame([], LOG), spark.createDataFrame([], REC)
    assert classify(r, w, F.col("ts"), F.col("observed_ts")).count() == 0


def test_stream_corrects_then_finalises(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k string, id bigint, ts timestamp"
    batches = [[("a", 1, ms(1)), ("a", 2, ms(20))], [("a", 3, ms(5)), ("a", 3, ms(5))], [("a", 4, ms(200))], [("a", 5, ms(2))], [("a", 6, ms(210))]]
    found = {}
    for mode in ("update", "append"):
        rows = []
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src + mode)
            stream = period_counts(spark.readStream.schema(schema).parquet(src + mode), "ts", "30 minutes", "1 hour", ["k"], ["k", "id"])
            q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{mode}")).foreachBatch(lambda df, i: rows.extend(tuple(r)[:3] for r in df.collect())).trigger(availableNow=True).start()
            q.awaitTermination(120)
        found[mode] = [r[2] for r in rows if r[1].replace(tzinfo=None) == T0.replace(tzinfo=None)]
    assert found["update"] == [2, 3]  # published, then corrected by the late record; the one beyond the slack is left out
    assert found["append"] == [3]


@SLOW
@given(logs, recs)
def test_ordered_aggregates(spark, log, rec):
    w = spark.createDataFrame([("n", k, e, p, at(c), at(a)) for k, (p, c, a, e) in enumerate(log)], LOG)
    r = spark.createDataFrame([(p, "o", k, ms(t), ms(o), "abc"[k % 3] if k % 4 else None, "y") for k, (p, t, o) in enumerate(rec)] * 2, REC)
    fates = classify(r, w, F.col("ts"), F.col("observed_ts"))
    got = {(x.partition, x.period_start_ms): tuple(x)[2:] for x in ordered_aggregates(fates, ["partition", "origin", "seq"], "steps", slice_ms=120_000).collect()}
    groups = {}
    for x in fates.dropDuplicates(["partition", "seq"]).where("fate <> 'rejected' and ts_ms is not null").orderBy("ts_ms", "seq").collect():
        groups.setdefault((x.partition, x.ts_ms // 3_600_000 * 3_600_000), []).append((x.ts_ms, x.steps, x.fate == "final"))

    def walk(rows):
        pairs = list(zip(rows, rows[1:]))
        return sum(a[1] != b[1] for a, b in pairs), max((b[0] - a[0] for a, b in pairs), default=None)

    want = {}
    for k, rows in groups.items():
        out = [x for x in rows if x[2]]
        assert rows[: len(out)] == out  # what is released comes first
        (c, g), (cf, gf) = walk(rows), walk(out)
        want[k] = (len(rows), len(out), c, cf, g, gf)
    assert got == want


def test_stream_releases_in_order(spark, tmp_path):
    src, rows = str(tmp_path / "in"), []
    schema = "k string, ts timestamp, p string"
    batches = [[("a", ms(20), "r20"), ("a", ms(5), "r5"), ("b", ms(7), "s7")], [("a", ms(3), "r3")], [("a", ms(60), "r60")], [("a", ms(10), "late"), ("a", ms(45), "r45")], [("a", ms(200), "r200")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        out = released(spark.readStream.schema(schema).parquet(src), "ts", "20 minutes", "k", "p")
        q = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: rows.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
        q.awaitTermination(120)
    final = {k: [(r[2], r[4]) for r in rows if r[0] == "final" and r[1] == k] for k in "ab"}
    assert final == {"a": [(1, "r3"), (2, "r5"), (3, "r20"), (4, "r45"), (5, "r60")], "b": [(1, "s7")]}
    waiting = [r[5] for r in rows if r[0] == "provisional" and r[1] == "a"]
    assert waiting[0] == 2 and waiting[-1] == 1
