"""Patch composition against a sequential fold, for whole and partial changes, with and without a base."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators.patches import changelog_state, compose_patches

SLOW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "k string, seq bigint, del boolean, a string, b string"
change = st.tuples(st.sampled_from(["x", "y", None]), st.integers(1, 9), st.sampled_from([True, False, None]), st.sampled_from(["", "1", None]), st.sampled_from(["2", None]))


def fold(changes, base, partial):
    state = {k: dict(v) for k, v in base.items()}
    for k, _, deleted, a, b in sorted(changes, key=lambda c: c[1]):
        if deleted:
            state.pop(k, None)
        elif partial:
            row = state.setdefault(k, {"a": None, "b": None})
            row.update({n: v for n, v in (("a", a), ("b", b)) if v is not None})
        else:
            state[k] = {"a": a, "b": b}
    return {(k, v["a"], v["b"]) for k, v in state.items()}


@SLOW
@given(st.lists(change, max_size=25, unique_by=lambda c: (c[0], c[1])), st.booleans(), st.randoms())
def test_equals_fold(spark, changes, partial, rnd):
    base = {"x": {"a": "0", "b": "0"}, "z": {"a": "9", "b": None}}
    fed = changes + changes[: len(changes) // 2]
    rnd.shuffle(fed)
    df = spark.createDataFrame(fed, SCHEMA).withColumn("extra", F.lit(1)).repartition(3)
    base_df = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in base.items()], "k string, a string, b string")
    got = compose_patches(df, ["k"], ["seq"], ["a", "b"], F.col("del"), base=base_df, partial=partial, fan_in=1)
    assert {(r.k, r.a, r.b) for r in got.collect()} == fold(changes, base, partial)


def test_empty_feed_returns_base(spark):
    empty = spark.createDataFrame([], SCHEMA)
    base = spark.createDataFrame([("x", "1", None)], "k string, a string, b string")
    assert [tuple(r) for r in compose_patches(empty, ["k"], ["seq"], ["a", "b"], F.col("del"), base=base).collect()] == [("x", None, "1", None)]
    assert compose_patches(empty, ["k"], ["seq"], ["a", "b"], F.col("del")).count() == 0


def test_changelog_rules(spark):
    schema = "event string, dataset string, tenant string, changelog_key string, origin string, changelog_seq bigint, tombstone boolean, value string, __o string"
    rows = [
        ("ClientAck", "d", "t", "k", "n9", 1, None, "old", ""),
        ("ClientAck", "d", "t", "k", "n10", 7, True, None, ""),  # n10 < n9 as text
        ("ClientTimeout", "d", "t", "k", "n9", 2, None, "never", ""),
        ("ClientAck", "d", "t", "gone", "n1", 1, False, "v", ""),
        ("ClientAck", "d", "t", "gone", "n1", 2, True, None, ""),
        ("ClientAck", "d", "t", "empty", "n1", 3, False, "", ""),
        ("ClientAck", "d", "u", "k", "n1", None, None, "x" * 100_000, ""),
    ]
    got = {(r.tenant, r.changelog_key, r.origin, r.changelog_seq, r.value) for r in changelog_state(spark.createDataFrame(rows * 2, schema)).collect()}
    assert got == {("t", "k", "n9", 1, "old"), ("t", "empty", "n1", 3, ""), ("u", "k", "n1", None, "x" * 100_000)}
