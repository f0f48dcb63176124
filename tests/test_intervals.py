"""Runs and gaps against a set of covered numbers; prefix sums against a plain loop."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators.intervals import coalesce_ranges, manifest_coverage
from tidewright.operators.prefix import prefix_sums
from tidewright.operators.ranges import applied_through, contained, coverage_predicate, covered, overlapping, subtract_ranges, union_ranges

SLOW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "o string, f bigint, l bigint, n int"


def brute(ranges):
    out = set()
    for o in {r[0] for r in ranges if r[0] is not None}:
        have = {x for r in ranges if r[0] == o and r[1] is not None and r[2] is not None and 1 <= r[1] <= r[2] for x in range(r[1], r[2] + 1)}
        if not have:
            continue
        top, start = max(have), 1
        for x in range(1, top + 1):
            if x + 1 > top or ((x + 1) in have) != (x in have):
                out.add(("run" if x in have else "gap", o, start, x))
                start = x + 1
    return out


ranges = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3, 60)), st.one_of(st.none(), st.integers(-3, 60)), st.integers(0, 3)), max_size=40)


@SLOW
@given(ranges)
def test_runs_and_gaps(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in coalesce_ranges(df, ["o"], "f", "l").collect()}
    assert found == brute(rows)


def test_far_positions_and_repeats(spark):
    rows = [("a", 1, 70_000, 0)] * 3 + [("a", 70_001, 200_000, 0), ("a", 2**40, 2**40 + 5, 0), ("a", 5, 9, 1)]
    found = {tuple(r) for r in coalesce_ranges(spark.createDataFrame(rows, SCHEMA), ["o"], "f", "l").collect()}
    assert found == {("run", "a", 1, 200_000), ("gap", "a", 200_001, 2**40 - 1), ("run", "a", 2**40, 2**40 + 5)}


def test_empty_table_and_null_coverage(spark):
    assert coalesce_ranges(spark.createDataFrame([], SCHEMA), ["o"], "f", "l").count() == 0
    m = spark.createDataFrame([("d", "p", None, "x"), ("d", "p", [], "y"), ("d", "p", [("o", 2, 3)], "z")], "dataset string, partition string, origin_coverage array<struct<origin:string,first_seq:bigint,last_seq:bigint>>, kind string")
    assert {tuple(r) for r in manifest_coverage(m).collect()} == {("run", "d", "p", "o", 2, 3), ("gap", "d", "p", "o", 1, 1)}


@SLOW
@given(st.dictionaries(st.integers(0, 2**20), st.integers(1, 5), max_size=60))
def test_prefix_sums(spark, values):
    df = spark.createDataFrame([("k", p, v) for p, v in values.items()], "k string, p bigint, v bigint")
    found = {r.p: r.s for r in prefix_sums(df, ["k"], "p", "v", "s", 32).collect()}
    assert found == {p: sum(v for q, v in values.items() if q < p) for p in values}


def test_range_algebra(spark):
    keys = ["partition", "origin"]
    schema = "partition string, origin string, first_seq bigint, last_seq bigint"
    a = spark.createDataFrame([("p", "o", 1, 10), ("p", "o", 20, 30), ("p", "x", 1, 5)], schema)
    b = spark.createDataFrame([("p", "o", 3, 4), ("p", "o", 8, 22), ("p", "o", 9, 9)], schema)
    got = lambda df: {tuple(r) for r in df.collect()}
    assert got(subtract_ranges(a, b, keys)) == {("p", "o", 1, 2), ("p", "o", 5, 7), ("p", "o", 23, 30), ("p", "x", 1, 5)}
    assert got(union_ranges(a.unionAll(b), keys)) == {("p", "o", 1, 30), ("p", "x", 1, 5)}
    assert got(overlapping(a, b, keys)) == {("p", "o", 1, 10), ("p", "o", 20, 30)}
    assert got(contained(b, a, keys)) == {("p", "o", 3, 4), ("p", "o", 9, 9)}
    rows = spark.createDataFrame([("p", "o", s) for s in (1, 3, 9, 40)] + [("p", "y", 1)], "partition string, origin string, seq bigint")
    assert {r.seq for r in covered(rows, b).collect()} == {3, 9}
    assert covered(rows, b, keep=False).count() == 3
    assert rows.where(coverage_predicate([("o", 1, 3), ("y", 2, 9)])).count() == 2
    assert rows.where(coverage_predicate([])).count() == 0
    assert {tuple(r) for r in applied_through(rows).collect()} == {("p", "o", 1), ("p", "y", 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_sweeps_over_blocks_equal_plain_sets(spark, seed):
    """Runs, gaps, differences, containment and loss counts over numbers on both sides of block ends, against sets."""
    import random

    from tidewright.operators import ranges as rg

    rnd, edge = random.Random(seed), 1 << 16
    spots = [1, 2, 50, edge - 2, edge - 1, edge, edge + 1, 2 * edge - 1, 2 * edge, 3 * edge + 7]
    points = [(k, n) for k in ("a", "b") for n in {rnd.choice(spots) + rnd.randrange(4) for _ in range(25)}] + [("c", n) for n in range(edge - 3, 2 * edge + 3)]
    df = spark.createDataFrame([*points, *points[:9], ("a", None), (None, 4), ("a", 0)], "k string, seq bigint")
    runs, gaps = {}, {}
    for key in ("a", "b", "c"):
        have, last, start = sorted({n for k, n in points if k == key}), 0, None
        for n in have:
            if n > last + 1 or start is None:
                if n > last + 1:
                    gaps.setdefault(key, set()).add((last + 1, n - 1))
                if start is not None:
                    runs.setdefault(key, set()).add((start, last))
                start = n
            last = n
        runs.setdefault(key, set()).add((start, last))
    as_sets = lambda d: {(r.k, r.first_seq, r.last_seq) for r in d.collect()}
    flat = lambda d: {(k, *x) for k, xs in d.items() for x in xs}
    assert as_sets(rg.coverage_runs(df, ["k"])) == flat(runs) and as_sets(rg.coverage_gaps(df, ["k"])) == flat(gaps)

    def some(n):
        return [(k, f, f + rnd.randrange(6)) for k in ("a", "b") for f in (rnd.choice(spots) + rnd.randrange(3) for _ in range(n))]

    a, b = some(12), some(8)
    sides = [spark.createDataFrame([*x, (None, 1, 2)], "k string, first_seq bigint, last_seq bigint") for x in (a, b)]
    cells = lambda rows: {(k, n) for k, f, l in rows for n in range(f, l + 1)}
    assert cells(as_sets(rg.subtract_ranges(*sides, ["k"]))) == cells(a) - cells(b)
    assert as_sets(rg.contained(*sides, ["k"])) == {x for x in a if any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in b)}
    assert as_sets(rg.overlapping(*sides, ["k"])) == {x for x in a if any(x[0] == y[0] and y[1] <= x[2] and x[1] <= y[2] for y in b)}
    inside = rg.covered(df, sides[1], ["k"]).where("k is not null and seq is not null")
    assert {tuple(r) for r in inside.collect()} == {p for p in points if p in cells(b)}
    lost = rg.union_ranges(sides[1], ["k"])
    counted = rg.covered_count(df.where("k is not null and seq > 0").distinct(), F.col("seq"), lost, ["k"], "n").collect()
    assert all(r.n == sum(k == r.k and n <= r.seq for k, n in cells(b)) for r in counted)
