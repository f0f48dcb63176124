"""Admission of repeated deliveries against union-find, over one batch and over several."""

import threading

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators.components import components
from tidewright.operators.redelivery import BUCKET_BITS, SeenStore, admit_in_batches, bit_is_set, duplicates

SLOW = settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "line_id bigint, tenant string, request_id string, source_incarnation string, first_index bigint, `set` string"


def brute(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owner = {}
    for r in rows:
        tokens = []
        if r[1] is not None:
            rid = (r[2] or "").strip(" \t\r\n\x0b\x0c").lower()
            if rid:
                tokens.append((r[1], rid))
            if (r[3] or "").strip(" \t\r\n\x0b\x0c") and r[4] is not None:
                tokens.append((r[1], r[3], r[4]))
        for t in tokens:
            a, b = root(owner.setdefault(t, r[0])), root(r[0])
            parent[max(a, b)] = min(a, b)
    return {r[0]: root(r[0]) for r in rows}


line = st.tuples(st.sampled_from(["t", "u", None]), st.sampled_from(["a", "A ", "\tb\n", "c", "d", " ", None]), st.sampled_from(["i", "j", "", None]), st.sampled_from([1, 2, 3, None]), st.just("x"))


@SLOW
@given(st.lists(line, max_size=40))
def test_one_batch(spark, tmp_path_factory, lines):
    rows = [(k + 1, *x) for k, x in enumerate(lines)]
    store = SeenStore(spark, str(tmp_path_factory.mktemp("seen")), shards=4)
    got = {r.line_id: r.kept_line_id for r in store.admit(spark.createDataFrame(rows, SCHEMA), "b").collect()}
    assert got == brute(rows)


def test_batches_replays_and_bits(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path), shards=2)
    first = spark.createDataFrame([(1, "t", "a", "i", 1, ""), (2, "t", "b", None, None, ""), (3, "t", None, None, None, "")], SCHEMA)
    second = spark.createDataFrame([(4, "t", "A", None, None, ""), (5, "t", "z", "i", 1, ""), (6, "t", "z", None, None, ""), (7, "t", "new", "k", 5, ""), (8, "t", None, "k", 5, "")], SCHEMA)
    assert {tuple(r) for r in store.admit(first, "1").collect()} == {(1, 1), (2, 2), (3, 3)}
    want = {(4, 1), (5, 1), (6, 1), (7, 7), (8, 7)}
    assert {tuple(r) for r in store.admit(second, "2").collect()} == want
    assert {tuple(r) for r in store.admit(second, "2").collect()} == want  # a replay answers as then
    again = spark.createDataFrame([(21, "t", "a", "i", 1, ""), (23, "t", None, None, None, "")], SCHEMA)
    assert {tuple(r) for r in duplicates(store.admit(again, "3")).collect()} == {(1, 21)}
    d = store.dictionary()
    assert d.count() == 6 and d.select("shard", "code").distinct().count() == 6
    assert store.bitmaps().agg(F.sum(F.bitmap_count("bits"))).first()[0] == 6
    joined = d.join(store.bitmaps().withColumn("code0", F.col("bucket") * BUCKET_BITS), "shard")
    assert joined.where(~bit_is_set(F.col("bits"), F.col("code"))).count() == 0
    assert joined.where(bit_is_set(F.col("bits"), F.col("code") + 1000)).count() == 0


def test_empty_batch(spark, tmp_path):
    assert SeenStore(spark, str(tmp_path)).admit(spark.createDataFrame([], SCHEMA), "e").count() == 0


def test_two_consumers_publish_one_after_the_other(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", "a", None, None, ""), (2, "t", "b", None, None, "")], SCHEMA)
    out = {}
    def work(k):
        out[k] = {tuple(r) for r in SeenStore(spark, str(tmp_path), shards=2).admit(rows.withColumn("line_id", F.col("line_id") + 10 * k), f"batch-{k}").collect()}

    threads = [threading.Thread(target=work, args=(k,)) for k in (0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    delivered = [line for found in out.values() for line, kept in found if line == kept]
    assert len(delivered) == 2 and SeenStore(spark, str(tmp_path)).head()["version"] == 2


def test_components_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 300), (300, 200)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u bigint, m bigint")).collect()}
    assert got == {(k, 1) for k in range(2, 41)} | {(101, 100), (102, 100), (300, 200)}
    assert components(spark.createDataFrame([], "u bigint, m bigint")).count() == 0


def test_codes_without_bits_were_not_seen(spark, tmp_path):
    """A consumer that died after it published codes leaves nothing that makes a line a repetition."""
    lines = spark.createDataFrame([(1, "t", "a", None, None, ""), (2, "t", "a", "i", 1, "")], SCHEMA)
    store = SeenStore(spark, str(tmp_path), shards=2)

    class Lost(SeenStore):
        def _put(self, log, version):
            if log == "_versions":
                raise RuntimeError("lost before the bits are published")
            return super()._put(log, version)

    try:
        Lost(spark, str(tmp_path), shards=2).admit(lines, "1")
    except RuntimeError:
        pass
    assert store.dictionary().count() == 2 and store.bitmaps().count() == 0
    assert {tuple(r) for r in store.admit(lines, "1").collect()} == {(1, 1), (2, 1)}
    assert store.dictionary().count() == 2 and store.bitmaps().agg(F.sum(F.bitmap_count("bits"))).first()[0] == 2


@SLOW
@given(st.lists(line, max_size=30))
def test_batches_resolve_to_the_same_requests(spark, tmp_path_factory, lines):
    rows = [(k * 7 % 31 + 1, *x) for k, x in enumerate(lines)]
    df = spark.createDataFrame([(*r, k % 4 if k % 5 else None) for k, r in enumerate(rows)], SCHEMA + ", batch_id bigint")
    got = {r.line_id: r.kept_line_id for r in admit_in_batches(SeenStore(spark, str(tmp_path_factory.mktemp("seen")), shards=4), df, "batch_id", 3).collect()}
    assert got == brute(rows)
