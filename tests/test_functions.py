"""Ladder boundaries, names, hashes, units and OTLP rendering."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import ids, ladder, naming, otlp, units
from tidewright.types import CHANGELOG, DatasetDecl, InvalidInput, ReservedColumn, SchemaConflict, UnsupportedType, check_payload, merged_schema


def test_ladder_at_its_edges(spark):
    rows = [(s, 1000, False) for s in (0, 799, 800, 949, 950, 999, 1000, 5000)] + [(0, 0, False), (850, 1000, True), (2**62, 2**62 + 1, False)]
    df = spark.createDataFrame(rows, "s bigint, c bigint, d boolean")
    out = df.select(ladder.rung(F.col("s"), F.col("c"), F.col("d")).alias("r"), ladder.retry_delay_ms(F.col("s"), F.col("c")).alias("m"), ladder.scaled_budget(F.lit(1000).cast("bigint"), F.col("s"), F.col("c")).alias("b")).collect()
    assert [r.r for r in out] == ["normal", "normal", "staging_pressure", "staging_pressure", "throttling", "throttling", "refusing_ingest", "refusing_ingest", "refusing_ingest", "drain_stalled", "throttling"]
    assert [r.m for r in out][3:10] == [1000, 1000, 29420, 30000, 30000, 30000, 1000]
    assert [r.b for r in out][:9] == [1000, 1000, 1000, 1745, 1750, 1995, 2000, 2000, 1000]
    assert [r.b for r in out] == [ladder.scaled_budget_value(1000, s, c) for s, c, _ in rows]


@given(st.text(max_size=12), st.text(max_size=12))
def test_encoding_is_injective(a, b):
    assert (naming.encode_component(a) == naming.encode_component(b)) == (a == b)


def test_names(spark):
    texts = ["", "otlp_logs", "Gable-yard.0", "é接"]
    got = [r.e for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(naming.encoded_component(F.col("t")).alias("e")).collect()]
    assert got == [naming.encode_component(t) for t in texts] and got[1] == "otlp_5flogs"
    assert naming.part_name("d", "t.0", 3) == "d/t_2e0/w3-primary.parquet"
    assert naming.supplement_suffix("n-1", 2, 4) == "supplement-n_2d1-2-4" and naming.snapshot_suffix(9) == "snapshot-9"
    tenants = ["a", "_sys", "", "x" * 150, "x" * 151, "ä", "a b", None]
    ok = [r.v for r in spark.createDataFrame([(k, t) for k, t in enumerate(tenants)], "k int, t string").orderBy("k").select(naming.tenant_is_valid(naming.resolved_tenant(F.col("t"))).alias("v")).collect()]
    assert ok == [True, False, False, True, False, False, False, True]


def test_rendezvous(spark):
    nodes, parts = ["n1", "n2", "n3"], [f"t{k}.0" for k in range(40)]
    got = {}
    for r in ids.ranked_nodes(spark.createDataFrame([(p,) for p in parts + [None]], "partition string"), nodes, 2).collect():
        got.setdefault(r.partition, {})[r.rank] = r.node
    for p in parts:
        order = sorted(nodes, key=lambda n: (ids.rendezvous_score(p, n), n), reverse=True)
        assert got[p] == {1: order[0], 2: order[1]}
    assert ids.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    # a node that leaves moves only its own partitions
    less = {r.partition: r.node for r in ids.ranked_nodes(spark.createDataFrame([(p,) for p in parts], "partition string"), nodes[:2], 1).collect()}
    assert all(less[p] == got[p][1] for p in parts if got[p][1] != "n3")


def test_units():
    assert units.duration_ms("15m") == 900_000 and units.size_bytes("384MiB") == 402_653_184
    with pytest.raises(InvalidInput):
        units.duration_ms("15")


def test_dedup_key(spark):
    df = spark.createDataFrame([("tok", "x"), (None, "x"), ("", "x")], "t string, p string")
    got = [r.k for r in df.select(ids.dedup_key(F.col("t"), F.col("p")).alias("k")).collect()]
    assert got == ["t:tok", "h:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", "t:"]


def test_otlp_levels_and_values(spark):
    kv = lambda k, v, **x: {"key": k, "value": v, **x}
    attrs = [kv("s", {"stringValue": 'a"b'}), kv("i", {"intValue": "9223372036854775807"}), kv("d", {"doubleValue": 1.5}), kv("nan", {"doubleValue": "NaN"}), kv("b", {"boolValue": False}), kv("y", {"bytesValue": "AAH/"}), kv("l", {"arrayValue": {"values": [{"intValue": "1"}, {"stringValue": "x"}]}}), kv("m", {"kvlistValue": {"values": [kv("k", {"boolValue": True})]}}), kv("none", None), kv("ref", {"stringValue": "x"}, keyStrindex=4)]
    req = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1500", "body": {"stringValue": "b"}, "attributes": attrs, "traceId": "0A0b", "spanId": ""}, {"observedTimeUnixNano": "2999", "body": {"intValue": "4"}}, {}]}]}, {"resource": {"attributes": [kv("r", {"intValue": "1"})]}, "scopeLogs": []}]}
    df = spark.createDataFrame([(json.dumps(req),), ("not json",), ("{}",)], "j string").select(otlp.parse_request(F.col("j")).alias("request"), otlp.ignored_references(F.lit(None).cast(otlp._KV)).alias("z"))
    a, b, c = otlp.flatten_logs(df).collect()
    assert json.loads(a.attrs) == {"s": 'a"b', "i": 9223372036854775807, "d": 1.5, "nan": None, "b": False, "y": "0001ff", "l": [1, "x"], "m": {"k": True}, "none": None}
    assert (a.resource_attrs, a.scope_name, a.trace_id, a.span_id, a.body, a.observed_ts) == ("{}", None, "0a0b", None, "b", None)
    assert a.ts.microsecond == 1 and b.ts.microsecond == 2 and b.body == "4" and c.body is None and c.ts.year == 1970


def test_declarations():
    with pytest.raises(InvalidInput):
        DatasetDecl("d", CHANGELOG)
    assert DatasetDecl("d", CHANGELOG, ("k",)).seal_order() == ["k", "origin", "seq"]
    assert DatasetDecl("d", CHANGELOG, ("k",)).seal_order(snapshot=True) == ["k"] and DatasetDecl("d").seal_order() == ["ts"]
    s = lambda **f: T.StructType([T.StructField(k, v) for k, v in f.items()])
    with pytest.raises(ReservedColumn):
        check_payload(s(Origin=T.StringType()))
    with pytest.raises(UnsupportedType):
        check_payload(s(x=T.DecimalType(10, 2)))
    a, b = s(x=T.IntegerType(), y=T.StringType()), s(x=T.LongType(), z=T.FloatType())
    assert merged_schema(a, b).simpleString() == "struct<x:bigint,y:string,z:float>"
    assert {f.simpleString() for f in merged_schema(b, a)} == {f.simpleString() for f in merged_schema(a, b)}
    with pytest.raises(SchemaConflict):
        merged_schema(s(x=T.LongType()), s(x=T.DoubleType()))


def test_otlp_values_of_any_depth(spark):
    def nested(k):
        if k == 0:
            return {"kvlistValue": {"values": [{"key": 'q"é', "value": {"stringValue": "a\n\"b\""}}, {"key": "ref", "value": {"intValue": "1"}, "keyStrindex": 2}, {"key": "y", "value": {"bytesValue": "AAH/"}}, {"key": "n", "value": {"doubleValue": "NaN"}}, {"key": "d", "value": {"doubleValue": 0.5}}, {"key": "i", "value": {"intValue": "9223372036854775807"}}, {"key": "b", "value": {"boolValue": True}}, {"key": "none"}, {"key": "e", "value": {"arrayValue": {}}}]}}
        return {"arrayValue": {"values": [{"intValue": str(k)}, nested(k - 1)]}}

    def plain(k):
        return {'q"é': 'a\n"b"', "y": "0001ff", "n": None, "d": 0.5, "i": 9223372036854775807, "b": True, "none": None, "e": []} if k == 0 else [k, plain(k - 1)]

    depths = [0, 1, 2, 3, 4, 5, 9, 60]
    rows = [(json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "r", "value": nested(k)}]}, "scopeLogs": [{"logRecords": [{"severityNumber": k, "body": nested(k), "attributes": [{"key": "x", "value": nested(k)}, {"key": "z", "value": {"stringValue": "{"}}, {"key": "none", "value": None}]}]}]}]}),) for k in depths]
    got = {r.severity_number: r for r in otlp.flatten_logs(spark.createDataFrame(rows, "j string").select(otlp.parse_request(F.col("j")).alias("request"))).collect()}
    for k in depths:
        assert json.loads(got[k].body) == plain(k) and json.loads(got[k].attrs) == {"x": plain(k), "z": "{", "none": None} and json.loads(got[k].resource_attrs) == {"r": plain(k)}


def test_no_record_carries_its_request_through_the_udf(spark, tmp_path):
    record = {"timeUnixNano": "1000", "body": {"stringValue": "b"}, "attributes": [{"key": "k", "value": {"intValue": "1"}}]}
    unusual = [{"key": "d", "value": {"doubleValue": 0.5}}]
    request = {"resourceLogs": [{"resource": {"attributes": unusual}, "scopeLogs": [{"scope": {"name": "n", "version": "1"}, "logRecords": [record] * 3}]}]}
    spark.createDataFrame([(json.dumps(request),)], "j string").select(otlp.parse_request(F.col("j")).alias("request")).write.parquet(str(tmp_path / "r"))
    flat = otlp.flatten_logs(spark.read.parquet(str(tmp_path / "r")))
    seen, plans = [], [flat._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        below = [plan.children().apply(k) for k in range(plan.children().size())]
        if plan.nodeName() == "ArrowEvalPython":
            seen += [below[0].output().apply(k).dataType().catalogString() for k in range(below[0].output().size())]
        plans += below
    assert seen and not [t for t in seen if "array" in t]
    assert {(r.attrs, r.resource_attrs, r.scope_name, r.scope_version) for r in flat.collect()} == {('{"k":1}', '{"d":0.5}', "n", "1")} and flat.count() == 3
