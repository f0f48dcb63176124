"""Audits: clean runs pass, each doctored input is convicted by its own audit, nothing checked is no verdict. Sources of their inputs."""

import pyarrow as pa
import pytest

from tidewright.operators.replication import ack_ready, admitted_incarnations, apply_outcomes, holders
from tidewright.plans import predicates as p
from tidewright.sources import formats, journal
from tidewright.types import InvalidInput

LINE = ["node", "seq", "event", "tenant", "partition", "request_id", "source_incarnation", "first_index", "record_count", "max_event_time_ms", "complete_through_ms"]


def run(tmp_path, spark, *extra, drop=()):
    path = str(tmp_path / f"j{len(extra)}{len(drop)}.ndjson")
    w = journal.JournalWriter(path, "n1")
    lines = [
        ("ClientAck", dict(tenant="t", partition="p", request_id="r1", source_incarnation="i", first_index=0, record_count=3, max_event_time_ms=100)),
        ("ClientAck", dict(tenant="_sys", partition="p", request_id="r0", source_incarnation="s", first_index=0, record_count=3)),
        ("LakeCommitOk", dict(partition="p", complete_through_ms=150)),
        ("ClaimAdvertise", dict(partition="p", complete_through_ms=150)),
    ]
    w.write_all([x for k, x in enumerate(lines) if k not in drop] + list(extra))
    w.close()
    return journal.read_journal(spark, path)


def reads(spark, keys=("i-0", "i-1", "i-2"), served=150, ops=0, query="q"):
    return spark.createDataFrame([("t", "p", "complete", "served", served, list(keys), query, ops)], "tenant string, partition string, concern string, outcome string, complete_through_ms bigint, record_keys array<string>, query string, residency_ops_before bigint")


def present(spark, count=3):
    return spark.createDataFrame([("t", "i", 0, count)], "tenant string, source_incarnation string, first_index bigint, count bigint")


def test_clean_and_seeded(spark, tmp_path):
    j, r = run(tmp_path, spark), reads(spark)
    assert p.zero_acked_lost(j, present(spark)).count() == p.unbacked_advertisements(j).count() == p.unproven_reads(j, r).count() == p.missing_under_watermark(j, r).count() == 0
    assert [tuple(x) for x in p.zero_acked_lost(j, present(spark, 2)).collect()] == [("t", "i", 2, 2)]
    assert [x.missing for x in p.missing_under_watermark(j, reads(spark, ("i-0", "i-2"))).collect()] == [["i-1"]]
    assert p.missing_under_watermark(j, reads(spark, (), served=99)).count() == 0  # not owed yet
    assert p.unproven_reads(j, reads(spark, served=151)).count() == 1
    early = run(tmp_path, spark, ("ClaimAdvertise", dict(partition="p", complete_through_ms=200)), ("LakeCommitOk", dict(partition="p", complete_through_ms=200)))
    assert [x.advertised_ms for x in p.unbacked_advertisements(early).collect()] == [200]  # its own commit came later
    lost = run(tmp_path, spark, ("DeclareLoss", dict(partition="p", complete_through_ms=1)))
    assert p.missing_under_watermark(lost, reads(spark, ())).count() == 0
    both = reads(spark).unionAll(reads(spark, ("i-0", "x"), ops=4))
    assert [(sorted(x.missing), x.extra) for x in p.differing_answers(both).collect()] == [(["i-1", "i-2"], ["x"])]
    gaps = p.journal_gaps(j.where("seq <> 1")).first()
    assert (gaps.missing, gaps.repeated) == (1, 0)
    assert p.outcome_tallies(j).first().reconciles


def test_verdicts():
    assert [p.verdict(0, 5), p.verdict(1, 5), p.verdict(0, 0)] == [0, 2, 3]
    assert [p.combined([0, 0]), p.combined([0, 3]), p.combined([3, 2]), p.combined([])] == [0, 3, 2, 3]


def test_retention_and_latest_view(spark):
    m = spark.createDataFrame(
        [("d", "p", 0, [("o", 1, 5)], "primary", 0, True), ("d", "p", 1, [("o", 6, 9)], "primary", 0, True), ("d", "p", 9, [("o", 1, 5)], "snapshot", 5, False), ("d", "p", 9, [("o", 4, 9)], "snapshot", 9, False), ("d", "p", 2, [("o", 3, 7)], "primary", 0, True)],
        "dataset string, partition string, window_id bigint, origin_coverage array<struct<origin:string,first_seq:bigint,last_seq:bigint>>, part_kind string, discriminator bigint, expired boolean",
    )
    assert [r.window_id for r in p.uncovered_expiries(m).collect()] == [2]  # two snapshots together don't count
    c = spark.createDataFrame([("ClientAck", "d", "p", "t", "k", "o", 1, None, "v"), ("ClientAck", "d", "p", "t", "k", "o", 8, None, "w"), ("ClientTimeout", "d", "p", "t", "k", "o", 9, None, "z"), ("ClientAck", "d", "p", "t", "g", "o", 2, True, None)], "event string, dataset string, partition string, tenant string, changelog_key string, origin string, changelog_seq bigint, tombstone boolean, value string")
    served = lambda v: spark.createDataFrame([("d", "t", "k", v)], "dataset string, tenant string, changelog_key string, value string")
    assert p.latest_view_findings(c, served("w")).count() == 0 and p.latest_view_findings(c, served("v")).first().expected == "w"
    assert p.latest_view_findings(c, served("w").limit(0)).first().has_served is False
    assert p.unjudgeable_slots(c).count() == 0 and p.unjudgeable_slots(c.unionAll(c.where("changelog_seq = 8").selectExpr(*[f"'other' AS value" if x == "value" else x for x in c.columns]))).count() == 1
    live = spark.createDataFrame([("d", "p", "o", 1, 7)], "dataset string, partition string, origin string, first_seq bigint, last_seq bigint")
    assert [r.changelog_seq for r in p.unreachable_values(c, live).collect()] == [8]


def test_medians(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("a", 3), ("a", 7), ("b", 1)], "g string, v int")
    assert {r.g: r.m for r in df.groupBy("g").agg(p.upper_median(df.v, 2).alias("m")).collect()} == {"a": 7, "b": None}


def test_replication_decisions(spark):
    f = spark.createDataFrame([("p", "o", 1, 5, 4), ("p", "me", 1, 1, 1), ("p", "z", 1, 1, 1), ("p", "o", 1, 1, 3), ("p", "o", 1, 7, 9), ("p", "o", 1, 3, 7), ("p", "o", 1, 6, 8)], "partition string, origin string, incarnation int, first_seq bigint, last_seq bigint")
    applied = spark.createDataFrame([("p", "o", 5)], "partition string, origin string, applied_seq bigint")
    fences = spark.createDataFrame([("z", 2)], "node string, incarnation int")
    got = {(r.origin, r.first_seq, r.last_seq): r.outcome for r in apply_outcomes(f, applied, fences, "me").collect()}
    assert got == {("o", 5, 4): "invalid_range", ("me", 1, 1): "self_origin_refused", ("z", 1, 1): "fenced", ("o", 1, 3): "duplicate_acked", ("o", 7, 9): "gap_refused", ("o", 3, 7): "gap_refused", ("o", 6, 8): "applied"}
    a = spark.createDataFrame([("n", 1, 1), ("n", 3, 2), ("n", 2, 3), ("n", 3, 4)], "node string, incarnation int, seq bigint")
    assert [r.admitted for r in admitted_incarnations(a).orderBy("seq").collect()] == [True, True, False, True]
    b = spark.createDataFrame([("p", "o", 5)], "partition string, origin string, last_seq bigint")
    rec = spark.createDataFrame([("p", "o", "o", 9), ("p", "o", "h1", 5), ("p", "o", "h1", 4), ("p", "o", "h2", 4)], "partition string, origin string, holder string, replicated_thru bigint")
    assert [(r.holders, r.ready) for r in ack_ready(b, rec, 2).collect()] == [(1, True)] and not ack_ready(b, rec, 3).first().ready
    owed = spark.createDataFrame([("p", 10), ("q", 10)], "partition string, through bigint")
    cand = spark.createDataFrame([("p", "a", False, 50), ("p", "b", True, 1), ("q", "a", False, 9)], "partition string, node string, is_owner boolean, replicated_thru bigint")
    assert {r.partition: r.holder for r in holders(owed, cand).collect()} == {"p": "b", "q": None}


def test_sources(spark, tmp_path):
    w = journal.JournalWriter(str(tmp_path / "x.ndjson"), "n")
    assert [w.write("A"), w.write("B", tenant="t")] == [0, 1]
    w.close()
    w = journal.JournalWriter(str(tmp_path / "x.ndjson"), "n")
    assert w.write("C") == 2
    w.close()
    (tmp_path / "x.ndjson").open("a").write("{broken\n")
    with pytest.raises(Exception):
        journal.read_journal(spark, str(tmp_path / "x.ndjson")).collect()
    (tmp_path / "f.ndjson").write_text('{"fault_id":"f","kind":"kill","target_node":"n","phase":"armed","at_ms":1}\n{"fault_id":"f","phase":"ended","at_ms":9}\n')
    f = journal.fault_windows(journal.read_ndjson(spark, str(tmp_path / "f.ndjson"), journal.FAULTS)).first()
    assert (f.kind, f.armed_ms, f.started_ms, f.ended_ms) == ("kill", 1, None, 9)
    sink = pa.BufferOutputStream()
    t = pa.table({"a": [1, 2]})
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    assert formats.read_arrow(spark, sink.getvalue().to_pybytes()).count() == 2
    with pytest.raises(InvalidInput):
        formats.read_arrow(spark, b"nonsense")
    g = formats.generated_logs(spark, 5, "inc").orderBy("body").collect()
    assert g[3].body == "loadgen record 3" and g[3].attrs == '{"loadgen.index":"inc-3"}'
    assert formats.read_parquet(spark, spark.range(1).schema).count() == 0


def test_blocking_and_vacuity(spark, tmp_path):
    rows = [("n", "p", "served", 0, 0, 10)] * 20 + [("n", "p", "served", 1, 2, 31), ("n", "p", "served", 1, 2, 30), ("m", "p", "served", 1, 2, 900)]
    r = spark.createDataFrame(rows, "serving_node string, partition string, outcome string, residency_ops_before bigint, residency_ops_after bigint, latency_ms bigint")
    assert [(x.serving_node, x.latency_ms) for x in p.blocked_reads(r).collect()] == [("n", 31)]
    j = run(tmp_path, spark)
    faults = spark.createDataFrame([("kill", 5), ("cut", None)], "kind string, started_ms bigint")
    got = {x.check: x.ok for x in p.vacuity(j, faults, ["kill"]).collect()}
    assert got == {"fault_schedule": True, "contention": False, "continuity": True, "outcomes": True}
    assert not {x.check: x.ok for x in p.vacuity(j, faults, ["kill", "cut"]).collect()}["fault_schedule"]
    assert not {x.check: x.ok for x in p.vacuity(j.limit(0), faults, ["kill"]).collect()}["continuity"]


def test_transforms_and_upkeep(spark):
    from tidewright.operators.upkeep import expired_manifests
    from tidewright.plans.transforms import checked, transformed
    from tidewright.types import NotASelect

    df = spark.createDataFrame([(1, "a")], "seq bigint, body string")
    assert transformed(df, "SELECT seq, upper(body) AS body FROM {rows}").first().body == "A" and transformed(df, None) is df
    for bad, error in (("SELECT 1", InvalidInput), ("INSERT INTO x SELECT * FROM {rows}", NotASelect)):
        with pytest.raises(error):
            transformed(df, bad)
    with pytest.raises(InvalidInput):
        checked(df, "SELECT body FROM {rows}", ["seq"])
    with pytest.raises(ValueError):
        expired_manifests(df, 0, {str(k): 1 for k in range(9)})
