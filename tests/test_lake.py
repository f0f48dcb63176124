"""The commit contract, races, and landing to lake to query end to end."""

import datetime as dt
import json
import os
import re
import threading
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.plans.engine import COMPLETE, Engine
from tidewright.plans.guards import Guards, bound_schema, check_select
from tidewright.sources.commitlog import ABORTED, COMMITTED, LakeLog
from tidewright.streaming.drain import drain, eligible
from tidewright.streaming.landing import Landing
from tidewright.types import ByteBudgetExceeded, DatasetDecl, DeadlineExceeded, InvalidInput, LedgerError, NotASelect, Overloaded, PayloadTooLarge, SchemaConflict, UncoveredRange, UnknownPart

BODY = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("body", T.StringType())])
LOGS = DatasetDecl("logs")


def manifest(w, first, last, part=None):
    return {"dataset": "conformance", "partition": "p", "window_id": w, "origin_coverage": [{"origin": "o1", "first_seq": first, "last_seq": last}], "rows": last - first + 1, "event_time_min_ms": 1000 * (w + 1), "event_time_max_ms": 1000 * (w + 1), "dedup_removed": 0, "parts": [part or f"w{w}"], "part_kind": "primary", "discriminator": 0, "expired": False}


def marks(log):
    return {r.partition: r.complete_through_ms for r in log.read_watermarks().collect()}


def test_commit_contract(spark, tmp_path):
    log = LakeLog(spark, str(tmp_path))
    assert log.evolve_schema("conformance", BODY) == log.evolve_schema("conformance", BODY)
    version = log.state().version
    assert log.commit_files(manifest(0, 1, 10), 1000) == COMMITTED and marks(log) == {"p": 1000}
    assert log.commit_files(manifest(0, 1, 10), 1000) == COMMITTED and log.state().version == version + 1
    assert log.commit_files(manifest(1, 11, 20), 2000) == COMMITTED and marks(log) == {"p": 2000}
    assert log.commit_files(manifest(2, 31, 40), None) == COMMITTED and marks(log) == {"p": 2000}
    assert log.commit_files(manifest(0, 1, 10, "other"), 9000) == ABORTED and marks(log) == {"p": 2000}
    log.expire(["w0"])
    log.expire(["w0"])
    assert log.commit_files(manifest(0, 1, 10, "again"), 9000) == ABORTED and log.live_files("conformance") == [f"{tmp_path}/w1", f"{tmp_path}/w2"]
    assert log.live_files("conformance", from_ms=2500) == [f"{tmp_path}/w2"]
    with pytest.raises(UnknownPart):
        log.expire(["nothing"])
    with pytest.raises(LedgerError):
        log.commit_files(manifest(5, 15, 16), 9000)
    with pytest.raises(LedgerError):
        log.commit_files(manifest(5, 60, 59), 9000)
    with pytest.raises(NotImplementedError):
        log.replace_files()
    assert "q" not in marks(log) and log.attach_info()["uri"] == str(tmp_path)
    assert log.orphans(["w1", "stray"]) == (["stray"], ["w2"])
    assert log.manifests().where("expired").count() == 1 and log.manifests(version).count() == 0
    assert {tuple(r) for r in log.applied().collect()} == {("p", "o1", 40)}


def test_checkpoints_open_the_same_state(spark, tmp_path):
    log = LakeLog(spark, str(tmp_path))
    for w in range(55):
        log.commit_files(manifest(w, w * 10 + 1, w * 10 + 10), 1000 * w)
    assert LakeLog(spark, str(tmp_path)).state() == log.state()
    assert LakeLog(spark, str(tmp_path)).state(10).version == 10


def test_racing_committers(spark, tmp_path):
    outcomes = []
    work = lambda k: outcomes.append(LakeLog(spark, str(tmp_path)).commit_files(manifest(0, 1, 10, f"by-{k}"), 1000))
    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(outcomes) == [ABORTED] * 7 + [COMMITTED] and len(LakeLog(spark, str(tmp_path)).state().manifests) == 1


def test_evolution_converges_in_any_order(spark, tmp_path):
    steps = [T.StructType([T.StructField("a", T.IntegerType())]), T.StructType([T.StructField("b", T.StringType())]), T.StructType([T.StructField("a", T.LongType())])]
    found = set()
    for k, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 0, 2)]):
        log = LakeLog(spark, str(tmp_path / str(k)))
        for s in order:
            log.evolve_schema("d", steps[s])
        found.add(frozenset(f.simpleString() for f in log.schema("d")))
    assert found == {frozenset({"a:bigint", "b:string"})}
    with pytest.raises(SchemaConflict):
        log.evolve_schema("d", T.StructType([T.StructField("b", T.LongType())]))
    with pytest.raises(SchemaConflict):
        log.schema("unknown")


def request(bodies, minute=0):
    nanos = lambda k: str((1_770_000_000 + minute * 60 + k) * 10**9)
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": nanos(k), "body": {"stringValue": b}} for k, b in enumerate(bodies)]}]}]})


def land(spark, landing, rows, batch, now):
    return landing.stage(spark.createDataFrame(rows, "tenant string, token string, request string"), "q", batch, now)


def test_landing_is_idempotent_and_numbers_densely(spark, tmp_path):
    a = Landing(spark, str(tmp_path), "n1", window_ms=60_000)
    first = land(spark, a, [("t", "1", request("ab")), ("t", "1", request("ab")), ("u", None, request("c")), ("u", None, request("c"))], 0, 1000)
    assert (first["rows"], first["duplicates"], first["window_id"]) == (3, 2, 0)
    assert land(spark, a, [("t", "1", request("ab"))], 0, 99_000) == first  # the same batch replayed
    b = Landing(spark, str(tmp_path), "n1", window_ms=60_000)  # after a restart
    second = land(spark, b, [("t", "1", request("zz")), ("t", "2", request("d")), (None, None, request("e"))], 1, 30_000)
    assert (second["rows"], second["duplicates"], second["window_id"]) == (2, 1, 0)
    third = land(spark, b, [("t", "3", request("f"))], 2, 61_001)
    assert third["window_id"] == 1 and [w["window_id"] for w in b.closed_windows(61_001)] == [0]
    assert [w["window_id"] for w in b.closed_windows(200_000)] == [0, 1]  # also by time alone
    late = land(spark, b, [("t", "1", request("g"))], 3, 1000 + 25 * 3_600_000)
    assert late["rows"] == 1  # the ledger forgets after its time to live
    seqs = {p: sorted(r.seq for r in b.rows().where(F.col("partition") == p).collect()) for p in ("t.0", "u.0", "anonymous.0")}
    assert seqs == {"t.0": [1, 2, 3, 4, 5], "u.0": [1], "anonymous.0": [1]}
    assert b.compact_ledger(1000 + 25 * 3_600_000).count() == 1 and {tuple(r) for r in b.applied().collect()} >= {("t.0", "n1", 5)}
    for bad, error in (([("_sys", "x", request("a"))], InvalidInput), ([("t", "x", "{")], InvalidInput), ([("", "x", request("a"))], InvalidInput)):
        with pytest.raises(error):
            land(spark, b, bad, 9, 5)
    with pytest.raises(PayloadTooLarge):
        land(spark, Landing(spark, str(tmp_path), "n1", max_payload=10), [("t", "y", request("a"))], 9, 5)


def test_stream_to_lake_to_sql(spark, tmp_path):
    src, landing = str(tmp_path / "in"), Landing(spark, str(tmp_path / "landing"), "n1", window_ms=1)
    schema = "tenant string, token string, request string"
    lake = LakeLog(spark, str(tmp_path / "lake"))
    for k in range(3):
        spark.createDataFrame([("t", f"{k}", request("ab", k)), ("u", f"{k}", request("c", k))], schema).coalesce(1).write.mode("append").parquet(src)
        landing.start(spark.readStream.schema(schema).parquet(src), "s", str(tmp_path / "cp")).awaitTermination(120)
    assert [len(landing.closed_windows(2**60)), landing.rows().count()] == [3, 9]
    closed = landing.closed_windows(2**60)
    assert eligible(closed, closed[0]["closed_ms"] + 900_000 - 1) == [] and eligible(closed, closed[0]["closed_ms"] + 900_000)[0] == 0
    out = drain(spark, landing, lake, LOGS, closed[1]["closed_ms"], lateness_ms=0)
    assert [o for *_, o in out] == [COMMITTED] * 4 and landing.rows().count() == 3
    assert drain(spark, landing, lake, LOGS, closed[1]["closed_ms"], lateness_ms=0) == []
    base = 1_770_000_000_000
    assert marks(lake) == {"t.0": base + 61_000, "u.0": base + 60_000}
    e = Engine(spark, lake, [LOGS], hot={"logs": landing.rows()})
    assert e.sql("SELECT count(*) AS n, count(DISTINCT partition, origin, seq) AS d FROM logs").first().asDict() == {"n": 9, "d": 9}
    assert e.sql("SELECT count(*) AS n FROM logs", COMPLETE, base + 60_000).first()["n"] == 9
    with pytest.raises(UncoveredRange):
        e.sql("SELECT count(*) FROM logs", COMPLETE, base + 61_000)
    assert e.absent("logs", base + 10_000, base + 50_000) and not e.absent("logs", base, base + 60_000)
    with pytest.raises(UncoveredRange):
        e.absent("logs", base, base + 10**9)
    pinned = e.version
    drain(spark, landing, lake, LOGS, 2**60, lateness_ms=0)
    assert e.sql("SELECT count(*) AS n FROM logs").first()["n"] == 9  # still the pinned files and bounds
    assert e.pin() > pinned and Engine(spark, lake, [LOGS]).sql("SELECT count(*) AS n FROM logs").first()["n"] == 9
    f = e.freshness(base + 200_000).first()
    assert (f.dataset, f.complete_through_ms, f.laggard) == ("logs", base + 120_000, "u.0")
    assert e.view("logs", from_ms=base + 115_000).count() == 3
    assert Engine(spark, lake, [LOGS], tenants=["u"]).view("logs").count() == 3
    assert e.fetch("SELECT body FROM logs").num_rows == 9 and e.status()["version"] == e.version


def test_guards(spark):
    for text in ("SELECT 1", "WITH x AS (SELECT 1) SELECT * FROM x", "VALUES (1)"):
        check_select(spark, text)
    for text in ("DROP TABLE x", "INSERT INTO t SELECT 1", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM x", "CREATE TABLE t AS SELECT 1", "SET a=b", "not sql", "CACHE TABLE t"):
        with pytest.raises(NotASelect):
            check_select(spark, text)
    assert bound_schema(spark, "SELECT 1 AS a, 'x' AS b").simpleString() == "struct<a:int,b:string>"
    assert Guards().fetch(spark.range(1000)).num_rows == 1000 and Guards().fetch(spark.range(0)).num_rows == 0
    with pytest.raises(ByteBudgetExceeded):
        Guards(max_bytes=1000).fetch(spark.range(100_000))
    began = time.time()
    with pytest.raises(DeadlineExceeded):
        Guards(deadline_s=0.5).fetch(spark.range(2 * 10**10).where("pmod(xxhash64(id), 7) = 9"))
    assert time.time() - began < 20  # interrupted: undisturbed it takes a minute
    g = Guards(concurrent=1)
    with g.slot(), pytest.raises(Overloaded), g.slot():
        pass
    assert g.budget(900, 1000) == 3 * 2**30


def test_changelog_views(spark, tmp_path):
    from tidewright.operators.changelog import asof_join, latest_view, snapshot, validity, view_from_snapshot

    rows = [("a", "v1", None, "o", 1), ("a", "v2", "upsert", "o", 2), ("b", "x", None, "o", 3), ("b", None, "delete", "o", 4)]
    df = spark.createDataFrame(rows, "k string, v string, _op string, origin string, seq bigint")
    assert [(r.k, r.v) for r in latest_view(df, ["k"]).collect()] == [("a", "v2")]
    as_of = spark.createDataFrame([("o", 3)], "origin string, as_of_seq bigint")
    snap = snapshot(df, ["k"], as_of)
    assert {(r.k, r.v) for r in snap.collect()} == {("a", "v2"), ("b", "x")}
    assert [(r.k, r.v) for r in view_from_snapshot(snap, df.where("seq > 3"), ["k"]).collect()] == [("a", "v2")]
    assert latest_view(df.drop("_op"), ["k"]).count() == 2 and latest_view(df.limit(0), ["k"]).count() == 0
    t = lambda h: dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)
    left = spark.createDataFrame([("a", 1, t(0)), ("a", 2, t(5)), ("a", 3, t(30)), ("b", 4, t(1)), (None, 5, t(1)), ("a", 6, None)], "k string, id int, ts timestamp")
    right = spark.createDataFrame([("a", t(5), "r5"), ("a", t(1), "r1"), ("c", t(0), "c"), (None, t(0), "n")], "k string, at timestamp, w string")
    got = {r.id: r.w for r in asof_join(left, right, ["k"], "ts", "at", ["w"]).collect()}
    assert got == {1: None, 2: "r5", 3: "r5", 4: None, 5: None, 6: None}
    assert asof_join(left, right.limit(0), ["k"], "ts", "at", ["w"]).where("w is null").count() == 6
    v = {r.w: r.valid_to for r in validity(right.where("k = 'a'").withColumns({"origin": F.lit("o"), "seq": F.lit(1)}), ["k"], "at").collect()}
    assert v["r5"] is None and v["r1"] is not None


def test_range_keeps_landed_rows_of_uncommitted_partitions(spark, tmp_path):
    landing, lake = Landing(spark, str(tmp_path / "landing"), "n1", window_ms=1), LakeLog(spark, str(tmp_path / "lake"))
    land(spark, landing, [("t", "1", request("ab"))], 0, 1000)
    drain(spark, landing, lake, LOGS, 2**60, lateness_ms=0)
    land(spark, landing, [("new", "1", request("c"))], 1, 90_000)  # another tenant lands, nothing of it is committed
    base = 1_770_000_000_000
    e = Engine(spark, lake, [LOGS], hot={"logs": landing.rows()})
    assert min(marks(lake).values()) >= base
    assert sorted(r.partition for r in e.view("logs", base, base).collect()) == ["new.0", "t.0"]
    assert not Engine(spark, lake, [LOGS], hot={"logs": landing.rows()}, tenants=["new"]).absent("logs", base, base)
    assert e.absent("logs", base - 1000, base - 500)


def test_dropping_keeps_what_the_lake_lacks(spark, tmp_path):
    from tidewright.streaming.landing import ALREADY_GONE, DROPPED, RESIDUE_KEPT

    landing = Landing(spark, str(tmp_path), "n1")
    record = '{"timeUnixNano":"1000","body":{"stringValue":"%d"}}'
    request = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[%s]}]}]}'
    rows = [("t", f"tok{k}", request % ",".join(record % n for n in range(3))) for k in range(4)]
    landing.stage(spark.createDataFrame(rows, "tenant string, token string, request string"), "q", 0, now_ms=0)
    before = landing.staged_bytes()
    assert sorted(r.seq for r in landing.rows([0]).collect()) == list(range(1, 13))
    ranges = lambda *x: spark.createDataFrame([("t.0", "n1", a, b) for a, b in x], "partition string, origin string, first_seq bigint, last_seq bigint")
    assert landing.drop_covered(0, ranges((1, 5), (9, 12))) == RESIDUE_KEPT
    assert sorted(r.seq for r in landing.rows([0]).collect()) == [6, 7, 8] and 0 < landing.staged_bytes() < before
    assert Landing(spark, str(tmp_path), "n1").drop_covered(0, ranges((1, 12))) == DROPPED
    assert landing.drop_covered(0, ranges((1, 12))) == ALREADY_GONE and landing.rows() is None and landing.staged_bytes() == 0


def test_paths_without_scheme_belong_to_the_default_file_system(spark, tmp_path):
    from tidewright.sources.atomic import list_names, put_if_absent, read_bytes

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    (tmp_path / "mounted").mkdir()
    conf.set("fs.viewfs.mounttable.lake.link./data", f"file://{tmp_path}/mounted")
    conf.set("fs.defaultFS", "viewfs://lake/")
    try:
        assert put_if_absent(spark, "/data/v/1.json", b"x") and not put_if_absent(spark, "/data/v/1.json", b"y")
        assert read_bytes(spark, "/data/v/1.json") == b"x" and list_names(spark, "/data/v") == ["1.json"]
        spark.range(3).write.parquet("/data/t")
    finally:
        conf.set("fs.defaultFS", old or "file:///")
    assert (tmp_path / "mounted" / "v" / "1.json").read_bytes() == b"x" and (tmp_path / "mounted" / "t").is_dir()


def test_changelog_parts_expire_under_a_snapshot_only(spark, tmp_path):
    from tidewright.sources.commitlog import LakeLog
    from tidewright.types import LedgerError

    lake = LakeLog(spark, str(tmp_path))
    span = lambda a, b: [{"origin": "o", "first_seq": a, "last_seq": b}]
    m = {"dataset": "d", "partition": "p", "rows": 1, "event_time_min_ms": 1, "event_time_max_ms": 2, "dedup_removed": 0, "discriminator": 0}
    for k, (kind, cover) in enumerate([("primary", span(1, 5)), ("primary", span(6, 9)), ("snapshot", span(1, 7))]):
        lake.commit_files(m | {"window_id": k, "parts": [f"part{k}"], "part_kind": kind, "origin_coverage": cover}, None)
    with pytest.raises(LedgerError):
        lake.expire(["part0", "part1"], require_snapshot=True)
    assert len(lake.live_files("d")) == 2
    lake.expire(["part0"], require_snapshot=True)
    assert lake.live_files("d") == [f"{tmp_path}/part1"]


def test_landing_and_draining_leave_only_what_the_logs_name(spark, tmp_path):
    from tidewright.session import shared_dir

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in (blocks.getAllBlocks().apply(k).toString() for k in range(blocks.getAllBlocks().size())) if n.startswith("shuffle_") and n.endswith(".data")}
    before, files = set(os.listdir(urlparse(shared_dir(spark)).path)), shuffles()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    landing, lake = Landing(spark, str(tmp_path / "landing"), "n1", window_ms=1), LakeLog(spark, str(tmp_path / "lake"))
    land(spark, landing, [("t", f"{k}", request("ab", k)) for k in range(40)], 0, 1000)
    with pytest.raises(InvalidInput):
        land(spark, landing, [("t", "x", "{")], 1, 2000)
    assert [o for *_, o in drain(spark, landing, lake, LOGS, 2**60, lateness_ms=0)] == [COMMITTED]
    assert [o for *_, o in drain(spark, landing, lake, LOGS, 2**60, lateness_ms=0, transform="SELECT * FROM {rows}")] == []
    land(spark, landing, [("t", "late", request("c"))], 2, 90_000)
    assert [o for *_, o in drain(spark, landing, lake, LOGS, 2**60, lateness_ms=0, transform="SELECT * FROM {rows}")] == [COMMITTED]
    assert Engine(spark, lake, [LOGS]).view("logs").count() == 81
    assert {n.rpartition("-")[0] for n in set(os.listdir(urlparse(shared_dir(spark)).path)) - before} <= {"ends", "losses"}
    deadline = time.time() + 20  # files go in the background
    while (left := len(shuffles() - files)) > 10 and time.time() < deadline:
        time.sleep(0.5)
    assert left <= 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_dropping_under_coverage_deletes_its_shuffles(spark, tmp_path):
    landing = Landing(spark, str(tmp_path), "n1")
    land(spark, landing, [("t", f"{k}", request("ab", k)) for k in range(5)], 0, 1000)
    half = spark.createDataFrame([("t.0", "n1", 1, 5)], "partition string, origin string, first_seq bigint, last_seq bigint")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in (f.getName() for f in (blocks.getAllFiles().apply(k) for k in range(blocks.getAllFiles().size()))) if n.startswith("shuffle_") and n.endswith(".data")}
    before = shuffles()
    assert landing.drop_covered(0, half) == "residue_kept"
    deadline = time.time() + 20  # files go in the background
    while (left := shuffles() - before) and time.time() < deadline:
        time.sleep(0.5)
    assert sorted(r.seq for r in landing.rows([0]).collect()) == [6, 7, 8, 9, 10] and not left


def moved_bytes(spark):
    """Bytes that each stage wrote to shuffles, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_landing_and_sealing_move_a_record_once_each(spark, tmp_path):
    texts = spark.range(400).select(F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(16)]).alias("t")).collect()
    rows = [("t", f"{k}", request([r.t])) for k, r in enumerate(texts)]
    size = sum(len(r.t) for r in texts) / 2  # hex digits, which are compressed
    logs = DatasetDecl("logs", natural_key=("partition", "origin", "seq"))
    landing, lake = Landing(spark, str(tmp_path / "landing"), "n1", window_ms=1), LakeLog(spark, str(tmp_path / "lake"))
    before = max(moved_bytes(spark), default=-1)
    land(spark, landing, rows, 0, 1000)
    landed = moved_bytes(spark)
    assert sum(n for k, n in landed.items() if k > before) < 2 * size
    assert [o for *_, o in drain(spark, landing, lake, logs, 2**60, lateness_ms=0)] == [COMMITTED]
    assert sum(n for k, n in moved_bytes(spark).items() if k > max(landed)) < 2 * size
    got = Engine(spark, lake, [logs]).view("logs").collect()
    assert sorted(r.body for r in got) == sorted(r.t for r in texts) and sorted(r.seq for r in got) == list(range(1, 401))


def test_the_least_of_the_requests_with_one_token_is_landed(spark, tmp_path):
    landing = Landing(spark, str(tmp_path), "n1")
    sent = [("t", "1", request("b")), ("t", "1", request("ac")), ("t", "1", request("b")), ("t", "2", request("d")), ("u", "1", request("e"))]
    entry = land(spark, landing, sent, 0, 1000)
    assert (entry["rows"], entry["duplicates"]) == (4, 2)
    assert sorted((r.tenant, r.body) for r in landing.rows().collect()) == [("t", "a"), ("t", "c"), ("t", "d"), ("u", "e")]
    again = land(spark, landing, [*sent, ("t", "3", request("g")), ("t", "3", request("f"))], 1, 2000)
    assert (again["rows"], again["duplicates"]) == (1, 6) and sorted(r.body for r in landing.rows().collect()) == ["a", "c", "d", "e", "f"]


def test_a_window_is_sealed_alike_whether_its_key_has_the_partition(spark, tmp_path):
    for k, key in enumerate([("partition", "body"), ("body",), ("partition", "window_id", "origin", "seq", "body")]):
        logs = DatasetDecl("logs", natural_key=key)
        landing, lake = Landing(spark, str(tmp_path / f"a{k}"), "n1", window_ms=1), LakeLog(spark, str(tmp_path / f"b{k}"))
        land(spark, landing, [("t", "1", request("abca")), ("t", "2", request("cd")), ("u", "1", request("xx"))], 0, 1000)
        assert [o for *_, o in drain(spark, landing, lake, logs, 2**60, lateness_ms=0)] == [COMMITTED] * 2
        whole = "seq" in key
        assert {(m.partition, m.rows, m.dedup_removed) for m in lake.manifests().collect()} == ({("t.0", 6, 0), ("u.0", 2, 0)} if whole else {("t.0", 4, 2), ("u.0", 1, 1)})
        got = sorted((r.tenant, r.body) for r in Engine(spark, lake, [logs]).view("logs").collect())
        assert got == ([("t", c) for c in "aabccd"] + [("u", "x")] * 2 if whole else [("t", c) for c in "abcd"] + [("u", "x")])
        assert [sum(n.endswith(".parquet") for n in os.listdir(urlparse(f).path)) for f in lake.live_files("logs")] == [1, 1]


def test_events_are_gathered_as_numbers(spark, data):
    from tidewright.plans.lake_queries import requests

    plan = requests(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"collect_list\(struct\((\w+)", plan) == ["us"]
