"""Queries that go through the whole data plane: requests are landed, sealed, committed with their watermark, and served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans.engine import Engine, time_ms
from tidewright.plans.registry import Registry, table
from tidewright.session import scratch_path
from tidewright.sources.commitlog import LakeLog
from tidewright.streaming.drain import drain
from tidewright.streaming.landing import Landing
from tidewright.types import APPLIED, DatasetDecl

R = Registry()
LOGS = DatasetDecl("event_logs", natural_key=("partition", "origin", "seq"))
#: Records of a request, parts of the events' time that are landed one after the other, length of an arrival window.
REQUEST_RECORDS, PARTS, WINDOW_MS = 500, 3, 60_000


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The events as OTLP/JSON requests of their type's tenant: tenant, token, request, part (by event time)."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ends = events.agg(F.floor(F.min("us") / 1000).alias("lo"), F.floor(F.max("us") / 1000).alias("hi"))
    part = F.floor((F.floor(F.col("us") / 1000) - F.col("lo")) * PARTS / (F.col("hi") - F.col("lo") + 1))
    # one row of bounds
    rows = events.crossJoin(F.broadcast(ends)).withColumn("part", part).withColumn("chunk", F.floor(F.col("event_id") / REQUEST_RECORDS))
    attribute = lambda e: F.struct(F.lit("event_id").alias("key"), F.struct(e["event_id"].cast("string").alias("intValue")).alias("value"))
    record = lambda e: F.struct(F.concat(e["us"].cast("string"), F.lit("000")).alias("timeUnixNano"), F.struct(F.concat(F.lit("user "), e["user_id"].cast("string")).alias("stringValue")).alias("body"), F.array(attribute(e)).alias("attributes"))
    # a request holds at most REQUEST_RECORDS records; they are rendered where they have been gathered, so that numbers are moved and not texts
    one = rows.groupBy("event_type", "part", "chunk").agg(F.collect_list(F.struct("us", "event_id", "user_id")).alias("events"))
    one = one.withColumn("records", F.sort_array(F.transform("events", record)))
    scope = F.array(F.struct(F.col("records").alias("logRecords")))
    body = F.to_json(F.struct(F.array(F.struct(scope.alias("scopeLogs"))).alias("resourceLogs")))
    return one.select(F.col("event_type").alias("tenant"), F.concat_ws("-", "event_type", "part", "chunk").alias("token"), body.alias("request"), "part")


def landed_lake(spark: SparkSession, folder: str) -> tuple[Landing, LakeLog]:
    """All parts landed in windows of their own, the second batch with the first one's requests once more, all windows but the last drained."""
    root = scratch_path(spark, "lake")
    landing, lake = Landing(spark, root, "n1", window_ms=WINDOW_MS), LakeLog(spark, root)
    source = requests(spark, folder)
    for k in range(PARTS):
        batch = source.where(F.col("part") <= 1) if k == 1 else source.where(F.col("part") == k)
        landing.stage(batch.drop("part"), "events", k, now_ms=2 * k * WINDOW_MS)
    drain(spark, landing, lake, LOGS, now_ms=2 * (PARTS - 1) * WINDOW_MS, lateness_ms=0)
    return landing, lake


def served(spark: SparkSession, folder: str) -> tuple[Engine, Landing]:
    landing, lake = landed_lake(spark, folder)
    hot = landing.rows()
    return Engine.attach(spark, lake.path, [LOGS], hot={} if hot is None else {LOGS.name: hot}), landing


_PARTS = f"""
WITH e AS (SELECT event_type || '.0' AS partition, epoch_us(ts) // 1000 AS ms, event_id FROM events),
b AS (SELECT min(ms) AS lo, max(ms) AS hi FROM e),
p AS (SELECT partition, ms, event_id, (ms - lo) * {PARTS} // (hi - lo + 1) AS part FROM e, b),
m AS (SELECT partition, max(ms) AS bound FROM p WHERE part < {PARTS - 1} GROUP BY partition)
"""


@R.add("lake_served", _PARTS + "SELECT partition, count(*) AS n, count(*) FILTER (ms <= bound) AS n_cold, count(*) FILTER (bound IS NULL OR ms > bound) AS n_hot, max(bound) AS complete_through_ms FROM p LEFT JOIN m USING (partition) GROUP BY partition")
def lake_served(spark: SparkSession, folder: str) -> DataFrame:
    """Events landed as requests, some of them twice, sealed and committed but for the last window, and served as one view."""
    engine, _ = served(spark, folder)
    rows = engine.view(LOGS.name).groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("window_id") < PARTS - 1).alias("n_cold"), F.count_if(F.col("window_id") == PARTS - 1).alias("n_hot"))
    return rows.join(engine.watermarks(), "partition", "left")


@R.add("lake_range", _PARTS + "SELECT partition, event_id FROM p, b WHERE ms BETWEEN lo + (hi - lo) // 4 AND lo + (hi - lo) // 2")
def lake_range(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a time range, read from the committed parts and landed rows that may hold it."""
    engine, _ = served(spark, folder)
    lo, hi = table(spark, folder, "events").agg(F.min(time_ms("ts")), F.max(time_ms("ts"))).first()
    rows = engine.view(LOGS.name, lo + (hi - lo) // 4, lo + (hi - lo) // 2)
    return rows.select("partition", F.get_json_object("attrs", "$.event_id").cast("bigint").alias("event_id"))


@R.add("lake_residue", _PARTS + f"SELECT partition, count(*) - count(*) // 2 AS n_left, 'residue_kept' AS outcome FROM p WHERE part = {PARTS - 1} GROUP BY partition")
def lake_residue(spark: SparkSession, folder: str) -> DataFrame:
    """What stays landed of the last window after it is dropped under coverage of the first half of each partition's numbers in it."""
    landing, _ = landed_lake(spark, folder)
    edges = landing.rows([PARTS - 1]).groupBy("partition", "origin").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
    half = edges.select("partition", "origin", "first_seq", (F.col("first_seq") + F.floor(F.col("n") / 2) - 1).alias("last_seq"))
    outcome = landing.drop_covered(PARTS - 1, half)
    return landing.rows([PARTS - 1]).groupBy("partition").agg(F.count(F.lit(1)).alias("n_left")).withColumn("outcome", F.lit(outcome))


_MANIFEST = {"dataset": "d", "partition": "p", "window_id": 0, "rows": 1, "event_time_min_ms": 1, "event_time_max_ms": 2, "dedup_removed": 0, "part_kind": "primary", "discriminator": 0}


@R.add("lake_commits", "SELECT * FROM (VALUES (1, 'committed', 7), (2, 'committed', 7), (3, 'aborted', 7), (4, 'failed_precondition', 7), (5, 'committed', 9)) AS t(step, outcome, complete_through_ms)")
def lake_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of commits: a window's files, the same again, other files for it, numbers that it covers, the next window; with the watermark after each."""
    lake = LakeLog(spark, scratch_path(spark, "lake"))
    span = lambda a, b: [{"origin": "o", "first_seq": a, "last_seq": b}]
    steps = [
        (_MANIFEST | {"parts": ["a"], "origin_coverage": span(1, 5)}, 7),
        (_MANIFEST | {"parts": ["a"], "origin_coverage": span(1, 5)}, 7),
        (_MANIFEST | {"parts": ["b"], "origin_coverage": span(6, 7)}, 8),
        (_MANIFEST | {"window_id": 1, "parts": ["c"], "origin_coverage": span(5, 8)}, 8),
        (_MANIFEST | {"window_id": 1, "parts": ["d"], "origin_coverage": span(6, 8)}, 9),
    ]
    rows = []
    for k, (manifest, mark) in enumerate(steps, 1):
        try:
            outcome = lake.commit_files(manifest, mark)
        except Exception as error:
            outcome = getattr(error, "code", "error").lower()
        rows.append((k, outcome, lake.state().watermarks["p"]))
    return spark.createDataFrame(rows, "step int, outcome string, complete_through_ms bigint")


@R.add("lake_applied", "SELECT * FROM (VALUES ('x', 'p', 5), ('y', 'p', 3)) AS t(origin, partition, applied_seq)")
def lake_applied(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest committed number of each origin, an expired window's included."""
    lake = LakeLog(spark, scratch_path(spark, "lake"))
    lake.commit_files(_MANIFEST | {"parts": ["a"], "origin_coverage": [{"origin": "x", "first_seq": 1, "last_seq": 5}]}, None)
    lake.commit_files(_MANIFEST | {"window_id": 1, "parts": ["b"], "origin_coverage": [{"origin": "y", "first_seq": 1, "last_seq": 3}]}, None)
    lake.expire(["a"])
    return lake.applied().select(*sorted(APPLIED.names))
