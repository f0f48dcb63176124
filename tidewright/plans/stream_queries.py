"""Queries of the data plane and the query contract, over the staged logs and the journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import ids, ladder, naming, otlp
from tidewright.operators import changelog as cl
from tidewright.operators import dedup, ranges, replication, upkeep, watermark
from tidewright.plans import engine, predicates
from tidewright.plans.registry import Registry, table
from tidewright.session import materialise
from tidewright.streaming.drain import window_manifests
from tidewright.types import DatasetDecl

R = Registry()
PO = ["partition", "origin"]
LOGS = DatasetDecl("otlp_logs", natural_key=("partition", "window_id", "origin", "seq"))


def _logs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "otlp_logs").select(*columns)


# ranges

_RUNS = """
runs AS (SELECT partition, origin, min(seq) AS first_seq, max(seq) AS last_seq FROM (
  SELECT *, seq - row_number() OVER (PARTITION BY partition, origin ORDER BY seq) AS g FROM (SELECT DISTINCT partition, origin, seq FROM otlp_logs)) GROUP BY partition, origin, g)
"""


@R.add("coverage_runs", f"WITH {_RUNS} SELECT * FROM runs")
def coverage_runs(spark, folder):
    """Contiguous runs of the staged numbers per (partition, origin)."""
    return ranges.coverage_runs(_logs(spark, folder, *PO, "seq"), PO)


_GAPS = f"WITH {_RUNS}, gaps AS (SELECT partition, origin, coalesce(lag(last_seq) OVER (PARTITION BY partition, origin ORDER BY first_seq), 0) + 1 AS first_seq, first_seq - 1 AS last_seq FROM runs)"


@R.add("coverage_gaps", f"{_GAPS} SELECT * FROM gaps WHERE first_seq <= last_seq")
def coverage_gaps(spark, folder):
    """Missing numbers per (partition, origin)."""
    return ranges.coverage_gaps(_logs(spark, folder, *PO, "seq"), PO)


def _marks(spark, folder):
    applied = table(spark, folder, "applied_log").where("status = 'committed' and applied_seq > 0").groupBy(*PO).agg(F.max("applied_seq").alias("last_seq"))
    return applied.select(*PO, F.lit(1).cast("bigint").alias("first_seq"), "last_seq")


@R.add(
    "coverage_residue",
    f"""WITH {_RUNS}, m AS (SELECT partition, origin, max(applied_seq) AS a FROM applied_log WHERE status = 'committed' AND applied_seq > 0 GROUP BY ALL)
SELECT r.partition, r.origin, greatest(r.first_seq, coalesce(m.a, 0) + 1) AS first_seq, r.last_seq FROM runs r LEFT JOIN m USING (partition, origin) WHERE r.last_seq > coalesce(m.a, 0)""",
)
def coverage_residue(spark, folder):
    """Staged ranges beyond what earlier runs applied."""
    return replication.residue(ranges.coverage_runs(_logs(spark, folder, *PO, "seq"), PO), _marks(spark, folder))


@R.add("applied_through", f"WITH {_RUNS} SELECT partition, origin, coalesce(max(last_seq) FILTER (WHERE first_seq = 1), 0) AS applied_seq FROM runs GROUP BY ALL")
def applied_through(spark, folder):
    """The end of each contiguous prefix."""
    return ranges.applied_through(_logs(spark, folder, *PO, "seq"))


@R.add(
    "covered_records",
    """SELECT DISTINCT l.partition, l.origin, l.seq FROM otlp_logs l JOIN (SELECT partition, unnest(origin_coverage) AS u FROM window_manifests WHERE dataset = 'otlp_logs') m
ON l.partition = m.partition AND l.origin = m.u.origin AND m.u.first_seq >= 1 AND l.seq BETWEEN m.u.first_seq AND m.u.last_seq""",
)
def covered_records(spark, folder):
    """Staged records that some manifest of the lake covers."""
    m = table(spark, folder, "window_manifests").where("dataset = 'otlp_logs'").select("partition", F.explode("origin_coverage").alias("r")).select("partition", "r.*")
    return ranges.covered(_logs(spark, folder, *PO, "seq"), m).distinct()


@R.add(
    "manifest_overlaps",
    """WITH r AS (SELECT DISTINCT partition, window_id, u.origin AS origin, u.first_seq AS f, u.last_seq AS l FROM (SELECT *, unnest(origin_coverage) AS u FROM window_manifests WHERE dataset = 'otlp_logs'))
SELECT DISTINCT a.partition, a.window_id, a.origin, a.f AS first_seq, a.l AS last_seq FROM r a JOIN r b ON a.partition = b.partition AND a.origin = b.origin AND a.window_id <> b.window_id AND a.f <= b.l AND a.l >= b.f""",
)
def manifest_overlaps(spark, folder):
    """Ranges that meet one of another window of the same partition and origin."""
    m = table(spark, folder, "window_manifests").where("dataset = 'otlp_logs'").select("partition", "window_id", F.explode("origin_coverage").alias("r")).select("partition", "window_id", "r.*").distinct()
    b = m.select(*[F.col(c).alias("b_" + c) for c in m.columns])
    meets = (m.partition == b.b_partition) & (m.origin == b.b_origin) & (m.window_id != b.b_window_id) & (m.first_seq <= b.b_last_seq) & (m.last_seq >= b.b_first_seq)
    return m.join(b, meets, "left_semi")


# de-duplication


@R.add("dedup_keep_first", "SELECT DISTINCT ON (dataset, tenant, changelog_key) dataset, tenant, changelog_key, origin, changelog_seq AS seq FROM changelog WHERE event = 'ClientAck' ORDER BY dataset, tenant, changelog_key, origin, changelog_seq")
def dedup_keep_first(spark, folder):
    """The first change of every key."""
    rows = table(spark, folder, "changelog").where("event = 'ClientAck'").select("dataset", "tenant", "changelog_key", "origin", F.col("changelog_seq").alias("seq"))
    return dedup.keep_first(rows, ["dataset", "tenant", "changelog_key"])


@R.add("dedup_keep_latest", "SELECT DISTINCT ON (dataset, tenant, changelog_key) dataset, tenant, changelog_key, origin, changelog_seq AS seq FROM changelog WHERE event = 'ClientAck' ORDER BY dataset, tenant, changelog_key, origin DESC, changelog_seq DESC")
def dedup_keep_latest(spark, folder):
    """The last change of every key, deletes included."""
    rows = table(spark, folder, "changelog").where("event = 'ClientAck'").select("dataset", "tenant", "changelog_key", "origin", F.col("changelog_seq").alias("seq"))
    return dedup.keep_latest(rows, ["dataset", "tenant", "changelog_key"])


@R.add("dedup_removed_count", "SELECT partition, count(*) AS total, count(DISTINCT (origin, seq)) AS sealed, count(*) - count(DISTINCT (origin, seq)) AS dedup_removed FROM otlp_logs GROUP BY partition")
def dedup_removed_count(spark, folder):
    """Copies that sealing by record identity would remove."""
    return dedup.seal_counts(_logs(spark, folder, *PO, "seq"), ["origin", "seq"], ["partition"])


@R.add("dedup_content_key", "SELECT line_id, CASE WHEN request_id IS NOT NULL THEN 't:' || request_id ELSE 'h:' || sha256(coalesce(tenant, '') || '/' || coalesce(source_incarnation, '') || '/' || coalesce(first_index::VARCHAR, '')) END AS dedup_key FROM client_acks")
def dedup_content_key(spark, folder):
    """The de-duplication key of every request line: its token or a hash of its content."""
    acks = table(spark, folder, "client_acks")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.concat_ws("/", text("tenant"), text("source_incarnation"), text("first_index"))
    return acks.select("line_id", ids.dedup_key(F.col("request_id"), content).alias("dedup_key"))


@R.add(
    "dedup_ledger_split",
    """WITH b AS (SELECT DISTINCT tenant, 't:' || request_id AS dedup_key FROM client_acks WHERE event = 'ClientTimeout' AND request_id IS NOT NULL),
l AS (SELECT tenant, 't:' || request_id AS dedup_key, max(max_event_time_ms) AS created_ms FROM client_acks WHERE event = 'ClientAck' AND request_id IS NOT NULL GROUP BY ALL)
SELECT b.tenant, b.dedup_key, EXISTS (SELECT 1 FROM l WHERE l.tenant = b.tenant AND l.dedup_key = b.dedup_key AND l.created_ms >= 1770163200000 - 86400000) AS known FROM b""",
)
def dedup_ledger_split(spark, folder):
    """Timed-out requests that an acknowledged one within a day's time to live answers."""
    acks = table(spark, folder, "client_acks").where("request_id is not null").withColumn("dedup_key", F.concat(F.lit("t:"), "request_id"))
    batch = acks.where("event = 'ClientTimeout'").select("tenant", "dedup_key").distinct()
    ledger = acks.where("event = 'ClientAck'").groupBy("tenant", "dedup_key").agg(F.max("max_event_time_ms").alias("created_ms")).withColumn("outcome", F.lit("ack"))
    fresh, known = dedup.split_known(batch, ledger, 1_770_163_200_000, 86_400_000)
    return fresh.withColumn("known", F.lit(False)).unionAll(known.select("tenant", "dedup_key", F.lit(True).alias("known")))


@R.add("dedup_evict_cap", "SELECT tenant, dedup_key, created_ms FROM (SELECT tenant, request_id AS dedup_key, max(max_event_time_ms) AS created_ms FROM client_acks WHERE request_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY created_ms DESC NULLS LAST, dedup_key DESC) <= 10")
def dedup_evict_cap(spark, folder):
    """The ten newest ledger rows of each tenant."""
    acks = table(spark, folder, "client_acks").where("request_id is not null")
    return dedup.evict_beyond(acks.groupBy("tenant", F.col("request_id").alias("dedup_key")).agg(F.max("max_event_time_ms").alias("created_ms")), 10)


@R.add("dedup_conflicts", "SELECT dataset, partition, origin, changelog_seq, count(*) AS versions FROM (SELECT DISTINCT dataset, partition, origin, changelog_seq, tenant, changelog_key, coalesce(tombstone, false) AS t, value FROM changelog WHERE event = 'ClientAck' AND changelog_seq IS NOT NULL) GROUP BY ALL HAVING count(*) > 1")
def dedup_conflicts(spark, folder):
    """Slots that were acknowledged with different contents."""
    return predicates.unjudgeable_slots(table(spark, folder, "changelog"))


@R.add("conflicting_keys", "SELECT dataset, changelog_key, count(*) AS versions FROM (SELECT DISTINCT dataset, changelog_key, tenant FROM changelog WHERE event = 'ClientAck') GROUP BY ALL HAVING count(*) > 1")
def conflicting_keys(spark, folder):
    """Keys that are alike across tenants, so that a view keyed without the tenant would mix them up."""
    return dedup.conflicts(table(spark, folder, "changelog").where("event = 'ClientAck'"), ["dataset", "changelog_key"], ["tenant"])


@R.add(
    "sequence_errors",
    """WITH r AS (SELECT DISTINCT dataset, partition, window_id FROM window_manifests WHERE dataset IS NOT NULL AND partition IS NOT NULL AND window_id IS NOT NULL),
f AS (SELECT partition, arg_min(dataset, (window_id, dataset)) AS d FROM r GROUP BY partition),
w AS (SELECT partition, window_id, coalesce(lag(window_id) OVER (PARTITION BY partition ORDER BY window_id), -1) AS b FROM (SELECT DISTINCT partition, window_id FROM r))
SELECT DISTINCT r.partition, r.window_id, 'dataset_mismatch' AS error FROM r JOIN f USING (partition) WHERE r.dataset <> f.d UNION SELECT partition, window_id, 'window_not_next' FROM w WHERE window_id <> b + 1""",
)
def sequence_errors(spark, folder):
    """Windows that the ledger would refuse for their dataset or their place."""
    return watermark.sequence_errors(table(spark, folder, "window_manifests"))


# windows, watermark


@R.add(
    "window_manifest",
    """WITH t AS (SELECT partition, window_id, count(*) AS total, count(DISTINCT (origin, seq)) AS rows, min(epoch_us(ts) // 1000) AS event_time_min_ms, max(epoch_us(ts) // 1000) AS event_time_max_ms FROM otlp_logs GROUP BY ALL),
r AS (SELECT partition, window_id, origin, min(seq) AS f, max(seq) AS l FROM (SELECT *, seq - row_number() OVER (PARTITION BY partition, window_id, origin ORDER BY seq) AS g FROM (SELECT DISTINCT partition, window_id, origin, seq FROM otlp_logs)) GROUP BY partition, window_id, origin, g),
c AS (SELECT partition, window_id, string_agg(origin || ':' || f || '-' || l, ',' ORDER BY origin, f) AS coverage FROM r GROUP BY ALL)
SELECT 'otlp_logs' AS dataset, partition, window_id, coverage, rows, event_time_min_ms, event_time_max_ms, total - rows AS dedup_removed FROM t JOIN c USING (partition, window_id)""",
)
def window_manifest(spark, folder):
    """The manifest of every arrival window, coverage as text."""
    m = window_manifests(_logs(spark, folder, "partition", "window_id", "origin", "seq", "ts"), LOGS)
    shown = F.array_join(F.transform("origin_coverage", lambda r: F.concat(r["origin"], F.lit(":"), r["first_seq"].cast("string"), F.lit("-"), r["last_seq"].cast("string"))), ",")
    return m.withColumn("origin_coverage", shown).withColumnRenamed("origin_coverage", "coverage")


def _dense_manifests(spark, folder):
    """Manifests over arrival windows numbered densely per partition, each record in the first window that has it."""
    first = _logs(spark, folder, *PO, "seq", "window_id", "ts").groupBy(*PO, "seq").agg(F.min("window_id").alias("window_id"), F.max("ts").alias("ts"))
    hours = first.withColumn("hour", F.floor(F.col("window_id") / 60))
    numbered = hours.select("partition", "hour").distinct().withColumn("w", F.row_number().over(Window.partitionBy("partition").orderBy("hour")).cast("bigint") - 1)
    rows = hours.drop("window_id").join(numbered, ["partition", "hour"]).withColumnRenamed("w", "window_id")
    return window_manifests(rows, DatasetDecl("otlp_logs"))


_DENSE = """
WITH d AS (SELECT partition, origin, seq, min(window_id) // 60 AS h, max(epoch_us(ts) // 1000) AS ms FROM otlp_logs GROUP BY partition, origin, seq),
n AS (SELECT partition, h, row_number() OVER (PARTITION BY partition ORDER BY h) - 1 AS w FROM (SELECT DISTINCT partition, h FROM d)),
x AS (SELECT d.*, n.w FROM d JOIN n USING (partition, h)),
losses AS ({losses}),
tops AS (SELECT partition, origin, w, max(seq) AS top, count(*) AS c FROM x GROUP BY ALL),
grid AS (SELECT n.partition, n.w, o.origin FROM n JOIN (SELECT DISTINCT partition, origin FROM x) o USING (partition)),
cum AS (SELECT g.partition, g.w, g.origin, sum(coalesce(t.c, 0)) OVER q AS have, max(t.top) OVER q AS top FROM grid g LEFT JOIN tops t USING (partition, origin, w) WINDOW q AS (PARTITION BY g.partition, g.origin ORDER BY g.w)),
lost AS (SELECT c.partition, c.w, c.origin, coalesce(sum(greatest(least(l.last_seq, c.top) - l.first_seq + 1, 0)), 0) AS lost FROM cum c LEFT JOIN losses l ON l.partition = c.partition AND l.origin = c.origin GROUP BY ALL),
clean AS (SELECT c.partition, c.w, bool_and(c.top IS NULL OR c.have + l.lost >= c.top) AS ok FROM cum c JOIN lost l USING (partition, w, origin) GROUP BY ALL),
ev AS (SELECT partition, w, max(max(ms)) OVER (PARTITION BY partition ORDER BY w) AS event_max FROM x GROUP BY partition, w)
SELECT partition, max(w) AS recorded_through, max(w) FILTER (WHERE ok) AS done_through, max(event_max) FILTER (WHERE ok) AS complete_through_ms FROM clean JOIN ev USING (partition, w) GROUP BY partition
"""


@R.add("watermark_advance", _DENSE.format(losses="SELECT NULL::VARCHAR AS partition, NULL::VARCHAR AS origin, NULL::BIGINT AS first_seq, NULL::BIGINT AS last_seq WHERE false"))
def watermark_advance(spark, folder):
    """Each partition's completeness over its hourly windows, holes and all."""
    return watermark.advance(materialise(_dense_manifests(spark, folder), "manifests"))


_LOSSES = _GAPS.removeprefix("WITH ") + ", m AS (SELECT partition, origin, max(applied_seq) AS a FROM applied_log WHERE status = 'committed' GROUP BY ALL) SELECT g.* FROM gaps g JOIN m USING (partition, origin) WHERE g.first_seq <= g.last_seq AND g.last_seq <= m.a"


@R.add("watermark_with_loss", _DENSE.format(losses="WITH " + _LOSSES))
def watermark_with_loss(spark, folder):
    """The same with holes below the applied marks declared lost."""
    gaps = coverage_gaps(spark, folder)
    marks = _marks(spark, folder).select(*PO, F.col("last_seq").alias("mark"))
    losses = gaps.join(marks, PO).where("last_seq <= mark").drop("mark")
    return watermark.advance(materialise(_dense_manifests(spark, folder), "manifests"), losses)


@R.add(
    "watermark_stalls",
    "WITH s AS (" + _DENSE.format(losses="SELECT NULL::VARCHAR AS partition, NULL::VARCHAR AS origin, NULL::BIGINT AS first_seq, NULL::BIGINT AS last_seq WHERE false") + f"), h AS ({_GAPS} SELECT * FROM gaps WHERE first_seq <= last_seq), "
    "m AS (SELECT partition, origin, max(applied_seq) AS a FROM applied_log WHERE status = 'committed' AND applied_seq > 0 GROUP BY ALL) "
    "SELECT s.partition, 'coverage_holes' AS reason, NULL::BIGINT AS expected_window, NULL::BIGINT AS n_deferred, count(h.origin) AS n_holes, count(*) FILTER (WHERE m.a >= h.last_seq) AS n_in_hot FROM s LEFT JOIN h USING (partition) LEFT JOIN m USING (partition, origin) WHERE s.done_through IS NULL OR s.done_through < s.recorded_through GROUP BY s.partition",
)
def watermark_stalls(spark, folder):
    """Partitions whose watermark stands, and why."""
    staging = _marks(spark, folder).select(*PO, F.col("last_seq").alias("applied_seq"))
    return watermark.stalls(materialise(_dense_manifests(spark, folder), "manifests"), None, staging)


@R.add("read_watermarks", "SELECT partition, max(complete_through_ms) AS complete_through_ms FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY partition")
def read_watermarks(spark, folder):
    """The committed watermark of every partition that has one."""
    return table(spark, folder, "watermark_log").where("event = 'LakeCommitOk'").groupBy("partition").agg(F.max("complete_through_ms").alias("complete_through_ms"))


# query contract


@R.add(
    "hot_cold_union",
    """WITH w AS (SELECT partition, max(complete_through_ms) AS b FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY partition)
SELECT l.partition, count(*) AS n, count(*) FILTER (WHERE epoch_us(l.ts) // 1000 <= w.b) AS n_cold FROM otlp_logs l LEFT JOIN w USING (partition) GROUP BY l.partition""",
)
def hot_cold_union(spark, folder):
    """The staged table as both tiers: the union has every row once."""
    logs = _logs(spark, folder, "partition", "ts")
    marks = materialise(read_watermarks(spark, folder), "marks")
    ms = engine.time_ms("ts")
    both = engine.tier_union(logs.withColumn("tier", F.lit("cold")), logs.withColumn("tier", F.lit("hot")), marks, ms)
    return both.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "cold").alias("n_cold"))


@R.add(
    "freshness",
    """WITH w AS (SELECT partition, max(complete_through_ms) AS b FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY partition),
d AS (SELECT DISTINCT dataset, partition FROM window_manifests WHERE dataset IS NOT NULL AND partition IS NOT NULL)
SELECT dataset, CASE WHEN count(*) = count(b) THEN min(b) END AS complete_through_ms, 1770163200000 - CASE WHEN count(*) = count(b) THEN min(b) END AS age_ms,
  arg_min(partition, (b IS NOT NULL, coalesce(b, 0), partition)) AS laggard FROM d LEFT JOIN w USING (partition) GROUP BY dataset""",
)
def freshness(spark, folder):
    """Completeness, age and laggard of every dataset."""
    parts = table(spark, folder, "window_manifests").where("dataset is not null and partition is not null").select("dataset", "partition").distinct()
    return engine.freshness(parts, read_watermarks(spark, folder), 1_770_163_200_000)


@R.add(
    "absent_hours",
    """WITH w AS (SELECT partition, max(complete_through_ms) AS b FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY partition),
h AS (SELECT partition, b, unnest(range(1769990400000 // 3600000, b // 3600000)) AS hour FROM w),
s AS (SELECT DISTINCT partition, (epoch_us(ts) // 1000) // 3600000 AS hour FROM otlp_logs)
SELECT h.partition, h.hour FROM h ANTI JOIN s USING (partition, hour)""",
)
def absent_hours(spark, folder):
    """Hours that are proven to hold no record: wholly at or below the watermark, and empty."""
    marks = read_watermarks(spark, folder)
    first, hour = 1_769_990_400_000 // 3_600_000, F.floor(F.col("complete_through_ms") / 3_600_000)
    hours = marks.where(hour > first).select("partition", F.explode(F.sequence(F.lit(first), hour - 1)).alias("hour"))
    seen = _logs(spark, folder, "partition", "ts").select("partition", F.floor(engine.time_ms("ts") / 3_600_000).alias("hour")).distinct()
    return hours.join(seen, ["partition", "hour"], "left_anti")


# changelog views

KEY = ["dataset", "tenant", "changelog_key"]


def _changes(spark, folder):
    rows = table(spark, folder, "changelog").where("event = 'ClientAck' and changelog_seq is not null")
    op = F.when(F.coalesce("tombstone", F.lit(False)), "delete").otherwise("upsert")
    # lines of one change agree; copies go first
    return rows.select(*KEY, "origin", F.col("changelog_seq").alias("seq"), "partition", "value", op.alias("_op")).distinct()


_C = "WITH c AS (SELECT DISTINCT dataset, tenant, changelog_key, origin, changelog_seq AS seq, partition, value, coalesce(tombstone, false) AS t FROM changelog WHERE event = 'ClientAck' AND changelog_seq IS NOT NULL)"


@R.add("latest_view", f"{_C} SELECT dataset, tenant, changelog_key, value FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset, tenant, changelog_key ORDER BY origin DESC, seq DESC) = 1) WHERE NOT t")
def latest_view(spark, folder):
    """Current rows by key."""
    return cl.latest_view(_changes(spark, folder), KEY).select(*KEY, "value")


@R.add("latest_with_tombstones", f"{_C} SELECT dataset, tenant, changelog_key, origin, seq, t AS deleted FROM c QUALIFY row_number() OVER (PARTITION BY dataset, tenant, changelog_key ORDER BY origin DESC, seq DESC) = 1")
def latest_with_tombstones(spark, folder):
    """The newest change of every key as a snapshot keeps it, deletes too."""
    rows = _changes(spark, folder)
    as_of = rows.groupBy("origin").agg(F.max("seq").alias("as_of_seq"))
    return cl.snapshot(rows, KEY, as_of).select(*KEY, "origin", "seq", (F.col("_op") == "delete").alias("deleted"))


@R.add("snapshot_plus_delta", f"{_C} SELECT dataset, tenant, changelog_key, value FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset, tenant, changelog_key ORDER BY origin DESC, seq DESC) = 1) WHERE NOT t")
def snapshot_plus_delta(spark, folder):
    """The latest view from a snapshot at half of each origin's numbers and the rows after it: the same as from all rows."""
    rows = _changes(spark, folder)
    as_of = rows.groupBy("origin").agg(F.floor(F.max("seq") / 2).alias("as_of_seq"))
    later = rows.join(as_of, "origin").where("seq > as_of_seq").select(rows.columns)
    return cl.view_from_snapshot(cl.snapshot(rows, KEY, as_of), later, KEY).select(*KEY, "value")


@R.add("scd2_validity", "SELECT event_id, user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events")
def scd2_validity(spark, folder):
    """Validity periods of each user's events."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return cl.validity(rows, ["user_id"], "ts", ("event_id",)).select("event_id", "user_id", "valid_from", "valid_to")


@R.add(
    "asof_enrich",
    """WITH l AS (SELECT DISTINCT partition, origin, seq, observed_ts FROM otlp_logs),
w AS (SELECT partition, at_ms, max(complete_through_ms) AS thru FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY ALL)
SELECT l.partition, l.origin, l.seq, w.thru FROM l ASOF LEFT JOIN w ON l.partition = w.partition AND epoch_us(l.observed_ts) >= w.at_ms * 1000""",
)
def asof_enrich(spark, folder):
    """Every record with the last watermark line of its partition at its arrival."""
    logs = _logs(spark, folder, *PO, "seq", "observed_ts").distinct()
    w = table(spark, folder, "watermark_log").where("event = 'LakeCommitOk'").groupBy("partition", "at_ms").agg(F.max("complete_through_ms").alias("thru"))
    w = w.select("partition", F.timestamp_millis("at_ms").alias("at"), "thru")
    return cl.asof_join(logs, w, ["partition"], "observed_ts", "at", ["thru"]).select(*PO, "seq", "thru")


@R.add("latest_enrich", "WITH d AS (SELECT l_partkey AS k, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS price FROM lineitem GROUP BY ALL) SELECT p_partkey, p_brand, d.price AS last_price FROM part LEFT JOIN d ON k = p_partkey")
def latest_enrich(spark, folder):
    """Parts with the price of their last shipment."""
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("last_price"))
    newest = dedup.keep_latest(lines, ["p_partkey"], ("l_shipdate", "l_orderkey", "l_linenumber")).select("p_partkey", "last_price")
    return table(spark, folder, "part").select("p_partkey", "p_brand").join(newest, "p_partkey", "left")


# ladder, replication

_FILL = "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS staged, CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 200000 END::BIGINT AS capacity, o_orderstatus = 'F' AS stalled FROM orders"


def _fill(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.floor("o_totalprice").alias("staged"), F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(200000).cast("bigint").alias("capacity"), (F.col("o_orderstatus") == "F").alias("stalled"))


@R.add("ladder_rung", f"SELECT o_orderkey, CASE WHEN capacity = 0 OR staged * 100 >= capacity * 100 THEN 'refusing_ingest' WHEN staged * 100 >= capacity * 95 THEN 'throttling' WHEN staged * 100 >= capacity * 80 THEN CASE WHEN stalled THEN 'drain_stalled' ELSE 'staging_pressure' END ELSE 'normal' END AS rung FROM ({_FILL})")
def ladder_rung(spark, folder):
    """The overload rung of every fill measure."""
    return _fill(spark, folder).select("o_orderkey", ladder.rung(F.col("staged"), F.col("capacity"), F.col("stalled")).alias("rung"))


@R.add("ladder_retry_delay", f"SELECT o_orderkey, CASE WHEN capacity = 0 THEN 30000 ELSE 1000 + 29000 * least(greatest(staged * 1000 // capacity - 950, 0), 50) // 50 END AS delay_ms FROM ({_FILL})")
def ladder_retry_delay(spark, folder):
    """The retry delay of every fill measure."""
    return _fill(spark, folder).select("o_orderkey", ladder.retry_delay_ms(F.col("staged"), F.col("capacity")).alias("delay_ms"))


@R.add("ladder_budget", f"SELECT o_orderkey, 2147483648 + CASE WHEN capacity = 0 THEN 0 ELSE 2147483648 * least(greatest(staged * 1000 // capacity - 800, 0), 200) // 200 END AS budget FROM ({_FILL})")
def ladder_budget(spark, folder):
    """The query budget of every fill measure."""
    return _fill(spark, folder).select("o_orderkey", ladder.scaled_budget(F.lit(2**31).cast("bigint"), F.col("staged"), F.col("capacity")).alias("budget"))


@R.add("ack_ready", "WITH m AS (SELECT partition, origin, run_id, max(applied_seq) AS thru FROM applied_log WHERE applied_seq IS NOT NULL GROUP BY ALL), b AS (SELECT partition, origin, max(seq) AS last_seq FROM otlp_logs GROUP BY ALL) SELECT b.partition, b.origin, b.last_seq, count(DISTINCT m.run_id) AS holders, count(DISTINCT m.run_id) >= 1 AS ready FROM b LEFT JOIN m ON m.partition = b.partition AND m.origin = b.origin AND m.thru >= b.last_seq GROUP BY ALL")
def ack_ready(spark, folder):
    """Streams whose last staged record some run's mark reaches (runs stand in for peers)."""
    batches = _logs(spark, folder, *PO, "seq").groupBy(*PO).agg(F.max("seq").alias("last_seq"))
    receipts = table(spark, folder, "applied_log").where("applied_seq is not null").select(*PO, F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("holder"), F.col("applied_seq").alias("replicated_thru"))
    return replication.ack_ready(batches, receipts, 2)


_FWD = "SELECT DISTINCT partition, u.origin AS origin, u.first_seq AS first_seq, u.last_seq AS last_seq FROM (SELECT partition, unnest(origin_coverage) AS u FROM window_manifests WHERE dataset = 'otlp_logs') WHERE u.origin IS NOT NULL AND u.first_seq IS NOT NULL AND u.last_seq IS NOT NULL"


@R.add("apply_outcomes", f"WITH f AS ({_FWD}), m AS (SELECT partition, origin, max(applied_seq) AS a FROM applied_log WHERE status = 'committed' AND applied_seq > 0 GROUP BY ALL) SELECT f.*, CASE WHEN first_seq > last_seq THEN 'invalid_range' WHEN origin = 'n9' THEN 'self_origin_refused' WHEN last_seq <= coalesce(a, 0) THEN 'duplicate_acked' WHEN first_seq <> coalesce(a, 0) + 1 THEN 'gap_refused' ELSE 'applied' END AS outcome FROM f LEFT JOIN m USING (partition, origin)")
def apply_outcomes(spark, folder):
    """What node n9 would answer to each covered range, given the applied marks."""
    m = table(spark, folder, "window_manifests").where("dataset = 'otlp_logs'").select("partition", F.explode("origin_coverage").alias("r")).select("partition", "r.*")
    forwards = m.where("origin is not null and first_seq is not null and last_seq is not null").distinct().withColumn("incarnation", F.lit(1))
    applied = _marks(spark, folder).select(*PO, F.col("last_seq").alias("applied_seq"))
    fences = spark.createDataFrame([], "node string, incarnation int")
    return replication.apply_outcomes(forwards, applied, fences, "n9").drop("incarnation")


@R.add("apply_outcomes_fenced", f"WITH f AS ({_FWD}), m AS (SELECT partition, origin, max(applied_seq) AS a FROM applied_log WHERE status = 'committed' AND applied_seq > 0 GROUP BY ALL), n AS (SELECT origin FROM f GROUP BY origin ORDER BY origin LIMIT 2), h AS (SELECT DISTINCT partition, origin, seq FROM otlp_logs) SELECT f.partition, f.origin, f.first_seq, f.last_seq, CASE WHEN first_seq > last_seq THEN 'invalid_range' WHEN f.origin = 'n9' THEN 'self_origin_refused' WHEN f.origin IN (SELECT origin FROM n) THEN 'fenced' WHEN last_seq <= coalesce(a, 0) THEN CASE WHEN h.seq IS NOT NULL THEN 'duplicate_acked' ELSE 'suspect_duplicate' END WHEN first_seq <> coalesce(a, 0) + 1 THEN 'gap_refused' ELSE 'applied' END AS outcome FROM f LEFT JOIN m USING (partition, origin) LEFT JOIN h ON h.partition = f.partition AND h.origin = f.origin AND h.seq = f.last_seq")
def apply_outcomes_fenced(spark, folder):
    """The same with a newer incarnation of the two first origins known, and duplicates checked against the records that are held."""
    m = table(spark, folder, "window_manifests").where("dataset = 'otlp_logs'").select("partition", F.explode("origin_coverage").alias("r")).select("partition", "r.*")
    forwards = m.where("origin is not null and first_seq is not null and last_seq is not null").distinct().withColumn("incarnation", F.lit(1))
    applied = _marks(spark, folder).select(*PO, F.col("last_seq").alias("applied_seq"))
    fences = forwards.select(F.col("origin").alias("node")).distinct().orderBy("node").limit(2).withColumn("incarnation", F.lit(2))
    return replication.apply_outcomes(forwards, applied, fences, "n9", _logs(spark, folder, *PO, "seq")).drop("incarnation")


@R.add("holder_resolution", "WITH o AS (SELECT partition, max(complete_through_ms) AS through FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY partition), c AS (SELECT partition, node, bool_or(event = 'LakeCommitOk') AS own, max(complete_through_ms) AS thru FROM watermark_log GROUP BY ALL) SELECT o.partition, o.through, (SELECT arg_max(c.node, (c.own, c.thru, c.node)) FROM c WHERE c.partition = o.partition AND (c.own OR c.thru >= o.through)) AS holder FROM o")
def holder_resolution(spark, folder):
    """The node that serves each partition: one that committed it, else one that advertised far enough."""
    log = table(spark, folder, "watermark_log")
    owed = read_watermarks(spark, folder).withColumnRenamed("complete_through_ms", "through")
    candidates = log.groupBy("partition", "node").agg(F.bool_or(F.col("event") == "LakeCommitOk").alias("is_owner"), F.max("complete_through_ms").alias("replicated_thru"))
    return replication.holders(owed, candidates)


@R.add("claims", "SELECT DISTINCT partition, node FROM watermark_log WHERE event = 'ClaimAdvertise'")
def claims(spark, folder):
    """Distinct advertised claims."""
    return replication.claims(table(spark, folder, "watermark_log"))


@R.add("hrw_ranked")
def hrw_ranked(spark, folder):
    """Owner and replicas of every partition among five nodes (tested against a plain computation)."""
    return ids.ranked_nodes(_logs(spark, folder, "partition"), [f"n{k}" for k in range(1, 6)], 2)


@R.add("hrw_takeovers")
def hrw_takeovers(spark, folder):
    """Partitions whose owner changes when a node leaves."""
    return replication.takeovers(_logs(spark, folder, "partition"), [f"n{k}" for k in range(1, 6)], [f"n{k}" for k in range(1, 5)], 2)


# OTLP


@R.add("otlp_flatten", "SELECT line, ts, observed_ts, severity_number, nullif(severity_text, '') AS severity_text, body, nullif(scope_name, '') AS scope_name, nullif(trace_id, '') AS trace_id, flags, nullif(event_name, '') AS event_name, service FROM (SELECT partition || '/' || origin || '/' || seq AS line, ts, CASE WHEN epoch_us(observed_ts) <> 0 THEN observed_ts END AS observed_ts, severity_number, severity_text, body, scope_name, trace_id, flags, event_name, resource_attrs ->> '$.\"service.name\"' AS service FROM otlp_logs)")
def otlp_flatten(spark, folder):
    """The staged logs written as OTLP/JSON requests, one record each, and flattened again."""
    logs = table(spark, folder, "otlp_logs")
    nanos = lambda c: F.concat(F.unix_micros(F.col(c).cast("timestamp")).cast("string"), F.lit("000"))
    text = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("stringValue"))))
    service = F.get_json_object("resource_attrs", "$['service.name']")
    pair = F.struct(F.lit("service.name").alias("key"), F.struct(service.alias("stringValue")).alias("value"))
    record = F.struct(
        nanos("ts").alias("timeUnixNano"), nanos("observed_ts").alias("observedTimeUnixNano"), F.col("severity_number").alias("severityNumber"), F.col("severity_text").alias("severityText"),
        F.when(F.col("body").isNotNull(), F.struct(F.col("body").alias("stringValue"))).alias("body"), F.col("flags"), F.col("trace_id").alias("traceId"), F.col("event_name").alias("eventName"),
    )
    scope = F.struct(F.struct(F.col("scope_name").alias("name"), F.col("scope_version").alias("version")).alias("scope"), F.array(record).alias("logRecords"))
    resource = F.struct(F.struct(F.array(pair).alias("attributes")).alias("resource"), F.array(scope).alias("scopeLogs"))
    wire = logs.select(F.concat_ws("/", "partition", "origin", "seq").alias("line"), F.to_json(F.struct(F.array(resource).alias("resourceLogs"))).alias("json"))
    flat = otlp.flatten_logs(wire.select("line", otlp.parse_request(F.col("json")).alias("request")), keep=["line"])
    return flat.select("line", "ts", "observed_ts", "severity_number", "severity_text", "body", "scope_name", "trace_id", "flags", "event_name", F.get_json_object("resource_attrs", "$['service.name']").alias("service"))


@R.add("json_attributes", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_attributes(spark, folder):
    """A field of each event's JSON properties."""
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@R.add("system_tenants", "SELECT coalesce(tenant, 'anonymous') AS tenant, count(*) AS n FROM otlp_logs WHERE coalesce(tenant, 'anonymous') NOT LIKE '\\_%' ESCAPE '\\' GROUP BY ALL")
def system_tenants(spark, folder):
    """Rows per tenant, the system's own left out, missing ones as anonymous; names that are no valid tenant would be refused."""
    rows = _logs(spark, folder, "tenant").select(naming.resolved_tenant(F.col("tenant")).alias("tenant"))
    return rows.where(naming.tenant_is_valid(F.col("tenant")) & ~F.col("tenant").startswith("_")).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


# audits

_ACKED = "SELECT DISTINCT tenant, source_incarnation AS inc, first_index AS f, record_count AS c FROM client_acks WHERE event = 'ClientAck' AND tenant IS NOT NULL AND tenant NOT LIKE '\\_%' ESCAPE '\\' AND source_incarnation IS NOT NULL AND first_index IS NOT NULL AND record_count > 0"


@R.add(
    "zero_acked_lost",
    f"""WITH a AS ({_ACKED}), p AS (SELECT DISTINCT tenant, source_incarnation AS inc, first_index AS f, record_count AS c FROM client_acks WHERE partition IS NOT NULL AND source_incarnation IS NOT NULL AND first_index IS NOT NULL AND record_count > 0),
e AS (SELECT tenant, inc, f AS pos, 1 AS da, 0 AS dp FROM a UNION ALL SELECT tenant, inc, f + c, -1, 0 FROM a UNION ALL SELECT tenant, inc, f, 0, 1 FROM p UNION ALL SELECT tenant, inc, f + c, 0, -1 FROM p),
g AS (SELECT tenant, inc, pos, sum(da) AS da, sum(dp) AS dp FROM e GROUP BY ALL),
s AS (SELECT tenant, inc, pos AS f, lead(pos) OVER w - 1 AS l, sum(da) OVER w AS na, sum(dp) OVER w AS np FROM g WINDOW w AS (PARTITION BY tenant, inc ORDER BY pos)),
x AS (SELECT *, f - lag(l) OVER (PARTITION BY tenant, inc ORDER BY f) AS d FROM s WHERE na > 0 AND np = 0 AND l IS NOT NULL),
y AS (SELECT *, sum(CASE WHEN d = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY tenant, inc ORDER BY f) AS isl FROM x)
SELECT tenant, inc AS source_incarnation, min(f) AS first_index, max(l) AS last_index FROM y GROUP BY tenant, inc, isl""",
)
def zero_acked_lost(spark, folder):
    """Acknowledged records missing from a final state, for which the lines with a partition stand in."""
    acks = table(spark, folder, "client_acks")
    present = acks.where("partition is not null and source_incarnation is not null and first_index is not null and record_count > 0").select("tenant", "source_incarnation", "first_index", F.col("record_count").alias("count"))
    return predicates.zero_acked_lost(acks, present)


@R.add(
    "unbacked_advertisements",
    """WITH c AS (SELECT * FROM watermark_log WHERE partition IS NOT NULL AND complete_through_ms IS NOT NULL), k AS (SELECT * FROM c WHERE event = 'LakeCommitOk')
SELECT node, seq, partition, advertised_ms, bound_ms FROM (SELECT a.node, a.seq, a.partition, a.complete_through_ms AS advertised_ms, greatest((SELECT max(k.complete_through_ms) FROM k WHERE k.partition = a.partition AND k.node <> a.node), (SELECT max(k.complete_through_ms) FROM k WHERE k.partition = a.partition AND k.node = a.node AND k.seq < a.seq)) AS bound_ms
FROM c a WHERE a.event = 'ClaimAdvertise') WHERE bound_ms IS NULL OR advertised_ms > bound_ms""",
)
def unbacked_advertisements(spark, folder):
    """Advertised completeness that nothing committed backs."""
    return predicates.unbacked_advertisements(table(spark, folder, "watermark_log"))


@R.add(
    "uncovered_expiries",
    """WITH r AS (SELECT DISTINCT dataset, partition, window_id, part_kind, discriminator, coalesce(expired, false) AS expired, u.origin AS o, u.first_seq AS f, u.last_seq AS l FROM (SELECT *, unnest(origin_coverage) AS u FROM window_manifests)),
g AS (SELECT * FROM r WHERE expired AND part_kind <> 'snapshot'), s AS (SELECT * FROM r WHERE NOT expired AND part_kind = 'snapshot'),
p AS (SELECT DISTINCT dataset, partition, window_id, part_kind, discriminator FROM g)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dataset, partition, window_id, discriminator FROM s) x WHERE x.dataset = p.dataset AND x.partition = p.partition AND NOT EXISTS (
  SELECT 1 FROM g WHERE g.dataset = p.dataset AND g.partition = p.partition AND g.window_id = p.window_id AND g.part_kind = p.part_kind AND g.discriminator IS NOT DISTINCT FROM p.discriminator AND NOT EXISTS (
    SELECT 1 FROM s WHERE s.dataset = x.dataset AND s.partition = x.partition AND s.window_id = x.window_id AND s.discriminator IS NOT DISTINCT FROM x.discriminator AND s.o = g.o AND s.f <= g.f AND s.l >= g.l)))""",
)
def uncovered_expiries(spark, folder):
    """Expired parts that no live snapshot covers."""
    return predicates.uncovered_expiries(table(spark, folder, "window_manifests"))


_LIVE = "SELECT DISTINCT dataset, partition, u.origin AS origin, u.first_seq AS f, u.last_seq AS l FROM (SELECT *, unnest(origin_coverage) AS u FROM window_manifests WHERE NOT coalesce(expired, false)) WHERE u.first_seq >= 1 AND u.last_seq >= u.first_seq AND u.origin IS NOT NULL"


@R.add(
    "unreachable_values",
    f"""{_C}, n AS (SELECT * FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset, tenant, changelog_key ORDER BY origin DESC, seq DESC) = 1) WHERE NOT t), v AS ({_LIVE})
SELECT dataset, tenant, changelog_key, partition, origin, seq AS changelog_seq FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.dataset = n.dataset AND v.partition = n.partition AND v.origin = n.origin AND n.seq BETWEEN v.f AND v.l)""",
)
def unreachable_values(spark, folder):
    """Latest values that no live part or snapshot holds."""
    live = table(spark, folder, "window_manifests").where("not coalesce(expired, false)").select("dataset", "partition", F.explode("origin_coverage").alias("r")).select("dataset", "partition", "r.*")
    return predicates.unreachable_values(table(spark, folder, "changelog"), live)


@R.add("latest_view_audit", f"{_C}, n AS (SELECT * FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset, tenant, changelog_key ORDER BY origin DESC, seq DESC) = 1) WHERE NOT t), s AS (SELECT * FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset, tenant, changelog_key ORDER BY origin, seq) = 1) WHERE NOT t) SELECT dataset, tenant, changelog_key, n.value AS expected, n.dataset IS NOT NULL AS has_expected, s.value AS served, s.dataset IS NOT NULL AS has_served FROM n FULL JOIN s USING (dataset, tenant, changelog_key) WHERE (n.seq IS NULL) <> (s.seq IS NULL) OR n.value IS DISTINCT FROM s.value".replace("n.dataset IS NOT NULL AS", "n.seq IS NOT NULL AS").replace("s.dataset IS NOT NULL AS", "s.seq IS NOT NULL AS"))
def latest_view_audit(spark, folder):
    """Keys that a view keeping the first instead of the latest change would serve wrongly."""
    rows = _changes(spark, folder)
    served = (first := dedup.keep_first(rows, KEY)).where(cl.op(first) != "delete").select(*KEY, "value")
    return predicates.latest_view_findings(table(spark, folder, "changelog"), served)


@R.add("outcome_tallies", "WITH o AS (SELECT node, request_id, bool_or(event = 'ClientAck') AS a, bool_or(event = 'ClientTimeout') AS t, bool_or(event = 'Throttle') AS r FROM client_acks WHERE request_id IS NOT NULL GROUP BY ALL) SELECT node, count(*) AS sent, count(*) FILTER (a) AS acked, count(*) FILTER (t AND NOT a) AS timed_out, count(*) FILTER (r AND NOT a AND NOT t) AS rejected, count(*) FILTER (a AND (t OR r)) AS ambiguous, count(*) = count(*) FILTER (a) + count(*) FILTER (t AND NOT a) + count(*) FILTER (r AND NOT a AND NOT t) AS reconciles FROM o GROUP BY node")
def outcome_tallies(spark, folder):
    """Outcomes of each node's requests."""
    return predicates.outcome_tallies(table(spark, folder, "client_acks"))


_READS = "SELECT partition, tenant, complete_through_ms FROM client_acks WHERE partition IS NOT NULL AND complete_through_ms IS NOT NULL"


def _reads(spark, folder):
    """Complete reads, for which the lines that name a partition and a bound stand in."""
    lines = table(spark, folder, "client_acks").where("partition is not null and complete_through_ms is not null")
    return lines.select("partition", "tenant", "complete_through_ms", F.lit("complete").alias("concern"), F.lit("served").alias("outcome"))


@R.add("unproven_reads", f"WITH r AS ({_READS}), b AS (SELECT partition, max(complete_through_ms) AS bound_ms FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY partition) SELECT partition, complete_through_ms AS served_ms, bound_ms FROM r LEFT JOIN b USING (partition) WHERE bound_ms IS NULL OR complete_through_ms > bound_ms")
def unproven_reads(spark, folder):
    """Complete answers beyond anything that was committed for their partition."""
    return predicates.unproven_reads(table(spark, folder, "watermark_log"), _reads(spark, folder))


@R.add("undisturbed_medians", "WITH x AS (SELECT node, max_event_time_ms - first_index AS v, row_number() OVER (PARTITION BY node ORDER BY max_event_time_ms - first_index) AS k, count(*) OVER (PARTITION BY node) AS n FROM client_acks WHERE max_event_time_ms - first_index IS NOT NULL) SELECT node, max(v) FILTER (k = n // 2 + 1 AND n >= 20) AS median FROM x GROUP BY node")
def undisturbed_medians(spark, folder):
    """The upper median of a measure of each node's lines, null for nodes with fewer than 20."""
    rows = table(spark, folder, "client_acks").select("node", (F.col("max_event_time_ms") - F.col("first_index")).alias("v")).where("v is not null")
    return rows.groupBy("node").agg(predicates.upper_median(F.col("v"), 20).alias("median"))


@R.add("audit_verdicts", "WITH n AS (SELECT node, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing, count(*) - count(DISTINCT seq) AS twice FROM client_acks GROUP BY node), c AS (SELECT CASE WHEN count(*) = 0 THEN 3 WHEN count(*) FILTER (missing > 0 OR twice > 0) > 0 THEN 2 ELSE 0 END AS gaps FROM n), p AS (SELECT CASE WHEN count(*) FILTER (partition IS NOT NULL) = 0 THEN 3 ELSE 0 END AS seen FROM client_acks) SELECT 'journal_gaps' AS audit, gaps AS code FROM c UNION ALL SELECT 'partitions_named', seen FROM p UNION ALL SELECT 'nothing_checked', 3 UNION ALL SELECT 'all', CASE WHEN gaps = 2 THEN 2 ELSE 3 END FROM c")
def audit_verdicts(spark, folder):
    """Codes of three audits, one of which checks nothing, and of all together."""
    acks = table(spark, folder, "client_acks")
    gaps = predicates.journal_gaps(acks)
    n, bad = gaps.agg(F.count(F.lit(1)), F.count_if(F.expr("missing > 0 or repeated > 0"))).first()
    named = acks.where("partition is not null").count()
    codes = {"journal_gaps": predicates.verdict(bad, n), "partitions_named": predicates.verdict(0, named), "nothing_checked": predicates.verdict(0, 0)}
    return spark.createDataFrame([*codes.items(), ("all", predicates.combined(list(codes.values())))], "audit string, code int")


@R.add("journal_gaps", "WITH p AS (SELECT node, seq, count(*) AS c FROM client_acks GROUP BY ALL) SELECT node, max(seq) - min(seq) + 1 - count(*) AS missing, count(*) FILTER (c > 1) AS repeated FROM p GROUP BY node")
def journal_gaps(spark, folder):
    """Missing and repeated numbers of each node's journal."""
    return predicates.journal_gaps(table(spark, folder, "client_acks"))


# upkeep

_NOW = 1_770_163_200_000


@R.add("staged_bytes", "SELECT partition, sum(strlen(partition) + strlen(origin) + 8 + coalesce(strlen(body), 0) + coalesce(strlen(severity_text), 0) + CASE WHEN observed_ts IS NULL THEN 0 ELSE 8 END)::BIGINT AS staged_bytes FROM otlp_logs GROUP BY partition")
def staged_bytes(spark, folder):
    """Content bytes staged per partition, over some of the columns."""
    return upkeep.staged_bytes(_logs(spark, folder, "partition", "origin", "seq", "body", "severity_text", "observed_ts"), ["partition"])


_WIDTHS = {"strlen({c})": "tenant partition origin severity_text body attrs resource_attrs scope_name scope_version trace_id span_id event_name", "8 + 0 * {c}": "window_id seq flags dropped_attributes_count", "4 + 0 * {c}": "severity_number", "CASE WHEN {c} IS NOT NULL THEN 8 END": "ts observed_ts"}


@R.add("staged_content", "SELECT partition, sum(" + " + ".join(f"coalesce({form.format(c=c)}, 0)" for form, names in _WIDTHS.items() for c in names.split()) + ")::BIGINT AS staged_bytes FROM otlp_logs GROUP BY partition")
def staged_content(spark, folder):
    """Content bytes staged per partition, over all columns."""
    return upkeep.staged_bytes(table(spark, folder, "otlp_logs"), ["partition"])


@R.add("retention_expired", "SELECT DISTINCT dataset, partition, window_id, part_kind FROM window_manifests WHERE NOT coalesce(expired, false) AND part_kind <> 'snapshot' AND event_time_max_ms + CASE WHEN starts_with(partition, '_') THEN 72 * 3600000 WHEN starts_with(partition, 'fjord') THEN 3600000 ELSE 30 * 86400000::BIGINT END < 1770163200000")
def retention_expired(spark, folder):
    """Windows past their retention, with an hour for some tenants."""
    return upkeep.expired_manifests(table(spark, folder, "window_manifests"), _NOW, {"fjord": 3_600_000})


@R.add(
    "snapshots_due",
    """WITH m AS (SELECT DISTINCT dataset, partition, window_id, part_kind, discriminator, rows FROM window_manifests WHERE NOT coalesce(expired, false)),
s AS (SELECT dataset, partition, window_id AS w, rows AS r FROM m WHERE part_kind = 'snapshot' QUALIFY row_number() OVER (PARTITION BY dataset, partition ORDER BY window_id DESC, discriminator DESC, rows DESC) = 1)
SELECT m.dataset, m.partition, coalesce(max(s.r), 0) AS snapshot_rows, sum(m.rows)::BIGINT AS later_rows FROM m LEFT JOIN s USING (dataset, partition) WHERE m.part_kind <> 'snapshot' AND (s.w IS NULL OR m.window_id > s.w) GROUP BY ALL HAVING later_rows > 0 AND later_rows >= snapshot_rows""",
)
def snapshots_due(spark, folder):
    """Partitions whose changes since the last snapshot outweigh it."""
    return upkeep.snapshots_due(table(spark, folder, "window_manifests"))


@R.add("contended_partitions", "SELECT partition, count(DISTINCT node) AS nodes FROM client_acks WHERE partition IS NOT NULL GROUP BY partition HAVING count(DISTINCT node) > 1")
def contended_partitions(spark, folder):
    """Partitions that several nodes' journals name."""
    return predicates.contended_partitions(table(spark, folder, "client_acks"))


# the flagship: from records to the served union


@R.add(
    "flagship_slice",
    """WITH e AS (SELECT event_type || '.0' AS partition, epoch_us(ts) // 1000 AS ms, (epoch_us(ts) // 86400000000) AS day FROM events),
n AS (SELECT partition, day, row_number() OVER (PARTITION BY partition ORDER BY day) - 1 AS w, count(*) OVER (PARTITION BY partition) AS k FROM (SELECT DISTINCT partition, day FROM e)),
m AS (SELECT e.partition, max(ms) AS b FROM e JOIN n USING (partition, day) WHERE w < k - 3 GROUP BY e.partition)
SELECT e.partition, count(*) AS n, count(*) FILTER (WHERE ms <= b) AS n_cold, count(*) FILTER (WHERE b IS NULL OR ms > b) AS n_hot, max(b) AS complete_through_ms FROM e LEFT JOIN m USING (partition) GROUP BY e.partition""",
)
def flagship_slice(spark, folder):
    """Events as a dataset: numbered, sealed by day except for the last three, watermarked, and served as committed and hot rows together."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    rows = events.select(naming.partition_id(F.col("event_type"), F.lit(0)).alias("partition"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("origin"), "event_id", "ts")
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy(*PO).orderBy("ts", "event_id")).cast("bigint")).withColumn("day", F.floor(engine.time_ms("ts") / 86_400_000))
    days = rows.select("partition", "day").distinct().withColumn("window_id", F.row_number().over(Window.partitionBy("partition").orderBy("day")).cast("bigint") - 1)
    days = days.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("partition")))
    staged = materialise(rows.join(days, ["partition", "day"]), "staged")
    manifests = window_manifests(staged.where("window_id < of - 3"), DatasetDecl("events"))
    marks = materialise(watermark.advance(materialise(manifests, "manifests")).select("partition", "complete_through_ms"), "marks")
    both = engine.tier_union(staged.where("window_id < of - 3").withColumn("tier", F.lit("cold")), staged.withColumn("tier", F.lit("hot")), marks.where("complete_through_ms is not null"), engine.time_ms("ts"))
    out = both.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "cold").alias("n_cold"), F.count_if(F.col("tier") == "hot").alias("n_hot"))
    return out.join(marks, "partition", "left")
