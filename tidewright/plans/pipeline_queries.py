"""Queries of the general data-pipeline operators (p1 to p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.incremental import IncrementalTarget, committed_marks
from tidewright.operators.intervals import manifest_coverage
from tidewright.operators.lateness import classify, epoch_ms, ordered_aggregates, past_cut_off, period_aggregates
from tidewright.operators.patches import changelog_state
from tidewright.operators.redelivery import SeenStore, admit_in_batches, duplicates
from tidewright.operators.skew import fragment_join, heavy_keys, per_key
from tidewright.plans.registry import Registry, table
from tidewright.session import materialise, scratch_path

R = Registry()

#: A request's lines linked by either identifier; components by least line over repeated hops.
_P1_LINKS = """
WITH RECURSIVE l AS (
  SELECT line_id, tenant, lower(trim(request_id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS rid,
         CASE WHEN trim(source_incarnation, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AND first_index IS NOT NULL THEN source_incarnation END AS inc, first_index AS idx
  FROM client_acks WHERE tenant IS NOT NULL
), links AS (
  SELECT a.line_id AS x, b.line_id AS y FROM l a JOIN l b ON a.tenant = b.tenant AND a.rid = b.rid WHERE a.rid <> ''
  UNION SELECT a.line_id, b.line_id FROM l a JOIN l b ON a.tenant = b.tenant AND a.inc = b.inc AND a.idx = b.idx WHERE a.inc IS NOT NULL
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, k.y FROM reach r JOIN links k ON r.y = k.x
)
"""


#: Batches of the journal are admitted in so many groups, one after the other.
P1_GROUPS = 2


def _admitted(spark: SparkSession, folder: str) -> tuple[SeenStore, DataFrame]:
    store = SeenStore(spark, scratch_path(spark, "seen"))
    return store, admit_in_batches(store, table(spark, folder, "client_acks"), "batch_id", P1_GROUPS)


@R.add("p1_found", _P1_LINKS + "SELECT min(y) AS kept_line_id, x AS line_id FROM reach GROUP BY x HAVING min(y) <> x")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated lines of requests beside the line that is kept."""
    return duplicates(_admitted(spark, folder)[1])


@R.add(
    "p1_seen_bits",
    """
SELECT 'request' AS kind, count(DISTINCT (tenant, lower(trim(request_id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) AS n_bits FROM client_acks
WHERE tenant IS NOT NULL AND trim(request_id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
UNION ALL SELECT 'record', count(DISTINCT (tenant, source_incarnation, first_index)) FROM client_acks
WHERE tenant IS NOT NULL AND first_index IS NOT NULL AND trim(source_incarnation, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
UNION ALL SELECT 'all', (SELECT count(DISTINCT (tenant, lower(trim(request_id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) FROM client_acks
WHERE tenant IS NOT NULL AND trim(request_id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
+ (SELECT count(DISTINCT (tenant, source_incarnation, first_index)) FROM client_acks
WHERE tenant IS NOT NULL AND first_index IS NOT NULL AND trim(source_incarnation, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
""",
)
def p1_seen_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Bits set in the bitmaps after the whole table was admitted ('all'), and the dictionary's identifiers by kind."""
    store, _ = _admitted(spark, folder)
    kinds = store.dictionary().groupBy(F.when(F.col("rid").isNotNull(), "request").otherwise("record").alias("kind")).agg(F.count(F.lit(1)).alias("n_bits"))
    return kinds.unionAll(store.bitmaps().agg(F.lit("all").alias("kind"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_bits")))


_P2 = """
SELECT dataset, tenant, changelog_key, origin, changelog_seq{more} FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, tenant, changelog_key ORDER BY origin DESC NULLS LAST, changelog_seq DESC NULLS LAST) AS rn
  FROM changelog WHERE event = 'ClientAck') WHERE rn = 1 AND NOT coalesce(tombstone, false)
"""


@R.add("p2_found", _P2.format(more=""))
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The deciding change of every live key."""
    return changelog_state(table(spark, folder, "changelog")).drop("value")


@R.add("p2_state", _P2.format(more=", value"))
def p2_state(spark: SparkSession, folder: str) -> DataFrame:
    """The current value of every live key."""
    return changelog_state(table(spark, folder, "changelog"))


_P3_FATE = """
WITH r AS (SELECT DISTINCT partition, origin, seq, ts, observed_ts, (epoch_us(ts) // 1000) AS ts_ms, (epoch_us(observed_ts) // 1000) AS observed_ms FROM otlp_logs),
c AS (SELECT partition, complete_through_ms AS thru, min(at_ms) AS at FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY ALL),
f AS (SELECT r.partition, r.origin, r.seq, r.ts_ms, r.observed_ms, min(c.at) AS release_ms FROM r LEFT JOIN c ON c.partition = r.partition AND c.thru >= r.ts_ms GROUP BY ALL)
"""


@R.add(
    "p3_found",
    _P3_FATE
    + """
SELECT 'otlp_logs' AS src, partition, origin AS writer, seq FROM f WHERE release_ms <= observed_ms
UNION SELECT 'client_acks', partition, node, seq FROM client_acks WHERE partition IS NOT NULL AND max_event_time_ms <= complete_through_ms
""",
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and requests past the committed cut-off."""
    return past_cut_off(table(spark, folder, "otlp_logs"), table(spark, folder, "watermark_log"), table(spark, folder, "client_acks"))


@R.add(
    "p3_hourly",
    _P3_FATE
    + """
, g AS (SELECT *, ts_ms // 3600000 AS h, coalesce(release_ms <= observed_ms, false) AS rejected FROM f)
SELECT partition, h * 3600000 AS period_start_ms,
  count(*) FILTER (NOT rejected AND coalesce(observed_ms, ts_ms) < (h + 1) * 3600000) AS n_on_time,
  count(*) FILTER (NOT rejected AND coalesce(observed_ms, ts_ms) >= (h + 1) * 3600000) AS n_late,
  count(*) FILTER (NOT rejected) AS n,
  count(*) FILTER (NOT rejected AND release_ms IS NOT NULL) AS n_final,
  count(*) FILTER (rejected) AS n_rejected,
  arg_min(origin || '/' || seq, (ts_ms, origin, seq)) FILTER (NOT rejected) AS first_event,
  arg_max(origin || '/' || seq, (ts_ms, origin, seq)) FILTER (NOT rejected) AS last_event,
  CASE WHEN count(*) FILTER (NOT rejected) = count(*) FILTER (NOT rejected AND release_ms IS NOT NULL) THEN 'final' ELSE 'provisional' END AS state
FROM g GROUP BY partition, h
""",
)
def p3_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per partition and hour of event time: on time, late, corrected, final, rejected."""
    logs = table(spark, folder, "otlp_logs").select("partition", "origin", "seq", "ts", "observed_ts")
    fates = classify(logs, table(spark, folder, "watermark_log"), F.col("ts"), F.col("observed_ts"))
    return period_aggregates(fates, ["partition", "origin", "seq"])


@R.add(
    "p3_ordered",
    _P3_FATE.replace("observed_ts, (epoch_us(ts)", "observed_ts, severity_number, (epoch_us(ts)").replace("r.ts_ms, r.observed_ms,", "r.ts_ms, r.observed_ms, r.severity_number AS s,")
    + """
, g AS (SELECT *, ts_ms // 3600000 AS h FROM f WHERE NOT coalesce(release_ms <= observed_ms, false)),
o AS (SELECT partition, h, ts_ms, release_ms IS NOT NULL AS released, ts_ms - lag(ts_ms) OVER w AS gap, s IS DISTINCT FROM lag(s) OVER w AS turn FROM g WINDOW w AS (PARTITION BY partition, h ORDER BY ts_ms, origin, seq))
SELECT partition, h * 3600000 AS period_start_ms, count(*) AS n, count(*) FILTER (released) AS n_final, count(*) FILTER (turn AND gap IS NOT NULL) AS changes,
  count(*) FILTER (turn AND gap IS NOT NULL AND released) AS changes_final, max(gap) AS longest_gap_ms, max(gap) FILTER (released) AS longest_gap_final_ms
FROM o GROUP BY partition, h
""",
)
def p3_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of severity and longest silence per partition and hour, in the order of release: final, and provisional with what is buffered."""
    logs = table(spark, folder, "otlp_logs").select("partition", "origin", "seq", "ts", "observed_ts", "severity_number")
    fates = classify(logs, table(spark, folder, "watermark_log"), F.col("ts"), F.col("observed_ts"))
    return ordered_aggregates(fates, ["partition", "origin", "seq"], "severity_number")


_P4 = """
WITH r AS (
  SELECT dataset, partition, u.origin AS origin, u.first_seq AS f, u.last_seq AS l FROM (SELECT dataset, partition, unnest(origin_coverage) AS u FROM window_manifests)
  WHERE dataset IS NOT NULL AND partition IS NOT NULL AND u.origin IS NOT NULL AND u.first_seq >= 1 AND u.last_seq >= u.first_seq
), m AS (SELECT *, max(l) OVER (PARTITION BY dataset, partition, origin ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r
), i AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, partition, origin ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS isl FROM m
), runs AS (SELECT dataset, partition, origin, isl, min(f) AS first_seq, max(l) AS last_seq FROM i GROUP BY ALL
), gaps AS (SELECT dataset, partition, origin, coalesce(lag(last_seq) OVER (PARTITION BY dataset, partition, origin ORDER BY first_seq), 0) + 1 AS first_seq, first_seq - 1 AS last_seq FROM runs)
SELECT 'run' AS kind, dataset, partition, origin, first_seq, last_seq FROM runs
UNION ALL SELECT 'gap', dataset, partition, origin, first_seq, last_seq FROM gaps WHERE first_seq <= last_seq
"""


@R.add("p4_found", _P4)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Covered runs and gaps of each origin's sequence numbers."""
    return manifest_coverage(table(spark, folder, "window_manifests"))


_P5 = """
SELECT DISTINCT s.partition, s.origin, s.seq FROM otlp_logs s LEFT JOIN (SELECT partition, origin, max(applied_seq) AS applied FROM applied_log WHERE status = 'committed' AND applied_seq IS NOT NULL GROUP BY ALL) m
ON m.partition IS NOT DISTINCT FROM s.partition AND m.origin IS NOT DISTINCT FROM s.origin WHERE m.applied IS NULL OR s.seq > m.applied
"""


def _target(spark: SparkSession, folder: str) -> tuple[IncrementalTarget, DataFrame]:
    """A target that holds what the committed runs applied, and the source."""
    source = table(spark, folder, "otlp_logs").select("partition", "origin", "seq")
    target = IncrementalTarget(spark, scratch_path(spark, "target"), ["partition", "origin"], "seq", source.schema, every=True)
    target.adopt(committed_marks(table(spark, folder, "applied_log")).withColumnRenamed("applied_seq", "seq"))
    return target, source


@R.add("p5_found", _P5)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that the next run takes, as it published them."""
    target, source = _target(spark, folder)
    return target.published(target.run(source))


def _lost(_: DataFrame) -> DataFrame:
    raise RuntimeError("this run is lost before it publishes")


@R.add("p5_runs", f"WITH p AS ({_P5}) SELECT 1 AS run, 'failed' AS status, 0::BIGINT AS n_rows UNION ALL SELECT 2, 'committed', count(*) FROM p UNION ALL SELECT 3, 'committed', 0")
def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that three runs in a row add to the target: one that fails before it publishes, one that takes its place, one without anything new."""
    target, source = _target(spark, folder)
    rows = []
    for run, transform in enumerate([_lost, lambda df: df, lambda df: df], 1):
        before = target.head()["version"]
        try:
            target.run(source, transform)
        except RuntimeError:
            pass
        head = target.head()
        added = target.published(head) if head["version"] > before else source.limit(0)
        rows.append(added.agg(F.lit(run).alias("run"), F.lit("committed" if head["version"] > before else "failed").alias("status"), F.count(F.lit(1)).alias("n_rows")))
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


P6_TABLES, P6_FIELDS, P6_SHARE = ("otlp_logs", "client_acks", "changelog"), ("tenant", "partition"), 0.05

_P6 = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{f}' AS field, {f} AS key_value FROM {t} WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) * 20 > (SELECT count(*) FROM {t})" for t in P6_TABLES for f in P6_FIELDS)


@R.add("p6_found", _P6)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that own more than a twentieth of a table."""
    found = heavy_keys({t: table(spark, folder, t) for t in P6_TABLES}, P6_FIELDS, P6_SHARE)
    return found.select("table_name", "field", "key_value")


@R.add(
    "p6_per_partition",
    """
SELECT partition, count(*) AS n_rows, count(body) AS n_bodies, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms, sum(severity_number)::BIGINT AS severity_sum
FROM otlp_logs GROUP BY partition
""",
)
def p6_per_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Several aggregates of every partition, hot or not."""
    logs = table(spark, folder, "otlp_logs").select("partition", "seq", "body", epoch_ms(F.col("ts")).alias("ms"), "severity_number")
    aggs = {"n_rows": ("rows", None), "n_bodies": ("count", "body"), "first_ms": ("min", "ms"), "last_ms": ("max", "ms"), "severity_sum": ("sum", "severity_number")}
    return per_key(logs, ["partition"], aggs)


@R.add(
    "p6_enriched",
    """
WITH w AS (SELECT partition AS p, max(complete_through_ms) AS bound FROM watermark_log WHERE event = 'LakeCommitOk' GROUP BY partition)
SELECT partition, severity_number, count(*) AS n_rows, count(DISTINCT body) AS n_bodies, count(*) FILTER (WHERE epoch_us(ts) // 1000 <= bound) AS n_complete
FROM otlp_logs LEFT JOIN w ON p = partition GROUP BY ALL
""",
)
def p6_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each partition and severity beside their partition's watermark: rows and distinct bodies, and rows that the watermark covers.

    Rows go to the tasks of a plan from estimated loads; a hot partition's are split by body, its watermark is copied to those shards only.
    """
    logs = table(spark, folder, "otlp_logs").select("partition", "severity_number", "body", epoch_ms(F.col("ts")).alias("ms"))
    log = table(spark, folder, "watermark_log").where("event = 'LakeCommitOk'")
    marks = materialise(log.groupBy("partition").agg(F.max("complete_through_ms").alias("bound")), "marks")
    placed = fragment_join(logs, marks, ["partition"], ["body"])
    per_body = placed.groupBy("partition", "severity_number", "body").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ms") <= F.col("bound")).alias("c"))
    return per_body.groupBy("partition", "severity_number").agg(F.sum("n").alias("n_rows"), F.count("body").alias("n_bodies"), F.sum("c").alias("n_complete"))
