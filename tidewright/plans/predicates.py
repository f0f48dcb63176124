"""Audits over journals: each is a relation of findings beside a count of what was checked; nothing checked is no verdict, never a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.changelog import latest_view
from tidewright.operators.dedup import conflicts, keep_latest
from tidewright.operators.ranges import contained, subtract_ranges, union_ranges

PASS, VIOLATION, NO_VERDICT = 0, 2, 3
#: Tenants of the system itself begin with this.
SYSTEM_PREFIX = "_"


def verdict(findings: int, checked: int) -> int:
    """The exit code of one audit."""
    return VIOLATION if findings else PASS if checked else NO_VERDICT


def combined(codes: list[int]) -> int:
    """Any violation decides; all passes pass; anything else, and nothing at all, is no verdict."""
    if VIOLATION in codes:
        return VIOLATION
    return PASS if codes and all(c == PASS for c in codes) else NO_VERDICT


def _acked(journal: DataFrame) -> DataFrame:
    ok = (F.col("event") == "ClientAck") & F.col("tenant").isNotNull() & ~F.col("tenant").startswith(SYSTEM_PREFIX)
    return journal.where(ok & F.col("source_incarnation").isNotNull() & F.col("first_index").isNotNull() & (F.col("record_count") > 0))


def zero_acked_lost(journal: DataFrame, present: DataFrame) -> DataFrame:
    """Acknowledged records that the final state lacks, as ranges: tenant, source_incarnation, first_index, last_index.

    ``present`` has tenant, source_incarnation, first_index, count. Ranges are subtracted as ranges; no record is expanded into a row.
    """
    keys = ["tenant", "source_incarnation"]
    first, last = (F.col("first_index") + 1).alias("first_seq"), lambda n: (F.col("first_index") + F.col(n)).alias("last_seq")
    owed, have = _acked(journal).select(*keys, first, last("record_count")), present.select(*keys, first, last("count"))
    lost = subtract_ranges(owed, have, keys)
    return lost.select(*keys, (F.col("first_seq") - 1).alias("first_index"), (F.col("last_seq") - 1).alias("last_index"))


COMMITS = ("LakeCommitOk",)


def unbacked_advertisements(claims: DataFrame) -> DataFrame:
    """Advertised completeness beyond what was committed: node, seq, partition, advertised_ms, bound_ms.

    ``claims`` has node, seq, event, partition, complete_through_ms. A claim is backed by everything any other node committed for the
    partition, and by what its own node committed on earlier lines; without any, by nothing (bound null).
    """
    is_commit = F.col("event").isin(*COMMITS)
    value = F.when(is_commit, F.col("complete_through_ms"))
    own = F.max(value).over(Window.partitionBy("partition", "node").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    rows = claims.where("partition is not null and complete_through_ms is not null").withColumn("own", own)
    # the two greatest nodes of a partition tell the greatest other node's value for every node
    tops = rows.where(is_commit).groupBy("partition", "node").agg(F.max("complete_through_ms").alias("top"))
    best = tops.groupBy("partition").agg(F.max(F.struct("top", "node")).alias("one"))
    second = tops.join(best, "partition").where(F.col("node") != F.col("one.node")).groupBy("partition").agg(F.max("top").alias("two"))
    bounds = best.join(second, "partition", "left")
    ads = rows.where(F.col("event") == "ClaimAdvertise").join(bounds, "partition", "left")
    others = F.when(F.col("one.node") == F.col("node"), F.col("two")).otherwise(F.col("one.top"))
    out = ads.withColumn("bound_ms", F.greatest(others, F.col("own")))
    bad = F.col("bound_ms").isNull() | (F.col("complete_through_ms") > F.col("bound_ms"))
    return out.where(bad).select("node", "seq", "partition", F.col("complete_through_ms").alias("advertised_ms"), "bound_ms")


def _complete_reads(reads: DataFrame) -> DataFrame:
    return reads.where((F.col("concern") == "complete") & (F.col("outcome") == "served"))


def unproven_reads(claims: DataFrame, reads: DataFrame) -> DataFrame:
    """Complete answers served beyond anything committed for their partition in the whole run."""
    bound = claims.where(F.col("event").isin(*COMMITS)).groupBy("partition").agg(F.max("complete_through_ms").alias("bound_ms"))
    out = _complete_reads(reads).join(bound, "partition", "left")
    return out.where(F.col("bound_ms").isNull() | (F.col("complete_through_ms") > F.col("bound_ms"))).select("partition", F.col("complete_through_ms").alias("served_ms"), "bound_ms")


def missing_under_watermark(journal: DataFrame, reads: DataFrame) -> DataFrame:
    """Acknowledged records owed to a complete answer but not in it: partition, served_ms, request_id, tenant, missing.

    Owed are batches of the read's partition and tenant whose greatest event time is at or below the served bound. Partitions with a
    declared loss are excused, all of them if a declaration names none.
    """
    losses = journal.where(F.col("event") == "DeclareLoss").select("partition").distinct()
    all_excused = losses.where("partition is null").limit(1).count() > 0
    r = _complete_reads(reads).join(losses, "partition", "left_anti").where(F.lit(not all_excused))
    r = r.select("partition", "tenant", F.col("complete_through_ms").alias("served_ms"), F.coalesce("record_keys", F.array()).alias("keys"))
    owed = _acked(journal).where("max_event_time_ms is not null").select("partition", "tenant", "request_id", "source_incarnation", "first_index", "record_count", "max_event_time_ms")
    both = r.join(owed, ["partition", "tenant"]).where("max_event_time_ms <= served_ms")
    keys = F.transform(F.sequence(F.col("first_index"), F.col("first_index") + F.col("record_count") - 1), lambda i: F.concat_ws("-", F.col("source_incarnation"), i.cast("string")))
    return both.withColumn("missing", F.array_except(keys, "keys")).where("size(missing) > 0").select("partition", "served_ms", "request_id", "tenant", "missing")


def latest_view_findings(changelog: DataFrame, served: DataFrame) -> DataFrame:
    """Keys whose served value is not the folded one: dataset, tenant, changelog_key, expected, served.

    Only acknowledged changes count (timed-out ones may or may not have landed). ``served`` has dataset, tenant, changelog_key, value. Absent keys show as null with the
    flags has_expected and has_served. Slots whose copies disagree make a run unjudgeable: see unjudgeable_slots().
    """
    key = ["dataset", "tenant", "changelog_key"]
    rows = changelog.where("event = 'ClientAck' and changelog_seq is not null").withColumn("_op", F.when(F.coalesce("tombstone", F.lit(False)), "delete").otherwise("upsert"))
    fold = latest_view(rows.withColumn("seq", F.col("changelog_seq")), key, ("origin", "seq")).select(*key, F.col("value").alias("expected"), F.lit(True).alias("has_expected"))
    view = served.select(*key, F.col("value").alias("served"), F.lit(True).alias("has_served"))
    both = fold.join(view, key, "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_expected", "has_served")})
    return both.where((F.col("has_expected") != F.col("has_served")) | ~F.col("expected").eqNullSafe(F.col("served")))


def unjudgeable_slots(changelog: DataFrame) -> DataFrame:
    """Slots (dataset, partition, origin, changelog_seq) that were acknowledged with different contents."""
    acked = changelog.where("event = 'ClientAck' and changelog_seq is not null")
    return conflicts(acked.withColumn("tombstone", F.coalesce("tombstone", F.lit(False))), ["dataset", "partition", "origin", "changelog_seq"], ["tenant", "changelog_key", "tombstone", "value"])


def uncovered_expiries(manifests: DataFrame) -> DataFrame:
    """Expired parts that no single live snapshot of their partition covers: dataset, partition, window_id, part_kind.

    Every range of the expired part must lie within a range of one and the same snapshot.
    """
    key = ["dataset", "partition"]
    ranges = manifests.select(*key, "window_id", "part_kind", "discriminator", F.coalesce("expired", F.lit(False)).alias("expired"), F.explode("origin_coverage").alias("r")).select("*", "r.origin", "r.first_seq", "r.last_seq").drop("r").distinct()
    gone = ranges.where("expired and part_kind <> 'snapshot'").drop("expired")
    snaps = ranges.where("not expired and part_kind = 'snapshot'").select(*key, F.col("window_id").alias("snap"), F.col("discriminator").alias("snap_d"), F.col("origin").alias("so"), F.col("first_seq").alias("sf"), F.col("last_seq").alias("sl"))
    part = [*key, "window_id", "part_kind", "discriminator"]
    tried = gone.join(snaps.select(*key, "snap", "snap_d").distinct(), key, "left")
    held = snaps.withColumnsRenamed({"snap": "hs", "snap_d": "hd", "dataset": "hds", "partition": "hp"})
    same = (F.col("dataset") == F.col("hds")) & (F.col("partition") == F.col("hp")) & (F.col("snap") == F.col("hs")) & F.col("snap_d").eqNullSafe(F.col("hd")) & (F.col("origin") == F.col("so")) & (F.col("first_seq") >= F.col("sf")) & (F.col("last_seq") <= F.col("sl"))
    hit = tried.join(held, same, "left").groupBy(*part, "snap", "snap_d", "origin", "first_seq", "last_seq").agg((F.count("hs") > 0).alias("ok"))
    by_snap = hit.groupBy(*part, "snap", "snap_d").agg(F.bool_and("ok").alias("ok"))
    return by_snap.groupBy(*part).agg(F.bool_or("ok").alias("ok")).where(~F.col("ok")).drop("ok")


def unreachable_values(changelog: DataFrame, live: DataFrame) -> DataFrame:
    """Latest changes whose own number no live range holds: dataset, tenant, changelog_key, partition, origin, changelog_seq.

    ``live`` has dataset, partition, origin, first_seq, last_seq of live parts and snapshots.
    """
    key = ["dataset", "tenant", "changelog_key"]
    rows = changelog.where("event = 'ClientAck' and changelog_seq is not null").withColumn("seq", F.col("changelog_seq"))
    newest = keep_latest(rows, key, ("origin", "seq")).where(~F.coalesce("tombstone", F.lit(False)))
    points = newest.select(*key, "partition", "origin", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"))
    at = ["dataset", "partition", "origin"]
    reached = contained(points, union_ranges(live, at), at).select(*key)
    return points.join(reached, key, "left_anti").select(*key, "partition", "origin", F.col("first_seq").alias("changelog_seq"))


def differing_answers(reads: DataFrame) -> DataFrame:
    """Answers to one question (tenant, partition, query, bound) that differ from the one given after the fewest cache operations."""
    q = ["tenant", "partition", "query", "complete_through_ms"]
    rows = reads.where("outcome = 'served' and query is not null").withColumn("keys", F.array_sort(F.array_distinct(F.coalesce("record_keys", F.array()))))
    # one row per distinct answer: copies of an answer are combined first
    each = rows.groupBy(*q, "keys").agg(F.min("residency_ops_before").alias("ops"))
    base = each.groupBy(*q).agg(F.min_by("keys", F.struct("ops", "keys")).alias("base"))
    out = each.join(base, q).where(F.col("keys") != F.col("base"))
    return out.select(*q, F.array_except("base", "keys").alias("missing"), F.array_except("keys", "base").alias("extra"))


def upper_median(value: Column, least: int) -> Column:
    """The upper median of a group, null below ``least`` values: the element at half the size of the sorted values.

    percentile() would interpolate between the two middle values of an even-sized group. A group is one node's latencies of a run.
    """
    ordered = F.sort_array(F.collect_list(value))
    return F.when(F.count(value) >= least, F.element_at(ordered, (F.floor(F.count(value) / 2) + 1).cast("int")))


def outcome_tallies(journal: DataFrame) -> DataFrame:
    """Per node: sent, acked, timed_out, rejected and whether they reconcile (a sent request has exactly one outcome)."""
    one = journal.where("request_id is not null").groupBy("node", "request_id").agg(
        F.bool_or(F.col("event") == "ClientAck").alias("acked"), F.bool_or(F.col("event") == "ClientTimeout").alias("timed_out"), F.bool_or(F.col("event") == "Throttle").alias("rejected")
    )
    out = one.groupBy("node").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if("acked").alias("acked"),
        F.count_if(F.col("timed_out") & ~F.col("acked")).alias("timed_out"),
        F.count_if(F.col("rejected") & ~F.col("acked") & ~F.col("timed_out")).alias("rejected"),
        F.count_if(F.col("acked") & (F.col("timed_out") | F.col("rejected"))).alias("ambiguous"),
    )
    return out.withColumn("reconciles", F.col("sent") == F.col("acked") + F.col("timed_out") + F.col("rejected"))


def journal_gaps(journal: DataFrame) -> DataFrame:
    """Nodes whose journal numbers aren't dense: node, missing, repeated."""
    per = journal.groupBy("node", "seq").count()
    return per.groupBy("node").agg((F.max("seq") - F.min("seq") + 1 - F.count("seq")).alias("missing"), F.count_if(F.col("count") > 1).alias("repeated"))


def blocked_reads(reads: DataFrame, factor: float = 3.0, least: int = 20) -> DataFrame:
    """Reads during cache operations that took more than ``factor`` times the upper median of undisturbed ones of their node.

    A read is undisturbed if no residency operation ran during it. Nodes with fewer than ``least`` undisturbed reads can't be judged and have no row.
    """
    moved = F.col("residency_ops_after") > F.col("residency_ops_before")
    served = reads.where("outcome = 'served' and latency_ms is not null")
    base = served.where(~moved).groupBy("serving_node").agg(upper_median(F.col("latency_ms"), least).alias("median_ms"))
    out = served.where(moved).join(base.where("median_ms is not null"), "serving_node")
    return out.where(F.col("latency_ms") > F.col("median_ms") * factor).select("serving_node", "partition", "latency_ms", "median_ms")


def vacuity(journal: DataFrame, faults: DataFrame, kinds: list[str], ambiguous_ceiling: float = 0.05) -> DataFrame:
    """What a run must have gone through to prove anything: check, ok.

    fault_schedule (every expected kind of fault started), contention (some partition is in two nodes' journals), continuity (journals are
    dense), outcomes (requests reconcile, and few enough are ambiguous). ``faults`` is fault_windows().
    """
    started = faults.where("started_ms is not null").select("kind").distinct()
    schedule = started.agg((F.count_if(F.col("kind").isin(kinds)) == len(set(kinds))).alias("ok"))
    contention = contended_partitions(journal).agg((F.count(F.lit(1)) > 0).alias("ok"))
    dense = journal_gaps(journal).agg(F.coalesce(F.bool_and((F.col("missing") == 0) & (F.col("repeated") == 0)), F.lit(False)).alias("ok"))
    t = outcome_tallies(journal).agg(F.bool_and("reconciles").alias("r"), F.sum("ambiguous").alias("a"), F.sum("sent").alias("s"))
    outcomes = t.select(F.coalesce(F.col("r") & (F.col("a") <= F.col("s") * ambiguous_ceiling), F.lit(False)).alias("ok"))
    out = None
    for name, df in (("fault_schedule", schedule), ("contention", contention), ("continuity", dense), ("outcomes", outcomes)):
        row = df.select(F.lit(name).alias("check"), "ok")
        out = row if out is None else out.unionAll(row)
    return out


def contended_partitions(journal: DataFrame) -> DataFrame:
    """Partitions that several nodes' journals name: partition, nodes."""
    return journal.where("partition is not null").groupBy("partition").agg(F.count_distinct("node").alias("nodes")).where("nodes > 1")
