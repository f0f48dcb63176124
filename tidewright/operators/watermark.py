"""The completeness ledger, set-based: advance, reconstruction, loss and the errors of malformed manifests.

``complete_through_ms`` of a partition is the greatest event time over its committed windows up to the last one after which
no origin has a hole from number 1 on, declared losses excused. Windows count while they are dense from 0. As it is a running maximum
of event time, one row dated in the future moves it far ahead; that is the rule, and freshness() shows what it hides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ranges import covered_count, overlapping, subtract_ranges, union_ranges
from tidewright.session import materialise

PO = ["partition", "origin"]


def _ranges(manifests: DataFrame) -> DataFrame:
    return manifests.select("partition", "window_id", F.explode("origin_coverage").alias("r")).select("partition", "window_id", "r.origin", "r.first_seq", "r.last_seq")


def dense_windows(manifests: DataFrame) -> DataFrame:
    """Manifests of the dense prefix 0, 1, 2, ... of each partition's windows."""
    # ids are distinct per partition in a valid log; supplements share their window's id and follow it
    order = Window.partitionBy("partition").orderBy("window_id")
    ranked = manifests.withColumn("__tw_k", F.dense_rank().over(order) - 1)
    return ranked.where("window_id = __tw_k").drop("__tw_k")


def advance(manifests: DataFrame, losses: DataFrame | None = None) -> DataFrame:
    """partition, recorded_through, done_through, complete_through_ms; the last two are null while no window is clean.

    ``manifests`` has partition, window_id, origin_coverage, event_time_max_ms, with pairwise disjoint ranges per origin (check with
    ledger_errors()); ``losses`` has partition, origin, first_seq, last_seq. Windows of the prefix are counted, not walked:
    an origin is whole at a window if the lengths of its ranges so far outside the losses, plus the losses up to the greatest number,
    make up that number.
    """
    dense = dense_windows(manifests)
    lost = None if losses is None else materialise(union_ranges(losses.select(*PO, "first_seq", "last_seq"), PO), "losses")
    r = _ranges(dense).withColumn("len", F.col("last_seq") - F.col("first_seq") + 1)
    if lost is not None:
        # numbers of a range that are lost: those up to its end less those before its begin
        r = covered_count(covered_count(r, F.col("last_seq"), lost, PO, "upto"), F.col("first_seq") - 1, lost, PO, "before")
        r = r.withColumn("len", F.col("len") - F.col("upto") + F.col("before")).drop("upto", "before")
    at = r.groupBy(*PO, "window_id").agg(F.sum("len").alias("len"), F.max("last_seq").alias("top"))
    so_far = Window.partitionBy(*PO).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    at = at.select(*PO, "window_id", F.sum("len").over(so_far).alias("have"), F.max("top").over(so_far).alias("top"))
    at = at.withColumn("lost", F.lit(0)) if lost is None else covered_count(at, F.col("top"), lost, PO, "lost")
    dirty = at.withColumn("dirty", F.when(F.col("have") + F.col("lost") < F.col("top"), 1).otherwise(0))
    step = dirty.withColumn("step", F.col("dirty") - F.lag("dirty", 1, 0).over(Window.partitionBy(*PO).orderBy("window_id")))
    steps = step.groupBy("partition", "window_id").agg(F.sum("step").alias("step"))
    windows = dense.groupBy("partition", "window_id").agg(F.max("event_time_max_ms").alias("event_max"))
    by_window = Window.partitionBy("partition").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    walked = windows.join(steps, ["partition", "window_id"], "left").select("partition", "window_id", F.sum(F.coalesce("step", F.lit(0))).over(by_window).alias("holes"), F.max("event_max").over(by_window).alias("event_max"))
    clean = F.when(F.col("holes") == 0, F.col("window_id"))
    return walked.groupBy("partition").agg(F.max("window_id").alias("recorded_through"), F.max(clean).alias("done_through"), F.max(F.when(F.col("holes") == 0, F.col("event_max"))).alias("complete_through_ms"))


def blocking_holes(manifests: DataFrame, losses: DataFrame | None, staging: DataFrame) -> DataFrame:
    """Holes below the greatest committed number of each origin: partition, origin, first_seq, last_seq, in_hot.

    ``staging`` has the applied marks of live hot data; a hole is in hot if some mark reaches its end.
    """
    have = union_ranges(_ranges(dense_windows(manifests)), PO)
    tops = have.groupBy(*PO).agg(F.max("last_seq").alias("last_seq")).select(*PO, F.lit(1).cast("bigint").alias("first_seq"), "last_seq")
    excused = have if losses is None else have.unionByName(losses.select(*PO, "first_seq", "last_seq"))
    holes = subtract_ranges(tops, excused, PO)
    marks = staging.groupBy(*PO).agg(F.max("applied_seq").alias("mark"))
    return holes.join(marks, PO, "left").withColumn("in_hot", F.coalesce(F.col("mark") >= F.col("last_seq"), F.lit(False))).drop("mark")


def stalls(manifests: DataFrame, losses: DataFrame | None, staging: DataFrame) -> DataFrame:
    """Why a partition's watermark stands: partition, reason (missing_window | coverage_holes), expected_window, n_deferred, n_holes, n_in_hot."""
    state = advance(manifests, losses)
    waiting = manifests.groupBy("partition").agg(F.count_distinct("window_id").alias("n"))
    gap = waiting.join(state, "partition", "left").select("partition", (F.coalesce("recorded_through", F.lit(-1)) + 1).alias("expected_window"), (F.col("n") - F.coalesce("recorded_through", F.lit(-1)) - 1).alias("n_deferred"))
    none = F.lit(None).cast("bigint")
    missing = gap.where("n_deferred > 0").select("partition", F.lit("missing_window").alias("reason"), "expected_window", "n_deferred", none.alias("n_holes"), none.alias("n_in_hot"))
    holes = blocking_holes(manifests, losses, staging).groupBy("partition").agg(F.count(F.lit(1)).alias("n_holes"), F.count_if("in_hot").alias("n_in_hot"))
    behind = state.where("done_through is null or done_through < recorded_through").select("partition")
    held = behind.join(holes, "partition", "left").select("partition", F.lit("coverage_holes").alias("reason"), none.alias("expected_window"), none.alias("n_deferred"), F.coalesce("n_holes", F.lit(0)).alias("n_holes"), F.coalesce("n_in_hot", F.lit(0)).alias("n_in_hot"))
    return missing.unionAll(held)


def ledger_errors(manifests: DataFrame) -> DataFrame:
    """Manifests that no ledger takes: partition, window_id, error.

    duplicate_window (the same primary window twice), invalid_range, invalid_event_time, coverage_overlap (two manifests claim a number).
    """
    primary = manifests.where(F.coalesce("part_kind", F.lit("primary")) == "primary") if "part_kind" in manifests.columns else manifests
    twice = primary.groupBy("partition", "window_id").count().where("count > 1").select("partition", "window_id", F.lit("duplicate_window").alias("error"))
    r = _ranges(manifests)
    bad = r.where("first_seq is null or last_seq is null or origin is null or first_seq < 1 or last_seq < first_seq").select("partition", "window_id", F.lit("invalid_range").alias("error"))
    times = manifests.where("event_time_min_ms > event_time_max_ms").select("partition", "window_id", F.lit("invalid_event_time").alias("error"))
    ordered = r.where("first_seq >= 1 and last_seq >= first_seq").withColumn("before", F.max("last_seq").over(Window.partitionBy(*PO).orderBy("first_seq", "last_seq", "window_id").rowsBetween(Window.unboundedPreceding, -1)))
    meets = ordered.where("first_seq <= before").select("partition", "window_id", F.lit("coverage_overlap").alias("error"))
    return twice.unionAll(bad).unionAll(times).unionAll(meets).distinct()


def sequence_errors(manifests: DataFrame) -> DataFrame:
    """Manifests that the ledger can't take next: partition, window_id, error.

    dataset_mismatch (the partition's first window, the least by number and name, is of another dataset), window_not_next (a window whose
    predecessor, or for the first window number 0, is missing). Windows of partitions with a null name count for nothing.
    """
    rows = manifests.where("partition is not null and dataset is not null and window_id is not null").select("dataset", "partition", "window_id").distinct()
    first = rows.groupBy("partition").agg(F.min(F.struct("window_id", "dataset")).alias("first"))
    other = rows.join(first, "partition").where(F.col("dataset") != F.col("first.dataset")).select("partition", "window_id", F.lit("dataset_mismatch").alias("error"))
    before = F.coalesce(F.lag("window_id").over(Window.partitionBy("partition").orderBy("window_id")), F.lit(-1))
    jumps = rows.select("partition", "window_id").distinct().withColumn("before", before).where("window_id <> before + 1").select("partition", "window_id", F.lit("window_not_next").alias("error"))
    return other.unionAll(jumps).distinct()


def loss_refusals(requests: DataFrame, live: DataFrame, consent: bool) -> DataFrame:
    """Which loss declarations (partition, origin, first_seq, last_seq) are refused, and why; accepted ones have a null refusal.

    Without consent nothing is accepted. A range that some replica still covers from its first number on is recoverable.
    """
    best = live.groupBy(*PO).agg(F.max("replicated_thru").alias("thru"), F.max_by("node", "replicated_thru").alias("covering_node"))
    bad = (F.col("first_seq") < 1) | (F.col("last_seq") < F.col("first_seq"))
    why = F.when(F.lit(not consent), "consent_not_given").when(bad, "invalid_range").when(F.col("thru") >= F.col("first_seq"), "still_recoverable")
    return requests.join(best, PO, "left").select(*requests.columns, why.alias("refusal"), F.when(why == "still_recoverable", F.col("covering_node")).alias("covering_node"))


def recoverable(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """Declared ranges that meet known coverage."""
    return overlapping(requests, coverage, PO)
