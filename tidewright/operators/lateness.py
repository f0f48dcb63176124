"""Event-time aggregates over late and out-of-order records, with a committed cut-off (K-slack reordering).

A partition's slack is not a constant but its committed completeness. When a record arrives, the greatest ``complete_through_ms`` committed
by then is the operator's watermark. A record at or below it is past the cut-off: it is reported and counts nowhere. Any other is
buffered until a commit reaches its event time. Each commit releases what it reaches, in order of event time; as no record below the
watermark is let in, the released records of a partition are in order as a whole, and the final aggregate may depend on it
(ordered_aggregates()). Until then the aggregate over released and buffered records is published as provisional.

Watermarks at arrival and instants of release are staircases per partition, over arrival and over event time, stored as one row
per partition and period, so a record finds its step with an equi-join, and a hot partition is spread over its periods. The order is made
within slices of a second and carried from slice to slice, so no task sorts a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.skew import lookup_join
from tidewright.session import materialise

HOUR_MS = 3_600_000
#: Released records are sorted within slices of so many ms.
SLICE_MS = 1000

FINAL, PROVISIONAL, REJECTED = "final", "provisional", "rejected"


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 UTC of a timestamp with or without zone, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def _committed(watermarks: DataFrame) -> DataFrame:
    return watermarks.where((F.col("event") == "LakeCommitOk") & F.col("partition").isNotNull() & F.col("complete_through_ms").isNotNull() & F.col("at_ms").isNotNull())


def arrival_steps(watermarks: DataFrame, wanted: DataFrame, period_ms: int = HOUR_MS) -> DataFrame:
    """The staircase of watermarks over arrival, one row per ``wanted`` (partition, period): partition, period, steps, before_ms.

    ``steps`` holds the period's commits (at, through); ``before_ms`` is the greatest value committed in earlier periods. What counts is as in release_steps().
    """
    by_at = _committed(watermarks).groupBy("partition", F.col("at_ms").alias("at")).agg(F.max("complete_through_ms").alias("through"))
    cells = by_at.groupBy("partition", F.floor(F.col("at") / period_ms).alias("period")).agg(F.sort_array(F.collect_list(F.struct("at", "through"))).alias("steps"), F.max("through").alias("top"))
    every = cells.join(wanted.select("partition", "period", F.lit(True).alias("is_wanted")), ["partition", "period"], "full")
    earlier = Window.partitionBy("partition").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("before_ms", F.max("top").over(earlier)).where("is_wanted").select("partition", "period", "steps", "before_ms")


def at_arrival(rows: DataFrame, watermarks: DataFrame, observed_ms: str = "observed_ms", out: str = "watermark_ms", period_ms: int = HOUR_MS) -> DataFrame:
    """``rows`` with ``out``, the watermark of their partition when they arrive (null: none yet, or no arrival time)."""
    rows = rows.withColumn("__tw_arrived", F.floor(F.col(observed_ms) / period_ms))
    wanted = rows.where("__tw_arrived is not null").select("partition", F.col("__tw_arrived").alias("period")).distinct()
    cells = materialise(arrival_steps(watermarks, wanted, period_ms), "arrivals").withColumnsRenamed({"period": "__tw_arrived", "steps": "__tw_steps", "before_ms": "__tw_before"})
    joined = lookup_join(rows, cells, ["partition", "__tw_arrived"], [observed_ms], "left")
    passed = F.filter("__tw_steps", lambda s: s["at"] <= F.col(observed_ms))
    now = F.greatest(F.col("__tw_before"), F.array_max(F.transform(passed, lambda s: s["through"])))
    return joined.withColumn(out, now).drop("__tw_steps", "__tw_before", "__tw_arrived")


def is_late(ts_ms: Column, watermark_ms: Column) -> Column:
    """The operator's admission: whether a record's event time is at or below the watermark that it meets."""
    return F.coalesce(ts_ms <= watermark_ms, F.lit(False))


def release_steps(watermarks: DataFrame, wanted: DataFrame, period_ms: int = HOUR_MS) -> DataFrame:
    """The staircase of release instants, one row per ``wanted`` (partition, period): partition, period, steps, after_ms.

    ``steps`` holds the period's (through, at); ``after_ms`` is the release instant of event times beyond its last step. Only
    LakeCommitOk lines count; a line with a null field counts for nothing; repeated and receding lines change nothing. The window
    runs over one row per partition and period, not over records, and periods that no record is in cost nothing.
    """
    by_value = _committed(watermarks).groupBy("partition", F.col("complete_through_ms").alias("through")).agg(F.min("at_ms").alias("at"))
    cells = by_value.groupBy("partition", F.floor(F.col("through") / period_ms).alias("period")).agg(F.sort_array(F.collect_list(F.struct("through", "at"))).alias("steps"), F.min("at").alias("low"))
    every = cells.join(wanted.select("partition", "period", F.lit(True).alias("is_wanted")), ["partition", "period"], "full")
    following = Window.partitionBy("partition").orderBy("period").rowsBetween(1, Window.unboundedFollowing)
    return every.withColumn("after_ms", F.min("low").over(following)).where("is_wanted").select("partition", "period", "steps", "after_ms")


def classify(records: DataFrame, watermarks: DataFrame, ts: Column, observed: Column, period_ms: int = HOUR_MS) -> DataFrame:
    """``records`` with ``ts_ms``, ``observed_ms``, ``period``, ``release_ms`` and ``fate`` (final, provisional, rejected).

    A null observed time means on time: it is never past the cut-off. A null event time belongs to no period and is
    provisional for good. A null partition has no watermark. Extra columns pass through, except for those named like a result,
    which are replaced.
    """
    rows = at_arrival(records.withColumns({"ts_ms": epoch_ms(ts), "observed_ms": epoch_ms(observed)}), watermarks, out="__tw_now", period_ms=period_ms)
    rows = rows.withColumn("period", F.floor(F.col("ts_ms") / period_ms))
    wanted = rows.where("period is not null").select("partition", "period").distinct()
    cells = materialise(release_steps(watermarks, wanted, period_ms), "steps").withColumnsRenamed({"steps": "__tw_steps", "after_ms": "__tw_after"})
    joined = lookup_join(rows, cells, ["partition", "period"], ["ts_ms", "observed_ms"], "left")
    reached = F.filter("__tw_steps", lambda s: s["through"] >= F.col("ts_ms"))
    release = F.least(F.array_min(F.transform(reached, lambda s: s["at"])), F.col("__tw_after"))
    out = joined.withColumn("release_ms", release).drop("__tw_steps", "__tw_after")
    fate = F.when(is_late(F.col("ts_ms"), F.col("__tw_now")), REJECTED).when(F.col("release_ms").isNotNull(), FINAL).otherwise(PROVISIONAL)
    return out.withColumn("fate", fate).drop("__tw_now")


def period_aggregates(classified: DataFrame, identity: list[str], period_ms: int = HOUR_MS) -> DataFrame:
    """Per partition and period: counts as first published, as corrected by late records, and final, with the period's edges.

    ``identity`` names a record; repeated copies count once (all copies share fate and times). Result: partition, period_start_ms, n_on_time
    (arrived before the period ended), n_late (admitted after that), n (their sum), n_final, n_rejected, first_event, last_event (the ends of
    the admitted records in order of event time, ties by identity), state ('final' once everything admitted is released).
    """
    one = classified.where("ts_ms is not null").groupBy(*identity).agg(*[F.first(c).alias(c) for c in ("ts_ms", "observed_ms", "period", "fate") if c not in identity])
    end = (F.col("period") + 1) * period_ms
    admitted = F.col("fate") != REJECTED
    late = admitted & (F.coalesce(F.col("observed_ms"), F.col("ts_ms")) >= end)
    name = F.struct(*[c for c in identity if c != "partition"])
    order = F.when(admitted, F.struct("ts_ms", name.alias("id")))
    out = one.groupBy("partition", "period").agg(
        F.count_if(admitted & ~late).alias("n_on_time"),
        F.count_if(late).alias("n_late"),
        F.count_if(admitted).alias("n"),
        F.count_if(F.col("fate") == FINAL).alias("n_final"),
        F.count_if(~admitted).alias("n_rejected"),
        F.min(order).alias("lo"),
        F.max(order).alias("hi"),
    )
    shown = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", *[F.col(f"{c}.id.{x}").cast("string") for x in identity if x != "partition"]))
    state = F.when((F.col("n") == F.col("n_final")), FINAL).otherwise(PROVISIONAL)
    return out.select("partition", (F.col("period") * period_ms).alias("period_start_ms"), "n_on_time", "n_late", "n", "n_final", "n_rejected", shown("lo").alias("first_event"), shown("hi").alias("last_event"), state.alias("state"))


def ordered_aggregates(classified: DataFrame, identity: list[str], value: str, period_ms: int = HOUR_MS, slice_ms: int = SLICE_MS) -> DataFrame:
    """Aggregates per partition and period that depend on the order of release, over what is released (final) and what is admitted so far (provisional).

    Result: partition, period_start_ms, n, n_final, changes and changes_final (how often ``value`` differs from the record before, nulls
    are alike), longest_gap_ms and longest_gap_final_ms (greatest distance in event time of neighbours; null for a single record). Records are
    in order of event time, ties by identity; copies count once. What is released is the earlier part of that order, so the
    final aggregate is one of a prefix and never changes when buffered records follow.

    A slice sorts its records; slices are then joined end to end, of which a period has at most ``period_ms / slice_ms``.
    """
    name = [c for c in identity if c != "partition"]
    kept = [c for c in ("ts_ms", "period", "fate", value) if c not in identity]
    one = classified.where((F.col("fate") != REJECTED) & F.col("ts_ms").isNotNull()).groupBy(*identity).agg(*[F.first(c).alias(c) for c in kept])
    rows = one.select("partition", "period", "ts_ms", *name, F.col(value).alias("v"), (F.col("fate") == FINAL).alias("out"), F.floor(F.col("ts_ms") / slice_ms).alias("slice"))
    by = ["partition", "period", "slice"]
    inside = Window.partitionBy(*by).orderBy("ts_ms", *name)
    gap = F.col("ts_ms") - F.lag("ts_ms").over(inside)
    steps = rows.withColumns({"gap": gap, "turn": F.lag("ts_ms").over(inside).isNotNull() & ~F.col("v").eqNullSafe(F.lag("v").over(inside))})
    edge = F.struct("ts_ms", *name, "v", "out")
    slices = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("out").alias("n_final"), F.count_if("turn").alias("turns"), F.count_if(F.col("turn") & F.col("out")).alias("turns_final"),
        F.max("gap").alias("gap"), F.max(F.when(F.col("out"), F.col("gap"))).alias("gap_final"), F.min(edge).alias("lo"), F.max(edge).alias("hi"),
    )
    across = Window.partitionBy("partition", "period").orderBy("slice")
    before = F.lag("hi").over(across)
    joined = slices.withColumns({"step": F.col("lo.ts_ms") - before["ts_ms"], "turned": before.isNotNull() & ~F.col("lo.v").eqNullSafe(before["v"])})
    released = F.col("lo.out")
    turn = F.when(F.col("turned"), 1).otherwise(0)
    out = joined.groupBy("partition", "period").agg(
        F.sum("n").alias("n"), F.sum("n_final").alias("n_final"), F.sum(F.col("turns") + turn).alias("changes"), F.sum(F.col("turns_final") + F.when(released, turn).otherwise(0)).alias("changes_final"),
        F.max(F.greatest("gap", "step")).alias("longest_gap_ms"), F.max(F.greatest("gap_final", F.when(released, F.col("step")))).alias("longest_gap_final_ms"),
    )
    return out.select("partition", (F.col("period") * period_ms).alias("period_start_ms"), "n", "n_final", "changes", "changes_final", "longest_gap_ms", "longest_gap_final_ms")


def past_cut_off(logs: DataFrame, watermarks: DataFrame, acks: DataFrame) -> DataFrame:
    """Records and requests that the operator does not let in: src, partition, writer, seq, distinct.

    A record meets the watermark committed when it arrives; a request line brings the one that held when it was written.
    """
    rows = logs.select("partition", F.col("origin").alias("writer"), "seq", epoch_ms(F.col("ts")).alias("ts_ms"), epoch_ms(F.col("observed_ts")).alias("observed_ms"))
    met = at_arrival(rows, watermarks).select(F.lit("otlp_logs").alias("src"), "partition", "writer", "seq", "ts_ms", "watermark_ms")
    own = acks.where(F.col("partition").isNotNull()).select(F.lit("client_acks"), "partition", F.col("node").alias("writer"), "seq", F.col("max_event_time_ms"), F.col("complete_through_ms"))
    return met.unionAll(own).where(is_late(F.col("ts_ms"), F.col("watermark_ms"))).select("src", "partition", "writer", "seq").distinct()
