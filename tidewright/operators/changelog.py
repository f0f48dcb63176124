"""Views of keyed changelogs: latest rows, snapshots and what follows them, as-of enrichment, validity periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.dedup import keep_latest

ORDER = ("origin", "seq")


def op(df: DataFrame, name: str = "_op") -> Column:
    """The row's operation; without the column, or null, an upsert."""
    return F.coalesce(F.col(name), F.lit("upsert")) if name in df.columns else F.lit("upsert")


def latest_view(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """The newest row of each key that isn't deleted by it; deletes are dropped after the fold, not before."""
    return (rows := keep_latest(changes, keys, order)).where(op(rows) != "delete")


def snapshot(changes: DataFrame, keys: Sequence[str], as_of: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest row of each key as of a number per origin (``as_of``: origin, as_of_seq). Deletes are kept: they hide older rows."""
    seen = changes.join(as_of, "origin").where(F.col("seq") <= F.col("as_of_seq")).drop("as_of_seq")
    return keep_latest(seen.select(changes.columns), keys, order)


def view_from_snapshot(snap: DataFrame, later: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """The latest view from a snapshot and the rows after it."""
    return latest_view(snap.unionByName(later), keys, order)


def validity(changes: DataFrame, keys: Sequence[str], time: str, order: Sequence[str] = ORDER) -> DataFrame:
    """``changes`` with ``valid_from`` and ``valid_to`` (null: still valid), the time of the key's next change."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    return changes.withColumn("valid_from", F.col(time)).withColumn("valid_to", F.lead(time).over(w))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], tie: Sequence[str] = (), bucket_s: int = 3600) -> DataFrame:
    """``left`` with ``columns`` of the last ``right`` row of the same key at or before its time (left join; null if there is none).

    Linear: both sides are cut into time buckets, each bucket begins with the last row carried over from earlier ones, and
    one ordered pass per (key, bucket) finds the match; a hot key is spread over its buckets. Null keys or times match nothing. ``tie``
    orders right rows of equal time. Right columns must not clash with left ones.
    """
    tick = lambda t: F.unix_micros(F.col(t).cast("timestamp"))
    bucket = lambda t: F.floor(tick(t) / (bucket_s * 1_000_000))
    ok = F.col(right_time).isNotNull()
    for k in on:
        ok = ok & F.col(k).isNotNull()
    r = right.where(ok).select(*on, bucket(right_time).alias("__tw_b"), tick(right_time).alias("__tw_t"), F.struct(*tie, F.lit(0)).alias("__tw_tie"), F.struct(*columns).alias("__tw_r"))
    l = left.withColumn("__tw_b", bucket(left_time)).withColumn("__tw_t", tick(left_time))
    ends = r.groupBy(*on, "__tw_b").agg(F.max_by("__tw_r", F.struct("__tw_t", "__tw_tie")).alias("__tw_last"))
    wanted = l.select(*on, "__tw_b").distinct().withColumn("__tw_want", F.lit(True))
    before = Window.partitionBy(*on).orderBy("__tw_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(wanted, [*on, "__tw_b"], "full").withColumn("__tw_r", F.last("__tw_last", ignorenulls=True).over(before)).where("__tw_want and __tw_r is not null")
    row = F.struct(*left.columns)
    none, no_row = F.lit(None).cast(r.schema["__tw_r"].dataType), F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType)
    no_tie = F.lit(None).cast(r.schema["__tw_tie"].dataType)
    both = r.select(*on, "__tw_b", "__tw_t", F.lit(1).alias("__tw_side"), "__tw_tie", "__tw_r", no_row.alias("__tw_l"))
    both = both.unionAll(carried.select(*on, "__tw_b", F.lit(None).cast("bigint").alias("__tw_t"), F.lit(0).alias("__tw_side"), no_tie.alias("__tw_tie"), "__tw_r", no_row.alias("__tw_l")))
    both = both.unionAll(l.select(*on, "__tw_b", "__tw_t", F.lit(2).alias("__tw_side"), no_tie.alias("__tw_tie"), none.alias("__tw_r"), row.alias("__tw_l")))
    w = Window.partitionBy(*on, "__tw_b").orderBy(F.col("__tw_t").asc_nulls_first(), "__tw_side", "__tw_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__tw_hit", F.last("__tw_r", ignorenulls=True).over(w)).where("__tw_l is not null")
    timed = F.col("__tw_t").isNotNull()
    return found.select("__tw_l.*", *[F.when(timed, F.col(f"__tw_hit.{c}")).alias(c) for c in columns])


def enrich_latest(events: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Events with the current row of their dimension key; Spark broadcasts the dimension if its measured size is below the session's bound."""
    return events.join(latest_view(dimension, keys).drop("origin", "seq", "_op"), list(keys), how)
