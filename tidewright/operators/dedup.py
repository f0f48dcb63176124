"""Keeping one row per key, and finding keys whose copies disagree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool) -> DataFrame:
    # an aggregate instead of a ranked window: copies are combined before the shuffle and no key is sorted in one task
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pick = F.max_by if newest else F.min_by
    row = pick(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(row.alias("__tw_row")).select(*[F.col(c) if c in keys else F.col(f"__tw_row.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("origin", "seq")) -> DataFrame:
    """The least row by ``order`` of each key. Null keys are a key; ``order`` should be unique within a key."""
    return _one(df, keys, order, newest=False)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("origin", "seq")) -> DataFrame:
    """The greatest row by ``order`` of each key."""
    return _one(df, keys, order, newest=True)


def seal_counts(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per ``by``: rows before, rows after de-duplication by ``keys`` (within ``by``), and rows removed."""
    per_key = df.groupBy(*dict.fromkeys([*by, *keys])).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.groupBy(*by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sealed"))
    return out.withColumn("dedup_removed", F.col("total") - F.col("sealed"))


def conflicts(df: DataFrame, slot: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Slots whose copies disagree in ``content``, with the number of versions. Nulls are a value of their own."""
    versions = df.groupBy(*slot, *content).agg(F.lit(1).alias("one"))
    return versions.groupBy(*slot).agg(F.count("one").alias("versions")).where("versions > 1")


def split_known(batch: DataFrame, ledger: DataFrame, now_ms: int, ttl_ms: int) -> tuple[DataFrame, DataFrame]:
    """A batch of requests (tenant, dedup_key, ...) as fresh ones and, with the stored outcome, known ones.

    A ledger row counts while its creation is within the time to live, ends included.
    """
    live = ledger.where(F.col("created_ms") >= now_ms - ttl_ms).select("tenant", "dedup_key", "outcome")
    return batch.join(live, ["tenant", "dedup_key"], "left_anti"), batch.join(live, ["tenant", "dedup_key"])


def evict_beyond(ledger: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` rows of each tenant, ties by key: what stays in a bounded ledger."""
    from pyspark.sql import Window

    order = Window.partitionBy("tenant").orderBy(F.desc("created_ms"), F.desc("dedup_key"))
    return ledger.withColumn("__tw_rn", F.row_number().over(order)).where(F.col("__tw_rn") <= cap).drop("__tw_rn")


def event_bounds(ts: Column) -> list[Column]:
    """Aggregates for the event-time bounds in milliseconds; (0, 0) without rows."""
    ms = F.unix_millis(ts.cast("timestamp"))
    return [F.coalesce(F.min(ms), F.lit(0)).alias("event_time_min_ms"), F.coalesce(F.max(ms), F.lit(0)).alias("event_time_max_ms")]
