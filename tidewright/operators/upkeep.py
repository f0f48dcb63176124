"""Upkeep of landed and committed data: bytes staged, retention, when a snapshot is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Retention in ms of ordinary and of system tenants' data, and how many classes there may be.
STANDARD_MS, SYSTEM_MS, MAX_CLASSES = 30 * 86_400_000, 72 * 3_600_000, 8

_FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}


def content_bytes(schema: T.StructType) -> Column:
    """Bytes of a row's content: octets of texts and binaries, the width of other types; nulls count nothing."""
    out = F.lit(0).cast("bigint")
    for f in schema.fields:
        size = F.octet_length(F.col(f.name)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.when(F.col(f.name).isNotNull(), _FIXED[type(f.dataType)])
        out = out + F.coalesce(size, F.lit(0))
    return out


def staged_bytes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Content bytes per group of ``by``: the measure of the overload ladder."""
    return rows.groupBy(*by).agg(F.sum(content_bytes(rows.schema)).alias("staged_bytes"))


def expired_manifests(manifests: DataFrame, now_ms: int, classes: dict[str, int] | None = None) -> DataFrame:
    """Manifests whose newest event is older than their partition's retention, not yet expired: dataset, partition, window_id, part_kind.

    ``classes`` maps a partition's prefix to its retention in ms (the longest matching prefix counts); system tenants (``_``) and all
    others have the fixed defaults. Snapshots are kept.
    """
    classes = {"_": SYSTEM_MS, "": STANDARD_MS} | (classes or {})
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} retention classes")
    keep = F.lit(STANDARD_MS)
    for prefix, ms in sorted(classes.items(), key=lambda c: len(c[0])):
        keep = F.when(F.col("partition").startswith(prefix), F.lit(ms)).otherwise(keep)
    old = F.col("event_time_max_ms") + keep < now_ms
    live = ~F.coalesce("expired", F.lit(False)) & (F.col("part_kind") != "snapshot")
    return manifests.where(live & old).select("dataset", "partition", "window_id", "part_kind").distinct()


def snapshots_due(manifests: DataFrame) -> DataFrame:
    """Partitions whose rows after the newest snapshot are at least as many as the snapshot's: dataset, partition, snapshot_rows, later_rows.

    A snapshot covers what its window number covers; partitions without a snapshot are due as soon as they have rows. Expired parts don't count; repeated manifests count once.
    """
    m = manifests.where(~F.coalesce("expired", F.lit(False))).select("dataset", "partition", "window_id", "part_kind", "discriminator", "rows").distinct()
    snap = m.where("part_kind = 'snapshot'").groupBy("dataset", "partition").agg(F.max(F.struct("window_id", "discriminator", "rows")).alias("s"))
    later = m.where("part_kind <> 'snapshot'").join(snap, ["dataset", "partition"], "left").where(F.col("s").isNull() | (F.col("window_id") > F.col("s.window_id")))
    out = later.groupBy("dataset", "partition").agg(F.coalesce(F.max("s.rows"), F.lit(0)).alias("snapshot_rows"), F.sum("rows").alias("later_rows"))
    return out.where((F.col("later_rows") > 0) & (F.col("later_rows") >= F.col("snapshot_rows")))
