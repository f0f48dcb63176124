"""A feed of keyed inserts, updates and deletes, folded into current state by composing patches.

A change is a function on a key's row. Composing two of them is associative, commutative and idempotent once each carries
its order: a composed patch is (greatest delete order, per column the value with the greatest order), and composition
takes the greater of each part. So repeated and out-of-order changes need no sort, any chunk of the feed can be composed
by itself, and partial patches are reduced as a tree: the map task's chunk of the feed (before the shuffle, also within a
hot key), then ranges of ``fan_in`` neighbouring chunks within a key, then the key. A base table is a patch older than all changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(value: Column, order: Column, where: Column | None = None) -> Column:
    return F.max_by(value, order if where is None else F.when(where, order))


def _chunk(fan_in: int) -> Column:
    """The range of neighbouring chunks that the row's chunk (the split that its task reads) belongs to."""
    return F.floor(F.spark_partition_id() / fan_in).alias("__tw_chunk")


def compose_patches(changes: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], deleted: Column, *, base: DataFrame | None = None, partial: bool = False, fan_in: int = 16) -> DataFrame:
    """Current rows: keys, order columns of the deciding change, values.

    ``deleted`` tells a delete; any other change sets ``values`` (with ``partial``, a null value leaves that column as it was). ``order``
    compares field by field, nulls first; changes equal in order must be equal. ``base`` has keys and values and counts as
    older than every change. Null keys are keys; an empty feed returns the base. Other columns are ignored.

    Middle level: a key's patches are composed per range of ``fan_in`` neighbouring chunks of the feed first, so a hot
    key that occurs in every chunk is still reduced by many tasks.
    """
    o = F.struct(*[F.col(c) for c in order])
    feed = changes.select(*keys, *order, *values, F.coalesce(deleted, F.lit(False)).alias("__tw_del"), _chunk(fan_in), F.lit(1).alias("__tw_age"))
    if base is not None:
        types = {f.name: f.dataType for f in feed.schema}
        old = base.select(*keys, *[F.lit(None).cast(types[c]).alias(c) for c in order], *values, F.lit(False).alias("__tw_del"), _chunk(fan_in), F.lit(0).alias("__tw_age"))
        feed = feed.unionAll(old.select(*feed.columns))
    feed = feed.withColumn("__tw_o", F.struct("__tw_age", o.alias("o")))
    patch = [F.max(F.when(F.col("__tw_del"), F.col("__tw_o"))).alias("__tw_d"), F.max(F.when(~F.col("__tw_del"), F.col("__tw_o"))).alias("__tw_s")]
    if partial:
        for c in values:
            live = ~F.col("__tw_del") & F.col(c).isNotNull()
            patch += [F.max(F.when(live, F.struct(F.col("__tw_o").alias("o"), F.col(c).alias("v")))).alias("__tw_v_" + c)]
    else:
        patch += [_newest(F.struct(*values), F.col("__tw_o"), ~F.col("__tw_del")).alias("__tw_v")]
    merge = [F.max("__tw_d").alias("__tw_d"), F.max("__tw_s").alias("__tw_s2")]
    merge += [F.max("__tw_v_" + c).alias("__tw_v_" + c) for c in values] if partial else [F.max_by("__tw_v", "__tw_s").alias("__tw_v")]
    chunks = feed.groupBy(*keys, "__tw_chunk").agg(*patch)
    state = chunks.groupBy(*keys).agg(*merge).where(F.col("__tw_s2").isNotNull() & (F.col("__tw_d").isNull() | (F.col("__tw_s2") > F.col("__tw_d"))))
    if partial:
        kept = [F.when(F.col("__tw_d").isNull() | (F.col(f"__tw_v_{c}.o") > F.col("__tw_d")), F.col(f"__tw_v_{c}.v")).alias(c) for c in values]
    else:
        kept = [F.col(f"__tw_v.{c}").alias(c) for c in values]
    return state.select(*keys, *[F.col(f"__tw_s2.o.{c}").alias(c) for c in order], *kept)


def changelog_state(changelog: DataFrame) -> DataFrame:
    """Live keys of the journalled changelog: dataset, tenant, changelog_key, origin, changelog_seq, value.

    Only acknowledged lines count. A null tombstone means false; an empty or null value is a value; a change without sequence number
    is older than its origin's numbered ones.
    """
    acked = changelog.where(F.col("event") == "ClientAck")
    return compose_patches(acked, ["dataset", "tenant", "changelog_key"], ["origin", "changelog_seq"], ["value"], F.col("tombstone"))
