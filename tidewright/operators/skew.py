"""Per-key work when a few keys hold most rows: fragment and replicate by estimated load.

The load of every key is estimated from a sample of bounded size (or taken from counts that the caller has). Keys above a task's fair
share ("heavy") are split into shards in proportion to their load; all fragments are bin-packed onto tasks, longest first, and
rows are moved to exactly the task that the plan gives their fragment. There are at most ``SPLIT * tasks`` heavy keys whatever the
data, so the plan is small enough for the driver by construction; all other keys are far below a task's share and go to
the bins by hash. A matching side is replicated only to the shards of heavy keys. The estimate decides where rows go, never which.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import materialise, parallelism

#: A key is heavy above 1/SPLIT of a task's fair share; light keys share SPLIT hash bins per task.
SPLIT = 4
#: A matching side of at most so many rows and bytes is broadcast; a larger one is fragment-replicated. It is measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 * 2**20
#: Rows that loads are estimated from, about; tables that seem smaller are counted whole.
SAMPLE_ROWS = 1_000_000

_SHARD, _TASK, _SHARDS = "__tw_shard", "__tw_task", "__tw_shards"


@dataclass(frozen=True)
class LoadPlan:
    """Where the rows of each key go. ``heavy``: key values, load, the task of each shard; ``bins``: the task of each light bin."""

    keys: tuple[str, ...]
    tasks: int
    total: int
    heavy: list[tuple[tuple, int, list[int]]] = field(default_factory=list)
    bins: list[int] = field(default_factory=list)

    @property
    def loads(self) -> list[float]:
        """Planned rows of each task; the light keys' share is spread over their bins."""
        out = [0.0] * self.tasks
        light = self.total - sum(load for _, load, _ in self.heavy)
        for task in self.bins:
            out[task] += light / len(self.bins)
        for _, load, at in self.heavy:
            for task in at:
                out[task] += load / len(at)
        return out


def sampled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df``, all if it has no more: a Bernoulli sample with a fixed seed. Counting the rows of files reads only their footers."""
    rows = SAMPLE_ROWS if rows is None else rows
    n = df.count()
    return df if n <= rows else df.sample(False, rows / n, 1)


def plan_loads(df: DataFrame, keys: Sequence[str], tasks: int | None = None, loads: DataFrame | None = None) -> LoadPlan:
    """Estimate the load of each key of ``df`` and plan its fragments. Null is a key of its own; an empty ``df`` gives an empty plan.

    One job: the sample's counts are combined before the shuffle and only the ``SPLIT * tasks`` largest reach the driver. Who has the counts already
    (keys and ``__tw_load``, one row per key) passes them as ``loads``. Loads are in rows of the sample; only their proportions matter.
    """
    tasks = tasks or parallelism(df.sparkSession)
    seen = Observation()
    if loads is None:
        loads = sampled(df.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__tw_load"))
    loads = loads.select(*keys, "__tw_load").observe(seen, F.sum("__tw_load").alias("total"))
    top = loads.orderBy(F.desc("__tw_load")).limit(SPLIT * tasks).collect()
    total = (seen.get["total"] or 0) if top else 0
    fair = total / tasks
    heavy = [(tuple(row[k] for k in keys), row["__tw_load"]) for row in top if row["__tw_load"] * SPLIT > fair and row["__tw_load"] > 1]
    n_bins = SPLIT * tasks
    light = (total - sum(load for _, load in heavy)) / n_bins
    pieces = [(light, "bin", i) for i in range(n_bins)]
    for k, (_, load) in enumerate(heavy):
        n = max(1, math.ceil(load / max(fair, 1)))
        pieces += [(load / n, "key", k)] * n
    tasks_heap = [(0.0, t) for t in range(tasks)]
    bins, at = [0] * n_bins, [[] for _ in heavy]
    for load, kind, k in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        filled, task = heapq.heappop(tasks_heap)
        heapq.heappush(tasks_heap, (filled + load, task))
        if kind == "bin":
            bins[k] = task
        else:
            at[k].append(task)
    return LoadPlan(tuple(keys), tasks, total, [(key, load, where) for (key, load), where in zip(heavy, at)], bins)


def _heavy_table(df: DataFrame, plan: LoadPlan, prefix: str = "__tw_h_") -> DataFrame:
    """Key columns, shard count and tasks of the heavy keys: at most ``SPLIT * tasks`` rows."""
    fields = [T.StructField(prefix + k, df.schema[k].dataType) for k in plan.keys]
    fields += [T.StructField(_SHARDS, T.IntegerType()), T.StructField("__tw_tasks", T.ArrayType(T.IntegerType()))]
    return df.sparkSession.createDataFrame([(*key, len(at), at) for key, _, at in plan.heavy], T.StructType(fields))


def _same(df: DataFrame, other: DataFrame, keys: Sequence[str], prefix: str = "__tw_h_") -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(other[prefix + k])
    return cond


def _light_task(plan: LoadPlan, columns: Sequence[str]) -> Column:
    """The task of a light key: that of its hash's bin."""
    light = F.pmod(F.xxhash64(*columns), F.lit(len(plan.bins))).cast("int")
    # one literal that is folded into an array once, however many bins there are
    return F.element_at(F.split(F.lit(",".join(map(str, plan.bins))), ",").cast("array<int>"), light + 1)


def with_fragment(df: DataFrame, plan: LoadPlan, spread: Sequence[str]) -> DataFrame:
    """``df`` with ``__tw_shard`` (of the row's key) and ``__tw_task``. ``spread``: columns whose hash picks a heavy key's shard."""
    bins = _light_task(plan, plan.keys)
    if not plan.heavy:
        return df.withColumns({_SHARD: F.lit(0), _TASK: bins})
    heavy = _heavy_table(df, plan)
    out = df.join(F.broadcast(heavy), _same(df, heavy, plan.keys), "left")
    shard = F.coalesce(F.pmod(F.xxhash64(F.lit(7), *spread), F.col(_SHARDS)).cast("int"), F.lit(0))
    out = out.withColumn(_SHARD, shard).withColumn(_TASK, F.coalesce(F.element_at("__tw_tasks", F.col(_SHARD) + 1), bins))
    return out.drop(*heavy.columns)


def place(df: DataFrame, plan: LoadPlan, spread: Sequence[str]) -> DataFrame:
    """Rows moved to the task that the plan gives their fragment, exactly (no second hash that could pile bins up)."""
    return with_fragment(df, plan, spread).repartitionById(plan.tasks, F.col(_TASK))


def fragment_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left", tasks: int | None = None, loads: DataFrame | None = None) -> DataFrame:
    """Join on null-safe equal keys ``on``; a heavy key's left rows are spread over its shards, its right rows copied there.

    Both sides are moved to the planned tasks, and the join needs no other exchange. ``how`` is inner, left, left_semi or left_anti. Other
    clashing column names must be renamed before. Result columns: those of left, then right's without ``on``.
    """
    plan = plan_loads(left, on, tasks, loads)
    # the keys' hashes must agree, so the right side's have the left's types
    other = right.select([F.col(c).cast(left.schema[c].dataType).alias("__tw_r_" + c) if c in on else F.col(c) for c in right.columns])
    a = place(left, plan, spread)
    light = _light_task(plan, ["__tw_r_" + c for c in on])
    if plan.heavy:
        heavy = _heavy_table(left, plan)
        cond = F.lit(True)
        for k in on:
            cond = cond & other["__tw_r_" + k].eqNullSafe(heavy["__tw_h_" + k])
        copies = F.coalesce(F.transform("__tw_tasks", lambda t, i: F.struct(i.alias("copy"), t.alias("to"))), F.array(F.struct(F.lit(0).alias("copy"), light.alias("to"))))
        other = other.join(F.broadcast(heavy), cond, "left").withColumn("__tw_c", F.explode(copies)).drop(*heavy.columns)
        other = other.select("*", F.col("__tw_c.copy").alias("__tw_copy"), F.col("__tw_c.to").alias("__tw_to")).drop("__tw_c")
    else:
        other = other.withColumns({"__tw_copy": F.lit(0), "__tw_to": light})
    other = other.repartitionById(plan.tasks, F.col("__tw_to"))
    cond = (a[_TASK] == other["__tw_to"]) & (a[_SHARD] == other["__tw_copy"])
    for k in on:
        cond = cond & a[k].eqNullSafe(other["__tw_r_" + k])
    return a.join(other, cond, how).drop(_TASK, _SHARD, "__tw_copy", "__tw_to", *["__tw_r_" + k for k in on])


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` has at most so many rows (BROADCAST_ROWS) and no more than BROADCAST_BYTES of content, measured up to the bound only."""
    bound = BROADCAST_ROWS if rows is None else rows
    n, size = df.limit(bound + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return n <= bound and (size or 0) <= BROADCAST_BYTES


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left", broadcast_rows: int | None = None, loads: DataFrame | None = None) -> DataFrame:
    """``fragment_join`` whose right side is broadcast if it was measured to be small (is_small()).

    ``right`` is read up to the bound only; pass it materialised if it is costly to compute.
    """
    if not is_small(right, broadcast_rows):
        return fragment_join(left, right, on, spread, how, loads=loads)
    other = right.select([F.col(c).alias("__tw_r_" + c) if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in on:
        cond = cond & left[k].eqNullSafe(other["__tw_r_" + k])
    return left.join(F.broadcast(other), cond, how).drop(*["__tw_r_" + k for k in on])


#: Partial and merging form of each aggregate that per_key() offers.
_PARTIAL = {
    "rows": (lambda c: F.count(F.lit(1)), F.sum),
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def per_key(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, str | None]], spread: Sequence[str] = (), fan_in: int = 4) -> DataFrame:
    """Results per key: ``aggs`` maps a result column to (rows | count | sum | min | max, column).

    The table is read once: each range of ``fan_in`` neighbouring splits is aggregated by itself, combined on the map side. What is
    moved then, the partial results, is counted per key and planned: a key that stands in many splits has its partials spread over shards,
    every fragment is merged on the task that the plan gives it, and a key's few shards are merged last. ``spread``, columns that vary within a key, is no longer
    needed, as splits vary. Null keys are kept as keys; an empty table gives no row; extra columns are ignored.
    """
    chunk = F.floor(F.spark_partition_id() / fan_in).alias("__tw_chunk")
    parts = df.withColumn("__tw_chunk", chunk).groupBy(*keys, "__tw_chunk").agg(*[_PARTIAL[kind][0](col).alias(name) for name, (kind, col) in aggs.items()])
    parts = materialise(parts, "partials")
    plan = plan_loads(parts, keys, loads=parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__tw_load")))
    merge = [_PARTIAL[kind][1](name).alias(name) for name, (kind, _) in aggs.items()]
    shards = place(parts, plan, ["__tw_chunk"]).groupBy(_TASK, _SHARD, *keys).agg(*merge)
    return shards.groupBy(*keys).agg(*merge)


def heavy_keys(tables: dict[str, DataFrame], fields: Sequence[str], share: float) -> DataFrame:
    """Per-key row counts of ``fields`` of several tables by per_key(), kept where above ``share`` of the table's rows.

    Columns: table_name, field, key_value (string), n_rows, of_rows. Null values are counted in ``of_rows`` but are no key.
    At most ``1/share`` rows per table and field can result. The comparison is exact for shares of up to 4 decimals.
    """
    rows = None
    for name, df in tables.items():
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields])
        part = df.select(F.lit(name).alias("table_name"), F.inline(pairs))
        rows = part if rows is None else rows.unionAll(part)
    counts = per_key(rows, ["table_name", "field", "key_value"], {"n_rows": ("rows", None)})
    counts = materialise(counts, "per-key")
    totals = counts.groupBy(F.col("table_name").alias("t"), F.col("field").alias("f")).agg(F.sum("n_rows").alias("of_rows"))
    # one row for each table and field
    out = counts.join(F.broadcast(totals), (F.col("t") == F.col("table_name")) & (F.col("f") == F.col("field"))).drop("t", "f")
    return out.where(F.col("key_value").isNotNull() & (F.col("n_rows") * 10_000 > F.col("of_rows") * F.lit(round(share * 10_000))))


def _spreading(df: DataFrame, fields: Sequence[str]) -> str:
    """A column that varies within a key: the sequence number if there is one, else any other column."""
    return next((c for c in ("seq", "line_id", "event_id") if c in df.columns), next((c for c in df.columns if c not in fields), df.columns[0]))


def load_report(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Rows that each task gets under the plan: task, n_rows, counted after moving the rows."""
    plan = plan_loads(df, keys, tasks)
    moved = place(df.select(*keys, _spreading(df, keys)), plan, [_spreading(df, keys)])
    return moved.groupBy(F.col(_TASK).alias("task")).agg(F.count(F.lit(1)).alias("n_rows"))
