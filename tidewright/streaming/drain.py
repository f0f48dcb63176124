"""Sealing of landed windows into the lake: sort, de-duplicate, write once, commit files with the watermark, then drop."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.naming import encode_component
from tidewright.operators.dedup import event_bounds, keep_first, keep_latest
from tidewright.operators.ranges import coverage_runs
from tidewright.operators.watermark import advance
from tidewright.plans.transforms import checked
from tidewright.session import Scratch
from tidewright.sources.commitlog import COMMITTED, INDETERMINATE, LakeLog
from tidewright.sources.formats import write_sorted_parts
from tidewright.streaming.landing import Landing
from tidewright.types import CHANGELOG, MANIFEST, DatasetDecl

LATENESS_MS = 15 * 60_000


def eligible(closed: list[dict], now_ms: int, lateness_ms: int = LATENESS_MS) -> list[int]:
    """Closed windows whose allowed lateness has passed, its last instant included."""
    return [w["window_id"] for w in closed if now_ms >= w["closed_ms"] + lateness_ms]


def seal_key(d: DatasetDecl) -> tuple[str, ...]:
    """The columns of which a sealed window has one row each; none if it keeps all rows."""
    return d.key_cols if d.kind == CHANGELOG else d.natural_key


def sealed_rows(rows: DataFrame, d: DatasetDecl) -> DataFrame:
    """One row per natural key: the first of an event, the latest of a changelog; without a key all rows."""
    if d.kind == CHANGELOG:
        return keep_latest(rows, d.key_cols)
    return keep_first(rows, d.natural_key) if d.natural_key else rows


def window_manifests(rows: DataFrame, d: DatasetDecl) -> DataFrame:
    """Manifest columns of each (partition, window_id): coverage, rows, event bounds (over all landed rows), removed copies."""
    by = ["partition", "window_id"]
    cover = coverage_runs(rows, [*by, "origin"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("origin", "first_seq", "last_seq"))).alias("origin_coverage"))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *event_bounds(F.col(d.time_col)))
    # which row of a key is kept depends on its number only; what else a row has would be moved with it
    needed = rows.select(*dict.fromkeys([*by, *seal_key(d), "origin", "seq"]))
    kept = sealed_rows(needed, d).groupBy(*by).agg(F.count(F.lit(1)).alias("rows")) if seal_key(d) else total.select(*by, F.col("total").alias("rows"))
    out = total.join(kept, by, "left").join(cover, by, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.select(F.lit(d.name).alias("dataset"), *by, "origin_coverage", "rows", "event_time_min_ms", "event_time_max_ms", (F.col("total") - F.col("rows")).alias("dedup_removed"))


def drain(spark: SparkSession, landing: Landing, lake: LakeLog, d: DatasetDecl, now_ms: int, lateness_ms: int = LATENESS_MS, transform: str | None = None) -> list[tuple[str, int, str]]:
    """Seal and commit every eligible window; (partition, window, outcome) of each. Windows that can't be committed stay landed.

    One job writes a window's parts, one entry of the log commits them with their watermarks. A lake window is numbered per
    partition, densely, in the order of the landing's windows, so partitions that had no rows in a window leave no hole.
    """
    done = []
    for w in eligible(landing.closed_windows(now_ms), now_ms, lateness_ms):
        rows = landing.rows([w])
        outcomes = []
        if rows is not None:
            with Scratch(rows.sparkSession) as scratch:
                rows = checked(rows, transform, ["partition", "window_id", "origin", "seq", d.time_col])
                # landed parts are never rewritten; only what a transform makes of them could differ from one reading to the next
                outcomes = _seal(spark, lake, d, rows if transform is None else scratch.table(rows, "window"), w)
        done += outcomes
        if outcomes and all(o == COMMITTED for _, _, o in outcomes):
            held = lake.manifests().where((F.col("dataset") == d.name) & (F.col("part_kind") != "snapshot")).select("partition", F.explode("origin_coverage").alias("r")).select("partition", "r.*")
            landing.drop_covered(w, held)
    return done


def _seal(spark: SparkSession, lake: LakeLog, d: DatasetDecl, rows: DataFrame, window: int) -> list[tuple[str, int, str]]:
    lake.evolve_schema(d.name, rows.schema)
    fresh = [m.asDict(recursive=True) for m in window_manifests(rows, d).collect()]  # one per partition of the window: log metadata
    before = [x for x in lake.state().manifests.values() if x["dataset"] == d.name and x["part_kind"] == "primary"]
    held = {(x["partition"], json.dumps(x["origin_coverage"])) for x in before}
    landed = [m for m in fresh if (m["partition"], json.dumps(m["origin_coverage"])) in held]  # by an earlier attempt
    new = [m for m in fresh if m not in landed]
    outcomes = [(m["partition"], window, COMMITTED) for m in landed]
    if not new:
        return outcomes
    folder = f"{encode_component(d.name)}/seal-{window}-{uuid.uuid4().hex[:12]}"
    # copies of a key that has the partition lie within one: moved to their part first, they are removed there
    placed = "partition" in seal_key(d)
    kept = sealed_rows(rows.repartition("partition") if placed else rows, d)
    write_sorted_parts(kept.where(F.col("partition").isin([m["partition"] for m in new])), f"{lake.path}/{folder}", "partition", d.seal_order(), placed)
    numbers: dict[str, int] = {}
    for x in before:
        numbers[x["partition"]] = max(numbers.get(x["partition"], -1), x["window_id"])
    manifests = [m | {"window_id": numbers.get(m["partition"], -1) + 1, "parts": [f"{folder}/__part={escaped(m['partition'])}"], "part_kind": "primary", "discriminator": 0, "expired": False} for m in new]
    marks = watermarks_after(spark, before, manifests)
    found = lake.commit_all([(m, marks.get(m["partition"])) for m in manifests])
    return outcomes + [(m["partition"], window, lake.reconcile(m) if o == INDETERMINATE else o) for m, o in zip(manifests, found)]


def escaped(value: str) -> str:
    """A value as it stands in the name of a partition folder."""
    return re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def watermarks_after(spark: SparkSession, committed: list[dict], new: list[dict]) -> dict[str, int]:
    """The watermark of each partition with the new manifests, by the ledger's rule; none while no window is clean. One job for all."""
    touched = {m["partition"] for m in new}
    ranges = lambda x: [tuple(r[c] for c in ("origin", "first_seq", "last_seq")) for r in x["origin_coverage"]]
    rows = [tuple(ranges(x) if n == "origin_coverage" else x[n] for n in MANIFEST.names) for x in [*(c for c in committed if c["partition"] in touched), *new]]
    found = advance(spark.createDataFrame(rows, MANIFEST)).where("complete_through_ms is not null").collect()  # one row per partition
    return {r["partition"]: r["complete_through_ms"] for r in found}
