"""The query engine over a lake and its landing: one view per dataset, pinned bounds, read concerns, absence, freshness.

A dataset's view is committed rows at or below its partitions' watermarks together with landed rows above them. Both
branches use one reading of the watermarks, taken when the engine is pinned, as literals of the plan; a second reading across a commit would count rows
twice or lose them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.changelog import latest_view
from tidewright.plans.guards import Guards, check_select
from tidewright.sources.commitlog import LakeLog
from tidewright.types import CHANGELOG, WATERMARK, DatasetDecl, UncoveredRange

COMPLETE, AVAILABLE = "complete", "available"
#: Up to so many partitions' bounds become literals of the tier predicate, else a joined table.
LITERAL_BOUNDS = 64


def tier_union(cold: DataFrame, hot: DataFrame, watermarks: DataFrame, time_ms: Column) -> DataFrame:
    """Committed rows at or below the partition's bound and landed rows above it, by position of ``cold``'s columns.

    ``watermarks`` has at most one row per partition; without a row nothing of the partition is committed yet. It should be materialised
    or literal, since both branches read it. Rows of neither side are looked at twice: the bound is joined by partition (Spark broadcasts it by its measured size).
    """
    w = watermarks.select(F.col("partition").alias("__tw_p"), F.col("complete_through_ms").alias("__tw_bound"))
    columns = cold.columns
    below = cold.join(w, F.col("partition") == F.col("__tw_p")).where(time_ms <= F.col("__tw_bound")).select(columns)
    above = hot.join(w, F.col("partition") == F.col("__tw_p"), "left").where(F.col("__tw_bound").isNull() | (time_ms > F.col("__tw_bound"))).select(columns)
    return below.unionAll(above)


def time_ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def freshness(datasets: DataFrame, watermarks: DataFrame, now_ms: int) -> DataFrame:
    """Per dataset: complete_through_ms (the least over its partitions), age_ms, the partition that lags most.

    ``datasets`` has dataset, partition, one row each. A partition without a watermark makes the dataset's bound null, and is the laggard.
    """
    rows = datasets.join(watermarks, "partition", "left")
    out = rows.groupBy("dataset").agg(
        F.when(F.count("*") == F.count("complete_through_ms"), F.min("complete_through_ms")).alias("complete_through_ms"),
        F.min_by("partition", F.struct(F.col("complete_through_ms").isNotNull(), "complete_through_ms", "partition")).alias("laggard"),
    )
    return out.select("dataset", "complete_through_ms", (F.lit(now_ms) - F.col("complete_through_ms")).alias("age_ms"), "laggard")


class Engine:
    """Datasets of a lake, and of landed rows, behind SQL."""

    def __init__(self, spark: SparkSession, lake: LakeLog, datasets: list[DatasetDecl], hot: dict[str, DataFrame] | None = None, guards: Guards | None = None, tenants: list[str] | None = None):
        # a session of its own: views of two engines (other pins, other tenants) must not replace each other
        self.spark = spark.newSession()
        self.lake, self.guards = LakeLog(self.spark, lake.path), guards or Guards()
        self.datasets = {d.name: d for d in datasets}
        self.hot, self.tenants = hot or {}, tenants
        self.version = 0
        self._marks: dict[str, int] = {}
        self.pin()

    @classmethod
    def attach(cls, spark: SparkSession, path: str, datasets: list[DatasetDecl], **kwargs) -> Engine:
        """Mount a lake: afterwards every dataset is a view of its name, and changelogs have a ``_latest`` view too."""
        return cls(spark, LakeLog(spark, path), datasets, **kwargs)

    def pin(self, version: int | None = None) -> int:
        """Fix the log's version, files and watermarks for what follows, and register the views."""
        state = self.lake.state(version)
        self.version, self._marks = state.version, dict(state.watermarks)
        for d in self.datasets.values():
            if d.name not in state.schemas:
                continue
            view = self.view(d.name)
            view.createOrReplaceTempView(d.name)
            if d.kind == CHANGELOG:
                latest_view(view, d.key_cols).createOrReplaceTempView(f"{d.name}_latest")
        return self.version

    def watermarks(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self._marks.items()), WATERMARK)

    def view(self, name: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
        """The dataset's rows; a time range prunes committed files by their manifests, and the landed rows of partitions that are complete through it."""
        d = self.datasets[name]
        cold = self.lake.scan(name, self.version, from_ms, to_ms)
        ms = time_ms(d.time_col)
        in_range = F.lit(True)
        if from_ms is not None:
            in_range = in_range & (ms >= from_ms)
        if to_ms is not None:
            in_range = in_range & (ms <= to_ms)
        hot = self.hot.get(name)
        if hot is None:
            hot = self.spark.createDataFrame([], cold.schema)
        elif to_ms is not None and len(self._marks) <= LITERAL_BOUNDS:
            # partitions without a bound have landed rows only, which stay
            through = [p for p, mark in sorted(self._marks.items()) if mark is not None and mark >= to_ms]
            hot = hot.where(F.col("partition").isNull() | ~F.col("partition").isin(through))
        hot = project_generation(hot, cold.schema)
        if len(self._marks) <= LITERAL_BOUNDS:
            bound = F.lit(None).cast("bigint")
            for p, mark in sorted(self._marks.items()):
                bound = F.when(F.col("partition") == p, F.lit(mark)).otherwise(bound)
            out = cold.where(ms <= bound).unionAll(hot.where(bound.isNull() | (ms > bound)))
        else:
            out = tier_union(cold, hot, self.watermarks(), ms)
        out = out.where(in_range)
        if self.tenants is not None:
            out = out.where(F.col("tenant").isin(self.tenants))
        return out

    def _partition_marks(self, name: str) -> dict[str, int | None]:
        parts = {m["partition"] for m in self.lake.state(self.version).manifests.values() if m["dataset"] == name}
        return {p: self._marks.get(p) for p in sorted(parts)}

    def tables_of(self, text: str) -> list[str]:
        """The engine's datasets that a query reads, by its analysed plan's views."""
        plan = self.spark.sql(text)._jdf.queryExecution().analyzed().toString()
        return sorted(n for n in self.datasets if f"SubqueryAlias {n}\n" in plan or f"SubqueryAlias {n}_latest\n" in plan)

    def sql(self, text: str, concern: str = AVAILABLE, through_ms: int | None = None) -> DataFrame:
        """A query's DataFrame. With concern complete, every dataset read must be complete through ``through_ms`` in all partitions, or UncoveredRange is raised before anything runs."""
        check_select(self.spark, text)
        if concern == COMPLETE:
            if through_ms is None:
                raise ValueError("a complete read states through when")
            for name in self.tables_of(text):
                self.prove(name, through_ms)
        return self.spark.sql(text)

    def fetch(self, text: str, concern: str = AVAILABLE, through_ms: int | None = None):
        """The same as Arrow, under the guards."""
        return self.guards.fetch(self.sql(text, concern, through_ms))

    def schema(self, text: str) -> T.StructType:
        check_select(self.spark, text)
        return self.spark.sql(text).schema

    def prove(self, name: str, through_ms: int) -> None:
        """Raise unless all partitions of the dataset are complete through the time; a dataset without partitions proves nothing."""
        marks = self._partition_marks(name)
        if not marks:
            raise UncoveredRange(name, "*", through_ms, None)
        for p, mark in marks.items():
            if mark is None or mark < through_ms:
                raise UncoveredRange(name, p, through_ms, mark)

    def absent(self, name: str, from_ms: int, to_ms: int) -> bool:
        """Whether it is proven that the dataset has no row in the range; not provable raises, which is not the same as empty."""
        self.prove(name, to_ms)
        return self.view(name, from_ms, to_ms).isEmpty()

    def freshness(self, now_ms: int) -> DataFrame:
        """complete_through_ms, age and laggard per dataset, and landed rows that sit at or below the bound (hidden until they are drained)."""
        rows = [(name, p) for name in sorted(self.datasets) for p in self._partition_marks(name)]
        base = freshness(self.spark.createDataFrame(rows, "dataset string, partition string"), self.watermarks(), now_ms)
        hidden = self.spark.createDataFrame([], "dataset string, hot_stragglers bigint")
        for name, hot in self.hot.items():
            w = self.watermarks()
            late = hot.join(w, "partition").where(time_ms(self.datasets[name].time_col) <= F.col("complete_through_ms"))
            hidden = hidden.unionAll(late.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name), "n"))
        return base.join(hidden, "dataset", "left").withColumn("hot_stragglers", F.coalesce("hot_stragglers", F.lit(0)))

    def status(self) -> dict:
        return {"uri": self.lake.path, "version": self.version, "watermarks": dict(self._marks), "datasets": sorted(self.datasets)}


def project_generation(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of an earlier generation under a later schema, column by column: missing ones null, narrower ones cast up."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
