"""Runs that take exactly the new or changed records: the target itself is the state.

Every target row carries its source key and version; what a run must take is the anti-join of the source against them. A
run writes its rows under a name of its own and publishes the next target version by one exclusive file creation. A run
that fails before that leaves nothing that counts, a run that is repeated finds its rows in the target, and of two
concurrent runs the later one to publish is judged again against the other's version.

Where a key is a stream and versions are its sequence numbers, every number is a record of its own (``every``). The target's keys and
versions are then folded to one row per stream, its greatest number, published with each version; runs read the fold, not all rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.skew import lookup_join
from tidewright.sources.atomic import list_names, put_if_absent, read_bytes


def committed_marks(applied_log: DataFrame) -> DataFrame:
    """The marks that count: the greatest applied_seq of committed rows per (partition, origin).

    Failed and running runs, null marks, repeated and receding rows count for nothing.
    """
    ok = applied_log.where((F.col("status") == "committed") & F.col("applied_seq").isNotNull())
    return ok.groupBy("partition", "origin").agg(F.max("applied_seq").alias("applied_seq"))


def beyond_marks(source: DataFrame, marks: DataFrame, stream: Sequence[str] = ("partition", "origin"), seq: str = "seq", mark: str = "applied_seq") -> DataFrame:
    """Rows of ``source`` that no mark covers (anti-join on stream and seq <= mark); copies of a record pass alike.

    A stream without mark is taken whole. Null stream fields match null ones; a null seq is beyond no mark. All columns of ``source`` are kept. Marks are broadcast if counted to be
    few, else a hot stream's rows are spread over shards and its one mark is copied there.
    """
    held = marks.select(*stream, F.col(mark).alias("__tw_mark"))
    return lookup_join(source, held, list(stream), [seq], "left").where(F.col("__tw_mark").isNull() | (F.col(seq) > F.col("__tw_mark"))).drop("__tw_mark")


#: After so many parts the target is rewritten as one.
COMPACT_PARTS = 64


class IncrementalTarget:
    """A target table whose published versions tell which source records it holds.

    ``keys`` name a source record, ``version`` (may be None for immutable records) is its bigint version: a record is taken if
    the target has no row with its key, or only ones with smaller version. Of a record's versions only the newest is taken, or with
    ``every`` each of them. Every target row stores key and version.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: str | None, schema: T.StructType, every: bool = False):
        self.spark, self.path, self.keys, self.version, self.schema, self.every = spark, path.rstrip("/"), list(keys), version, schema, every

    def head(self) -> dict:
        names = [n for n in list_names(self.spark, f"{self.path}/_versions") if n.endswith(".json")]
        return json.loads(read_bytes(self.spark, f"{self.path}/_versions/{names[-1]}")) if names else {"version": 0, "files": [], "held": None, "part": None}

    def _read(self, files: Sequence[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def rows(self, head: dict | None = None) -> DataFrame:
        """All published rows, older versions of changed records included."""
        return self._read((head or self.head())["files"], self.schema)

    def published(self, head: dict) -> DataFrame:
        """The rows that one version added."""
        return self._read([head["part"]] if head["part"] else [], self.schema)

    def current(self) -> DataFrame:
        """The newest version of every record."""
        if self.version is None:
            return self.rows()
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = self.rows().groupBy(*self.keys).agg(F.max(F.struct(self.version, *[c for c in rest if c != self.version])).alias("__tw_row"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"__tw_row.{c}").alias(c) for c in self.schema.names])

    def _fold(self, rows: DataFrame) -> DataFrame:
        """Keys and the greatest version that rows have of each: what the anti-join compares with."""
        return rows.groupBy(*self.keys).agg((F.max(self.version) if self.version else F.lit(0).cast("bigint")).alias("__tw_held"))

    def held(self, head: dict | None = None) -> DataFrame:
        """Keys and ``__tw_held``, the greatest version of each that the target has; with ``every`` as published, else folded from the rows."""
        head = head or self.head()
        schema = T.StructType([*[self.schema[k] for k in self.keys], T.StructField("__tw_held", T.LongType())])
        return self._read([head["held"]], schema) if head["held"] else self._fold(self.rows(head))

    def pending(self, source: DataFrame, head: dict | None = None) -> DataFrame:
        """The source records to take now. Copies of one record (same key and version) come out once, the newest version of each, or every one.

        Keys are compared null-safely, a null version is older than any other. With ``every`` a key may be hot: what the target holds of it is one
        row, which is broadcast if all of them are small, and else copied to the shards that the stream's records are spread over.
        """
        held = self.held(head)
        least = F.lit(-(2**63)).cast("bigint")
        if self.every:
            found = lookup_join(source, held.withColumn("__tw_has", F.lit(True)), self.keys, [self.version], "left")
            new = found.where(F.col("__tw_has").isNull() | (F.coalesce(self.version, least) > F.coalesce("__tw_held", least))).select(source.columns)
            by = [*self.keys, self.version]
        else:
            other = held.withColumnsRenamed({k: "__tw_t_" + k for k in self.keys})
            cond = F.lit(True)
            for k in self.keys:
                cond = cond & source[k].eqNullSafe(other["__tw_t_" + k])
            if self.version:
                cond = cond & (F.coalesce(source[self.version], least) <= F.coalesce(other["__tw_held"], least))
            new = source.join(other, cond, "left_anti")
            by = self.keys
        rest = [c for c in source.columns if c not in by]
        if not rest:
            return new.distinct()
        lead = [self.version] if self.version and not self.every else []
        one = new.groupBy(*by).agg(F.max(F.struct(*lead, *[c for c in rest if c not in lead])).alias("__tw_row"))
        return one.select(*[F.col(c) if c in by else F.col(f"__tw_row.{c}").alias(c) for c in source.columns])

    def _publish(self, head: dict, rows: DataFrame) -> dict | None:
        """Write ``rows`` under names of their own and publish them as the next version; None if another run published first."""
        number, run = head["version"] + 1, uuid.uuid4().hex[:12]
        part = f"part-{number:06d}-{run}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{part}")
        files, held = [*head["files"], part], None
        if len(files) > COMPACT_PARTS:
            whole = f"whole-{number:06d}-{run}"
            self._read(files, self.schema).write.parquet(f"{self.path}/{whole}")
            files = [whole]
        if self.every:
            held = f"held-{number:06d}-{run}"
            added = self._fold(self._read([part], self.schema))
            both = self.held(head).unionAll(added).groupBy(*self.keys).agg(F.max("__tw_held").alias("__tw_held")) if head["version"] else added
            both.write.parquet(f"{self.path}/{held}")
        version = {"version": number, "files": files, "held": held, "part": part}
        return version if put_if_absent(self.spark, f"{self.path}/_versions/{number:09d}.json", json.dumps(version).encode()) else None

    def adopt(self, rows: DataFrame) -> dict:
        """Publish rows that earlier runs are known to have applied (keys and version; other columns of the schema may be missing and are null)."""
        full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        while (version := self._publish(self.head(), full)) is None:
            pass
        return version

    def run(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict:
        """One run: pending records through ``transform`` (row-wise; keeps keys and version) into the next target version, which is returned."""
        while True:
            head = self.head()
            version = self._publish(head, transform(self.pending(source, head)))
            if version is not None:
                return version
