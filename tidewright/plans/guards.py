"""Guards of served queries: only reads, at most so many at once, so many bytes and so long. A tripped guard raises; nothing is truncated."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.ladder import scaled_budget_value
from tidewright.session import materialise
from tidewright.types import ByteBudgetExceeded, DeadlineExceeded, NotASelect, Overloaded

#: Names of plan nodes that do something besides reading.
_WRITES = ("Command", "InsertInto", "CreateTable", "CreateView", "CreateNamespace", "CreateFunction", "CreateVariable", "DropTable", "DropView", "MergeInto", "DeleteFrom", "UpdateTable", "ReplaceTable", "AlterTable", "SetVariable", "CompoundBody", "Truncate", "LoadData", "CacheTable", "RefreshTable", "WriteTo", "OverwriteBy", "AppendData")


def _nodes(node) -> Iterator:
    yield node
    for group in (node.children(), node.innerChildren()):
        for k in range(group.size()):
            child = group.apply(k)
            if hasattr(child, "innerChildren"):
                yield from _nodes(child)


def check_select(spark: SparkSession, text: str) -> None:
    """Refuse anything but a query. The whole parsed plan is walked: neither its first word nor its root tells."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(text)
    except Exception as error:
        raise NotASelect(f"not parsed: {str(error).splitlines()[0]}") from error
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if any(w in name for w in _WRITES) or node.getClass().getName().startswith("org.apache.spark.sql.execution.command"):
            raise NotASelect(f"{name} is not a read")


def bound_schema(spark: SparkSession, text: str) -> T.StructType:
    """The schema of a query's result, without running it."""
    check_select(spark, text)
    return spark.sql(text).schema


class Guards:
    """Limits of one server process."""

    def __init__(self, max_bytes: int = 2 * 2**30, deadline_s: float = 30.0, concurrent: int = 8):
        self.max_bytes, self.deadline_s = max_bytes, deadline_s
        self._slots = threading.Semaphore(concurrent)

    @contextmanager
    def slot(self) -> Iterator[None]:
        """A query's place; none free raises at once."""
        if not self._slots.acquire(blocking=False):
            raise Overloaded("too many queries at once")
        try:
            yield
        finally:
            self._slots.release()

    def budget(self, staged: int = 0, capacity: int = 0) -> int:
        """The byte budget, raised while the landing fills up."""
        return scaled_budget_value(self.max_bytes, staged, capacity)

    def fetch(self, df: DataFrame, staged: int = 0, capacity: int = 0) -> pa.Table:
        """The result as Arrow, or ByteBudgetExceeded or DeadlineExceeded.

        The executors write it in packed batches with their sizes to the shared folder, in one interruptible job; only a result
        whose sizes sum to no more than the budget is then brought to the driver.
        """
        sc, group, late = df.sparkSession.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()
        budget = self.budget(staged, capacity)

        done = threading.Event()

        def watch() -> None:
            if not done.wait(self.deadline_s):
                late.set()
                while not done.is_set():  # again and again: the job may only be about to start
                    sc.cancelJobGroup(group)
                    done.wait(0.2)

        watcher = threading.Thread(target=watch, daemon=True)
        with self.slot():
            # the group is the calling thread's; tasks are interrupted, not only told to stop
            sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
            watcher.start()
            try:
                return self._collect(df, budget, late)
            except (ByteBudgetExceeded, DeadlineExceeded):
                raise
            except Exception as error:
                if late.is_set():
                    raise DeadlineExceeded(f"not done after {self.deadline_s} s") from error
                raise
            finally:
                done.set()
                watcher.join()
                for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                    sc.setLocalProperty(key, None)

    @staticmethod
    def _collect(df: DataFrame, budget: int, late: threading.Event) -> pa.Table:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64()), "ipc": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        kept = materialise(df.mapInArrow(packed, "n bigint, ipc binary"), "result")
        total = kept.agg(F.sum("n")).first()[0] or 0
        if late.is_set():
            raise DeadlineExceeded("interrupted")
        if total > budget:
            raise ByteBudgetExceeded(f"{total} bytes, more than {budget}")
        tables = [pa.ipc.open_stream(row["ipc"]).read_all() for row in kept.select("ipc").toLocalIterator()]
        return pa.concat_tables(tables) if tables else pa.Table.from_pandas(df.limit(0).toPandas())
