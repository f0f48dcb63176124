"""Session construction and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.sources.atomic import remove

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass your own session to every function instead."""
    conf = LOCAL_DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidewright")
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a single-machine session may lack it; it then gets a temporary one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a written table in the shared folder (checkpoint() would compute it twice)."""
    return materialise(df, "cut")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, columnar, safe from lost executors.

    The files belong to the run and stay until the folder's owner clears it (a temporary folder goes with the process).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Deletes a query's shuffle files as it ends. Without it they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """What one call keeps on disk while it runs: ``table()`` is materialise(), but the files go when the call is over, or by ``free()``.

    Queries that are built within the call delete their shuffle files as they end, so nothing that is built in it should be run twice (it would
    shuffle again) or read after it.
    """

    _lock = threading.Lock()
    #: Calls that run, and the setting that they found, by session.
    _running: dict[str, tuple[int, str]] = {}

    def __init__(self, spark: SparkSession):
        self.spark, self._session, self._paths = spark, spark._jsparkSession.sessionUUID(), {}

    def __enter__(self) -> Scratch:
        with self._lock:
            n, found = self._running.get(self._session) or (0, self.spark.conf.get(_CLEANUP, "false"))
            self._running[self._session] = (n + 1, found)
            self.spark.conf.set(_CLEANUP, "true")
        return self

    def __exit__(self, *_: object) -> None:
        with self._lock:
            n, found = self._running.pop(self._session)
            if n > 1:
                self._running[self._session] = (n - 1, found)
            else:
                self.spark.conf.set(_CLEANUP, found)
        self.free(*self._paths)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._paths[name] = path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self._paths.pop(name))


def parallelism(spark: SparkSession) -> int:
    """Tasks to plan for: at least the shuffle partitions, at least the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
