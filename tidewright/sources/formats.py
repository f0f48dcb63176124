"""Reading and writing of batches: Parquet with a declared schema, Arrow, JSON and Kafka streams, generated logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.types import InvalidInput


def read_parquet(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """Files of one declared schema; no inference, no merging by name. No paths give no rows."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_arrow(spark: SparkSession, stream: bytes) -> DataFrame:
    """The batches of an Arrow IPC stream; bytes that are none raise InvalidInput."""
    try:
        table = pa.ipc.open_stream(stream).read_all()
    except (pa.ArrowInvalid, OSError) as error:
        raise InvalidInput(f"not an Arrow stream: {error}") from error
    return spark.createDataFrame(table)


def json_stream(spark: SparkSession, schema: str, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The values of a topic as text, with Kafka's own position columns. Needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.options(**options).load().selectExpr("CAST(value AS STRING) AS request", "topic", "partition AS topic_partition", "offset")


def generated_logs(spark: SparkSession, n: int, incarnation: str) -> DataFrame:
    """n log records numbered from 0, as a load generator sends them: the number is the time in nanoseconds."""
    i = F.col("id")
    attrs = F.concat(F.lit('{"loadgen.index":"' + incarnation + '-'), i.cast("string"), F.lit('"}'))
    return spark.range(n).select(F.timestamp_micros(F.floor(i / 1000)).cast("timestamp_ntz").alias("ts"), F.lit(9).alias("severity_number"), F.lit("INFO").alias("severity_text"), F.concat(F.lit("loadgen record "), i.cast("string")).alias("body"), attrs.alias("attrs"))


def write_sorted_parts(df: DataFrame, path: str, by: str, order: list[str], placed: bool = False) -> None:
    """One folder ``__part=<value>`` with one sorted file per value of ``by``, all written by one job.

    A part is one window of one partition, bounded by the landing's window and byte budget, so one task may hold it. ``placed``: the rows of a
    value are in one task already, and aren't moved again.
    """
    parts = df.withColumn("__part", F.col(by))
    parts = (parts if placed else parts.repartition("__part")).sortWithinPartitions("__part", *order)
    parts.write.mode("errorifexists").partitionBy("__part").parquet(path)
