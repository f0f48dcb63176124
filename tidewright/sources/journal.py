"""NDJSON journals and the other inputs of the audits, with explicit schemas: a malformed line fails the run."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The journal's line, the read log's and the fault ledger's.
JOURNAL = (
    "node string, seq bigint, event string, request_id string, tenant string, record_count bigint, first_index bigint, source_incarnation string, partition string, "
    "max_event_time_ms bigint, complete_through_ms bigint, dataset string, changelog_key string, origin string, changelog_seq bigint, tombstone boolean, value string, "
    "part string, part_kind string, dataset_kind string, origin_coverage array<struct<origin:string,first_seq:bigint,last_seq:bigint>>"
)
READ_LOG = (
    "tenant string, partition string, concern string, outcome string, complete_through_ms bigint, record_keys array<string>, query string, serving_node string, "
    "residency_ops_before bigint, residency_ops_after bigint, latency_ms bigint"
)
FAULTS = "fault_id string, kind string, target_node string, phase string, at_ms bigint, detail map<string,string>"


def read_ndjson(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines of one schema; unknown fields are ignored, a line that is no JSON object of it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_journal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_ndjson(spark, path, JOURNAL)


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_ndjson(spark, path, READ_LOG)


def fault_windows(faults: DataFrame) -> DataFrame:
    """One row per fault from its armed, started and ended lines: fault_id, kind, target_node, armed_ms, started_ms, ended_ms."""
    at = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("at_ms"))).alias(f"{phase}_ms")
    return faults.groupBy("fault_id").agg(F.max("kind").alias("kind"), F.max("target_node").alias("target_node"), at("armed"), at("started"), at("ended"))


class JournalWriter:
    """One flushed line per event, numbered densely per node; reopening continues the numbers."""

    def __init__(self, path: str, node: str):
        self.node, self.seq = node, 0
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as old:
                self.seq = sum(1 for line in old if json.loads(line)["node"] == node)
        self._out = open(path, "a", encoding="utf-8")  # noqa: SIM115

    def write(self, event: str, **fields) -> int:
        line = {"node": self.node, "seq": self.seq, "event": event} | {k: v for k, v in fields.items() if v is not None}
        self._out.write(json.dumps(line, ensure_ascii=False) + "\n")
        self._out.flush()
        self.seq += 1
        return self.seq - 1

    def write_all(self, lines: Iterable[tuple[str, dict]]) -> None:
        for event, fields in lines:
            self.write(event, **fields)

    def close(self) -> None:
        self._out.close()
