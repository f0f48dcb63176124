"""K-slack over a stream: provisional counts while records are buffered, final ones in event-time order when they are released.

period_counts() leaves the buffering to Spark's own state: a windowed aggregate in update mode publishes each period's provisional value again whenever
a late record corrects it, and one in append mode publishes the final value once the watermark (the greatest event time seen less K) has passed
the period. Records later than that are left out. Copies of a record are dropped while they are within K.

released() is for aggregates that depend on order: it buffers the records themselves, releases them sorted once the watermark reaches
them, and tells meanwhile how many are buffered.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admitted(stream: DataFrame, ts: str, slack: str, identity: list[str] | None = None) -> DataFrame:
    """The stream with its watermark; with ``identity``, each record once. Times without zone are read as the session's zone."""
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, slack)
    return out.dropDuplicatesWithinWatermark(identity) if identity else out


def period_counts(stream: DataFrame, ts: str, slack: str, period: str, keys: list[str], identity: list[str] | None = None) -> DataFrame:
    """Counts per key and period: keys, period_start, n, first_ts, last_ts. Write it in update mode for provisional values, in append mode for final ones."""
    rows = admitted(stream, ts, slack, identity)
    out = rows.groupBy(*keys, F.window(ts, period).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.select(*keys, F.col("w.start").alias("period_start"), "n", "first_ts", "last_ts")


def released(stream: DataFrame, ts: str, slack: str, key: str, payload: str) -> DataFrame:
    """Records of each key in the order of event time (ties by payload), as the watermark releases them: kind, key, position, ts_ms, payload, n_buffered.

    kind 'final' is a released record, with its position among all of its key from 1 on; kind 'provisional' follows each batch of a key with how many
    records are buffered (n_buffered; position and payload null, ts_ms the greatest of them). Records at or below the watermark when they arrive are
    left out. ``key`` and ``payload`` are text columns. The state of a key is its records of one slack; a key should not be hot beyond what one task buffers.
    """
    rows = admitted(stream, ts, slack).select(F.col(key).alias("key"), ts, F.unix_millis(ts).alias("ts_ms"), F.col(payload).alias("payload"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, position = state.get if state.exists else (pickle.dumps([]), 0)
        buffered, now = pickle.loads(raw), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for batch in batches:
                buffered += [(int(t), p) for t, p in zip(batch["ts_ms"], batch["payload"]) if t > now]
        out = sorted(r for r in buffered if r[0] <= now)
        rest = [r for r in buffered if r[0] > now]
        found = [("final", name[0], position + k, t, p, None) for k, (t, p) in enumerate(out, 1)]
        found.append(("provisional", name[0], None, max((t for t, _ in rest), default=None), None, len(rest)))
        state.update((pickle.dumps(rest), position + len(out)))
        if rest:
            state.setTimeoutTimestamp(min(t for t, _ in rest) + 1)
        columns = ["kind", "key", "position", "ts_ms", "payload", "n_buffered"]
        yield pd.DataFrame(found, columns=columns).astype({"position": "Int64", "ts_ms": "Int64", "n_buffered": "Int64"})

    schema = "kind string, key string, position bigint, ts_ms bigint, payload string, n_buffered bigint"
    return rows.groupBy("key").applyInPandasWithState(step, schema, "buffer binary, position bigint", "append", GroupStateTimeout.EventTimeTimeout)
