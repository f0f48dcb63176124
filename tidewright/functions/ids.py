"""Keys and hashes: de-duplication keys, hex identifiers, rendezvous scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of FNV-1a with 64 bits, and the byte between the two names that are hashed.
FNV_BASIS, FNV_PRIME, SEPARATOR = 0xCBF29CE484222325, 0x00000100000001B3, 0xFF


def hex_id(c: Column) -> Column:
    """Lower-case hex of bytes; null for empty ones."""
    return F.when(F.octet_length(c) > 0, F.lower(F.hex(c)))


def dedup_key(token: Column, payload: Column) -> Column:
    """``t:`` and the client's token, else ``h:`` and the SHA-256 of the payload. An empty token is a token."""
    return F.when(token.isNotNull(), F.concat(F.lit("t:"), token)).otherwise(F.concat(F.lit("h:"), F.sha2(payload, 256)))


def fnv1a(data: bytes, state: int = FNV_BASIS) -> int:
    for byte in data:
        state = ((state ^ byte) * FNV_PRIME) % 2**64
    return state


def rendezvous_score(partition: str, node: str) -> int:
    return fnv1a(partition.encode() + bytes([SEPARATOR]) + node.encode())


@F.pandas_udf(T.DecimalType(20, 0))
def rendezvous_scores(partition: pd.Series, node: pd.Series) -> pd.Series:
    """Unsigned 64-bit scores, byte position by byte position over the whole batch."""
    from decimal import Decimal

    texts = [p.encode() + bytes([SEPARATOR]) + n.encode() for p, n in zip(partition, node)]
    state = np.full(len(texts), FNV_BASIS, np.uint64)
    width = max(map(len, texts), default=0)
    grid = np.zeros((len(texts), width), np.uint64)
    for k, t in enumerate(texts):
        grid[k, : len(t)] = np.frombuffer(t, np.uint8)
    sizes = np.array([len(t) for t in texts])
    for k in range(width):
        on = sizes > k
        state[on] = (state[on] ^ grid[on, k]) * np.uint64(FNV_PRIME)
    return pd.Series([Decimal(int(x)) for x in state])


def ranked_nodes(partitions: DataFrame, nodes: list[str], replicas: int) -> DataFrame:
    """partition, node, rank: each partition's ``replicas`` nodes by descending score, ties to the greater name; rank 1 owns.

    ``nodes`` is the cluster's membership, a short list; every partition becomes ``len(nodes)`` rows within its task, without a join.
    """
    names = F.explode(F.array(*[F.lit(n) for n in sorted(set(nodes))])) if nodes else F.explode(F.array().cast("array<string>"))
    scored = partitions.select("partition").where("partition is not null").distinct().select("partition", names.alias("node")).withColumn("score", rendezvous_scores("partition", "node"))
    order = Window.partitionBy("partition").orderBy(F.desc("score"), F.desc("node"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= replicas).select("partition", "node", "rank")
