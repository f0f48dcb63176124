"""Names of partitions and sealed parts: pure functions of identity, so that every retry writes the same object."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tenant's characters and length, the tenant of requests without one.
TENANT_PATTERN = r"^[A-Za-z0-9.-][A-Za-z0-9._-]{0,149}$"
ANONYMOUS = "anonymous"


def partition_id(tenant: Column, shard: Column) -> Column:
    """``tenant.shard``."""
    return F.concat_ws(".", tenant, shard.cast("string"))


def key_shard(keys: list[str], shards: int) -> Column:
    """The shard of a changelog key."""
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


def resolved_tenant(header: Column) -> Column:
    """The header, or the anonymous tenant where there is none. An empty header stays empty, and is invalid."""
    return F.coalesce(header, F.lit(ANONYMOUS))


def tenant_is_valid(tenant: Column) -> Column:
    return F.coalesce(tenant.rlike(TENANT_PATTERN), F.lit(False))


def encode_component(raw: str) -> str:
    """Injective encoding into [a-z0-9_]: lower-case letters and digits as they are, other bytes as ``_`` and two hex digits."""
    return re.sub(rb"[^a-z0-9]", lambda m: b"_%02x" % m[0][0], raw.encode()).decode()


def encoded_component(c: Column) -> Column:
    """encode_component() of a column, without Python."""
    digits = F.lower(F.hex(F.encode(c, "UTF-8")))
    byte = F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda i: F.substring(digits, i.cast("int") * 2 + 1, F.lit(2)))
    plain = lambda h: F.decode(F.unhex(h), "UTF-8")
    keep = lambda h: h.between("61", "7a") | h.between("30", "39")
    out = F.array_join(F.transform(byte, lambda h: F.when(keep(h), plain(h)).otherwise(F.concat(F.lit("_"), h))), "")
    return F.when(F.octet_length(c) == 0, F.lit("")).otherwise(out)


def part_name(dataset: str, partition: str, window_id: int, suffix: str = "primary") -> str:
    """``dataset/partition/wN-suffix.parquet`` with encoded components."""
    return f"{encode_component(dataset)}/{encode_component(partition)}/w{window_id}-{suffix}.parquet"


def supplement_suffix(origin: str, first_seq: int, last_seq: int) -> str:
    return f"supplement-{encode_component(origin)}-{first_seq}-{last_seq}"


def snapshot_suffix(as_of_seq: int) -> str:
    return f"snapshot-{as_of_seq}"
