"""Durations, byte sizes and the sizing formula."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.types import InvalidInput

#: Milliseconds of a duration's unit, bytes of a size's unit.
MILLIS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
BYTES = {"b": 1, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12}


def _parse(text: str, units: dict[str, int]) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    if not m or m[2].lower() not in units:
        raise InvalidInput(f"not a whole number and a unit of {', '.join(units)}: {text!r}")
    return int(m[1]) * units[m[2].lower()]


def duration_ms(text: str) -> int:
    """``15m`` is 900000."""
    return _parse(text, MILLIS)


def size_bytes(text: str) -> int:
    """``384MiB`` is 402653184."""
    return _parse(text, BYTES)


def disk_per_node(rate: Column, expansion: Column, residency_s: Column, replicas: Column, nodes: Column, staging: Column) -> Column:
    """Bytes of disk per node for an ingest rate, filled to three fifths at most."""
    return (rate * expansion * residency_s * replicas / nodes + staging) / F.lit(0.6)
