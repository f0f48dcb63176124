"""Overload ladder: rung, retry delay and query budget of a fill measure, in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ladder's percentages, the retry delay's ends in ms, the greatest factor of the query budget.
DISCLOSE, THROTTLE, REFUSE = 80, 95, 100
RETRY_MIN_MS, RETRY_MAX_MS = 1_000, 30_000
MAX_SCALE = 2

_WIDE = "decimal(38,0)"


def _permille(staged: Column, capacity: Column) -> Column:
    # integral division: a quotient of decimals would be rounded first
    return F.call_function("div", (staged.cast("decimal(20,0)") * 1000).cast(_WIDE), capacity.cast(_WIDE)).cast("decimal(20,0)")


def rung(staged: Column, capacity: Column, drain_stalled: Column) -> Column:
    """normal, staging_pressure or drain_stalled, throttling, refusing_ingest. No capacity means refusing."""
    at = lambda p: staged.cast(_WIDE) * 100 >= capacity.cast(_WIDE) * p
    out = F.when(capacity == 0, "refusing_ingest").when(at(REFUSE), "refusing_ingest").when(at(THROTTLE), "throttling")
    return out.when(at(DISCLOSE) & drain_stalled, "drain_stalled").when(at(DISCLOSE), "staging_pressure").otherwise("normal")


def retry_delay_ms(staged: Column, capacity: Column) -> Column:
    """Linear between the throttling and the refusing rung, the ends outside."""
    band = (REFUSE - THROTTLE) * 10
    position = F.least(F.greatest(_permille(staged, capacity) - THROTTLE * 10, F.lit(0)), F.lit(band)).cast("bigint")
    return F.when(capacity == 0, F.lit(RETRY_MAX_MS)).otherwise(F.lit(RETRY_MIN_MS) + F.floor(position * (RETRY_MAX_MS - RETRY_MIN_MS) / band)).cast("bigint")


def scaled_budget(base: Column, staged: Column, capacity: Column) -> Column:
    """The byte budget of a query: the base up to the disclosing rung, then growing linearly to twice the base at full."""
    band = (REFUSE - DISCLOSE) * 10
    position = F.least(F.greatest(_permille(staged, capacity) - DISCLOSE * 10, F.lit(0)), F.lit(band))
    extra = F.floor(base.cast("decimal(20,0)") * (MAX_SCALE - 1) * position.cast("decimal(5,0)") / band).cast("bigint")
    return F.when(capacity == 0, base).otherwise(base + extra).cast("bigint")


def scaled_budget_value(base: int, staged: int, capacity: int) -> int:
    """scaled_budget() of plain numbers, for guards on the driver."""
    if capacity == 0:
        return base
    band = (REFUSE - DISCLOSE) * 10
    return base + base * (MAX_SCALE - 1) * min(max(staged * 1000 // capacity - DISCLOSE * 10, 0), band) // band
