"""Prefix sums per key along an integer axis, without ever giving one key's whole axis to one task.

The axis is cut by its digits in base 2**16: a row's prefix sum is the sum over earlier rows in its block of 2**16
positions, plus that over earlier blocks, which is the same problem over the block numbers. As positions are distinct per
key, no window ever holds more than 2**16 rows, whatever the data; four levels cover all of 64 bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16


def prefix_sums(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, bits: int) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over rows of the same key with a smaller ``pos``.

    ``pos`` is a non-null, non-negative bigint below 2**bits and distinct per key; keys are not null; values are not null.
    """
    if bits <= DIGIT:
        before = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
    # names by level: the blocks of one level are the positions of the next
    block, total, before = f"__tw_block{bits}", f"__tw_sum{bits}", f"__tw_before{bits}"
    rows = df.withColumn(block, F.shiftright(F.col(pos), DIGIT))
    blocks = rows.groupBy(*keys, block).agg(F.sum(value).alias(total))
    offsets = prefix_sums(blocks, keys, block, total, before, bits - DIGIT)
    offsets = offsets.select(*[F.col(k).alias("__tw_o_" + k) for k in keys], F.col(block).alias("__tw_o_block"), before)
    inside = Window.partitionBy(*keys, block).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__tw_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    cond = local[block] == offsets["__tw_o_block"]
    for k in keys:
        cond = cond & (local[k] == offsets["__tw_o_" + k])
    joined = local.join(offsets, cond)
    return joined.withColumn(out, F.col("__tw_local") + F.col(before)).select(*df.columns, out)


def axis_bits(df: DataFrame, pos: str) -> int:
    """Bits that the largest ``pos`` needs, rounded up to whole digits (one scalar job)."""
    top = df.agg(F.max(pos)).first()[0] or 0
    return -(-max(int(top).bit_length(), 1) // DIGIT) * DIGIT
