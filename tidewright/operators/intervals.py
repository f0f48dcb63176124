"""Overlapping and gapped integer intervals per entity, by independently ranked starts and ends.

Sort the starts and, separately, the ends of an entity. Everything that began has ended before the (k+1)-th start exactly
if that start exceeds the k-th end; such a pair is a break: the gap lies between, a period ends before and one begins
after. Ranks are prefix sums over distinct positions (operators/prefix.py), so an entity with any share of all rows is
ranked by many tasks, and the two sides meet in a join on (entity, rank), which has one row per entity and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.prefix import axis_bits, prefix_sums
from tidewright.session import cut

_ENTITY = "__tw_entity"


def _ranked(df: DataFrame, pos: str, bits: int, start: str, end: str) -> DataFrame:
    """Distinct positions with their count ``n`` and the ranks before (``start``) and through (``end``) them."""
    counted = df.groupBy(_ENTITY, pos).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counted, [_ENTITY], pos, "n", start, bits).withColumn(end, F.col(start) + F.col("n"))


def coalesce_ranges(df: DataFrame, entity: Sequence[str], first: str, last: str, origin: int = 1) -> DataFrame:
    """Periods and gaps of the closed integer ranges [first, last] of each entity.

    Result: ``kind`` ('run' or 'gap'), the entity columns, ``first``, ``last``. Ranges that overlap or adjoin make one
    run; gaps are the uncovered stretches from ``origin`` to the entity's greatest covered position. A range with a null end or entity
    field, first < origin or last < first covers nothing. Repeated rows change nothing; an empty table gives an empty result; columns other
    than those named are ignored.
    """
    # exact duplicates first: copies of a range, however many, are combined before anything is shuffled
    ok = F.col(first).isNotNull() & F.col(last).isNotNull() & (F.col(first) >= origin) & (F.col(last) >= F.col(first))
    for c in entity:
        ok = ok & F.col(c).isNotNull()
    ranges = df.where(ok).select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(entity)]).alias(_ENTITY), (F.col(first) - origin).alias("s"), (F.col(last) - origin).alias("e")).distinct()
    ranges = cut(ranges)
    bits = axis_bits(ranges, "e")
    starts = _ranked(ranges.select(_ENTITY, "s"), "s", bits, "s_before", "s_through")
    ends = _ranked(ranges.select(_ENTITY, "e"), "e", bits, "e_before", "e_through")
    # the k-th end beside the next-ranked start; the last end has no next start, the first start no end before it
    a = starts.select(_ENTITY, F.col("s_before").alias("k"), "s")
    b = ends.select(_ENTITY, F.col("e_through").alias("k"), "e")
    total = starts.groupBy(_ENTITY).agg(F.sum("n").alias("k")).withColumn("is_last", F.lit(True))
    pairs = a.join(b, [_ENTITY, "k"], "full").join(total, [_ENTITY, "k"], "left")
    is_break = (F.col("s") > F.col("e") + 1) | ((F.col("k") == 0) & F.col("s").isNotNull()) | (F.col("is_last") & F.col("e").isNotNull())
    breaks = cut(pairs.where(is_break).select(_ENTITY, "s", "e"))
    gap_first = F.coalesce(F.col("e") + 1, F.lit(0))
    gaps = breaks.where(F.col("s").isNotNull() & (gap_first < F.col("s"))).select(F.lit("gap").alias("kind"), _ENTITY, gap_first.alias("f"), (F.col("s") - 1).alias("l"))
    # paired boundaries: the j-th period's start with the j-th period's end
    one = F.lit(1).cast("bigint")
    lows = prefix_sums(breaks.where("s is not null").select(_ENTITY, "s", one.alias("n")), [_ENTITY], "s", "n", "j", bits)
    highs = prefix_sums(breaks.where("e is not null").select(_ENTITY, "e", one.alias("n")), [_ENTITY], "e", "n", "j", bits)
    runs = lows.select(_ENTITY, "j", "s").join(highs.select(_ENTITY, "j", "e"), [_ENTITY, "j"]).select(F.lit("run").alias("kind"), _ENTITY, F.col("s").alias("f"), F.col("e").alias("l"))
    out = runs.unionAll(gaps)
    return out.select("kind", *[F.col(f"{_ENTITY}.k{i}").alias(c) for i, c in enumerate(entity)], (F.col("f") + origin).alias(first), (F.col("l") + origin).alias(last))


def manifest_coverage(manifests: DataFrame) -> DataFrame:
    """Runs and gaps of each origin's sequence numbers over all window manifests of a (dataset, partition), expired or not."""
    ranges = manifests.select("dataset", "partition", F.explode("origin_coverage").alias("r")).select("dataset", "partition", "r.origin", "r.first_seq", "r.last_seq")
    return coalesce_ranges(ranges, ["dataset", "partition", "origin"], "first_seq", "last_seq")
