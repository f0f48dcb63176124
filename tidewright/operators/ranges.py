"""Algebra of sequence ranges per (partition, origin): runs, gaps, subtraction, overlap, containment, contiguous prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.intervals import coalesce_ranges
from tidewright.operators.prefix import DIGIT, axis_bits, prefix_sums
from tidewright.session import materialise

KEYS = ("partition", "origin")


def _present(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Numbered rows by their block of 2**16 numbers; those that number nothing are left out."""
    ok = (F.col(seq) >= 1) & F.col(seq).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return rows.where(ok).select(*keys, F.col(seq).alias("__tw_n"), F.shiftright(seq, DIGIT).alias("__tw_block"))


def coverage_runs(rows: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Maximal contiguous runs of the sequence numbers present, before any de-duplication: keys, first_seq, last_seq.

    Runs are found within blocks of 2**16 numbers, by one shuffle of the rows; then the at most two runs of a block that touch its
    ends are joined over blocks, so no key's rows are sorted in one task. Nulls and numbers below 1 are no numbers.
    """
    inside = Window.partitionBy(*keys, "__tw_block").orderBy("__tw_n")
    island = F.col("__tw_n") - F.dense_rank().over(inside)
    blocks = _present(rows, keys, seq).withColumn("__tw_i", island).groupBy(*keys, "__tw_block", "__tw_i").agg(F.min("__tw_n").alias("first_seq"), F.max("__tw_n").alias("last_seq"))
    size = F.lit(1 << DIGIT)
    touches = (F.pmod("first_seq", size) == 0) | (F.pmod(F.col("last_seq") + 1, size) == 0)
    # a run at a block's end may go on in the next; all others are whole
    order = Window.partitionBy(*keys, "__tw_edge").orderBy("first_seq")
    marked = blocks.select(*keys, "first_seq", "last_seq", touches.alias("__tw_touches"), F.when(touches, -1).otherwise(F.col("__tw_block")).alias("__tw_edge"))
    begins = F.when(F.col("first_seq") == F.lag("last_seq").over(order) + 1, 0).otherwise(1)
    chains = marked.withColumn("__tw_new", begins).withColumn("__tw_c", F.sum("__tw_new").over(order))
    return chains.groupBy(*keys, "__tw_edge", "__tw_c").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")).drop("__tw_edge", "__tw_c")


def coverage_gaps(rows: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Missing numbers from 1 to the greatest present one, as ranges. A block's first number is compared with the last one of earlier blocks."""
    found = _present(rows, keys, seq)
    inside = Window.partitionBy(*keys, "__tw_block").orderBy("__tw_n")
    within = found.select(*keys, F.lag("__tw_n").over(inside).alias("p"), "__tw_n").where("p is not null")
    blocks = found.groupBy(*keys, "__tw_block").agg(F.min("__tw_n").alias("__tw_n"), F.max("__tw_n").alias("top"))
    before = F.coalesce(F.lag("top").over(Window.partitionBy(*keys).orderBy("__tw_block")), F.lit(0))
    both = within.unionAll(blocks.select(*keys, before.alias("p"), "__tw_n"))
    return both.where("__tw_n > p + 1").select(*keys, (F.col("p") + 1).alias("first_seq"), (F.col("__tw_n") - 1).alias("last_seq"))


def union_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges merged where they overlap or adjoin."""
    return coalesce_ranges(ranges, keys, "first_seq", "last_seq").where("kind = 'run'").drop("kind")


def subtract_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What of ``a`` is not in ``b``: a sweep over both sides' ends. Sides may overlap within themselves; invalid ranges count for nothing.

    How many ranges of each side are open at an end are prefix sums over blocks of 2**16 positions, so a key with any share of all ends
    is swept by many tasks; the pieces that are left are merged where they adjoin.
    """
    def ends(df: DataFrame, side: str) -> DataFrame:
        ok = df.where("first_seq >= 1 and last_seq >= first_seq")
        each = F.array(F.struct(F.col("first_seq").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("last_seq") + 1).alias("pos"), F.lit(-1).alias("d")))
        steps = ok.select(*keys, F.inline(each))
        return steps.select(*keys, "pos", *[(F.col("d") if s == side else F.lit(0)).alias(s) for s in ("a", "b")])

    known = " and ".join(f"{k} is not null" for k in keys)
    # both depths in one number: a's in the upper half
    depth = F.shiftleft(F.sum("a"), 32) + F.sum("b")
    steps = materialise(ends(a, "a").unionAll(ends(b, "b")).where(known).groupBy(*keys, "pos").agg(depth.alias("d")), "ends")
    swept = prefix_sums(steps, keys, "pos", "d", "open", axis_bits(steps, "pos")).withColumn("open", F.col("open") + F.col("d"))
    # the next end: within the block, else the least one of a later block
    rows = swept.withColumn("__tw_block", F.shiftright("pos", DIGIT))
    inside = Window.partitionBy(*keys, "__tw_block").orderBy("pos")
    local = rows.withColumn("next", F.lead("pos").over(inside))
    firsts = rows.groupBy(*keys, "__tw_block").agg(F.min("pos").alias("least"))
    later = firsts.withColumn("after", F.lead("least").over(Window.partitionBy(*keys).orderBy("__tw_block"))).drop("least")
    state = local.join(later, [*keys, "__tw_block"]).withColumn("next", F.coalesce("next", "after"))
    in_b = F.col("open").bitwiseAND(F.lit(2**32 - 1))
    left = state.where((F.col("open") >= F.lit(2**32)) & (in_b == 0) & F.col("next").isNotNull()).select(*keys, F.col("pos").alias("first_seq"), (F.col("next") - 1).alias("last_seq"))
    return union_ranges(left, keys)


def reached(rows: DataFrame, at: Column, ranges: DataFrame, keys: Sequence[str], out: str = "__tw_reach", value: Column | None = None) -> DataFrame:
    """``rows`` with ``out``: the greatest end (or ``value``) of the ranges of the same key that begin at or before ``at`` (null if there are none).

    Linear: both sides are cut into blocks of 2**16 positions, each block begins with the greatest end carried over from earlier ones, and
    one ordered pass per (key, block) finds the rest; a hot key is spread over its blocks, and no row meets every range of its key. Invalid ranges and
    nulls reach nothing.
    """
    ok = F.col("first_seq").isNotNull() & (F.col("last_seq") >= F.col("first_seq"))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    block = lambda c: F.shiftright(c, DIGIT)
    starts = ranges.where(ok).groupBy(*keys, F.col("first_seq").alias("__tw_at")).agg(F.max(F.col("last_seq") if value is None else value).alias("__tw_end")).withColumn("__tw_block", block("__tw_at"))
    left = rows.withColumn("__tw_at", at).withColumn("__tw_block", block("__tw_at"))
    tops = starts.groupBy(*keys, "__tw_block").agg(F.max("__tw_end").alias("__tw_top"))
    wanted = left.where("__tw_block is not null").select(*keys, "__tw_block").distinct().withColumn("__tw_want", F.lit(True))
    before = Window.partitionBy(*keys).orderBy("__tw_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.join(wanted, [*keys, "__tw_block"], "full").withColumn("__tw_end", F.max("__tw_top").over(before)).where("__tw_want and __tw_end is not null")
    row = F.struct(*[F.col(c) for c in rows.columns])
    none = F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType)
    cols = [*keys, "__tw_block"]
    both = starts.select(*cols, "__tw_at", F.lit(0).alias("__tw_side"), "__tw_end", none.alias("__tw_row"))
    both = both.unionAll(carried.select(*cols, F.lit(None).cast("bigint"), F.lit(0), "__tw_end", none))
    both = both.unionAll(left.select(*cols, F.col("__tw_at").cast("bigint"), F.lit(1), F.lit(None).cast(starts.schema["__tw_end"].dataType), row))
    w = Window.partitionBy(*cols).orderBy(F.col("__tw_at").asc_nulls_first(), "__tw_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(out, F.when(F.col("__tw_at").isNotNull(), F.max("__tw_end").over(w))).where("__tw_side = 1")
    return found.select("__tw_row.*", out)


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges of ``a`` that meet some range of ``b`` of the same key: one that begins at or before their end reaches their begin."""
    return reached(a, F.col("last_seq"), b, keys).where(F.col("__tw_reach") >= F.col("first_seq")).drop("__tw_reach")


def contained(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges of ``a`` that lie within one range of ``b`` of the same key: one that begins at or before them reaches their end."""
    return reached(a, F.col("first_seq"), b, keys).where(F.col("__tw_reach") >= F.col("last_seq")).drop("__tw_reach")


def covered(rows: DataFrame, coverage: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", keep: bool = True) -> DataFrame:
    """Rows whose number lies in a range of ``coverage`` (or, with ``keep`` false, in none). No ranges cover nothing."""
    inside = F.coalesce(F.col("__tw_reach") >= F.col(seq), F.lit(False))
    return reached(rows, F.col(seq), coverage.where("first_seq >= 1"), keys).where(inside if keep else ~inside).drop("__tw_reach")


def covered_count(rows: DataFrame, at: Column, ranges: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``rows`` with ``out``: how many numbers up to ``at`` the ranges of the same key hold. Ranges must be disjoint (union_ranges())."""
    length = ranges.select(*keys, "first_seq", "last_seq", (F.col("last_seq") - F.col("first_seq") + 1).alias("__tw_len"))
    summed = prefix_sums(length, keys, "first_seq", "__tw_len", "__tw_before", axis_bits(length, "first_seq"))
    last = F.struct("first_seq", "last_seq", "__tw_before")
    found = reached(rows.withColumn("__tw_pos", at), F.col("__tw_pos"), summed, keys, "__tw_last", last)
    n = F.col("__tw_last.__tw_before") + F.least("__tw_pos", "__tw_last.last_seq") - F.col("__tw_last.first_seq") + 1
    return found.withColumn(out, F.when(F.col("__tw_last").isNotNull(), n).otherwise(0)).drop("__tw_last", "__tw_pos")


def coverage_predicate(ranges: list[tuple[str, int, int]]) -> Column:
    """The same for a short literal list of (origin, first, last), as a predicate that reaches the scan."""
    out = F.lit(False)
    for origin, first, last in ranges:
        out = out | ((F.col("origin") == origin) & F.col("seq").between(first, last))
    return out


def applied_through(rows: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """The end of the contiguous prefix 1..t of each key; keys without number 1 have 0."""
    runs = coverage_runs(rows, keys, seq)
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("first_seq") == 1, F.col("last_seq"))), F.lit(0)).alias("applied_seq"))
