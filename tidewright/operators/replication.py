"""Decisions about replicas as relations over log tables: receipts, applies, fences, holders, takeovers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.ids import ranked_nodes
from tidewright.operators.ranges import subtract_ranges

PO = ["partition", "origin"]


def ack_ready(batches: DataFrame, receipts: DataFrame, replicas: int) -> DataFrame:
    """Batches (partition, origin, last_seq) with the number of other holders whose receipts reach them, and whether a client may be answered."""
    reach = receipts.groupBy(*PO, "holder").agg(F.max("replicated_thru").alias("thru")).withColumnsRenamed({"partition": "rp", "origin": "ro"})
    joined = batches.join(reach, (F.col("partition") == F.col("rp")) & (F.col("origin") == F.col("ro")) & (F.col("thru") >= F.col("last_seq")) & (F.col("holder") != F.col("origin")), "left")
    out = joined.groupBy(*batches.columns).agg(F.count_distinct("holder").alias("holders"))
    return out.withColumn("ready", F.col("holders") >= replicas - 1)


def apply_outcomes(forwards: DataFrame, applied: DataFrame, fences: DataFrame, node: str, records: DataFrame | None = None) -> DataFrame:
    """The outcome of each forwarded range at ``node``: forwards (partition, origin, incarnation, first_seq, last_seq) against applied marks and fences.

    Outcomes in order of precedence: invalid_range, self_origin_refused, fenced, duplicate_acked or suspect_duplicate, gap_refused, applied. A range that
    straddles the mark is refused like a gap. ``records`` (partition, origin, seq) are those that the node holds; a range below the mark
    whose last record isn't among them is suspect. Without them every such range is a duplicate.
    """
    marks = applied.groupBy(*PO).agg(F.max("applied_seq").alias("mark"))
    fence = fences.groupBy(F.col("node").alias("origin")).agg(F.max("incarnation").alias("newest"))
    thru = F.coalesce("mark", F.lit(0))
    columns, has = forwards.columns, F.lit(True)
    if records is not None:
        held = records.select(F.col("partition").alias("h_p"), F.col("origin").alias("h_o"), F.col("seq").alias("h_s")).distinct().withColumn("has", F.lit(True))
        forwards = forwards.join(held, (F.col("partition") == F.col("h_p")) & (F.col("origin") == F.col("h_o")) & (F.col("last_seq") == F.col("h_s")), "left").drop("h_p", "h_o", "h_s")
        has = F.coalesce("has", F.lit(False))
    out = (
        F.when(F.col("first_seq") > F.col("last_seq"), "invalid_range")
        .when(F.col("origin") == node, "self_origin_refused")
        .when(F.col("incarnation") < F.col("newest"), "fenced")
        .when(F.col("last_seq") <= thru, F.when(has, "duplicate_acked").otherwise("suspect_duplicate"))
        .when(F.col("first_seq") != thru + 1, "gap_refused")
        .otherwise("applied")
    )
    return forwards.join(marks, PO, "left").join(fence, "origin", "left").select(*columns, out.alias("outcome"))


def admitted_incarnations(requests: DataFrame) -> DataFrame:
    """Requests (node, incarnation, seq) with whether the fence admits them: no newer incarnation of the node came before."""
    before = Window.partitionBy("node").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("admitted", F.col("incarnation") >= F.max("incarnation").over(before))


def holders(owed: DataFrame, candidates: DataFrame) -> DataFrame:
    """One holder per owed partition (partition, through): the owner if it is there, else the one that replicated furthest and far enough.

    ``candidates`` has partition, node, is_owner, replicated_thru. Ties go to the greater node. A partition nobody covers has a null holder.
    """
    able = owed.join(candidates, "partition", "left").where(F.col("node").isNull() | F.col("is_owner") | (F.col("replicated_thru") >= F.col("through")))
    best = able.groupBy("partition").agg(F.max_by("node", F.struct("is_owner", "replicated_thru", "node")).alias("holder"))
    return owed.join(best, "partition", "left")


def takeovers(partitions: DataFrame, before: list[str], after: list[str], replicas: int) -> DataFrame:
    """Partitions whose owner changes with the membership: partition, old_owner, new_owner."""
    old = ranked_nodes(partitions, before, replicas).where("rank = 1").select("partition", F.col("node").alias("old_owner"))
    new = ranked_nodes(partitions, after, replicas).where("rank = 1").select("partition", F.col("node").alias("new_owner"))
    return old.join(new, "partition", "full").where(~F.col("old_owner").eqNullSafe(F.col("new_owner")))


def residue(window_coverage: DataFrame, winner_coverage: DataFrame) -> DataFrame:
    """What a window holds beyond what the winner committed: ranges per (partition, origin)."""
    return subtract_ranges(window_coverage, winner_coverage, PO)


def claims(journal: DataFrame) -> DataFrame:
    """Distinct advertised claims (partition, node)."""
    return journal.where(F.col("event") == "ClaimAdvertise").select("partition", "node").distinct()
