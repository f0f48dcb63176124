"""Connected components over edge lists, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.skew import fragment_join
from tidewright.session import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("m").alias("u"), F.col("u").alias("m")))
    least = both.groupBy("u").agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("__tw_load"))
    joined = fragment_join(both, least.drop("__tw_load"), ["u"], ["m"], "inner", loads=least)
    return joined.where(F.col("m") > F.col("u")).select(F.col("m").alias("u"), F.least("low", "u").alias("m"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("__tw_load"))
    joined = fragment_join(edges, least.drop("__tw_load"), ["u"], ["m"], "inner", loads=least)
    moved = joined.where(F.col("m") != F.col("low")).select(F.col("m").alias("u"), F.col("low").alias("m"))
    return moved.unionAll(least.select("u", F.col("low").alias("m")))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has one: then the roots are final (one scalar row)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child")), F.struct(F.col("m").alias("x"), F.lit(0).alias("child")))).alias("e")).select("e.*")
    nodes = ends.groupBy("x").agg(F.sum("child").alias("roots"), F.count_if(F.col("child") == 0).alias("leaves"))
    bad = (F.col("roots") > 1) | ((F.col("roots") > 0) & (F.col("leaves") > 0))
    return nodes.agg(F.count_if(bad)).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """Roots of the nodes of ``edges`` (u, m: bigint): columns u, m, one row per node that is not its component's least node.

    Self-loops and repeated edges change nothing. Each round is cut by a checkpoint; the rounds are logarithmic in a
    component's size, and the loop ends once the edges are stars.
    """
    now = cut(edges.select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("m")).where(F.col("u") != F.col("m")).distinct())
    for _ in range(MAX_ROUNDS):
        if _is_forest_of_stars(now):
            return now
        now = cut(_small_star(_large_star(now).distinct()).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
