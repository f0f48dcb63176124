"""A mix of several sources by target shares of tokens, small sources repeated up to a cap.

Each source's share of the mix is turned into whole copies of all its documents, which are certain, and a remainder that is sampled
without replacement: Pareto order sampling ranks the documents by random odds divided by inclusion odds and takes
them in that order until the remainder's tokens are filled. Inclusion odds may differ by document (``weight``). The random
numbers are hashes of the document's id, so the mix is the same after lost tasks and on any cluster.

Where the order must be cut is found by prefix sums over the ranks (operators/prefix.py), never by sorting a source in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.tokens import TOKENIZER, count_tokens
from tidewright.operators.prefix import prefix_sums
from tidewright.session import materialise

#: Ranks are cut to so many bits; documents of equal rank are taken together.
RANK_BITS = 32
#: The control table is for the driver; more sources than this are refused.
MAX_SOURCES = 100_000
#: Weights are summed for the plan in classes of a factor 2**(1/16): at most some 34 000 a source, as doubles have no more.
CLASSES_PER_OCTAVE = 16


@dataclass(frozen=True)
class Share:
    """One source's part of the plan. ``factor``: copies per unit of weight, ``goal``: tokens to reach."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    goal: int
    factor: float


def _sizes(docs: DataFrame, tokenizer: str, weight: str | None) -> DataFrame:
    """doc_id, source, n_tokens, w of all documents that have tokens, a source and a positive, finite weight ``w`` (1 without ``weight``)."""
    keep = ["doc_id", "source", *([weight] if weight else [])]
    counted = count_tokens(docs, keep=keep, path=tokenizer).where("n_tokens > 0 and source is not null")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # no, negative or infinite weight: never drawn
    return materialise(counted.select("doc_id", "source", "n_tokens", w.alias("w")).where("w > 0 and w < double('infinity')"), "sizes")


def plan_mix(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[Share]:
    """What each source of ``targets`` contributes. Reads one row per source and weight class of ``sizes``.

    Sources without documents or without a positive share and cap contribute nothing, and the others' shares are scaled to sum
    to 1. Without ``total`` the mix is the largest in which every source reaches its scaled share within its cap; with it, a
    source that would need more copies than its cap gives stays at its cap. A source named more than once has the sum of its shares and the least of its caps.
    """
    rows = targets.where("source is not null").distinct().groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    wanted = {r["source"]: (float(r["share"] or 0.0), int(r["cap"] or 0)) for r in rows}
    names = sizes.sparkSession.createDataFrame([(s,) for s in wanted], "source string")
    have: dict[str, dict[int, tuple[int, float]]] = {}
    cls = F.floor(F.log2("w") * CLASSES_PER_OCTAVE).cast("int").alias("cls")
    for r in sizes.join(F.broadcast(names), "source").groupBy("source", cls).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("w") * F.col("n_tokens")).alias("wn")).collect():
        have.setdefault(r["source"], {})[r["cls"]] = (r["n"], r["wn"])
    usable = {s: (share, cap) for s, (share, cap) in wanted.items() if share > 0 and cap > 0 and s in have}
    scale = sum(share for share, _ in usable.values())
    most = [cap * sum(n for n, _ in have[s].values()) / (share / scale) for s, (share, cap) in usable.items()]
    size = int(min(most, default=0)) if total is None else total
    out = []
    for s, (share, cap) in sorted(wanted.items()):
        tokens = sum(n for n, _ in have.get(s, {}).values())
        if s not in usable:
            out.append(Share(s, share, cap, tokens, 0, 0.0))
            continue
        goal = min(int(share / scale * size), cap * tokens)
        out.append(Share(s, share, cap, tokens, goal, _factor(have[s], goal, cap)))
    return out


def _factor(classes: dict[int, tuple[int, float]], goal: int, cap: int) -> float:
    """The factor at which copies min(cap, factor * weight) of all documents make up ``goal`` tokens (bisection over the classes).

    A class's tokens and weighted tokens are exact sums, so only the one class that the cap falls into is rounded, to its mean weight.
    """
    def made(f: float) -> float:
        return sum(min(cap * n, f * wn) for n, wn in classes.values())

    low, high = 0.0, cap * max(n / wn for n, wn in classes.values())
    if made(high) <= goal:
        # the least weight of a class may be below its mean
        return high * 2.0 ** (1 / CLASSES_PER_OCTAVE)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if made(mid) <= goal else (low, mid)
    # sums of weights may differ in their last bits from run to run
    return float(f"{low:.12g}")


def _rank(chance: Column, seed: int) -> Column:
    """The Pareto rank as an integer below 2**RANK_BITS, in the order of (u / (1 - u)) / (chance / (1 - chance))."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    q = (u / (1 - u)) * ((1 - chance) / chance)
    return F.least(F.floor(q / (1 + q) * F.lit(2.0**RANK_BITS)), F.lit(2**RANK_BITS - 1)).cast("bigint")


def mix(docs: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 1, tokenizer: str = TOKENIZER, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies >= 1) and its report.

    ``docs`` has doc_id, text, source (and ``weight``); ``targets`` has source, target_share, max_repeats. Null or unlisted sources and texts without tokens are
    not used. The report has one row per source on either side: source, target_share, max_repeats, n_docs, available_tokens,
    used_tokens, reached_share. A source misses its goal by at most half of the document that the cut falls on.
    """
    sizes = _sizes(docs, tokenizer, weight)
    plan = plan_mix(sizes, targets, total)
    spark = docs.sparkSession
    used = spark.createDataFrame([(p.source, p.max_repeats, float(p.goal), p.factor) for p in plan if p.goal > 0], "source string, cap int, goal double, factor double")
    # at most MAX_SOURCES rows
    rows = sizes.join(F.broadcast(used), "source")
    copies = F.least(F.col("cap").cast("double"), F.col("factor") * F.col("w"))
    rows = rows.withColumn("whole", F.least(F.floor(copies + 1e-9), F.col("cap"))).withColumn("chance", F.greatest(copies - F.col("whole"), F.lit(0.0)))
    drawn = F.col("chance") > 1e-9
    rows = rows.withColumn("rank", F.when(drawn, _rank(F.least(F.col("chance"), F.lit(1 - 1e-9)), seed)))
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("certain"), F.first("goal").alias("goal"))
    order = rows.where(drawn).groupBy("source", "rank").agg(F.sum("n_tokens").alias("n"))
    summed = prefix_sums(order, ["source"], "rank", "n", "before", RANK_BITS)
    # one row per source
    left = summed.join(F.broadcast(certain), "source")
    cuts = left.where(F.col("before") + F.col("n") / 2 <= F.col("goal") - F.col("certain")).groupBy("source").agg(F.max("rank").alias("cut"))
    out = rows.join(F.broadcast(cuts), "source", "left")
    extra = F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0)
    chosen = out.select("doc_id", "source", "n_tokens", (F.col("whole") + extra).cast("int").alias("copies")).where("copies > 0")
    chosen = materialise(chosen, "mix")
    return chosen, _report(chosen, sizes, plan)


def _report(chosen: DataFrame, sizes: DataFrame, plan: list[Share]) -> DataFrame:
    spark = sizes.sparkSession
    goals = spark.createDataFrame([(p.source, p.target_share, p.max_repeats) for p in plan], "source string, target_share double, max_repeats int")
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available_tokens"))
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    whole = used.agg(F.sum("used_tokens")).first()[0] or 0
    rows = have.join(goals, "source", "full").join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.col("used_tokens") / F.lit(max(whole, 1)), F.lit(0.0))
    return rows.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", zero("n_docs"), zero("available_tokens"), zero("used_tokens"), share.alias("reached_share"))
