"""Shares, caps and certainty of mixes; Pareto samples have the wanted size; edge cases."""

import pytest

from tidewright.llm.mixing import mix

DOCS = "doc_id bigint, text string, source string, quality double, n_tokens string, cut string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "word " * (5 + k % 40), "big", 1.0 + 3 * (k % 2), "x", "y") for k in range(2000)]
    rows += [(5000 + k, "small text here " * 4, "small", 1.0, "x", "y") for k in range(20)] + [(9000, None, "small", 1.0, "x", "y"), (9001, "", "big", None, "x", "y"), (9002, "a", None, 1.0, "x", "y"), (9003, "b", "unlisted", 1.0, "x", "y"), (9004, "c c", "big", None, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def report(r):
    return {x.source: x for x in r.collect()}


def test_largest_mix_reaches_shares_within_caps(spark, docs):
    chosen, rep = mix(docs, targets(spark, ("big", 0.8, 2), ("small", 0.2, 4), ("missing", 0.5, 3), ("never", 0.0, 3)))
    r = report(rep)
    assert r["small"].used_tokens == 4 * r["small"].available_tokens  # the small source sets the size
    assert abs(r["big"].reached_share - 0.8) < 0.01 and abs(r["small"].reached_share - 0.2) < 0.01
    assert r["missing"].used_tokens == r["never"].used_tokens == 0 and r["unlisted"].used_tokens == 0 and r["unlisted"].max_repeats is None
    rows = chosen.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and all(1 <= x.copies <= (4 if x.source == "small" else 2) for x in rows)
    assert {x.source for x in rows} == {"big", "small"} and not {9000, 9001, 9002} & {x.doc_id for x in rows}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(7), targets(spark, ("small", 0.2, 4), ("big", 0.8, 2), ("missing", 0.5, 3), ("never", 0.0, 3)))[0].collect()))


def test_given_total_caps_and_whole_copies(spark, docs):
    _, rep = mix(docs, targets(spark, ("big", 0.5, 1), ("small", 0.5, 3)), total=10_000)
    r = report(rep)
    assert r["small"].used_tokens == 3 * r["small"].available_tokens and abs(r["big"].used_tokens - 5000) <= 50
    whole, rep = mix(docs, targets(spark, ("small", 1.0, 2)))
    assert {x.copies for x in whole.collect()} == {2} and report(rep)["small"].reached_share == 1.0


def test_weights_tilt_the_odds(spark, docs):
    chosen, rep = mix(docs, targets(spark, ("big", 1.0, 1)), total=10_000, weight="quality")
    heavy = [x.doc_id % 2 for x in chosen.collect()]
    assert abs(report(rep)["big"].used_tokens - 10_000) <= 50 and sum(heavy) > 0.7 * len(heavy)
    assert 9004 not in {x.doc_id for x in chosen.collect()}  # no weight, never drawn


def test_empty(spark, docs):
    chosen, rep = mix(docs.limit(0), targets(spark, ("big", 1.0, 1)))
    assert chosen.count() == 0 and report(rep)["big"].reached_share == 0.0
    assert mix(docs, targets(spark, ("big", 1.0, 1)).limit(0))[0].count() == 0
