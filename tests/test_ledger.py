"""The watermark ledger against a walk over windows, and its refusals."""

import random

from tidewright.operators.watermark import advance, blocking_holes, ledger_errors, loss_refusals, stalls
from tidewright.types import LOSS, MANIFEST


def manifest(p, w, ranges, top, low=0):
    return ("d", p, w, ranges, sum(l - f + 1 for _, f, l in ranges), low, top, 0, [f"{p}{w}"], "primary", 0, False)


def walk(windows, losses):
    cov, done, best, event, nxt = {}, None, None, None, 0
    for w, ranges, top in windows:
        if w != nxt:
            break
        nxt += 1
        for o, f, l in ranges:
            cov.setdefault(o, set()).update(range(f, l + 1))
        event = top if event is None else max(event, top)
        lost = {o: {x for q, f, l in losses if q == o for x in range(f, l + 1)} for o in cov}
        if all(set(range(1, max(have) + 1)) <= have | lost[o] for o, have in cov.items()):
            done, best = w, event
    return nxt - 1, done, best


def test_random_histories(spark):
    rnd = random.Random(5)
    rows, losses, want = [], [], {}
    for k in range(60):
        p, n = f"p{k}", {"a": 1, "b": 1}
        windows, lost = [], []
        for w in range(rnd.randint(1, 6)):
            ranges = []
            for o in ("a", "b"):
                if rnd.random() < 0.7:
                    if rnd.random() < 0.25:
                        gap = rnd.randint(1, 3)
                        if rnd.random() < 0.6:
                            lost.append((o, n[o], n[o] + gap - rnd.randint(0, 1)))
                        n[o] += gap
                    size = rnd.randint(1, 4)
                    ranges.append((o, n[o], n[o] + size - 1))
                    n[o] += size
            windows.append((w if rnd.random() < 0.95 else w + 1, ranges, rnd.randint(0, 100)))
        windows = sorted({w[0]: w for w in windows}.values())
        rows += [manifest(p, w, r, t) for w, r, t in windows]
        losses += [(p, o, f, l, 0) for o, f, l in lost if f <= l]
        seen = walk(windows, [x for x in lost if x[1] <= x[2]])
        if seen[0] >= 0:
            want[p] = seen
    rnd.shuffle(rows)
    got = {r.partition: (r.recorded_through, r.done_through, r.complete_through_ms) for r in advance(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(losses, LOSS)).collect()}
    assert got == want


def test_stalls_and_holes(spark):
    rows = [manifest("p", 0, [("o", 1, 5)], 10), manifest("p", 1, [("o", 8, 9)], 20), manifest("p", 3, [("o", 10, 10)], 30), manifest("q", 0, [("o", 1, 2)], 5)]
    m = spark.createDataFrame(rows, MANIFEST)
    staging = spark.createDataFrame([("p", "o", 7)], "partition string, origin string, applied_seq bigint")
    assert [tuple(r) for r in blocking_holes(m, None, staging).collect()] == [("p", "o", 6, 7, True)]
    got = {(r.partition, r.reason, r.expected_window, r.n_deferred, r.n_holes, r.n_in_hot) for r in stalls(m, None, staging).collect()}
    assert got == {("p", "missing_window", 2, 1, None, None), ("p", "coverage_holes", None, None, 1, 1)}


def test_errors(spark):
    rows = [manifest("p", 0, [("o", 1, 5)], 10), manifest("p", 0, [("o", 5, 6)], 10), manifest("p", 1, [("o", 9, 8)], 10), manifest("p", 2, [("o", 20, 21)], 1, low=5)]
    got = {tuple(r) for r in ledger_errors(spark.createDataFrame(rows, MANIFEST)).collect()}
    assert got == {("p", 0, "duplicate_window"), ("p", 0, "coverage_overlap"), ("p", 1, "invalid_range"), ("p", 2, "invalid_event_time")}


def test_loss_refusals(spark):
    req = spark.createDataFrame([("p", "o", 5, 9), ("p", "o", 11, 12), ("p", "o", 0, 3), ("p", "x", 1, 1)], "partition string, origin string, first_seq bigint, last_seq bigint")
    live = spark.createDataFrame([("p", "o", "n1", 4), ("p", "o", "n2", 7)], "partition string, origin string, node string, replicated_thru bigint")
    got = {(r.origin, r.first_seq): (r.refusal, r.covering_node) for r in loss_refusals(req, live, True).collect()}
    assert got == {("o", 5): ("still_recoverable", "n2"), ("o", 11): (None, None), ("o", 0): ("invalid_range", None), ("x", 1): (None, None)}
    assert {r.refusal for r in loss_refusals(req, live, False).collect()} == {"consent_not_given"}
