"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest

from gridloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, q string, block int, windows int"


def brute(rows):
    known: dict = {}
    for v, e, label, *_ in rows:
        if v is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        mine = ((label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * x) for x in e])
        known[v] = min(known.get(v, mine), mine)
    out = []
    for a, (label, q) in known.items():
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(q, p)), v, own == label) for v, (own, p) in known.items() if v != a]
        for s, v, _ in sorted(x for x in scores if x[2])[:5]:
            hits = sorted(x for x in scores if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(a, v, k + 1, w, -s, -t) for k, (t, w, _) in enumerate(hits)]
    return sorted(out)


def found(spark, rows):
    return sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize(("rows_a_block", "first"), [(1024, 64), (16, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows_a_block, first):
    monkeypatch.setattr(negatives, "MIN_ROWS", rows_a_block)
    monkeypatch.setattr(negatives, "FIRST_CANDIDATES", first)
    monkeypatch.setattr(negatives, "CELLS", 50)
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (20, 24))
    rows = [(int(v), (base[v % 20] + rng.normal(0, 0.08, 24)).tolist(), int(rng.integers(0, 4)), "x", 1, 2) for v in rng.permutation(900)]
    same = base[0].tolist()
    rows += [(1000 + k, same, k % 3, "x", 1, 2) for k in range(300)]  # one vector of very many rows
    rows += [(5, rows[0][1], 0, "x", 1, 2), (500, rows[1][1], 3, "x", 1, 2), rows[7], rows[7], (None, same, 1, "x", 1, 2)]
    rows += [(2000, None, 1, "x", 1, 2), (2100, same, None, "x", 1, 2), (2200, [*same[:3], None], 1, "x", 1, 2), (2300, [*same[:3], float("nan")], 1, "x", 1, 2), (2301, [float("-inf")], 1, "x", 1, 2)]
    rows += [(2400, [], 1, "x", 1, 2), (2500, same[:7], 2, "x", 1, 2), (2600, same + [9.0] * 5, 1, "x", 1, 2), (2**62 - 4, same, 2, "x", 1, 2), (-100, (-base[0]).tolist(), 0, "x", 1, 2)]
    want = brute(rows)
    assert len(want) > 300 and found(spark, rows) == want


def test_large_components_and_few_rows(spark):
    rng = random.Random(4)
    for scale in (30.0, 1e5, 3e6):
        rows = [(v, [rng.uniform(-0.2, 1) * scale for _ in range(6)], v % 3, "x", 1, 2) for v in range(0, 1400, 20)]
        want = brute(rows)
        assert found(spark, rows) == want and want
    assert found(spark, [(100, [1.0], 1, "x", 1, 2)]) == [] and found(spark, []) == []


def test_bounds_hold_for_every_row():
    """The index leaves dimensions out, and its bounds are never under the scores."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x = (rng.normal(0, 60, (500, 40)) * np.linspace(2, 0.05, 40)).astype(np.int64)
    index = negatives.BlockIndex(pa.array(range(500)), pa.array([0] * 500), pa.array(x.tolist(), pa.list_(pa.int64())))
    assert index.posted.max() < len(index.panels)
    hits = index.search(np.array([-1, -2]), np.array([0, 0]), x[:2], [[(0, -negatives.ANY, negatives.ANY)]] * 2, True, 500)
    assert {(a, i): s for a, _, i, s in hits} == {(-1 - k, i): int(x[k] @ x[i]) for k in range(2) for i in range(500)}
