"""Profile tests one by one, planted widths, and the shapes rule on members."""

import math

import numpy as np
import pytest

from gridloom.operators import voigt
from gridloom.operators.fit import levenberg

FIELDS = "c long, center_row int, center_col int, brow int, bcol int, net double"


def spot(c, sigma, gamma, radius=5, height=100.0, floor=0.0, noise=0.0, seed=0, at=(10, 10)):
    rng = np.random.default_rng(seed)
    cells = [(r, k) for r in range(at[0] - radius, at[0] + radius + 1) for k in range(at[1] - radius, at[1] + radius + 1)]
    d = np.array([math.hypot(r - at[0], k - at[1]) for r, k in cells])
    net = floor + voigt.pseudo_voigt(d, height, sigma, gamma) + rng.normal(0, noise, len(d))
    return [(c, *at, r, k, float(v)) for (r, k), v in zip(cells, net, strict=True)]


def test_planted_widths_are_recovered(spark):
    truth = {1: (1.5, 0.01), 2: (2.5, 0.8), 3: (1.2, 1.0), 4: (3.0, 0.4)}
    rows = [x for c, (s, g) in truth.items() for x in spot(c, s, g)]
    out = {r.c: r for r in voigt.verify(spark.createDataFrame(rows, FIELDS), ["c"]).collect()}
    for c, (s, g) in truth.items():
        r = np.linspace(0, 8, 4000)
        half = lambda a, b: float(r[np.argmax(voigt.pseudo_voigt(r, 1.0, a, b) <= 0.5)])  # noqa: E731, B023
        assert out[c].kept and out[c].reason == "voigt" and out[c].r2 > 0.99
        assert half(out[c].sigma, out[c].gamma) == pytest.approx(half(s, g), rel=0.05)
    noisy = voigt.verify(spark.createDataFrame(spot(9, 1.8, 0.3, noise=2.0), FIELDS), ["c"]).first()
    assert noisy.kept and half(noisy.sigma, noisy.gamma) == pytest.approx(half(1.8, 0.3), rel=0.05)


def test_each_test_rejects(spark):
    grid = [(r, k) for r in range(5) for k in range(5)]
    flat = lambda c, f: [(c, 2, 2, r, k, float(f(r, k))) for r, k in grid]
    rows = [(1, 2, 2, 2, 2, 5.0), (1, 2, 2, 2, 3, 4.0)]  # few
    rows += flat(2, lambda r, k: -1)  # neg
    rows += [(3, 9, 9, r, k, 1.0 + r) for r, k in grid]  # no_center
    rows += flat(4, lambda r, k: 0 if (r, k) == (2, 2) else 10 + r)  # weak
    rows += flat(5, lambda r, k: 100 if (r, k) == (2, 2) else 0)  # few_signal
    rows += flat(6, lambda r, k: 100 + (r + k) % 2)  # few signal or flat
    rows += flat(7, lambda r, k: 100 if (r, k) in ((2, 2), (2, 3)) else 0)  # compact
    rows += [(8, 0, 2, r, k, {(0, 2): 100.0, (0, 8): 20.0}.get((r, k), 0.0)) for r in range(2) for k in range(9)]  # spread
    rows += [(9, 5, 5, r, k, 100.0 if (r - 5) ** 2 + (k - 5) ** 2 >= 16 else 60.0 if (r, k) == (5, 5) else 40.0) for r in range(11) for k in range(11)]  # flat_io
    rows += [(10, 2, 2, 2, 2, None)]
    rows += flat(11, lambda r, k: 100 - (r + k) % 5)
    out = {r.c: r for r in voigt.verify(spark.createDataFrame(rows, FIELDS), ["c"]).collect()}
    want = {1: "few", 2: "neg", 3: "no_center", 4: "weak", 5: "few_signal", 7: "compact", 8: "spread", 9: "flat_io"}
    assert {c: out[c].reason for c in want} == want and 10 not in out and out[6].reason in ("few_signal", "flat") and not out[11].kept
    assert [c for c in want if out[c].kept] == [7]
    wide = voigt.fit_profile(np.linspace(0, 30, 60), 1 - np.linspace(0, 30, 60) / 60, 20, voigt.Rules(widest=1.0))
    assert wide[1] == "wide"
    assert voigt.verify(spark.createDataFrame([], FIELDS), ["c"]).count() == 0


def test_falling_rule_keeps_what_the_fit_does_not_explain():
    rng = np.random.default_rng(5)
    d = np.sort(rng.uniform(0, 6, 40))
    kept = voigt.fit_profile(d, np.linspace(1, 0.2, 40) ** 3, 20, voigt.Rules(least_r2=2.0))
    assert kept[:2] == (True, "falling") and kept[5] == 1.0
    assert voigt.fit_profile(d, rng.uniform(0, 1, 40), 20, voigt.Rules(least_r2=2.0))[:2] == (False, "poor_fit")
    for step in (voigt.PAIRS, 100):
        v = rng.uniform(0, 1, 60)
        dd = rng.uniform(0, 3, 60).round(1)
        pairs = [(a, b) for a in range(60) for b in range(60) if dd[b] - dd[a] >= 0.1]
        voigt.PAIRS, old = step, voigt.PAIRS
        assert voigt.falling_share(dd, v) == (len(pairs), sum(v[b] < v[a] for a, b in pairs) / len(pairs))
        voigt.PAIRS = old


def test_members_rule(spark):
    rows = [(1, 0, 0, 5.0), (2, 0, 0, 5.0), (2, 0, 1, 4.0), (3, 0, 0, -1.0), (3, 0, 1, -2.0), (4, 0, 0, 9.0), (4, 0, 1, 9.0), (4, 1, 1, 9.1), (6, 0, 0, None)]
    rows += [(5, r, k, float(v)) for _, _, _, r, k, v in spot(0, 1.5, 0.4)]
    out = {r.f: (r.kept, r.reason, r.n) for r in voigt.verify_members(spark.createDataFrame(rows, "f long, brow int, bcol int, intensity double"), ["f"]).collect()}
    assert out == {1: (False, "isolated", 1), 2: (True, "compact", 2), 3: (False, "neg", 2), 4: (False, "flat", 3), 5: (True, "voigt", 121)}


def test_a_fit_asks_the_model_once_a_place():
    t, places = np.linspace(0, 6, 30), []
    truth = lambda p: p[2] + p[0] * np.exp(-((t / p[1]) ** 2))

    def model(p):
        places.append(tuple(p))
        return truth(p)

    y = truth(np.array([1.0, 2.0, 0.1])) + np.random.default_rng(2).normal(0, 0.1, len(t))
    bounds = np.array([0.5, 1.0, 0.0]), np.array([0.1, 0.1, -1.0]), np.array([2.0, 9.0, 1.0])
    levenberg(model, *bounds, y, rounds=3)
    assert 4 < len(places) == len(set(places)) <= 1 + 3 * 4
    assert levenberg(truth, *bounds, y, rounds=300) == pytest.approx([1.0, 2.0, 0.1], abs=0.15)
