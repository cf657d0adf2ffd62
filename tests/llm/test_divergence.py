"""Source divergence against a plain count over rows."""

import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import divergence

ROWS = [
    (1, "Alpha beta, BETA gamma9delta", "en", "a"), (2, "alpha beta", "en", "b"), (3, "alpha zeta beta", "en", "b"), (4, None, "en", "c"), (5, "Ünder Über über É", "de", "a"),
    (6, "über É", "de", "a"), (7, "über É über", None, "a"), (8, "é über É", None, None), (9, "über x", "", "b"), (10, "x x x", "", ""), (11, "", "fr", "only"), (12, "123 --", "es", "p"),
    (13, "a b", "es", "q"), (1, "Alpha beta, BETA gamma9delta", "en", "a"), (None, "gamma " * 3000 + "delta", "en", "a"), (15, "\0alpha\x7fbeta\ngamma", "en", "long " * 50),
]


def brute(rows, min_docs=3, top=200):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for _, text, lang, source in rows]
    sources, df, n, out = defaultdict(set), defaultdict(Counter), defaultdict(Counter), []
    for lang, source, w in words:
        sources[lang].add(source)
        df[lang].update(set(w))
        n[lang, source].update(w)
    rank = lambda items: [(k, v, i + 1) for i, (k, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())))]
    for lang, own in sources.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]

        def rates(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: rates(n[lang, s]) for s in own}
        q = rates(sum((n[lang, s] for s in own), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in own:
            out += [(lang, s, "pair", *r) for r in rank([(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s])]
            out += [(lang, s, "term", *r) for r in rank([(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]])[:top]]
    return sorted(out)


@pytest.mark.parametrize(("cells", "held", "size"), [(divergence.SHARD_CELLS, divergence.HELD_ROWS, divergence.TEXT_BYTES), (4, 1, 10)])
def test_divergence_equals_plain_counts(spark, monkeypatch, cells, held, size):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    monkeypatch.setattr(divergence, "TEXT_BYTES", size)
    docs = spark.createDataFrame([(*r, "x", 5) for r in ROWS], "doc_id long, text string, lang string, source string, term string, n int")
    for min_docs, top in ((3, 200), (1, 2), (99, 200)):
        got = divergence.source_divergence(docs, min_docs, top).collect()
        assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(ROWS, min_docs, top)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_rates_are_exact_for_large_counts():
    import numpy as np

    n, total = np.array([0, 7, 9 * 10**14]), np.array([9 * 10**15 - 1] * 3)
    assert divergence._rates(n, total).tolist() == [1 + 10**9 * (int(k) + 1) // int(t) for k, t in zip(n, total)]
