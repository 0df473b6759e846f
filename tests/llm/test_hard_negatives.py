import math
import random

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int, score string, rank int"


def by_hand(rows):
    """All anchors against all rows."""
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, lab, *_ in rows
          if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for r in sorted(ok):
        if r[0] % 100 == 0:
            anchors.setdefault(r[0], r)
    out = []
    for i, lab, x in anchors.values():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in ok)
        for ps, p in [(-s, j) for s, j, other in scored if other == lab and j != i][:5]:
            fits = [(-s, j) for s, j, other in scored if other != lab and 80 * ps <= 100 * -s <= 100 * ps][:5]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


def run(spark, rows):
    out = hn.report(spark.createDataFrame(rows, ROWS).repartition(3))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(rnd, n, width=40, groups=6):
    centres = [[rnd.gauss(0, 0.2) for _ in range(width)] for _ in range(groups)]
    return [(i, [c + rnd.gauss(0, 0.15) for c in rnd.choice(centres)], rnd.choice([0, 1, 1, 1, 2, 9]), "x", 1) for i in range(n)]


@pytest.mark.parametrize("seed,sample,block", [(1, 2048, 16384), (2, 20, 64), (3, 0, 128)])
def test_against_all_pairs(spark, monkeypatch, seed, sample, block):
    monkeypatch.setattr(hn, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(hn, "ROW_BLOCK", 50)
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", 2)
    rnd = random.Random(seed)
    rows = vectors(rnd, 900)
    # copies over several labels, ties, a far longer vector, a rare label
    rows += [(2000 + i, rows[100][1], i % 3, "x", 1) for i in range(150)] + [(5000, rows[3][1], 7, "", 0), (5100, rows[4][1], 7, "", 0), (5001, [3 * c for c in rows[5][1]], 2, "", 0)]
    assert run(spark, rows) == by_hand(rows)


def test_edges(spark):
    one = [0.5, -0.25, 0.125]
    rows = [(100, one, 1, "", 0), (101, one, 1, "", 0), (102, one, 2, "", 0), (102, one, 2, "", 0), (None, one, 2, "", 0), (103, None, 2, "", 0),
            (104, one, None, "", 0), (105, [0.5, None, 0.1], 2, "", 0), (106, [float("nan"), 1.0, 1.0], 2, "", 0), (107, [float("inf"), 1.0, 1.0], 2, "", 0),
            (108, [], 2, "", 0), (200, [-c for c in one], 3, "", 0), (201, one, 3, "", 0), (300, [0.0, 0.0, 0.0], 4, "", 0), (302, one, 4, "", 0), (100, one, 1, "", 0), (400, one, 6, "", 0)]
    got = run(spark, rows)
    assert got == by_hand(rows) and {r[0] for r in got} == {100, 300}
    assert run(spark, []) == [] and run(spark, [(101, one, 1, "", 0)]) == [] and run(spark, [(100, one, 1, "", 0)]) == []


@pytest.mark.parametrize("seed", range(8))
def test_reaching_is_exact_whatever_the_thresholds(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(hn, "SLAB", int(rng.integers(3, 20)))
    anchors, rows = np.floor(rng.normal(0, 40, (7, 37))), np.floor(rng.normal(0, 40, (90, 37)) * rng.random((90, 1)) * 2)
    scores = anchors @ rows.T
    for q in (0.05, 0.5, 0.9, 0.99, 1.0):
        t = np.quantile(scores, q, axis=1) if seed % 2 else np.full(7, np.quantile(scores, q))
        a, r, s = hn.reaching(anchors, t, rows)
        want = np.argwhere(scores >= t[:, None]).tolist()
        assert sorted(zip(a.tolist(), r.tolist())) == [tuple(w) for w in want]
        assert (s == scores[a, r]).all()
    assert all(len(x) == 0 for x in hn.reaching(anchors, np.full(7, 1e9), rows))
