import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periodic as pr

DOCS = "doc_id long, text string, runs string, start int"


def runs_by_hand(words):
    """Every maximal stretch of every period; of those that are the same stretch the one with the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - b >= max(6, 4 * q):
                out.setdefault((b, i + q), q)
    return sorted((b, e - b, q) for (b, e), q in out.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rnd, n):
    letters = "abcdefgh"[: rnd.choice([1, 2, 3, 8])]
    out = []
    while len(out) < n:
        unit = [rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 9]))]
        out += unit * rnd.choice([1, 1, 2, 4, 5, 7])
        if rnd.random() < 0.2 and out:
            out += out[-rnd.randint(1, len(out)):] * rnd.randint(1, 3)
    return out[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_several_documents_against_all_periods(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(pr, "TESTED_AT_ONCE", 5)
    rnd = random.Random(seed)
    texts = [random_words(rnd, rnd.randint(0, 120)) for _ in range(12)]
    got = list(pr._batch([[w.encode() for w in t] for t in texts]))
    for (runs, kept), words in zip(got, texts):
        want = runs_by_hand(words)
        assert [tuple(r) for r in runs.tolist()] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert [w.decode() for w in kept] == [w for i, w in enumerate(words) if i not in gone]


def test_two_runs_of_one_period_across_one_boundary():
    words = "x y z x y z x y z x y z x b z x b z x b z x b z x b".split()
    assert [tuple(r) for r in pr.runs_of(np.array([ord(w) for w in words]), np.zeros(len(words), np.int64))[:, 1:].tolist()] == runs_by_hand(words)


def test_long_periodic_documents_are_not_quadratic():
    ids = np.r_[np.zeros(200_000, np.int64), np.tile(np.arange(30_000), 5)]
    got = pr.runs_of(ids, np.r_[np.zeros(200_000, np.int64), np.ones(150_000, np.int64)])
    assert got.tolist() == [[0, 0, 200_000, 1], [1, 0, 150_000, 30_000]]


def test_grammar_expands_to_the_text():
    """Every occurrence of a nonterminal spells the same words, and the last rounds end in one root per document."""
    rnd = random.Random(5)
    docs = [random_words(rnd, 80), random_words(rnd, 41)]
    ids = np.array([ord(w) for t in docs for w in t])
    doc = np.repeat([0, 1], [80, 41])
    roots = set()
    for rule, lo, m, hi in pr._repair(ids, doc, np.arange(len(ids))):
        for r in set(rule.tolist()):
            k = np.flatnonzero(rule == r)
            assert len({(ids[lo[i]:m[i]].tobytes(), ids[m[i]:hi[i]].tobytes()) for i in k}) == 1
        assert all(doc[a] == doc[b - 1] for a, b in zip(lo, hi))
        roots |= {(a, b) for a, b in zip(lo.tolist(), hi.tolist())}
    assert {(0, 80), (80, 121)} <= roots


def test_report_against_brute_force_and_edges(spark, monkeypatch):
    monkeypatch.setattr(pr, "WORDS_AT_ONCE", 500)
    rnd = random.Random(7)
    rows = [(i, " ".join(random_words(rnd, rnd.randint(0, 150))), "x", 1) for i in range(150)]
    rows += [(900, None, None, None), (901, "", "", 0), (902, " \t\n", "", 0), (None, "a " * 9, "", 0), (5, rows[5][1], "y", 2),
             (903, "é é b " * 7, "", 0), (904, "long " * 4000, "", 0), (905, "one\x0btwo\x0cone two", "", 0)]
    got = pr.report(spark.createDataFrame(rows, DOCS).repartition(3))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((d, *expected(d, t)) for d, t, _, _ in rows), key=key)
    assert pr.report(spark.createDataFrame([], DOCS)).collect() == []
