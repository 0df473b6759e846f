import random
import re

from tidemark.llm import wordpiece as wp
from tidemark.llm.common import vocabulary

DOCS = "doc_id long, text string, n_words string, lang string"


def greedy(word, initial, inner):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (inner if at else initial):
                break
        else:
            return 0
        at, n = end, n + 1
    return n


def test_counts_against_greedy_search():
    rnd = random.Random(1)
    for _ in range(80):
        make = lambda: {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 14))}
        initial, inner = make(), make()
        a = wp.Automaton(sorted(initial), sorted(inner))
        for _ in range(150):
            word = "".join(rnd.choice("abcd" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randint(1, 14)))
            assert a.count(word) == greedy(word, initial, inner), (word, initial, inner)


def test_public_vocabulary_on_long_and_odd_words():
    initial, inner = wp.pieces_of(vocabulary("piece_bpe_32k.model"))
    a, first, rest = wp.Automaton(initial, inner), set(initial), set(inner)
    for word in ["the", "internationalisation", "Straße", "ab" * 5000, "日本", "x́", "…", "ñandú", "q" * 300]:
        assert a.count(word) == greedy(word, first, rest)


def test_query(spark):
    initial, inner = ["a", "ab", "."], ["b", "c"]
    rows = [(1, "ab abc b a.a"), (2, None), (3, ""), (1, "ab abc b a.a"), (None, "zz_"), (4, "ab " * 50000)]
    got = wp.token_counts(spark.createDataFrame([(*r, "x", "en") for r in rows], DOCS), initial, inner).collect()
    words = re.compile(r"[^\W_]+|[^\w\s]|_")
    want = []
    for d, t in rows:
        counts = [greedy(w, set(initial), set(inner)) for w in words.findall(t or "")]
        want.append((d, len(t or ""), len(counts), sum(c or 1 for c in counts), sum(not c for c in counts)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert wp.token_counts(spark.createDataFrame([], DOCS), initial, inner).collect() == []


def test_small_memory_of_words(monkeypatch):
    monkeypatch.setattr(wp, "_CACHE", 2)
    a = wp.Automaton(["a"], ["a", "b"])
    assert a.counts("a ab abb a ab abb aab") == (7, 1 + 2 + 3 + 1 + 2 + 3 + 3, 0) and len(a.cache) <= 2
