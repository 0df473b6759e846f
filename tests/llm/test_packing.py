import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as pk
from tidemark.llm.common import vocabulary

DOCS = "doc_id long, text string, length string, rank int, part string"
JSON, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizer(text):
    assert pk.token_ids(text, JSON, RANKS).tolist() == reference_ids(text)


def test_ids_of_every_plain_character_and_special_strings():
    full, _ = pk._encoders(JSON, RANKS, "<|endoftext|>")
    plain = [chr(c) for c in range(0x250) if pk._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 400
    for c in plain:
        for text in (c, f"a{c}b", f" {c} 1{c}{c}  x", f"{c}\n\n {c}'s"):
            assert pk.token_ids(text, JSON, RANKS).tolist() == full.encode(text, add_special_tokens=False).ids
    for text in ("<|endoftext|>", "a <|endoftext|> b", "", "日本  x\x1c y", "don't  stop\t\r\n"):
        assert pk.token_ids(text, JSON, RANKS).tolist() == reference_ids(text)


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.random((12, 30)), rng.random(12) * 3
        gram, target = a.T @ a, a.T @ b
        x = pk.nnls(gram, target)
        slope = target - gram @ x
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_patterns_fill_a_sequence():
    got = pk.patterns(12, 3)
    want = {tuple(sorted(t, reverse=True)) for a in range(1, 13) for b in range(13) for c in range(13) if a + b + c == 12 for t in [tuple(x for x in (a, b, c) if x)]}
    assert set(got) == want and len(got) == len(want)


def best_fit_one_by_one(lengths, capacity=2048):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def check_plan(histogram, capacity):
    rows, n = pk.plan(histogram, capacity)
    sequences, seen = {}, np.zeros(capacity + 1, np.int64)
    for length, first, count, sequence, offset in rows.tolist():
        assert first == seen[length]
        seen[length] += count
        for i in range(count):
            sequences.setdefault(sequence + i, []).append((offset, length))
    assert (seen == histogram).all() and set(sequences) == set(range(n))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity
    return n


@pytest.mark.parametrize("capacity", [1, 5, 64, 2048])
def test_plans(capacity):
    rng = np.random.default_rng(capacity)
    for size in (0, 1, 7, 300, 20000):
        lengths = np.minimum(capacity, 1 + rng.exponential(capacity / 4, size).astype(int))
        h = np.bincount(lengths, minlength=capacity + 1)
        n = check_plan(h, capacity)
        lower = -(-int(lengths.sum()) // capacity)
        if size == 20000 and capacity >= 64:
            assert n <= lower * 1.002 + 1
        assert n >= lower


def test_plan_size_does_not_follow_the_counts():
    h = np.bincount(np.random.default_rng(3).integers(1, 2049, 3000), minlength=2049)
    small, large = pk.plan(h)[0], pk.plan(h * 10**9)[0]
    assert len(large) < 4 * len(small) + 2048


def test_query_against_brute_force(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["alpha", "be", "Gamma,", "δέλτα", "x1"]) for _ in range(rnd.choice([0, 1, 30, 400, 1500, 9000]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (200, None), (201, ""), (None, "no id"), (202, " the" * 2047), (203, " the" * 2048), (204, " the" * 4095)]
    df = spark.createDataFrame([(d, t, "s", 1, "p") for d, t in rows], DOCS).repartition(3)
    out = pk.pack(pk.pieces(df, JSON, RANKS)).collect()
    want = []
    for doc, text in rows:
        ids = [*reference_ids(text or ""), 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    assert len(by) <= best_fit_one_by_one([r.length for r in out]) * 1.01


def test_empty_table(spark):
    assert pk.pack(pk.pieces(spark.createDataFrame([], DOCS), JSON, RANKS)).collect() == []
