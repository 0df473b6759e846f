import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import simhash

DOCS = "doc_id long, text string, fp string, rep long, lang string"


def by_hand(text, k=3):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" "):
        if w:
            words.append(w)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def reachable(rows):
    """Brute force over all pairs: doc_id -> smallest doc_id of the group."""
    fps = sorted({f for _, f in rows})
    group = {f: f for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                group[find(a)] = find(b)
    low = {}
    for d, f in rows:
        if d is not None:
            low[find(f)] = min(low.get(find(f), d), d)
    return [(d, f"{f:016x}", low.get(find(f))) for d, f in rows]


@pytest.mark.parametrize("text", [None, "", "  \n\t", "One", "one TWO", "a b c", "a b c d a b c d", "Été À b c\td", "x " * 500 + "ende", "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == by_hand(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text) == whole == by_hand(text)


@pytest.mark.parametrize("n", [2, 5, 60, 200, 3000])
def test_posting_links(n):
    rng = np.random.default_rng(n)
    base = int(rng.integers(0, 1 << 62))
    values = np.unique([base ^ (int(a) << 8) ^ (int(b) << 40) for a, b in rng.integers(0, 256 if n > 100 else 16, (n, 2))]).astype(np.int64)
    u, v = simhash.posting_links(values)
    assert (u > v).all()
    want = {d: c for d, _, c in reachable([(int(x), int(x)) for x in values])}
    got = {int(x): int(x) for x in values} | dict(zip(u.tolist(), v.tolist()))
    assert got == want


def test_groups_against_brute_force(spark):
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words[rnd.randrange(60)] = "zz"
        rows.append((1000 - i, " ".join(words), "clash", 1, None))
    rows += [(5, None, None, None, None), (7, "", None, None, None), (None, "  ", None, None, None), (7, "", None, None, None), (None, "lonely words here now", "x", 2, "en")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = reachable([(r[0], by_hand(r[1])) for r in rows])
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert len({c for _, _, c in want}) < 200


def test_random_fingerprints_and_chains(spark):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    x = rnd.getrandbits(64)
    for _ in range(200):  # a chain of single flips
        x ^= 1 << rnd.randrange(64)
        fps.append(x)
    for f in list(fps[:100]):
        for _ in range(3):
            fps.append(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = sorted(set(fps))
    from tidemark.llm.common import connected_components

    rows = [(simhash._signed(f),) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long"))
    roots = dict(map(tuple, connected_components(links).collect()))
    groups = {}
    for f in fps:
        s = simhash._signed(f)
        groups.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for d, _, c in reachable([(f, f) for f in fps]):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_hash_equals_the_built_in_one(spark):
    words = ["", "a", "été", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").cast(T.LongType())).collect()
    assert [r[0] for r in got] == [simhash._signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]


def jaccard(a, b):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def near_copies(rnd):
    rows, d = [], 0
    for _ in range(60):
        base = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(rnd.randint(60, 200))]
        for k in range(rnd.choice([1, 2, 4])):
            words = list(base)
            for _ in range(k and rnd.choice([0, 1, 1, 2, 3])):
                words[rnd.randrange(len(words))] = "edit" + str(rnd.randrange(10**6))
            rows.append((d := d + 7, " ".join(words)))
    return rows


def test_similar_pairs_are_right_and_mostly_found(spark):
    rnd = random.Random(9)
    rows = near_copies(rnd)
    df = spark.createDataFrame([(d, t, "f", 1, "x") for d, t in [*rows, (None, rows[0][1]), (9999, None), (9998, ""), (9998, "")]], DOCS).repartition(3)
    got = {(r.u, r.v) for r in simhash.similar_pairs(df).collect()}
    first = {}
    for d, t in rows:
        first.setdefault(t, d)
    texts = {d: t for t, d in first.items()}
    near = {(max(a, b), min(a, b)): j for a in texts for b in texts if a < b and (j := jaccard(texts[a], texts[b])) >= 0.8}
    assert got <= set(near) and len(near) > 40
    group = {d: d for d in texts}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in got:
        group[find(u)] = find(v)
    joined = [find(u) == find(v) for (u, v), j in near.items() if j >= 0.9]
    assert sum(joined) >= 0.95 * len(joined) > 20
    joined = [find(u) == find(v) for u, v in near]
    assert sum(joined) >= 0.85 * len(joined)


def test_groups_join_both_kinds_of_links(spark):
    rows = near_copies(random.Random(4))
    df = spark.createDataFrame([(d, t, "f", 1, "x") for d, t in [*rows, (3, rows[0][1].upper()), (None, rows[1][1]), (None, "nobody else has this")]], DOCS)
    groups = simhash.duplicate_groups(df).collect()
    assert len(groups) == len(rows) + 3
    of = {r.doc_id: r.component_id for r in groups if r.doc_id is not None}
    assert of[7] == of[3] == 3
    for r in simhash.near_duplicates(df).where("doc_id is not null").collect():
        assert of[r.doc_id] == of[r.component_id]
    for r in simhash.similar_pairs(df).collect():
        assert of[r.u] == of[r.v]
    text = dict(rows) | {3: rows[0][1]}
    members = {}
    for d, c in of.items():
        members.setdefault(c, []).append(d)
    for c, ds in members.items():
        assert c == min(ds)
        assert all(d == c or max(jaccard(text[d], text[e]) for e in ds if e != d) > 0.7 for d in ds)


def test_neighbours_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    key, rep = np.sort(rng.integers(0, 40, 300)), np.arange(300)
    a, b = np.zeros(300, np.int64), np.where(rep % 5 == 0, -1, 0)  # a fifth differ in 64 bits

    def run(size):
        parts = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in (key, rep, a, b)], names=["key", "rep", "a", "b"]) for i in range(0, 300, size)]
        return sorted((u, v) for x in simhash._neighbours(parts) for u, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist()))

    want = []
    for k in range(40):
        mine = rep[key == k]
        for i in range(1, len(mine)):
            want += [(x, y) for x, y in ((mine[i], mine[0]), (mine[i], mine[i - 1])) if b[x] == b[y]]
    assert run(300) == run(7) == run(1) == sorted(want)


def test_similar_pairs_of_an_empty_table(spark):
    assert simhash.similar_pairs(spark.createDataFrame([], DOCS)).collect() == [] == simhash.duplicate_groups(spark.createDataFrame([], DOCS)).collect()


def shared_template(rnd):
    """A family of texts below 0.8 to each other, with true pairs between them in id order: (rows, pairs)."""
    template = [f"t{i}" for i in range(200)]
    texts, pairs = [], []

    def changed(words, n):
        words = list(words)
        for i in rnd.sample(range(0, 195, 5), n):
            words[i + 2] = f"own{rnd.randrange(10**9)}"
        return words

    for k in range(150):
        texts.append((rnd.random(), k, changed(template, 4)))
    for k in range(150, 180):
        texts.append((rnd.random(), k, changed(texts[k - 150][2], 3)))
        pairs.append((k - 150, k))
    order = {k: 10 * i for i, (_, k, _) in enumerate(sorted(texts))}
    return [(order[k], " ".join(w)) for _, k, w in texts], [(order[a], order[b]) for a, b in pairs]


def test_true_pairs_among_texts_of_one_template(spark, monkeypatch):
    from tidemark.llm import common, minhash

    rows, pairs = shared_template(random.Random(3))
    text, group = dict(rows), {d: d for d, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    near = {(max(a, b), min(a, b)) for a in text for b in text if a < b and jaccard(text[a], text[b]) >= 0.8}
    for a, b in near:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    want = {d: find(d) for d in text if find(d) != d}
    assert {(max(p), min(p)) for p in pairs} <= near and 30 <= len(near) < 200
    df = spark.createDataFrame([(d, t, "f", 1, "x") for d, t in rows], DOCS)
    for held, streamed in ((128, 8192), (7, 50)):
        monkeypatch.setattr(common, "HELD", held)
        monkeypatch.setattr(common, "STREAMED", streamed)
        links = simhash.similar_pairs(df)
        assert {(r.u, r.v) for r in links.collect()} <= near
        assert {r.node: r.root for r in common.connected_components(links).collect() if r.node != r.root} == want
        assert {r.doc_id: r.class_id for r in minhash.near_duplicate_links(df).collect()} == want
