import random
import re

import numpy as np

from tidemark.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id long, score string"
ITEMS = "item_id long, text string, doc_id long, lang string"


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if x == y else -dc.MISMATCH), h[i - 1][j] - dc.GAP, h[i][j - 1] - dc.GAP)
    return max(map(max, h))


def test_alignment_against_the_full_table():
    rnd = random.Random(4)
    for _ in range(60):
        item = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 15))]
        window = [rnd.randint(0, 6) for _ in range(rnd.randint(1, 40))]
        score, x, y = dc.align(np.array(item), np.array(window))
        assert score == smith_waterman(item, window)
        if score:
            assert smith_waterman(item, window[x:y]) == score


def edited(rnd, item, share):
    out = []
    for w in item:
        r = rnd.random()
        if r < share / 3:
            continue
        out.append("changed" if r < 2 * share / 3 else w)
        if 2 * share / 3 <= r < share:
            out.append("added")
    return out


def case(spark):
    rnd = random.Random(8)
    items = [words(rnd, rnd.randint(15, 50)) for _ in range(20)]
    stock = words(rnd, 9)
    items[3] = stock + items[3][:14]
    rows, planted = [], set()
    for d in range(150):
        body = words(rnd, rnd.randint(20, 120))
        if d % 2:
            body += stock
        if d % 5 == 0:
            i = rnd.randrange(20)
            at = rnd.randint(0, len(body))
            body[at:at] = edited(rnd, items[i], rnd.choice([0, 0.1, 0.2]))
            planted.add((d, i))
        rows.append((d, " ".join(body) + rnd.choice(["", ".", "\n"]), 1, "x"))
    docs = spark.createDataFrame([*rows, (900, None, 1, "x"), (901, "", 1, "x"), (None, " ".join(items[0]).upper(), 1, "x"), (5, rows[5][1], 1, "x")], DOCS)
    bench = spark.createDataFrame([*((i, ", ".join(w).capitalize(), 7, "en") for i, w in enumerate(items)), (77, None, 0, ""), (78, "too short", 0, ""), (None, "", 0, "")], ITEMS)
    return items, rows, planted, docs, bench


def test_planted_and_edited_passages(spark):
    items, rows, planted, docs, bench = case(spark)
    got = dc.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(None, 0)}
    text = {r[0]: r[1] for r in rows} | {None: " ".join(items[0]).upper()}
    for r in got:
        found = re.findall("[a-z]+", text[r.doc_id][r.span_start : r.span_end].lower())
        assert abs(smith_waterman(items[r.item_id], found) / (dc.MATCH * len(items[r.item_id])) - r.score) < 1e-9
        # no alignment of the whole text is better
        whole = re.findall("[a-z]+", text[r.doc_id].lower())
        assert smith_waterman(items[r.item_id], whole) / (dc.MATCH * len(items[r.item_id])) == r.score
    assert len([r for r in got if r.doc_id == 5]) == 2 * len({p for p in planted if p[0] == 5})
    kept = dc.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id for r in kept.collect()), key=str)
    assert left == sorted([d for d in range(150) if d % 5] + [900, 901] , key=str)


def test_edited_copies_in_hundreds_of_documents(spark):
    rnd = random.Random(5)
    items = [words(rnd, rnd.randint(15, 59)) for _ in range(12)]
    copies = []
    for item in items:  # one version of each, a tenth of its words changed, that all its documents have
        at = set(rnd.sample(range(len(item)), round(len(item) / 10)))
        copies.append([f"changed{k}" if k in at else w for k, w in enumerate(item)])
    rows = [(400 * k + d, " ".join(words(rnd, 20) + copies[k] + words(rnd, 20))) for k in range(12) for d in range(300)] + [(9000, " ".join(words(rnd, 80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w), 1, "x") for k, w in enumerate(items)], ITEMS)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()} == {(400 * k + d, k) for k in range(12) for d in range(300)}
    assert [r.doc_id for r in dc.without_leaks(docs, bench).collect()] == [9000]


def test_seeds_in_every_stretch():
    rnd = random.Random(6)
    phrase = [1, 2, 3, 4, 5]
    items = [(k, " ".join(f"w{x}" for x in [*phrase, *(rnd.randint(100, 10**6) for _ in range(12))])) for k in range(6)]
    block = dc.Block.of([*items, (99, items[0][1])])
    df = {int(c.view(np.int64)): n for c, n in zip(block.codes, [900, 800, 900] + [0] * 12)}
    codes, owner, place = block.rare(df)
    assert {(o, p) for o, p in zip(owner.tolist(), place.tolist())} == {(o, p) for o in range(7) for p in range(15) if p not in (0, 2)}


def test_blocks_of_items(spark, monkeypatch):
    _, _, planted, docs, bench = case(spark)
    monkeypatch.setattr(dc, "BLOCK_CHARS", 900)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()} == planted | {(None, 0)}


def test_two_places_and_long_texts(spark):
    rnd = random.Random(2)
    item = words(rnd, 30)
    text = " ".join(words(rnd, 30000) + item + words(rnd, 200) + item)
    got = dc.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [text[r.span_start : r.span_end] for r in got] == [" ".join(item)] * 2 and {r.score for r in got} == {1.0}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], ITEMS)
    assert dc.leaks(docs, bench).collect() == [] and dc.without_leaks(docs, bench).count() == 1
    none = spark.createDataFrame([], DOCS)
    assert dc.leaks(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


def test_words_cut_as_bytes_are_the_words_of_the_pattern():
    rnd = random.Random(11)
    alphabet = "abZ09_ -.\n\t'éßñ日本Ωи\u0307\u201c²½\u200b\x1c\x85\xa0"
    for _ in range(400):
        t = "".join(rnd.choice(alphabet[: rnd.choice([12, 17, 24, len(alphabet)])]) for _ in range(rnd.randint(0, 60))).lower()
        assert [w.decode() for w in dc.words_of(t)] == dc._WORD.findall(t)
