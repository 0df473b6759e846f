import random
import re

import duckdb

from tidemark.llm import licenses as lc

DOCS = "doc_id long, text string, labels string, block int, score string"
NOISE = "the a this of under licensed released version license mit apache general public gnu work is 2 0 free software terms redistribute été".split()


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    ws, starts, base = find(low), [], set()
    for phrase, label in lc.PHRASES:
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    best, more = 0.0, set()
    for line in low.split("\n"):
        have = set(find(line))
        for label, t in lc.TEMPLATES:
            need = set(t.split())
            share = len(have & need) / len(need)
            if len(have & need) * 1000 >= round(lc.CONTAINMENT * 1000) * len(need):
                more.add(label)
                best = max(best, share)
    return (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if starts else best)


def cases():
    rnd = random.Random(5)
    rows = []
    for i in range(250):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            words = [rnd.choice(NOISE) for _ in range(rnd.randint(0, 12))]
            if rnd.random() < 0.5:
                t = rnd.choice(lc.TEMPLATES)[1].split()
                for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                    t[rnd.randrange(len(t))] = rnd.choice(NOISE)
                at = rnd.randint(0, len(words))
                words[at:at] = t
            lines.append(rnd.choice([" ", ", ", "-"]).join(rnd.choice([w, w.capitalize(), w.upper()]) for w in words))
        rows.append((i, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "MIT"), (303, "license mit license"), (None, "The MIT License"), (304, "x " * 30000 + "Apache\n License"), (5, rows[5][1]), (6, "MIT License")]
    return rows


def test_scan_against_brute_force_and_sql(spark):
    rows = cases()
    out = lc.scan(spark.createDataFrame([(d, t, "clash", 3, "x") for d, t in rows], DOCS))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, out.collect()), key=key)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=key)
    assert sum(r[6] != r[5] for r in got) > 20
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(lc.scan_sql()).fetchall(), key=key) == got


def test_no_python_in_the_plan(spark):
    plan = lc.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_other_templates_and_thresholds(spark):
    df = spark.createDataFrame([(1, 1, "one two three four\nfive"), (2, 2, "four three\n two one")], "doc_id long, text_key long, text string")
    got = lc.matches(df, [("x", "one two three four")], 1.0).collect()
    assert [(r.doc_id, r.block, r.shared, r.containment) for r in got] == [(1, 0, 4, 1.0)]
    assert {(r.doc_id, r.block) for r in lc.matches(df, [("x", "one two three four")], 0.5).collect()} == {(1, 0), (2, 0), (2, 1)}


def test_empty_table(spark):
    assert lc.scan(spark.createDataFrame([], DOCS)).collect() == []
