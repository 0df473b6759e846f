import random

from tidemark.llm import substring_dedup as sd

DOCS = "doc_id long, text string, n_chars int, start string, digest string"


def passage(rnd, words):
    out = []
    while sum(len(s.split()) for s in out) < words:
        out.append(" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(rnd.randint(3, 14))) + ".")
    return " ".join(out)


def brute(rows, min_run=sd.MIN_RUN_WORDS):
    """Sequential pass over the ranked documents."""
    seen, out = {}, set()
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        run = []
        us = sd.units(text or "")
        for u in [*us, None]:
            if u is not None and u[3] in seen:
                run.append((u, seen[u[3]]))
                continue
            if run and sum(x[2] for x, _ in run) >= min_run:
                out.add((doc, run[0][0][0], run[-1][0][1], run[0][1]))
            run = []
            if u is not None:
                seen[u[3]] = (doc, u[0])
    return out


def test_units_keep_offsets_and_content():
    text = "  One two three four five six seven eight. Short. Next one goes on here for some more words now!\nAb c. De f g.\nHi j k. End l\nm"
    got = sd.units(text)
    assert [text[a:b] for a, b, _, _ in got] == [
        "One two three four five six seven eight.", "Next one goes on here for some more words now!", "Ab c. De f g.\nHi j k. End l\nm"]
    assert [n for _, _, n, _ in got] == [8, 10, 11]
    assert sd.units("") == sd.units(" \n ") == sd.units("Too few words.") == []


def test_spans_against_brute_force(spark):
    rnd = random.Random(1)
    shared = [passage(rnd, 60) for _ in range(3)]
    rows = []
    for i in range(40):
        body = [passage(rnd, 40)]
        if i % 3 == 0:
            body.insert(rnd.randint(0, 1), shared[i % 9 // 3])
        rows.append((i, rnd.choice([" ", "\n"]).join(body)))
    rows += [(50, rows[3][1]), (50, rows[3][1]), (51, None), (52, ""), (53, "x"), (50, rows[4][1]), (None, shared[0])]
    df = spark.createDataFrame([(d, t, -1, "s", "d") for d, t in rows], DOCS)
    spans = sd.repeated_spans(df)
    got = {(r.doc_id, r.span_start, r.span_end, (r.kept_doc_id, r.kept_start)) for r in spans.collect()}
    # two different texts share doc_id 50, so equal places are told apart by their text only
    want = brute([r for r in rows if r[0] != 50])
    assert {g for g in got if g[0] != 50} == want
    assert len([g for g in got if g[0] == 50]) == 2
    texts = {d: t for d, t in rows if d != 50}
    cleaned = {r.doc_id: r for r in sd.remove_spans(df, spans).collect() if r.doc_id != 50}
    assert len(cleaned) == len(texts)
    for d, t in texts.items():
        mine = sorted((a, b) for x, a, b, _ in want if x == d)
        assert cleaned[d].text == (sd.cut(t, mine) if mine else t)
        assert cleaned[d].n_chars == (len(cleaned[d].text) if mine else -1)
    assert sd.remove_spans(df, spans).columns == df.columns
    assert sd.remove_spans(df, spans).count() == len(rows)
    assert any(shared[0].split(". ")[1] in (c.text or "") for c in cleaned.values())


def test_passage_inside_a_line_and_stock_phrases(spark):
    rnd = random.Random(2)
    p, stock = passage(rnd, 70), "See the terms of use before you copy any of this."
    rows = [(i, f"{passage(rnd, 30)}\n{stock}\n{passage(rnd, 20)} {p if i in (1, 4) else ''}") for i in range(6)]
    got = sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.kept_doc_id) for r in got] == [(4, 1)]
    kept = dict(rows)[4][got[0].span_start : got[0].span_end]
    assert kept in p and len(kept) > len(p) - 60


def test_cut():
    assert sd.cut("a b c d", [(2, 3)]) == "a c d"
    assert sd.cut("a\nb\nc", [(2, 3)]) == "a\nc"
    assert sd.cut("abc", [(0, 3)]) == "" and sd.cut("abc ", []) == "abc "


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    spans = sd.repeated_spans(df)
    assert spans.collect() == [] and sd.remove_spans(df, spans).collect() == []
