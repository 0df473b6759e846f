import datetime as dt
import random

import pytest

from tidemark.operators.dedup import keep_first, near_duplicates

START = dt.datetime(2026, 1, 1)


def sequential(rows, threshold=0.8, hours=48):
    """Greedy arrival order by hand."""
    import re

    stop = set("a an the of to in on for and or is are at by with as from its it be this that after over".split())
    toks = {i: {t for t in re.findall(r"[a-z0-9&]+", title.lower()) if t not in stop and len(t) > 1} for i, title, _ in rows}
    leaders, out = [], {}
    for i, _, at in sorted(rows):
        best = None
        for j, jat in leaders:
            a, b = toks[i], toks[j]
            if abs(jat - at) <= dt.timedelta(hours=hours) and a and b and len(a & b) / len(a | b) >= threshold:
                if best is None or (jat, j) < best:
                    best = (jat, j)
        out[i] = best[1] if best else None
        if best is None:
            leaders.append((i, at))
    return out


def resolve(spark, rows, **kw):
    df = spark.createDataFrame(rows, "news_id long, title string, published_at timestamp_ntz")
    return {r["news_id"]: r["duplicate_of"] for r in near_duplicates(df, **kw).collect()}


def test_chain_is_not_a_component(spark):
    base = [f"w{i}" for i in range(20)]
    a, b, c = base, base[2:] + ["x1", "x2"], base[4:] + ["x1", "x2", "x3", "x4"]
    rows = [(i + 1, " ".join(t), START) for i, t in enumerate((a, b, c))]
    assert resolve(spark, rows) == {1: None, 2: 1, 3: None}


def test_window_edges_and_titles_without_words(spark):
    t = "Monsoon reaches Kerala coast two days early this year"
    rows = [(1, t, START), (2, "Flash: " + t, START + dt.timedelta(hours=30)), (3, t, START + dt.timedelta(hours=49)),
            (4, "at the", START), (5, "at the", START), (6, t, START + dt.timedelta(hours=48))]
    assert resolve(spark, rows) == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: 1}


@pytest.mark.parametrize("seed,budget", [(1, 64), (2, 0.5), (3, 1.5)])
def test_random_corpus_matches_sequential(spark, seed, budget):
    """Small vocabularies force long chains; a tiny pair budget forces the flood path."""
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(14)]
    rows = []
    for i in range(150):
        words = vocab[:10] if i % 3 == 0 else rng.sample(vocab, rng.randint(3, 11))
        rows.append((i, " ".join(words), START + dt.timedelta(hours=rng.randint(0, 300))))
    assert resolve(spark, rows, pair_budget=budget) == sequential(rows)


def test_keep_first(spark):
    df = spark.createDataFrame([(2, "http://a.com/x?utm_source=1", "b"), (1, "http://a.com/x", "a"), (3, "http://a.com/y", "c")],
                               "news_id long, url string, title string")
    got = {(r["news_id"], r["title"]) for r in keep_first(df).collect()}
    assert got == {(1, "a"), (3, "c")}
    stored = keep_first(df).where("news_id = 3").select("url_hash")
    assert {r["news_id"] for r in keep_first(df, stored=stored).collect()} == {1}


@pytest.mark.parametrize("seed", [4, 5])
def test_large_components_in_slices(spark, monkeypatch, seed):
    from tidemark.operators import dedup

    monkeypatch.setattr(dedup, "CUTS", 8)
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(12)]
    rows = [(i * 7 + rng.randint(0, 6), " ".join(rng.sample(vocab, 10)), START + dt.timedelta(hours=2 * i + rng.randint(-60, 60))) for i in range(160)]
    assert resolve(spark, rows, slice_rows=25, pair_budget=rng.choice([3, 64])) == sequential(rows)


def chained(days, a_day):
    """A daily report whose headline changes by a number, several a day."""
    return [(a_day * d + k, f"Closing bell markets end the day little changed number {a_day * d + k}", START + dt.timedelta(hours=24 * d + k)) for d in range(days) for k in range(a_day)]


@pytest.mark.parametrize("a_day", [1, 40])
def test_rounds_do_not_follow_the_calendar(spark, monkeypatch, a_day):
    """As many passes on 200 days as on 20, also when every bucket is crowded; contraction takes a logarithm of rounds."""
    from tidemark.operators import dedup

    counts = []
    for days in (20, 200):
        passes, cuts = [], []
        with monkeypatch.context() as m:
            resolve_, cut = dedup._resolve, dedup.cut_lineage
            m.setattr(dedup, "_resolve", lambda *a: passes.append(1) or resolve_(*a))
            m.setattr("tidemark.operators.graph.cut_lineage", lambda df: cuts.append(1) or cut(df))
            rows = chained(days, a_day) + [(100_000 + i, f"Unrelated story {i} about something else", START + dt.timedelta(hours=24 * i)) for i in range(5)]
            got = resolve(spark, rows)
            if a_day == 1 or days == 20:
                assert got == sequential(rows)
        counts.append((len(passes), len(cuts)))
    assert counts[0][0] == counts[1][0] == 1
    assert counts[1][1] <= counts[0][1] + 3 * 4


def test_components_of_paths_stars_and_loops(spark):
    from tidemark.operators.graph import components

    rng = random.Random(2)
    names = rng.sample(range(-(10**9), 10**9), 500)
    pairs = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[300 + i], names[300 + (i + 1) % 40]) for i in range(40)]
    pairs += [(names[400], names[400]), (names[401], names[402]), (names[402], names[401])]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    for group in ([names[i] for i in range(151)], names[200:300], names[300:340], [names[400]], names[401:403]):
        assert {got.pop(x) for x in group} <= set(group)
    assert not got
