import random

import pytest

from tidemark.llm import html_extract as hx

PAGES = "page_id long, url string, html string, host string, text string"


@pytest.mark.parametrize("source, want", [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<article><h1>A  b\n c</h1><p>x <b>y</b> z</p></article>", "A b c\nx y z"),
    ("<p><b>One.<br><p>Two<p>Three", "One.\nTwo\nThree"),
    ("<article><p>a<script>var t='</p>';</script>b</p><!-- no <p>c</p> --><style>p{}</style></article>", "ab"),
    ("<nav><ul><li>m</ul></nav><main><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></main><footer>f</footer>", "x\ny\n1\n2"),
    ("<article>t1<div class='ad'>buy</div>t2<aside>s</aside><form><p>f</p></form></article><div id=comments><article class=comment>c</article></div>", "t1\nt2"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body</article>", "Title\nBody"),
    ("<head><title>t</title><meta name=x><div>body text</div>", "body text"),
    ("<div class='content with-sidebar'><p>a</div><div class='sidebar'>b</div><div class=mainMenu>c</div>", "a"),
    ("<p>a <span class='share'>tweet</span> b <span class=comment>#c</span></p>", "a b #c"),
    ("<a href=x>one<div>two</div></a>three", "one\ntwo\nthree"),
    ("<p>&lt;b&gt; &eacute;&#233;&#x1F600; &nbsp;&unknown;", "<b> éé😀 &unknown;"),
    ("<p title='a>b'>q</p><p hidden>h</p><p style='display: none'>n</p>", "q"),
    ("</p></div>x<p/>y<", "x\ny<"),
    ("<article>a</article><article>b</article>", "a\nb"),
])
def test_one_page(source, want):
    assert hx.main_text(source, {}) == want


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert hx.main_text(deep, {}) == "x"
    many = "<article>" + "".join(f"<p>w{i}</p>" for i in range(20000)) + "</article>"
    assert hx.main_text(many, {}).count("\n") == 19999


def site(rnd, n, host):
    out = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rnd.choice('abcdefghijk') * rnd.randint(1, 9) for _ in range(12))}</p>" for _ in range(4))
        out.append((i, f"http://{host}/p/{i}",
                    f"<body><div class='alpha'><p>Our brand</p><p>Call us today</p></div><div class='beta'>{body}</div><div class='gamma'>Rights held by all</div></body>"))
    return out


def test_repeated_branches_of_a_host_go(spark):
    rnd = random.Random(1)
    rows = site(rnd, 30, "a.example") + [(100 + i, u, h) for i, u, h in site(rnd, 3, "b.example")]
    rows += [(200, "http://A.example:80/x", rows[4][2])] * 12 + [(300, None, None), (301, "", ""), (None, "http://c.example/?q=//a", "<p>only</p>")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    got = hx.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r.text for r in out}
    for i, _, h in rows[:30] + rows[33:34]:
        inner = h.split("<div class='beta'>")[1].split("</div>")[0]
        assert by[i] == "\n".join(p.split("</p>")[0] for p in inner.split("<p>")[1:])
    assert by[100].startswith("Our brand\nCall us today\n")  # three pages tell nothing about a host
    assert by[300] == by[301] == "" and by[None] == "only"


def test_joined_trees_give_the_same(spark, monkeypatch):
    rows = [(*r, "c", "c") for h in ("a.x", "b.x", "c.x") for r in site(random.Random(2), 12, h)]
    df = spark.createDataFrame(rows, PAGES)
    want = sorted(hx.extract(df).collect())
    monkeypatch.setattr(hx, "BROADCAST_PATHS", 1)
    assert sorted(hx.extract(df).collect()) == want


def test_tree_by_hand(spark):
    pages = [("h", "<div><p>same</p></div>")] * 4
    rows = {(r.seen, r.layouts): r for r in hx.site_style_tree(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert set(rows) == {(4, 1)} and rows[4, 1].layout_importance == 0
    pages = [("h", f"<p>t{i}</p>") for i in range(4)]
    tree = [r for r in hx.site_style_tree(spark.createDataFrame(pages, "host string, html string")).collect() if r.has_content]
    assert [(r.seen, r.content_importance) for r in tree] == [(4, 1.0)]


def test_empty_table(spark):
    assert hx.extract(spark.createDataFrame([], PAGES)).collect() == []
