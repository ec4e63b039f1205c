import html
import random
import re
import time

import numpy as np

from quarryline.llm import html_text, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a><li>News</ul></nav><div id="cookie-notice">We use cookies</div><div class="ad banner">Buy</div>
<main><article><h1>Title &amp; more</h1><p><b>First  para &eacute;<br>goes\n on.<p>Second <i>one</i> &#x41;</p><aside>See also</aside><form><label>Mail</label></form>
<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><script>var a="</p><article>x";</script><blockquote>Quote</blockquote></article>
<section class="comments"><article class="comment"><p>Reader says</p></article></section></main><footer>&copy; us</footer>"""


def test_marks_decide():
    assert html_text.blocks(PAGE) == (["Title & more", "First para é goes on.", "Second one A", "a", "b", "c", "d", "Quote"], True)
    assert html_text.blocks(None) == ([], True) and html_text.blocks("") == ([], True)
    assert html_text.blocks("<p>loose <p>text &am") == (["loose", "text &am"], False)
    assert html_text.blocks("<script>x</script><nav>y</nav>") == ([], True)


def test_repetition_decides_elsewhere(spark):
    menu = "Home News Sport Weather Contact About Imprint Privacy Terms"
    rows = [(i, f"http://H{i % 2}.org/{i}", f"<div>{menu}</div><div>own words of page {i * 17} are kept as they stand number {i}</div><div>same end for every page of the host whatever it holds</div>", "c") for i in range(8)]
    rows += [(20, "http://other/1", "<div>same end for every page of the host whatever it holds</div>", ""), (21, None, None, ""), (22, "http://[bad", "", ""), (0, rows[0][1], rows[0][2], "")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(menu not in by[i] and "same end" not in by[i] and f"{i * 17}" in by[i] for i in range(8))
    assert by[20].startswith("same end") and by[21] == by[22] == ""
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = "<h1>Head</h1><p>" + "A story of some length is told in this paragraph. " * 8 + "</p>"
TOLD = ["Head", ("A story of some length is told in this paragraph. " * 8).strip()]


def test_names_and_wrappers():
    for page in (
        f'<div class="layout with-sidebar"><article>{STORY}</article><div class="sidebar">Menu</div></div>',
        f'<div class="sidebar"><article>{STORY}</article></div>',
        f'<article class="post comment-open">{STORY}</article><section id="comments"><article class="comment">Reader says</article></section>',
        f'<div class="ad-banner">Buy</div><article><header><h1>Head</h1><span>By me</span><div>1 May</div></header>{STORY[13:]}<footer>Tags</footer></article>',
        f'<div>{STORY}</div><article class="card">A teaser card</article>',
        f'<main>{STORY}<article>A teaser</article></main><div class="cookieNotice">We use cookies</div>',
        f'<main><article>{STORY}</article><article>Another teaser</article></main>',
    ):
        assert html_text.blocks(page)[0] == TOLD, page[:60]
    assert html_text.blocks(f'<article><p class="search-term">word</p>{STORY}</article>')[0] == ["word", *TOLD]
    assert html_text.blocks("<article>One tale here</article><article>Two tales here</article>") == (["One tale here", "Two tales here"], False)


def test_long_and_unclosed_pages():
    n = 60_000
    began = time.perf_counter()
    assert html_text.blocks("<article>" + "<b>x" * n + "</p></i>" * n)[0] == ["x" * n]
    assert len(html_text.blocks("<div>" * n + "deep" + "</span></li>" * n)[0]) == 1
    assert html_text.blocks("<article>" + "<p>word " * n + "</article>")[0] == ["word"] * n
    assert time.perf_counter() - began < 20


def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    pages = []
    for i in range(30):
        parts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        pages.append((f"h{i % 3}", i, "\n".join(parts)))
    got = {}
    for r in html_text.repeats(spark.createDataFrame(pages, "host string, page long, text string").repartition(3)).collect():
        got.setdefault(r.page, set()).update(range(r.at, r.at + r.n))
    streams = {i: (h, html_text.stream(t.split("\n"))) for h, i, t in pages}
    for i, (h, tokens) in streams.items():
        want = set()
        for a in range(len(tokens) - html_text.RUN + 1):
            if any(tokens[a : a + html_text.RUN] == other[b : b + html_text.RUN] for j, (g, other) in streams.items() if j != i and g == h for b in range(len(other))):
                want.update(range(a, a + html_text.RUN))
        assert got.get(i, set()) == want
    assert html_text.unique_runs(["a b c d e f g h i", "x y", "z"], [(0, 8), (10, 1)]) == ["i", "y", "z"] and html_text.unique_runs([], []) == []


def test_query_on_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = queries.op2_html(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_repetition_weighs_regions(spark):
    """A menu that no mark names outweighs the article; as other pages have it too, the article is entered and keeps what articles share."""
    menu = " ".join(f"Item{i}" for i in range(300))
    shared = "a passage of ten words that both of the articles share"
    html_ = lambda i: f"<div>{menu}</div><article><p>{shared}</p><p>{' '.join(f'own{i}x{k}' for k in range(200))}</p></article>"
    rows = [(i, f"http://h/{i}", html_(i)) for i in range(4)] + [(9, "http://h/9", html_(0)), (10, "http://alone/1", html_(1))]
    by = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(by[i].split("\n") == [shared, " ".join(f"own{i}x{k}" for k in range(200))] for i in range(4)) and by[9] == by[0]
    assert by[10].split("\n")[0] == menu
    assert html_text.main_blocks(["a b", "c d x", "e f"], [0, 1, 0], [0, 0], [(0, 2), (7, 2)]) == ["c d x"]


def test_every_page_meets_the_suffix_array(spark, monkeypatch):
    met = []
    repeats = html_text.repeats
    monkeypatch.setattr(html_text, "repeats", lambda pages: met.extend(pages.select("host", "text").collect()) or repeats(pages))
    rows = [(i, f"http://h/{i}", f"<article>words of page {i}</article>") for i in range(5)]
    assert html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 5 and len(met) == 5


def test_texts_are_not_shuffled(spark):
    """Where broadcasts are out of the question, as for many pages, no exchange stands above the written texts."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    menu = "one two three four five six seven eight nine"
    rows = [(i, f"http://h/{i % 2}", f"<div>{menu}</div><div>{i // 2} stands alone</div>") for i in range(40)]
    try:
        spark.conf.set(key, "-1")
        got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.page_id: r.text for r in got.collect()} == {i: f"{i // 2} stands alone" for i in range(40)}
    finally:
        spark.conf.set(key, before)


def test_blocks_of_numbers_and_suffixes():
    rng = np.random.default_rng(4)
    for bits, n in ((8, 1), (8, 200), (28, 5000), (32, 3), (1, 2)):
        x = np.unique(rng.integers(0, 1 << bits, n, np.uint64)).astype(np.uint32)
        assert (html_text._decoded(html_text._coded(x, bits)) == x).all()
    suffixes = sorted((int(h), "wörd \n " * k, k, 7 * k) for k, h in enumerate(rng.integers(0, 1 << 64, 50, np.uint64)))
    assert list(html_text._unpacked(html_text._packed(suffixes))) == suffixes
    found = sorted((int(r), int(a), int(n)) for r, a, n in rng.integers(0, 200, (50, 3)))
    assert sorted(zip(*(c.tolist() for c in html_text._places(html_text._stretches(found))), strict=True)) == found


def test_suffixes_of_parts_share_as_if_together():
    """Each suffix learns the most that it shares with one of another page, whether its own part or another has that."""
    rng = random.Random(8)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for _ in range(60):
        all_ = [(rng.randrange(3), rng.randrange(4), at, rng.randrange(2), [rng.choice("ab") for _ in range(rng.randint(1, 4))]) for at in range(rng.randint(1, 25))]
        got, dealt = {}, []
        for part in range(3):
            rest, met = html_text._met_here(sorted((head, " ".join(tail), row, at) for p, row, at, head, tail in all_ if p == part))
            got |= {at: n for _, at, n in met}
            dealt += [(head, tail, (part if row >= 0 else row, row), at) for head, tail, row, at in rest]
        for page, at, n in html_text._shared_by(sorted(dealt)):
            if page[1] >= 0:
                got[at] = max(n, got.get(at, 0))
        for p, row, at, head, tail in all_:
            others = [shared(tail, t) for q, r, _, g, t in all_ if g == head and (q, r) != (p, row)]
            assert got.get(at) == (html_text.RUN + max(others) if others else None)


def test_windows_are_those_of_the_streams():
    texts = ["a b c d e f g h i\nj", "short", "é" * 30 + " b c d e f g h", "x" * 200 + " b c d e f g h", "", "z\n" * 6 + "z"]
    data, ends, upto, of, first, h = html_text._windows(["h"] * len(texts), html_text.pa.array(["skipped", *texts])[1:])
    streams = [html_text.stream(t.split("\n")) for t in texts]
    want = [(i, tuple(s[a : a + html_text.RUN])) for i, s in enumerate(streams) for a in range(len(s) - html_text.RUN + 1)]
    assert list(upto) == [sum(map(len, streams[: i + 1])) for i in range(len(streams))]
    tokens = [t for s in streams for t in s]
    assert [(i, tuple(tokens[a : a + html_text.RUN])) for i, a in zip(of.tolist(), first.tolist(), strict=True)] == want
    assert len(set(h.tolist())) == len({w for _, w in want}) and len(tokens) == len(ends) and data.count(b" ", 0, -8) == len(ends)
