"""Main text of pages: the cut against all labellings, and pages whose main text is known."""

from __future__ import annotations

import itertools
import random
import re
from html import unescape

from pyspark.sql import functions as F

from dueline.llm.main_text import Page, extract, log_odds, main_text, minimum_cut, with_main_text
from dueline.llm.queries import op12_html_extraction

SF = "/root/testdata/sf0.01"
PRIOR = log_odds({})


def test_minimum_cut_equals_all_labellings():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        terminals = [rnd.uniform(-1, 1) for _ in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.uniform(0, 1)) for _ in range(rnd.randrange(0, 16))]

        def cost(sides) -> float:
            own = sum(max(t, 0) if not s else max(-t, 0) for t, s in zip(terminals, sides))  # noqa: B023
            return own + sum(c for i, j, c in edges if sides[i] != sides[j])  # noqa: B023

        least = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(minimum_cut(terminals, edges)) - least) < 1e-9


def test_ties_and_no_blocks():
    assert minimum_cut([], []) == [] and minimum_cut([0.0, 0.0], [(0, 1, 1.0)]) == [False, False]
    assert main_text("", PRIOR.tolist()) == "" and main_text(" <p> </p><!-- x ", PRIOR.tolist()) == ""


BODY = "The river rose in the night, and by morning the lower fields were under water. Nobody had seen it so high."
MORE = "Boats were brought down from the village; people carried what they could, and waited for the rain to stop."

PAGES = {
    "div soup": (
        f'<div id="top"><div class="site-header"><a href="/">Home</a> <a href="/x">News</a></div></div><div><div><h2>After the flood</h2><p>{BODY}</p>'
        f'<p>{MORE}</p></div></div><div><a href="/a">One</a> <a href="/b">Two</a> <a href="/c">Three</a></div><div class="site-footer">All rights reserved.</div>',
        f"After the flood {BODY} {MORE}",
    ),
    "sidebar, form, comments": (
        f'<main><article><header><h1>High water</h1></header><p>{BODY}<aside class="related"><p>Related: {MORE}</p></aside><p>{MORE}</p></article>'
        f'<section id="comments"><article class="comment"><p>{BODY}</p></article></section><form><p>{MORE}</p><input value="x"><button>Send</button></form></main>',
        f"High water {BODY} {MORE}",
    ),
    "notices": (
        f'<body class="has-sidebar"><div class="cookie-notice">{MORE}</div><div role="navigation"><ul><li>{BODY}</ul></div><article><p>{BODY}</p>'
        f'<div class="ad-slot">{MORE}</div><ul><li>First, a short item<li>Second</ul><p>{MORE}</article><div hidden><p>{BODY}</p></div></body>',
        f"{BODY} First, a short item Second {MORE}",
    ),
    "references and spaces": (
        f"<article><p>A&amp;B &lt;tag&gt; caf&eacute;&nbsp;&#8212;\n\t {BODY}<br>x<b>y</b>z</p><script>var a = '<p>no</p>';</script><style>p{{}}</style></article>",
        f"A&B <tag> café — {BODY} xyz",
    ),
    "torn": (f"<nav><a href='/'>x</a></nav><article title='a > b'><h1>High water</h1><p>{BODY}<p>{MORE}</p><foot", f"High water {BODY} {MORE}"),
    "table and quote": (
        f"<main><p>{BODY}</p><table><tr><td>North field<td>2 metres<tr><td>South field<td>3 metres</table><blockquote>{MORE}</blockquote><pre>a\n b</pre></main>",
        f"{BODY} North field 2 metres South field 3 metres {MORE} a b",
    ),
}


def test_known_pages():
    for name, (html, text) in PAGES.items():
        assert main_text(html, PRIOR.tolist()) == text, name


def test_whole_table(spark):
    """The test pages have one article each; what stands in it is the main text."""
    got = op12_html_extraction(spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    expected = {}
    for page in pages.itertuples():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)
        expected[page.page_id] = " ".join(unescape(re.sub(r"<[^>]*>", " ", article[1])).split())
    assert len(got) == len(pages) and dict(zip(got.page_id, got.text)) == expected
    assert (got.n_chars == got.text.map(len)).all()


def test_odd_tables(spark):
    long = "<article>" + f"<p>{BODY}</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + f"<p>{BODY}</p>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGES["torn"][0]), (3, "u", long), (3, "u", long), (4, "u", deep), (5, "u", "<a '" * 2000), (6, "u", "no markup at all"), (7, "u", "&#0; &#xD800; \u0001")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = extract(table).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == texts[2] == "" and texts[None] == PAGES["torn"][1]
    assert texts[3] == " ".join([BODY] * 20_000) and texts[4] == BODY
    assert extract(table.limit(0)).collect() == []
    out = with_main_text(table, "main", PRIOR)
    assert out.columns == [*table.columns, "main"]


def test_training_sharpens_but_keeps_the_prior():
    seen = Page(PAGES["notices"][0] * 200).cells()
    counts = {c: seen.count(c) for c in set(seen)}
    odds = log_odds(counts)
    assert odds.shape == PRIOR.shape and not (odds == PRIOR).all()
    assert main_text(PAGES["sidebar, form, comments"][0], odds.tolist()) == PAGES["sidebar, form, comments"][1]
