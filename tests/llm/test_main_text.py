"""Main text where the style tree and the lists of tags and classes disagree."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusveil.llm.html import DEALT, FREE, branches, combined, extract, leaf, main_text, parse, style_tree


def texts_of(spark, pages):
    docs = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["k"]: r["text"] for r in extract(docs).collect()}


def test_importance_decides_over_all_elements(spark):
    page = "<body><article><h4>Read more here</h4><p>text number {0}</p><p>same line everywhere</p><p class=x>and again</p><ul><li>item {0}<li>same item</ul></article><div class=related>story {0}</div><div class=sponsor>buy {1}</div></body>"
    got = texts_of(spark, [page.format(i, i % 50) for i in range(200)])
    article = {i: f"text number {i}\n\nitem {i}" for i in range(200)}
    assert got == article
    outside = page.replace("article>", "div>")
    got = texts_of(spark, [outside.format(i, i % 50) for i in range(200)])
    assert got == {i: f"{article[i]}\n\nstory {i}" for i in range(200)}
    assert texts_of(spark, [outside.format(i, i % 50) for i in range(4)]) == {i: f"Read more here\n\ntext number {i}\n\nsame line everywhere\n\nand again\n\nitem {i}\n\nsame item" for i in range(4)}


def test_names_do_not_outweigh_the_text():
    body = "<p>" + "long story " * 20 + "</p>"
    text = ("long story " * 20).strip()
    for wrapper in ("div id=page class='site header-fixed'", "div class='content with-sidebar'", "article class='post share-enabled'", "div class='post has-comments'", "div class='layout sidebar-left'", "form id=f"):
        tag = wrapper.split()[0]
        assert main_text(f"<div class=menu>menu</div><{wrapper}><div class=entry-header><h1>Head</h1></div>{body}<div class=post-share>share</div></{tag}>") == f"Head\n\n{text}", wrapper
    assert main_text(f"<main><div class=story>{body}</div><article class=teaser><p>other</p></article></main>") == f"{text}\n\nother"
    assert main_text(f"<main><article>{body}</article><p>more</p></main><p>x</p>") == text
    assert main_text(f"<main><p>short</p></main><div>{body}</div>") == f"short\n\n{text}"
    assert main_text("<article><p>a b c</p></article><nav>a long menu of the site</nav><div class=ad>buy</div>") == "a b c"


def test_odd_markup_is_read_in_linear_time():
    import time

    for source in ('<a x"b' * 100_000, "<a '>' " * 100_000, "<div>" * 60_000 + "x", "<div>" * 30_000 + "</p>" * 60_000, "<ul>" + "<li><div>" * 30_000, "<svg>x" * 80_000, "<" * 500_000, "<!x" * 200_000, "<script>x" * 50_000):
        began = time.process_time()
        main_text(source)
        branches(source)
        assert time.process_time() - began < 20, source[:20]
    assert main_text('<p title="a > b">x</p><p title="never closed>y</p>') == "x\n\ny"
    assert main_text("<title>t</title><p>a <span hidden>no</span> b <span class='ad'>buy <span>now</span></span> c</p><svg/><p>d</p><canvas><p>e") == "a b c\n\nd\n\ne"
    assert main_text("<p>1 < 2 and x<y") == "1 < 2 and x<y" and main_text("a<!-- never closed <p>b") == "a"


def test_importance_is_combined_up_the_tree():
    page = parse("<div class=a><p>one one</p><p>two</p></div><div class=b><p>three</p></div>")
    a, b = page.parts
    low = {a.path: 0.1, a.parts[0].path: 0.2, leaf(a.parts[0].path, "one one"): 0.0}
    p = 0.5 * 0.2 + 0.5 * 0.0, 0.5 * 0.2 + 0.5 * 1.0
    assert combined(page, low) == pytest.approx({id(a.parts[0]): p[0], id(a.parts[1]): p[1], id(a): 0.5 * 0.1 + 0.5 * (7 * p[0] + 3 * p[1]) / 10})
    assert id(b) not in combined(page, low)


def test_the_tree_equals_brute_force(spark):
    """Entropies of presentation and content by path, and the spread of leaves, from the definition."""
    rng = random.Random(2)
    pages = []
    for i in range(40):
        host = rng.choice(["a.example", "b.example", "b.example"])
        menu = "".join(f"<li>{x}</li>" for x in rng.sample(["home", "news", "help"], 2))
        pages.append((i, f"http://{host}/{i}", f"<body><ul>{menu}</ul><div class=n><p>text {i}</p>{'<p>often</p>' * (i % 2)}</div><div class=f>{rng.choice(['x', 'y'])}</div></body>"))
    pages += [(100 + i, *pages[i][1:]) for i in range(5)] + [(200, None, pages[0][2]), (201, "http://a.example/", None)]
    docs = spark.createDataFrame(pages, "page_id long, url string, h string").withColumn("host", F.coalesce(F.regexp_extract("url", "//([^/]+)", 1), F.lit("")))
    got = {(r["host"], r["path"], r["leaf"]): (r["m"], r["importance"], r["evidence"]) for r in style_tree(docs).collect()}
    seen = {}
    for _, url, source in pages:
        if url and source:
            rows, page = branches(source)
            for path, look, content, is_leaf in rows:
                seen.setdefault((url.split("/")[2], path, is_leaf), {}).setdefault(content if is_leaf else (look, content), set()).add(page)
    whole = lambda m: {p for pages in m.values() for p in pages}

    def entropy(counts, m):
        return -sum(n / m * math.log(n / m) for n in counts) / math.log(m) if m > 1 else 1.0

    want = {}
    for (host, path, is_leaf), contents in seen.items():
        m = len(whole(contents))
        if is_leaf:
            for place, on in contents.items():
                if len(on) > 1:
                    want[host, place, True] = (m, ((1 - math.log(len(on)) / math.log(m)) * m + 1) / (m + 1), 0.0)
        else:
            look, content = ([len({p for key, on in contents.items() if key[at] == x for p in on}) for x in {key[at] for key in contents}] for at in (0, 1))
            m = sum(content)
            expected = [m - v * (1 - (1 - 1 / v) ** m) for v in (DEALT, FREE)]
            evidence = (m - len(content)) * math.log(expected[0] / expected[1]) - expected[0] + expected[1] if m > 1 else 0.0
            want[host, path, False] = (m, ((0.1 * entropy(look, m) + 0.9 * entropy(content, m)) * m + 1) / (m + 1), evidence)
    assert {k: m for k, (m, *_) in got.items()} == {k: m for k, (m, *_) in want.items()}
    assert all(got[k] == pytest.approx(x, rel=1e-6) for k, x in want.items())


def test_unnamed_branches_dealt_out_of_few_texts_go(spark):
    """Menus and notices without names, from 60 texts on 50 pages; headings, articles and running text stay, few pages say nothing."""
    rng = random.Random(4)
    page = "<body><div class=a><ul><li>menu {0}</li></ul></div><div class=b>buy {1} now</div><div class=c><h2>part {2}</h2><p>story of number {3} and what came of it</p></div><article><p class=d>line {4}</p></article></body>"
    pages = [page.format(rng.randrange(60), rng.randrange(60), rng.randrange(60), i, i % 9) for i in range(50)]
    parts = [re.findall(r"part \d+|story[^<]+|line \d", p) for p in pages]
    assert texts_of(spark, pages) == {i: "\n\n".join(x) for i, x in enumerate(parts)}
    assert texts_of(spark, pages[:5])[0].startswith("menu ")


def test_what_readers_write_goes_however_it_differs(spark):
    page = "<body><div class=post><p>story of number {0} and what came of it in the end</p></div><div class=comments><p>I think {0}</p></div><div class=related><p>see {0}</p></div></body>"
    assert texts_of(spark, [page.format(i) for i in range(150)])[7] == "story of number 7 and what came of it in the end\n\nsee 7"


def test_rows_of_any_kind_come_back(spark):
    rows = [(1, "http://h.example/1", "<p>a</p>", "x", 1), (1, "http://h.example/1", "<p>a</p>", "y", 2), (None, None, "<p>b", None, None), (2, "no url", None, "z", 3), (3, "", "", None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")).collect()
    assert sorted(((r["k"], r["url"], r["text"], r["n_chars"]) for r in got), key=str) == sorted([(1, "http://h.example/1", "a", 1)] * 2 + [(None, None, "b", 1), (2, "no url", "", 0), (3, "", "", 0)], key=str)


def test_names_in_an_article_remove_no_headings_and_sections():
    page = '<main><article><h2 class="header">Title</h2><p>first</p><section id="related-work"><p>earlier</p></section><div class="search-results-explained"><p>why</p></div><div class="ad"><p>buy</p></div><ol class="commentlist"><li>me too</li></ol><div class="comments"><p>no</p></div><p>last</p></article></main>'
    assert main_text(page) == "Title\n\nfirst\n\nearlier\n\nwhy\n\nlast"
    assert main_text('<div class="related-links"><p>x</p></div><article><p>one</p></article>') == "one"
