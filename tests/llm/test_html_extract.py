import random

import pytest
from pyspark.sql import functions as F

from corpusguard.llm import html_extract as module
from corpusguard.llm.html_extract import Page, Paths, extract_text, importance, low_by_labels, main_text

SCHEMA = "page_id long, url string, html string, host string, low int, path int"

CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p>a<p>b<br>c", "a b c"),
    ("<article><h1>T &amp; U</h1><p>x<b>y</b>z&#233;&nbsp;&lt;p&gt;</p></article><footer>f</footer>", "T & U xyzé <p>"),
    ("<nav>n</nav><article><p><b>one<br><p>two &am</article>tail", "one two &am"),
    ("<article>a<script>if (a<b) x='</p>'</script>b<style>p{}</style><!-- c > --><form>q<input value='</article>'></form></article>", "a b"),
    ("<article>a<div class='comments'>c<article class=comment>d</article></div><aside>e</aside>b</article>", "a b"),
    ("<header>h</header><main>m<header>k</header><div id=sidebar-2>s</div></main><div>o</div>", "m k"),
    ("<body class='page with-sidebar'><div class='cookie-notice'>c</div><div>t</div><div role=navigation>n</div></body>", "t"),
    ("<article>a < b and c > d</article>", "a < b and c > d"),
    ("<article>a<p title='x > y'>b</p", "a b"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ("<ul><li>a<li>b</ul>", "a b"),
    ("<script>never closed", ""),
    ("<article>wor<i>d</i>s</i></b> x</article>", "words x"),
    ("<article>one</article><div class=ad>x</div><article>two</article>", "one two"),
    ("<div class='ad'>x</div><article></article><p>y", "y"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"),
]


def by_labels(page):
    """The text of a page of which only the labels are known."""
    paths = Paths()
    return main_text(page, low_by_labels(page, paths), paths)


@pytest.mark.parametrize(("page", "text"), CASES)
def test_one_page(page, text):
    assert by_labels(page or "") == text


def test_rows(spark):
    data = [(i, "http://h/x" if i % 2 else None, h, "x", 1, 1) for i, (h, _) in enumerate(CASES)]
    data += [data[4], (None, "http://h/y", "<p>n</p>", "x", 1, 1), (99, "u", "<article>" + "long " * 100_000 + "</article>", "x", 1, 1)]
    got = extract_text(spark.createDataFrame(data, SCHEMA)).collect()
    expected = [(i, t) for i, (_, t) in enumerate(CASES)] + [(4, CASES[4][1]), (None, "n"), (99, ("long " * 100_000).strip())]
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_what_a_site_repeats_goes(spark, limit, monkeypatch):
    """Without names that say so, layout shows by standing alike on a host's pages."""
    monkeypatch.setattr(module, "BROADCAST_KEYS", limit)
    rng = random.Random(2)

    def text(n):
        return " ".join(rng.choice("abcdefghij") * 3 for _ in range(n))

    data, expected = [], {}
    for i in range(60):
        body = text(30)
        if i < 40:  # one host with a layout, a third of its articles copies
            body = "copied words" if i % 3 == 0 else body
            page = f"<body><div class=x1><div>Home Shop</div></div><div class=x2><p>{body}</p><section>Read more on our site</section></div><div class=x3>all rights</div>"
            expected[i] = body
            data.append((i, f"http://one.example/{i}", page, "x", 1, 1))
        else:  # many hosts with a page each: what they have in common shows over all hosts
            page = f"<body><div class=x1>{body}</div><div class=x3>all rights</div><div class=y{i}>by {i}</div>"
            expected[i] = f"{body} by {i}"
            data.append((i, f"http://h{i}.example/", page, "x", 1, 1))
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == expected


def cut_out(pages):
    """Brute force for pages whose one article is marked: cutting it out."""
    import html
    import re

    inner = {r.page_id: re.search(r"<article>(.*)</article>", r.html, re.S)[1] for r in pages.collect()}
    return {i: " ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for i, x in inner.items()}


def test_against_the_article_of_plain_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == cut_out(pages)


def test_the_tree_does_the_work(spark, monkeypatch):
    """With an emptied tree the same pages keep their menus, adverts and footers."""
    pages, whole = spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), module.style_tree
    tree = whole(pages.select(F.xxhash64(module.host_and_path(F.col("url"))[0]).alias("site"), "html"))
    assert tree.where(f"importance < {module.THRESHOLD}").count() > 0 and tree.where("importance > 0.9").count() > 0
    monkeypatch.setattr(module, "style_tree", lambda rows: whole(rows).where("false"))
    got, want = {r.page_id: r.text for r in extract_text(pages).collect()}, cut_out(pages)
    assert all(len(got[i]) > len(want[i]) and want[i] in got[i] for i in want)


def test_importances_against_plain_entropies(spark):
    """The tree's numbers, from the pages' branches by plain counting."""
    import math
    from collections import defaultdict

    rng = random.Random(4)
    data = []
    for i in range(50):
        parts = [f"<div class=a>{rng.choice('xyz')}</div>", f"<p>{rng.random()}", "<div class=ad>buy</div>", f"<section>{'<i>k</i>' * rng.randrange(3)}</section>"]
        data.append((i, f"http://h{i % 3 if i % 7 else i}/", "".join(rng.sample(parts, rng.randrange(1, 5))), "x", 1, 1))
    paths, here, every, odds = Paths(), defaultdict(list), defaultdict(list), defaultdict(float)
    for _, url, page, *_ in data:
        for path, (shown, text, prior) in Page(page, paths).branches().items():
            for kind, value in enumerate((shown, text)):
                here[url, path, kind].append(value)
                every[path, kind].append(value)
            odds[url, path] = max(odds[url, path], prior)

    def entropy(values):
        m = len(values)
        return -sum(values.count(v) / m * math.log(values.count(v) / m) for v in set(values)) / math.log(m) if m > 1 else 0.5

    want = []
    for url, path in odds:
        mean = 0.0
        for kind, weight in ((0, 1 - module.CONTENT), (1, module.CONTENT)):
            n, n_all = len(here[url, path, kind]) - 1, len(every[path, kind]) - 1
            around = (n_all * entropy(every[path, kind]) + module.SHRINK / 2) / (n_all + module.SHRINK)
            mean += weight * (n * entropy(here[url, path, kind]) + module.SHRINK * around) / (n + module.SHRINK)
        want.append((path, round(importance(mean, odds[url, path]), 9)))
    frame = spark.createDataFrame(data, SCHEMA)
    got = module.style_tree(frame.select(F.xxhash64("url").alias("site"), "html")).collect()
    assert sorted((r.path, round(r.importance, 9)) for r in got) == sorted(want)


def test_an_article_may_open_with_inline_noise():
    one = "<article><a class=share>Share</a><p>first text</p></article>"
    assert by_labels(f"<body><p>outside</p>{one}</body>") == "first text"
    assert by_labels(f"<body>{one}<p>outside</p><article><p>second text</p></article></body>") == "first text second text"
    # The same with an inline branch that is alike on all pages of a host.
    page = "<body><p>outside</p><article><span class=kicker>Daily</span><p>first text</p></article></body>"
    paths = Paths()
    parsed = Page(page, paths)
    kicker = next(k for n, k in zip(parsed.nodes, parsed.keys, strict=True) if n.tag == "span")
    assert main_text(page, {kicker} | low_by_labels(page, paths), paths) == "first text"
    # An article inside noise, inline or not, still goes.
    assert by_labels("<body><div class=ads><article>spam</article></div><article>text</article></body>") == "text"
