import html
import os
import random
import re

import pytest

from docloom.llm import dom
from docloom.llm import extraction as E
from docloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are missing")
def test_pages_against_a_plain_reading(spark):
    got = {r.page_id: r for r in QUERIES["op10_html_extraction"](spark, SF_DIR).collect()}
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = p.html.split("<article>", 1)[1].split("</article>")[0]
        blocks = [re.sub(r"</?b>|<br>", " ", b) if "<br>" in b else re.sub(r"</?b>", "", b) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def page(i, body, notice="We use cookies here."):
    return f"<html><head><title>t{i}</title></head><body><div>{notice}</div><ul class='menu'><li><a href=/>m{i}</a></ul>{body}<div class='comments'><p>c{i}</p></div><aside>s{i}</aside></body></html>"


def test_what_a_host_shares_is_its_template(spark):
    rows = [(i, f"http://a.org/{i}", page(i, f"<div><p>Text {i} &amp; more</p><p>End&nbsp;{i}</p></div>")) for i in range(8)]
    rows += [(8, "http://b.org/", page(8, "<p>x</p>", "Own words."))]
    rows += [(20 + i, "http://c.org/", page(1, "<p>copy</p>")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as pivot")
    got = {r.page_id: r.text for r in E.extract(df).collect()}
    assert {i: got[i] for i in range(8)} == {i: f"Text {i} & more\nEnd {i}" for i in range(8)}
    assert got[8] == "Own words.\nx" and got[20] == "We use cookies here.\ncopy"
    shared = [(i, "http://d.org", f"<article><p>same</p><div>share</div><p>own {i}</p></article>") for i in range(8)]
    df = spark.createDataFrame(shared, "page_id long, url string, html string")
    assert {r.text for r in E.extract(df).collect()} == {f"same\nown {i}" for i in range(8)}


def test_what_elements_say(spark):
    cases = {
        "<nav>n</nav><main class='with-sidebar'><header><h1>T</h1></header><p>a<br>b</p><form>f</form><p class=ad>x</p></main><footer>f</footer>": "T\na b",
        "<div class='page sidebar-left'><article>A<p>b<p>c</article></div><p>out</p>": "A\nb\nc",
        "<article class=comment>c</article><p>main</p><p><a href=x>link only</a></p>": "main",
        "<p>a &lt;b&gt; &#233;&#x41; &amp c <script>x<y</script><!-- no --> d": "a <b> éA & c d",
        "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
        "<p title='a > b'>quoted <b>bo</b>ld</p": "quoted bold",
        "plain": "plain",
        "": "",
        None: "",
        "<script>only": "",
    }
    rows = [(i, None, h) for i, h in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in E.extract(df).collect()}
    assert list(map(got.get, range(len(cases)))) == list(cases.values())
    assert E.extract(df.limit(0)).count() == 0
    assert E.extract(df.union(df)).count() == 2 * len(cases)


def slow_match(a, b):
    if a.sign != b.sign:
        return 0
    best = {(-1, j): 0 for j in range(-1, len(b.children))} | {(i, -1): 0 for i in range(-1, len(a.children))}
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + slow_match(x, y))
    return best[len(a.children) - 1, len(b.children) - 1] + 1


def test_matching_against_recursion():
    rng = random.Random(1)

    def tree(depth):
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0))}</{tag}>"

    for _ in range(60):
        a, b = (dom.shape_of(dom.parse(tree(3))) for _ in range(2))
        assert dom.match(a, b) == slow_match(a, b)
        one = dom.parse(tree(3))
        dom.align(dom.shape_of(one), dom.shape_of(one))


def test_long_page(spark):
    body = "<p>" + "</p><p>".join(f"w{i} &amp; x" for i in range(20_000)) + "</p>"
    df = spark.createDataFrame([(1, "http://a.org", f"<article>{body}</article>")], "page_id long, url string, html string")
    assert E.extract(df).first().text.count("\n") == 19_999


@pytest.mark.parametrize("name", ["table", "varied", "list", "alternating", "deep"])
def test_large_pages_align_in_bounded_space(name):
    import tracemalloc

    rng = random.Random(4)
    rows = {
        "table": lambda n: f"<table>{''.join(f'<tr><td>a{i}<td>b{i}' for i in range(n))}</table>",
        "varied": lambda n: f"<table>{''.join('<tr>' + '<td>x' * rng.randint(1, 3) + '<th>y' * rng.randint(0, 1) for i in range(n // 4))}</table>",
        "list": lambda n: f"<ul>{''.join(f'<li><p>a{i}</p></li>' for i in range(n))}</ul>",
        "alternating": lambda n: f"<dl>{''.join(f'<dt>a{i}<dd>b{i}' for i in range(n))}</dl>",
        "deep": lambda n: "<div>t" * (n // 4) + "</div>" * (n // 4),
    }[name]
    one, other = (f"<body>{start}{rows(n)}</body>" for start, n in (("<h1>a</h1>", 20_000), ("<h2>a</h2>", 19_000)))
    E._pivot.cache_clear()
    tracemalloc.start()
    page, keys = E.keyed_blocks(one, one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(keys) == len(page.texts)
    assert all(owner.slot > 0 for owner in page.owners)
    page, keys = E.keyed_blocks(one, other)
    assert len(keys) == len(page.texts) and E.main_text(one, other, frozenset()).count("\n") == len(page.texts) - 1
    if name in ("table", "list"):
        assert len({owner.slot for owner in page.owners if owner.tag in ("td", "p")}) <= 2


def test_tables_made_again_in_blocks(monkeypatch):
    """Pairs are in order, and come to the score, however few rows of a table are kept."""
    rng = random.Random(6)

    def page():
        rows = "".join(f"<{t}>{'<p>x</p>' * rng.randint(0, 1)}<i>y</i></{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randint(1, 30)))
        return dom.shape_of(dom.parse(rows))

    for kept in (2, 3, 64):
        monkeypatch.setattr(dom, "KEPT_ROWS", kept)
        for _ in range(30):
            a, b = page(), page()
            matching = dom.Matching(a.kinds, b.kinds)
            pairs = sorted(matching.pairs(a.kind, b.kind).items())
            assert all(x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
            assert dom.match(a, b) == slow_match(a, b) == 1 + sum(slow_match(a.children[i], b.children[j]) for i, j in pairs)


def test_class_words_and_links_of_articles():
    cases = {
        '<article><header class="entry-header"><h1>Title</h1></header><p>a</p></article>': "Title\na",
        "<article><p class='form-of-verb'>a</p><div class='notice'>b</div><div class='share-price'>c</div><div class='toc-entry search'>d</div></article>": "a\nc\nd",
        "<main><div class='sidebar'>x</div><nav>y</nav><p class='ad'>z</p><p>a</p></main>": "a",
        "<div><p>A long enough paragraph of text.</p><p><a href=x>its source</a></p></div>": "A long enough paragraph of text.\nits source",
        "<p>t</p><ol><li>Author, Title of a work, 1999. <a href=x>doi</a></li><li><a href=y>A work online</a></li></ol>": "t\nAuthor, Title of a work, 1999. doi\nA work online",
        "<p>t</p><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>": "t",
    }
    assert [E.main_text(h, h, frozenset()) for h in cases] == list(cases.values())


BOXES = [
    "<div class=notice>We moved</div>",
    "<div class='cookie-notice'><p>We use cookies</p></div>",
    "<div class='sidebar-box'><p>More from us</p></div>",
    "<div class='social-share'>Share this</div>",
    "<div class='newsletter-box'><p>Join our list</p></div>",
    "<div class='alert banner'>Sale</div>",
    "<header class='site-header'><p>The Daily</p></header>",
    "<div class=footer>All rights</div>",
    "<footer>Foot</footer>",
    "<div id=footer><p>Foot</p></div>",
    "<div hidden>Not shown</div>",
    "<p style='color: red; display: none'>Not shown</p>",
    "<div role=complementary>Aside</div>",
]
KEPT = [
    "<header class='entry-header'><h1>Title {0}</h1></header>",
    "<div class='share-price' data-id='ad-1'>{0} points</div>",
    "<p class='form-of-verb' title=\"x class='ad' y\">form {0}</p>",
    "<div class='toc-entry search'>entry {0}</div>",
    "<div class='content-box'><p>boxed {0}</p></div>",
    "<div hidden=until-found style='display:block'>found {0}</div>",
    "<h2 class=header>Part {0}</h2>",
    "<p>Shared by all pages</p>",
]


@pytest.mark.parametrize("around", ["<main>{}</main>", "<body><article data-id='ad-1' data-role=comment>{}</article>", "<div><main id=content>{}</main></div>"])
def test_boxes_inside_a_main_element_go(spark, around):
    """Of one host with each box on all pages, and of pages alone with one box each."""
    parts = [x for pair in zip(BOXES, KEPT + [""] * 9, strict=False) for x in pair]
    rows = [(k, "http://a.org/", around.format("".join(p.format(k) for p in parts))) for k in range(8)]
    rows += [(100 + k, f"http://h{k}.org/", around.format(f"<p>text {k}</p>{box}")) for k, box in enumerate(BOXES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in E.extract(df).collect()}
    for k in range(8):
        assert got[k] == f"Title {k}\n{k} points\nform {k}\nentry {k}\nboxed {k}\nfound {k}\nPart {k}\nShared by all pages"
    assert [got[100 + k] for k in range(len(BOXES))] == [f"text {k}" for k in range(len(BOXES))]


def test_a_template_word_and_a_shared_text_go_together(spark):
    """A word of other matter among others tells only of what all pages of a host share."""
    page = "<article><p>own {0}</p><div class='promo-free share-note'><p>{1}</p></div></article>"
    rows = [(k, "http://a.org", page.format(k, "the same")) for k in range(8)]
    rows += [(10 + k, "http://b.org", page.format(k, f"another {k}")) for k in range(8)]
    page = page.replace("promo-free", "quiet")
    rows += [(20 + k, "http://c.org", page.format(k, "the same")) for k in range(8)]
    rows += [(30 + k, "http://d.org", page.format(k, f"another {k}")) for k in range(8)]
    got = {r.page_id: r.text for r in E.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in (*range(8), *range(10, 18))} == {f"own {k}" for k in range(8)}  # promo tells by itself
    assert [got[20 + k] for k in range(8)] == [f"own {k}" for k in range(8)]
    assert [got[30 + k] for k in range(8)] == [f"own {k}\nanother {k}" for k in range(8)]
