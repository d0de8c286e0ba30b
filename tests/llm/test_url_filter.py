import random

import pytest

from docloom.llm import url_filter as U


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), h + p, v))
    return host, path, best[2] if best else None, best[3] if best else default


RULES = [("net", "/", "block"), ("a.net", "/x", "allow"), ("com", "/x/y", "block"), ("b.com", "", "allow"), ("a.net", "/x/y/z", "block")]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(7)
    hosts = ["net", "a.net", "A.Net", "w.a.net", "xa.net", "com", "b.com", "c.b.com", "org", "", ".net", "a..net"]
    paths = ["", "/", "/x", "/x/", "/x/y/z", "/X", "/x/y?q", "?q/x", "#f", "/x#/y"]
    made = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return [*made, None, "", "net/", "mailto:a@net", "http://", "http://a.net://b.com/x"]


@pytest.mark.parametrize("limit", [U.MAX_FILTER_BYTES, 0])
def test_against_brute_force(spark, urls, limit):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "1 as rule")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge(pages, rules, max_filter_bytes=limit).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_long_list_needs_levels_and_is_exact(spark):
    rules = spark.range(400).selectExpr("concat('h', id * 3, '.org') as host", "'/' as path", "'block' as verdict")
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id, '.org/p') as url")
    got = U.judge(pages, rules).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(0, 1200, 3))
    universe, listed = pages.selectExpr("concat('h', page_id, '.org/') as key"), rules.selectExpr("concat(host, path) as key")
    assert len(U.build_cascade(listed, universe, 400, 3000).levels) > 1


def test_empty_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None), (1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in U.judge(pages, none, default="block").collect()} == {"block"}
    rules = spark.createDataFrame([(None, None, "block"), ("", "", "allow")], "host string, path string, verdict string")
    got = U.judge(pages, rules).collect()
    assert len(got) == 3 and {r.verdict for r in got if r.host == ""} == {"block"}
    assert U.judge(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        U.judge(pages, spark.createDataFrame([("a", "/", "maybe")], "host string, path string, verdict string"))
