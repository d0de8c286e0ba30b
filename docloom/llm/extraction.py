"""Main text of web pages by wrapper induction.

Pages of a host share a template. One page of each host is its pivot; every page's DOM tree is aligned
with its pivot's by simple tree matching, which gives each block of text a slot. Over all pages of the
host it is counted in how many different pages a slot holds a text. Texts that at least ``CONSTANT`` of
them share (and ``MIN_PAGES`` of them) are the template's own: menus, notices, taglines. What varies is
content, unless the slot's element says that it is none (menus, headers, footers, sidebars, adverts,
forms, comments), or it and the list or element around it are mostly links. If a page has an ``article``
or ``main`` element, only what is inside is its text, and fewer class words tell there.

Texts are counted by hashes, added up before they move; copies of a page count once. A host that holds
a third of all pages is counted like others, and its pages never meet in one task. Pivots and constants
come to the pages by a broadcast while they fit ``BROADCAST_BYTES``, and else by a join that adaptive
execution splits where a host is hot.

Null HTML is empty and its text is empty. A null URL, or one without a host, belongs to the host ''.
Pages whose whole text would be the template's (copies of one page) keep it. Repeated pages and null
page ids are treated row by row; extra columns are carried along, and their names may be any but those
added here. An empty table stays empty.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import dom
from docloom.llm.tables import stored
from docloom.llm.url_filter import host_and_path

#: Share of a host's different pages, and their number, from which a text is the template's.
CONSTANT, MIN_PAGES = 0.5, 5
BROADCAST_BYTES = 16 << 20

#: Elements, and words of classes, ids and roles, that hold no main text.
OTHER_TAGS = frozenset("nav header footer aside form button fieldset dialog menu".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc header masthead topbar footer "
    "sidebar rail aside widget cookie cookies consent gdpr notice notices notification alert warning disclaimer "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus replies respond complementary contentinfo search form".split()
)
#: Those of them that tell even of an element that is, or is around, a main one.
STRICT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements comment comments commentlist disqus replies respond "
    "sponsor sponsored promo promotion related recommended popup modal overlay".split()
) | {dom.HIDDEN}
#: Words that say only how an element looks or what it is around. Inside a main element ``OTHER_WORDS`` tell if an
#: element has no words besides them and these: a ``sidebar-box`` goes, an ``entry-header`` or ``share-price``
#: may be of the article.
PLAIN_WORDS = frozenset(
    "area bar block bottom box button buttons card container content cta col column grid group icon icons inner item "
    "items left link links list outer panel region right row section site small text tools top wrap wrapper".split()
)
#: Those that do not tell of a heading or paragraph of a main element.
HEADING_WORDS = frozenset("header toc form search".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements of running text: inside a main element their texts stay, however many pages share them, unless the
#: element or one around it has a word of other matter.
TEXT_TAGS = frozenset("article main p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption".split())
#: Parts of a container, and elements that are no container of one piece.
PART_TAGS = TEXT_TAGS | frozenset("tr tbody thead tfoot".split())
WHOLE_TAGS = frozenset("#page html body".split())


def _container(node: dom.Node) -> dom.Node:
    """The list or other element that a paragraph, or an item of a list or table, is part of."""
    while node.tag in PART_TAGS and node.parent is not None:
        node = node.parent
    return node


def _is_other(node: dom.Node) -> bool:
    """Whether the words of an element inside a main one tell that it is none of the article."""
    words = node.words - PLAIN_WORDS
    return bool(words) and words <= (OTHER_WORDS - HEADING_WORDS if node.tag in TEXT_TAGS else OTHER_WORDS)


def is_tinted(node: dom.Node) -> bool:
    """Whether an element, or one around it up to the main element, has a word of other matter among its words."""
    while node is not None and node.tag not in MAIN_TAGS:
        if node.words & OTHER_WORDS:
            return True
        node = node.parent
    return False


def content_blocks(page: dom.Page) -> tuple[list[int], bool]:
    """Numbers of the blocks that their elements allow to be main text, and whether these are the
    blocks inside main elements."""
    nodes: dict[int, dom.Node] = {}
    for owner in page.owners:
        up = owner
        while up is not None and id(up) not in nodes:
            nodes[id(up)] = up
            up = up.parent
    around_main: set[int] = set()
    for node in nodes.values():
        if node.tag in MAIN_TAGS and not node.words & STRICT_WORDS:
            up = node
            while up is not None and id(up) not in around_main:
                around_main.add(id(up))
                up = up.parent
    seen: dict[int, tuple[bool, bool]] = {}

    def place(node: dom.Node) -> tuple[bool, bool]:
        """Whether a node is inside other matter, and inside a main element."""
        path, up = [], node
        while up is not None and id(up) not in seen:
            path.append(up)
            up = up.parent
        other, main = seen[id(up)] if up is not None else (False, False)
        for down in reversed(path):
            if down.tag not in ("#page", "html", "body"):
                inner = main or id(down) in around_main
                tags = OTHER_TAGS - {"header"} if main else OTHER_TAGS
                other = other or bool(down.words & (STRICT_WORDS if inner else OTHER_WORDS))
                if id(down) not in around_main:
                    other = other or down.tag in tags or (main and _is_other(down))
            main = main or down.tag in MAIN_TAGS
            seen[id(down)] = (other, main)
        return seen[id(node)]

    allowed = [i for i, owner in enumerate(page.owners) if not place(owner)[0]]
    in_main = [i for i in allowed if place(page.owners[i])[1]]
    if in_main:
        return in_main, True
    # a block that is mostly links is text if the list or container it stands in is not
    sums: dict[int, list[int]] = {}
    for i in allowed:
        of = sums.setdefault(id(_container(page.owners[i])), [0, 0])
        of[0] += page.links[i]
        of[1] += len(page.texts[i])

    def mostly_text(i: int) -> bool:
        if 2 * page.links[i] <= len(page.texts[i]):
            return True
        within = _container(page.owners[i])
        if within.tag in WHOLE_TAGS:
            return False
        links, chars = sums[id(within)]
        return 2 * links <= chars

    return [i for i in allowed if page.owners[i].tag != "head" and mostly_text(i)], False


@functools.lru_cache(maxsize=256)
def _pivot(source: str) -> dom.Shape:
    return dom.shape_of(dom.parse(source))


def keyed_blocks(source: str | None, pivot: str | None) -> tuple[dom.Page, list[int]]:
    """A page aligned with its pivot, and a number for slot and text of each block."""
    page = dom.parse(source)
    dom.align(dom.shape_of(page), _pivot(pivot or ""))
    keys = []
    for text, owner in zip(page.texts, page.owners, strict=True):
        data = text.encode("utf-8", "surrogatepass")
        low = zlib.crc32(data) | zlib.adler32(data) << 32
        keys.append((low ^ (owner.slot & 0xFFFFFFFF) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63))
    return page, keys


def main_text(source: str | None, pivot: str | None, constants: frozenset[int]) -> str:
    page, keys = keyed_blocks(source, pivot)
    blocks, main = content_blocks(page)
    stays = lambda owner: main and owner.tag in TEXT_TAGS and not is_tinted(owner)
    varying = [i for i in blocks if keys[i] not in constants or stays(page.owners[i])]
    return "\n".join(page.texts[i] for i in varying or blocks)


def induce(pages: DataFrame) -> DataFrame:
    """``host, pivot, constants`` from ``pages(host, html)``."""
    first = F.min_by("html", F.struct(F.xxhash64("html"), F.length("html")))
    pivots = stored(pages.filter(F.col("html").isNotNull()).groupBy("host").agg(first.alias("pivot")), "pivots")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                hosts, keys, pages_ = [], [], []
                for host, source, pivot in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    found = sorted(set(keyed_blocks(source, pivot)[1]))
                    page = zlib.crc32(repr(found).encode())
                    hosts += [host] * len(found)
                    keys += found
                    pages_ += [page] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(pages_, pa.int64())],
                    ["host", "key", "page"],
                )

    blocks = _with_hosts(pages, pivots).select("host", "html", "pivot").mapInArrow(count, "host string, key bigint, page bigint")
    different = stored(blocks.distinct(), "blocks")
    # a page's hash and host name it; counting them needs no second look at the pages
    totals = different.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    shared = (
        different.groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= MIN_PAGES)
        .join(totals, "host")
        .filter(F.col("n") >= CONSTANT * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_set("key").alias("constants"))  # at most a page's blocks / CONSTANT
    )
    return stored(pivots.join(shared, "host", "left"), "templates")


def _with_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    size = hosts.agg(F.sum(F.octet_length("pivot") + 64)).first()[0] or 0
    return pages.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", "left")


def extract(
    pages: DataFrame, url_column: str = "url", html_column: str = "html", column: str = "text"
) -> DataFrame:
    """``pages`` with the main text of each, blocks joined by a line feed."""
    host, _ = host_and_path(F.coalesce(F.col(url_column), F.lit("")))
    templates = induce(pages.select(host.alias("host"), F.col(html_column).alias("html")))
    names = {c: f"_template_{c}" for c in ("host", "pivot", "constants")}
    hosts = templates.select(*[F.col(c).alias(n) for c, n in names.items()])

    @F.pandas_udf("string")
    def text_of(sources, pivots, constants):
        import pandas as pd

        sets: dict[int, frozenset[int]] = {}

        def as_set(keys) -> frozenset[int]:
            if keys is None or not len(keys):
                return frozenset()
            mark = hash(bytes(keys.data))
            if mark not in sets:
                sets[mark] = frozenset(keys.tolist())
            return sets[mark]

        return pd.Series([main_text(s, p, as_set(k)) for s, p, k in zip(sources, pivots, constants, strict=True)])

    size = templates.agg(F.sum(F.octet_length("pivot") + 64)).first()[0] or 0
    keyed = pages.withColumn(names["host"], host)
    joined = keyed.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, names["host"], "left")
    text = text_of(F.col(html_column), F.col(names["pivot"]), F.col(names["constants"]))
    return joined.withColumn(column, text).drop(*names.values())
