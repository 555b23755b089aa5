"""HTML extraction (operator 1): minimum-cut labelling.

Elements and text blocks of a page are nodes. A linear classifier over tag, names and text gives each node its
cost as content and as boilerplate, the capacities of its edges to the two terminals. Smoothness edges join what
lies near each other: an element or block with the element around it (DOM proximity), strongly inside of an
element that says what it is, weakly elsewhere, and next to nothing where such an element begins; and blocks that
follow each other (adjacency), the more the closer they are in the DOM. A maximum flow from content to boilerplate
leaves the cut of least total cost; the blocks on the content side in page order are the text. So the words of an
advert or a footer go with their element however much they read like an article, and a short heading stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import small_batches, table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms mtext msub msup mfrac msqrt q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it is dropped.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Elements that an opening tag of the key closes when they are the innermost block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that any other block closes, as they can't hold one.
CONTROLS = frozenset("p button select option legend h1 h2 h3 h4 h5 h6".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|aside|footer|foot|"
    r"related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|search|comments?|replies|respond|disqus|pagination|pager|widget|toolbar|toc|tags?|complementary|contentinfo|navigation|gdpr|paywall|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Names that mean boilerplate only where no name of content stands beside them.
WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:side|header|head|masthead)(?:$|[\s_-])", re.I)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body|text|hentry)(?:$|[\s_-])", re.I)
BAD_TAGS = frozenset("nav footer aside form dialog menu fieldset button select datalist noscript template".split())
GOOD_TAGS = frozenset(("article", "main"))
#: Weights of the classifier and of the smoothness edges, per text block.
BAD, GOOD, NAMED, OUTSIDE = 6.0, 3.0, 1.5, 1.0
HOLD, LOOSE, BORDER = 4.0, 0.3, 0.1
HELD = 1e-9


class Page:
    """Elements in the order of their tags: parent, tag, own evidence, depth; and text blocks: text, element, link characters."""

    def __init__(self) -> None:
        self.tag, self.parent, self.depth, self.bad, self.good = ["#"], [-1], [0], [0.0], [0.0]
        self.texts: list[str] = []
        self.of: list[int] = []
        self.linked: list[int] = []

    def open(self, tag: str, parent: int, attributes: str) -> int:
        bad = BAD if tag in BAD_TAGS else 0.0
        good = GOOD if tag in GOOD_TAGS else 0.0
        names = [x.strip("\"'") for x in NAMES.findall(attributes)] if "=" in attributes else []
        fine = any(GOOD_NAME.search(x) for x in names)
        if tag not in ("html", "body"):
            worst = any(BAD_NAME.search(x) for x in names) or not fine and any(WEAK_NAME.search(x) for x in names)
            bad = BAD if worst and not (tag in GOOD_TAGS and fine) else bad
            if not bad and fine:
                good = max(good, NAMED)
        if attributes and HIDDEN.search(attributes):
            bad = BAD
        if tag in GOOD_TAGS:
            up = parent
            while up > 0:  # a form around the whole page is none
                if self.tag[up] == "form":
                    self.bad[up] = 0.0
                up = self.parent[up]
        for column, value in zip((self.tag, self.parent, self.depth, self.bad, self.good), (tag, parent, self.depth[parent] + 1, bad, good)):
            column.append(value)
        return len(self.tag) - 1


def tag_end(page: str, at: int, lost: set[str]) -> int:
    """Behind the ``>`` of the tag that begins before ``at``, quoted values skipped; -1 without one. ``lost``: quotes that don't come any more."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        quotes = [(k, q) for q in "\"'" if (k := page.find(q, at, end)) >= 0 and page[at:k].rstrip()[-1:] == "=" and q not in lost]
        if not quotes:
            return end + 1
        k, q = min(quotes)
        close = page.find(q, k + 1)
        if close < 0:
            lost.add(q)
            return end + 1
        at = close + 1


def parse(page: str) -> Page:
    """Elements and text blocks of a page; character references are decoded, white space is one space. Each character is read a bounded number of times."""
    out = Page()
    node = 0
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    lost: set[str] = set()
    low = page.lower()
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.texts.append(text)
                out.of.append(node)
                out.linked.append(min(linked, len(text)))
            parts.clear()
        linked = 0

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) * (in_link > 0)
        if start == len(page):
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        ends = page.startswith("/", start + 1)
        name = NAME.match(page, start + 1 + ends)
        if not name:
            if page[start + 1 : start + 2] in ("!", "?", "/") and (end := page.find(">", start)) >= 0:
                at = end + 1
            else:
                parts.append("<")
                at = start + 1
            continue
        at = tag_end(page, name.end(), lost)
        if at < 0:  # no tag any more: text
            parts.append(page[start:])
            break
        tag = name[0].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = max(0, in_link + (-1 if ends else 1))
            continue
        close()
        if ends:
            top = node
            while top > 0 and out.tag[top] != tag:
                top = out.parent[top]
            if top > 0:
                node = out.parent[top]
            in_link = 0
            continue
        if tag in RAW:
            end = -1 if tag in unclosed else low.find(f"</{tag}", at)
            if end >= 0:
                at = end
            else:
                unclosed.add(tag)
                at = len(page) if tag in ("script", "style") else at
            continue
        if tag in VOID:
            continue
        while out.tag[node] in CLOSES.get(tag, ()) or out.tag[node] in CONTROLS and tag != "option":
            node = out.parent[node]
        node = out.open(tag, node, page[name.end() : at - 1])
    close()
    return out


def costs(text: str, linked: int, tag: str, outside: bool) -> tuple[float, float]:
    """Capacities (from content, to boilerplate) of a block: length, sentence marks and paragraphs against links, and whether an article lies elsewhere."""
    n = len(text)
    share = linked / n
    keep = 0.5 + min(2.0, n / 150) * (1 - share) + 0.5 * (text[-1] in ".!?…:;\"»”") + 0.4 * (tag in ("p", "h1", "blockquote", "pre"))
    return keep, 0.5 + 1.5 * share + OUTSIDE * outside


def graph(page: Page) -> tuple[list[tuple[float, float]], list[tuple[int, int, float]]]:
    """Terminal capacities of all elements, then all blocks, and smoothness edges between them."""
    n = len(page.tag)
    inside = [0] * n  # blocks below an element
    for k in page.of:
        inside[k] += 1
    for k in range(n - 1, 0, -1):
        inside[page.parent[k]] += inside[k]
    root, bad, main = [0] * n, [False] * n, [False] * n
    ends: list[tuple[float, float]] = []
    edges: list[tuple[int, int, float]] = []
    for k in range(n):
        up = page.parent[k]
        lost, good = page.bad[k], page.good[k]
        if k:
            root[k], bad[k], main[k] = root[up], bad[up], main[up] or page.tag[k] in GOOD_TAGS
            if page.tag[k] == "header" and not main[k]:
                lost = BAD
            good = 0.0 if bad[k] else good
            if lost or good:
                root[k], bad[k] = k, bad[k] or lost > 0
            strength = BORDER if root[k] == k else HOLD if root[k] else LOOSE
            edges.append((up, k, strength * max(1, inside[k])))
        ends.append((good * inside[k], lost * inside[k]))
    elsewhere = any(tag in GOOD_TAGS for tag in page.tag)
    for i, (text, k, linked) in enumerate(zip(page.texts, page.of, page.linked)):
        ends.append(costs(text, linked, page.tag[k], elsewhere and not main[k]))
        edges.append((k, n + i, HOLD if root[k] else LOOSE))
        if i:
            before = page.of[i - 1]
            if root[before] != root[k]:
                edges.append((n + i - 1, n + i, BORDER))
            else:
                far, x, y = 0, before, k
                while x != y and far < 8:
                    far += 1
                    if page.depth[x] >= page.depth[y]:
                        x = page.parent[x]
                    else:
                        y = page.parent[y]
                edges.append((n + i - 1, n + i, 0.2 + 0.5 / (1 + far)))
    return ends, edges


def min_cut(terminals: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut; ``terminals`` are capacities from the source and to the sink.

    Flow through a node from source to sink is taken at once. The rest is a maximum flow in phases: distances to
    what the sink still takes, then augmenting paths that only come nearer, each edge tried once a phase; phases are
    as many as lengths of paths. Of several minimum cuts the one with the largest source side is taken.
    """
    n = len(terminals)
    excess = [keep - drop for keep, drop in terminals]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, capacity in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (capacity, capacity)
    while True:
        far = [-1] * n
        queue = [i for i in range(n) if excess[i] < -HELD]
        for i in queue:
            far[i] = 0
        for j in queue:  # grows while it is read
            for e in near[j]:
                if far[to[e]] < 0 and room[e ^ 1] > HELD:
                    far[to[e]] = far[j] + 1
                    queue.append(to[e])
        sources = [i for i in range(n) if excess[i] > HELD and far[i] >= 0]
        if not sources:
            return [x < 0 for x in far]
        tried = [0] * n
        for source in sources:
            path: list[int] = []
            at = source
            while excess[source] > HELD:
                if excess[at] < -HELD:
                    flow = min(excess[source], -excess[at], *(room[e] for e in path)) if path else 0.0
                    excess[source] -= flow
                    excess[at] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, at = [], source
                    continue
                while tried[at] < len(near[at]):
                    e = near[at][tried[at]]
                    if room[e] > HELD and far[to[e]] == far[at] - 1:
                        break
                    tried[at] += 1
                if tried[at] < len(near[at]):
                    path.append(near[at][tried[at]])
                    at = to[path[-1]]
                elif path:
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text of a page, and how many blocks it has and kept."""
    found = parse(page or "")
    if not found.texts:
        return "", 0, 0
    kept = min_cut(*graph(found))[len(found.tag) :]
    return " ".join(t for t, k in zip(found.texts, kept) if k), len(kept), sum(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points) and ``n_blocks, n_kept``.

    Null and empty html give an empty text. Broken markup is read as far as it goes. Repeated rows are kept. Of
    equally good cuts the one with more content. Extra columns are ignored. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    types = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(2)]
            longs = [pa.array([x[k] for x in found], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([len(x[0]) for x in found], pa.int64()), *longs], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return source.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, n_blocks long, n_kept long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over ``pages``. Null html gives an empty text; an empty table gives no rows."""
    return extract(table(spark, sf_dir, "pages"))
