"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block-level element and each run of text is a node that is content or not. A node's state
depends on its parent's through a table for the kind of element (semantic tag, what class, id and
role words say), and shows in its features (kind, length of text, share of links, ends of sentences).
Tables are counted, smoothed, from labelled pages. Sum-product messages go up the tree and down again,
which gives the exact marginal of each node; runs of text whose marginal is above one half are kept.

Pages are independent rows, so nothing is shuffled; the model is a few small tables.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import ship, sliced, table
from veritab.llm.labelled_pages import labelled_pages

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names of the HTML standard, by what they mean for the text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split())
UNSEEN = frozenset(
    "annotation annotation-xml audio button canvas datalist head iframe input meter noembed noframes noscript object progress script select "
    "style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Open elements that the search for an open p, li and the like does not leave.
SCOPES = frozenset("button object select svg template".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# What words in class, id and role attributes say, and semantic tags of the same kind.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar",
    "edge": "header masthead banner footer contentinfo copyright colophon sitefooter siteheader",
    "side": "sidebar aside complementary widget widgets rail related recommended recommendations trending popular tags",
    "notice": "cookie cookies consent notice alert modal popup dialog overlay gdpr toast",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion promoted banner300",
    "form": "form search signup subscribe newsletter login register subscription",
    "comment": "comment comments reply replies respond disqus discussion reactions",
    "share": "share sharing social follow byline-tools toolbar",
    "main": "article content main post entry story body text articlebody maincontent hentry page-content",
}
SAYS = {w: kind for kind, words in WORDS.items() for w in words.split()}
TAGS = {"nav": "menu", "menu": "menu", "header": "head", "footer": "edge", "aside": "side", "dialog": "notice", "form": "form",
        "fieldset": "form", "search": "form", "article": "main", "main": "main"}
ORDER = ("advert", "notice", "comment", "form", "share", "menu", "side", "edge", "head", "main")


class Node:
    __slots__ = ("kind", "label", "links", "parent", "text")

    def __init__(self, parent: int, kind: str, label: int | None = None):
        self.parent, self.kind, self.text, self.links, self.label = parent, kind, None, 0, label


def kind_of(tag: str, attributes: str) -> tuple[str, int | None]:
    kinds, label = {TAGS[tag]} if tag in TAGS else set(), None
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role"):
                value = "".join(values).lower()
                for word in value.split():
                    if word in SAYS:
                        kinds.add(SAYS[word])
                    else:
                        kinds.update(SAYS[p] for p in re.split(r"[^a-z0-9]+", word) if p in SAYS)
            elif name in ("hidden", "aria-hidden") and "".join(values).lower() in ("", "hidden", "true"):
                kinds.add("notice")
            elif name == "y":
                label = int("".join(values))
    for kind in ORDER:
        if kind in kinds:
            return kind, label
    return ("heading" if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else "item" if tag == "li" else "plain"), label


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first. Nodes with ``text`` are runs of text, blanks reduced."""
    nodes, stack = [Node(-1, "plain")], [("", 0)]  # stack: (tag, node of the nearest block)
    held: list[str] = []
    linked, link_from, links = 0, -1, 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                node = Node(stack[-1][1], "text")
                node.text, node.links = text, links
                nodes.append(node)
        links = 0

    def close(upto: int) -> None:
        nonlocal linked, unseen
        if any(tag in BLOCKS for tag, _ in stack[upto:]):
            flush()
        linked -= sum(tag == "a" for tag, _ in stack[upto:])
        unseen -= sum(tag in UNSEEN for tag, _ in stack[upto:])
        del stack[upto:]

    def within(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        """The outermost open element of these names above the nearest that stops the search; -1: none."""
        found = -1
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                found = at
            elif stack[at][0] in stop or stack[at][0] in SCOPES:
                break
        return found

    at, unseen = 0, 0
    while at < len(page):
        hit = MARKUP.search(page, at)
        begin = hit.start() if hit else len(page)
        part = page[at:begin]
        if stack[-1][0] == "head" and part.strip():
            close(len(stack) - 1)
        if part and not unseen:
            held.append(part)
            if linked:
                links += len(part)
        if not hit:
            break
        at = hit.end()
        ending, tag = hit.group(1), (hit.group(2) or "").lower()
        if not tag:
            continue
        if hit.group()[-1] != ">":  # the page ends inside a tag
            break
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCKS and tag not in UNSEEN and stack[k][0] in BLOCKS:
                    break
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if tag in UNSEEN:
            if tag not in VOID and not hit.group().endswith("/>"):
                stack.append((tag, stack[-1][1]))
                unseen += 1
            continue
        if unseen and tag == "body":
            close(next(k for k, (name, _) in enumerate(stack) if name in UNSEEN))
        if unseen and tag in BLOCKS:  # no block stands in a drawing, but for its foreignObject
            drawn = [k for k, (name, _) in enumerate(stack) if name in ("svg", "foreignobject")]
            if drawn and stack[drawn[-1]][0] == "svg":
                close(drawn[-1])
        if tag in CLOSES_P and (k := within({"p"}, BLOCKS - {"p"})) > 0:
            close(k)
        if tag in SIBLINGS and (k := within(*SIBLINGS[tag])) > 0:
            close(k)
        if tag in BLOCKS:
            flush()
            if tag not in VOID:
                kind, label = kind_of(tag, hit.group(3))
                nodes.append(Node(stack[-1][1], kind, label))
                stack.append((tag, len(nodes) - 1))
        elif tag not in VOID and not hit.group().endswith("/>"):
            stack.append((tag, stack[-1][1]))
            linked += tag == "a"
    flush()
    return nodes


def shown(node: Node) -> tuple:
    """What a node shows of its state, besides its kind."""
    if node.text is None:
        return ()
    size, share = len(node.text), node.links / max(len(node.text), 1)
    return (("size", 0 if size < 12 else 1 if size < 40 else 2 if size < 120 else 3),
            ("links", 0 if share == 0 else 1 if share < 0.4 else 2), ("ends", node.text[-1] in ".!?:;\"'”»)"))


class Model:
    """Tables of the tree model as logarithms, counted from labelled pages."""

    def __init__(self, pages: list[str]):
        self.root = [1.0, 1.0]
        moves: dict[tuple, list[float]] = {}  # (kind, parent state) -> [not, content]
        signs: dict[tuple, list[float]] = {}
        for page in pages:
            nodes, states = parse(page), []
            for node in nodes:
                states.append(node.label if node.label is not None else states[node.parent] if node.parent >= 0 else 0)
            for k in range(len(nodes) - 1, -1, -1):  # what has nothing but content in it is content
                below = [s for n, s in zip(nodes, states, strict=True) if n.parent == k]
                if nodes[k].label is None and below and all(below):
                    states[k] = 1
            self.root[states[0]] += 1
            for node, state in zip(nodes, states, strict=True):
                if node.parent >= 0:
                    moves.setdefault((node.kind, states[node.parent]), [0.2, 0.2])[state] += 1
                for sign in shown(node):
                    signs.setdefault(sign, [2.0, 2.0])[state] += 1
        total = {name: [sum(n[s] for (own, _), n in signs.items() if own == name) for s in (0, 1)] for name, _ in signs}
        self.moves = {}
        for kind in {kind for kind, _ in moves}:
            every = [sum(moves[k][s] for k in moves if k[0] == kind) for s in (0, 1)]
            for state in (0, 1):  # a pair seen rarely leans on the kind's own share
                row = [n + 2 * e / sum(every) for n, e in zip(moves.get((kind, state), (0, 0)), every, strict=True)]
                self.moves[kind, state] = [n / sum(row) for n in row]
        self.signs = {key: [n[s] / total[key[0]][s] for s in (0, 1)] for key, n in signs.items()}

    def move(self, kind: str, state: int) -> list[float]:
        """P(not), P(content) of a node of this kind below a parent in this state."""
        return self.moves.get((kind, state)) or ([0.9, 0.1] if state == 0 else [0.1, 0.9])

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node given the whole page, by messages up and down."""
        local = []
        for node in nodes:
            a = b = 1.0
            for sign in shown(node):
                p = self.signs.get(sign, (1.0, 1.0))
                a, b = a * p[0], b * p[1]
            local.append([a, b])
        belief = [row[:] for row in local]
        up = [(1.0, 1.0)] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            node, (a, b) = nodes[k], belief[k]
            low, high = self.move(node.kind, 0), self.move(node.kind, 1)
            m0, m1 = low[0] * a + low[1] * b, high[0] * a + high[1] * b
            up[k] = (m0 / (m0 + m1), m1 / (m0 + m1))
            own = belief[node.parent]
            x, y = own[0] * up[k][0], own[1] * up[k][1]
            own[0], own[1] = x / (x + y), y / (x + y)
        out = [0.0] * len(nodes)
        x, y = belief[0][0] * self.root[0], belief[0][1] * self.root[1]
        full = [(x / (x + y), y / (x + y))] * len(nodes)
        for k in range(1, len(nodes)):
            node = nodes[k]
            p0, p1 = full[node.parent]
            x, y = p0 / up[k][0], p1 / up[k][1]  # the parent without this child's message
            low, high = self.move(node.kind, 0), self.move(node.kind, 1)
            a = (x * low[0] + y * high[0]) * belief[k][0]
            b = (x * low[1] + y * high[1]) * belief[k][1]
            full[k] = (a / (a + b), b / (a + b))
            out[k] = full[k][1]
        return out

    def text(self, page: str | None) -> str:
        nodes = parse(page or "")
        return "\n".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.text and p > 0.5)


@lru_cache(maxsize=1)
def model() -> Model:
    return Model(labelled_pages())


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages(page_id, url, html)``.

    A null or empty page has an empty text; rows with equal or null page_id stay rows of their own;
    other columns are ignored; an empty table gives no rows. Unclosed and misnested elements are closed
    where the HTML standard's common rules close them; a page cut off inside a tag ends before it.
    """
    ship(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = model().text
        for batch in sliced(batches):
            texts = [extract(page) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").alias("html"))
    return own.mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
