"""Main-text extraction by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, each the
half of what it got; a container's points are discounted by its share of link
text. The best container and those of its siblings that read like it are kept.
Time is linear in the page, whatever its depth.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import spread

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "title", "textarea", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
A_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.I)
MATH = "math mi mo mn ms mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtext mspace mstyle mfenced mtable mtr mtd semantics"
INLINE = frozenset(MATH.split()) | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROP = frozenset("nav footer aside button select option dialog menu iframe object svg canvas audio video noscript template head map annotation annotation-xml".split())
#: Elements that leave an open head open; its end tag is optional.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
SCORED = frozenset("p div section article main td pre blockquote li dd figcaption body center".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table article section div body main".split())
CONTROLS = frozenset("input select textarea button".split())
#: Parts of a class (cut at spaces, hyphens, underscores and capitals) that name what is no article text.
JUNK = frozenset(
    "ad ads adsense adslot banner cookie cookies consent gdpr notice alert popup modal overlay sidebar side aside widget nav navbar navigation menu breadcrumb breadcrumbs crumbs pager pagination"
    " footer foot masthead topbar toolbar comment comments commentlist discussion replies respond share sharing social related newsletter subscribe signup login search skip hidden legal copyright tags".split()
)
JUNK_STEMS = ("advert", "sponsor", "promo", "disqus", "recommend")
JUNK_PAIRS = frozenset({("site", "header"), ("page", "header"), ("header", "bar"), ("print", "only")})
#: Ids that name no section of an article; ids made from titles may be any other word.
JUNK_IDS = JUNK - frozenset("ad ads alert consent cookie cookies discussion foot legal login menu modal notice overlay pager replies search side skip social tags widget copyright hidden".split())
#: A class such as ``has-sidebar`` tells of the layout, not of the element.
ABOUT = frozenset("has with without no show hide".split())
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
WANTED, UNSURE, UNWANTED = 0, 1, 2


class _Node:
    """An element. ``up``: the block around it; ``open``: inline elements of each name that are open in a block; ``ends``: whether it ends where a block begins.

    ``state`` is what tag, role, class and id say of it; ``drop`` is set for blocks when the page is read,
    since what they hold may speak for them.
    """

    __slots__ = ("tag", "up", "begin", "end", "inline", "state", "drop", "link", "ends", "open", "chars", "links", "commas", "controls", "points", "kids", "all", "all_links")

    def __init__(self, tag: str, up: _Node | None, begin: int, inline: bool, state: int, link: bool):
        self.tag, self.up, self.begin, self.end, self.inline, self.state, self.link, self.ends = tag, up, begin, begin, inline, state, link, False
        self.drop = inline and state != WANTED
        self.chars = self.links = self.commas = self.controls = self.all = self.all_links = 0
        self.points = 0.0
        self.open: dict[str, int] = {}
        self.kids: list[_Node] = []


def _parts(name: str) -> list[str]:
    return [p.lower() for p in PARTS.findall(name)]


def _is_junk(parts: list[str], words: frozenset[str]) -> bool:
    if parts and parts[0] in ABOUT:
        return False
    return any(p in words or p.startswith(JUNK_STEMS) for p in parts) or any(pair in JUNK_PAIRS for pair in zip(parts, parts[1:], strict=False))


def _state(tag: str, attributes: str, in_article: bool) -> int:
    """What an element's tag and attributes say: ``UNSURE`` where a headline or main part inside overrules them."""
    if tag == "form":
        return UNWANTED if in_article else UNSURE
    if tag in DROP or tag == "header" and not in_article:
        return UNWANTED
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return WANTED
    got = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        got.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return UNWANTED
    if got.get("role", "").lower() in ROLES:
        return UNWANTED
    classes, own_id = [_parts(c) for c in got.get("class", "").split()], _parts(got.get("id", ""))
    if tag in ("body", "html", "main", "article"):
        return UNWANTED if any(p.startswith(("comment", "advert")) or p == "ad" for c in [*classes, own_id] for p in c) else WANTED
    if tag in HEADING:
        return UNSURE if any(_is_junk(c, JUNK) for c in classes) else WANTED
    if not in_article and any("header" in c for c in [*classes, own_id]) or any(_is_junk(c, JUNK) for c in classes):
        return UNSURE
    return UNSURE if _is_junk(own_id, JUNK_IDS if in_article or tag not in ("div", "ul", "ol", "table") else JUNK) else WANTED


def _closed_at_once(attributes: str) -> bool:
    """A slash at the end that is no part of an unquoted value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"'>]+$", attributes)


class _Builder:
    """The tree of elements, the flat list of text pieces (a space at each block border) and the blocks in page order."""

    def __init__(self):
        self.root = _Node("#root", None, 0, False, WANTED, False)
        self.stack, self.blocks, self.chunks = [self.root], [self.root], []
        self.open: dict[str, int] = {}  # open blocks of each name
        self.scopes: list[dict[str, int]] = [{}]  # the same within each open list, table or section
        self.block = self.root

    def text(self, raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        top = self.stack[-1]
        if top.tag == "head" and raw.strip():
            self.close(len(self.stack) - 1)
            top = self.stack[-1]
        self.chunks.append(raw)
        if not (top.inline and top.drop):
            n = len(" ".join(raw.split()))
            self.block.chars += n
            self.block.links += n if top.link else 0
            self.block.commas += raw.count(",") + raw.count("，") + raw.count("、")

    def push(self, tag: str, attributes: str, inline: bool) -> _Node:
        top = self.stack[-1]
        if top.inline and top.drop:
            state = UNWANTED
        else:
            state = _state(tag, attributes, bool(self.open.get("article") or self.open.get("main"))) if attributes or not inline else WANTED
        link = tag == "a" or top.link and tag not in ("article", "section", "main", "body")
        node = _Node(tag, self.block, len(self.chunks), inline, state, link)
        top.kids.append(node)
        if not inline:
            self.blocks.append(node)
        return node

    def enter(self, node: _Node) -> None:
        self.stack.append(node)
        names = self.block.open if node.inline else self.open
        names[node.tag] = names.get(node.tag, 0) + 1
        if node.ends:
            names["ends"] = names.get("ends", 0) + 1
        if not node.inline:
            self.block = node
            self.scopes[-1][node.tag] = self.scopes[-1].get(node.tag, 0) + 1
            if node.tag in SCOPE:
                self.scopes.append({})

    def close(self, k: int) -> None:
        """Close all elements from place ``k`` of the stack on."""
        while len(self.stack) > k:
            node = self.stack.pop()
            node.end = len(self.chunks)
            if node.inline:
                self.block.open[node.tag] -= 1
                if node.ends:
                    self.block.open["ends"] -= 1
            elif node.up is not None:
                self.open[node.tag] -= 1
                if node.tag in SCOPE:
                    self.scopes.pop()
                self.scopes[-1][node.tag] -= 1
                self.block = node.up
                self.chunks.append(" ")

    def close_inline(self, tag: str) -> None:
        """Close the nearest ``tag`` that is open in the current block, if there is one."""
        if self.block.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.close(k)

    def close_block(self, tag: str) -> None:
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k].tag != tag or self.stack[k].inline:
                k -= 1
            self.close(k)

    def before_block(self, tag: str) -> None:
        """What a new block ends: an open paragraph, links without an end tag, items of the same kind."""
        while self.block.tag == "p" or self.block.tag in HEADING and tag in HEADING:
            self.close_block(self.block.tag)
        if self.block.open.get("ends"):
            self.close(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].ends))
        if tag in CLOSES:
            count = sum(self.scopes[-1].get(t, 0) for t in CLOSES[tag])
            k = len(self.stack)
            while count:  # all of them, up to the list or table that they stand in
                k -= 1
                count -= self.stack[k].tag in CLOSES[tag] and not self.stack[k].inline
            self.close(k)


def parse(page: str) -> tuple[_Node, list[str], list[_Node]]:
    """The tree of ``page``, its text pieces and its blocks in page order."""
    tree = _Builder()
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            tree.text(page[at:])
            break
        if m.start() > at:
            tree.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and tag != "wbr":
                tree.close_inline(tag)
            elif tag in ("br", "p") and not tree.open.get(tag):
                tree.chunks.append(" ")
            elif tag not in VOID:
                tree.close_block(tag)
            continue
        if tag not in IN_HEAD and tree.stack[-1].tag == "head":
            tree.close(len(tree.stack) - 1)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            if end is None:
                at = size
            else:
                at = page.find(">", end.start())
                at = size if at < 0 else at + 1
            tree.chunks.append(" ")
            tree.block.controls += tag in CONTROLS
        elif tag in VOID:
            if tag in ("br", "hr"):
                tree.chunks.append(" ")
            tree.block.controls += tag in CONTROLS and not re.search(r"\btype\s*=\s*[\"']?hidden", m[3], re.I)
        elif tag in INLINE:
            if tag == "a":
                tree.close_inline("a")  # a new link ends an open one
            node = tree.push(tag, m[3], True)
            if not _closed_at_once(m[3]):
                if tag == "a":
                    after = A_TAG.search(page, at)
                    node.ends = after is None or not after[1]
                tree.enter(node)
        else:
            tree.before_block(tag)
            tree.chunks.append(" ")
            tree.block.controls += tag in CONTROLS
            node = tree.push(tag, m[3], False)
            if not _closed_at_once(m[3]):
                tree.enter(node)
    tree.close(1)
    tree.root.end = len(tree.chunks)
    return tree.root, tree.chunks, tree.blocks


def _density(node: _Node) -> float:
    return node.all_links / node.all if node.all else 0.0


def own_points(n: _Node) -> float:
    """Points of a block for the text that stands in it itself: length and commas, less its share of links."""
    if n.drop or not n.chars or n.tag not in SCORED and n.up is not None:
        return 0.0
    return (min(1.0, n.chars / 25) + n.commas + min(n.chars / 100, 3)) * (1 - min(1.0, n.links / n.chars))


def settle(blocks: list[_Node], forms: bool = False) -> None:
    """Set ``drop`` of all blocks. What tells against a block by name gives way to a headline or main part in it; a form also to more plain paragraphs than controls, or if ``forms``."""
    held: dict[int, list[int]] = {}  # headlines, plain paragraphs, controls
    for n in reversed(blocks):
        own = held.setdefault(id(n), [0, 0, 0])
        own[0] += n.tag in ("h1", "main")
        own[1] += n.tag == "p" and n.chars > n.links and not n.controls and not own[2]
        own[2] += n.controls
        if n.up is not None and n.state != UNWANTED:
            up = held.setdefault(id(n.up), [0, 0, 0])
            for k in range(3):
                up[k] += own[k]
    for n in blocks:
        heads, plain, controls = held[id(n)]
        out = n.state == UNWANTED or n.state == UNSURE and not heads and not (n.tag == "form" and (forms or plain > controls))
        n.drop = out or n.up is not None and n.up.drop


def score(blocks: list[_Node]) -> None:
    """Sums of text and links, and points: of a block's own text, for a container, and of its children and half of what they got from theirs."""
    for n in blocks:
        n.points, n.all, n.all_links = 0.0, 0, 0
    for n in reversed(blocks):
        passed = own_points(n) + n.points / 2
        if n.tag not in ("p", "pre", "li", "blockquote", "figcaption"):
            n.points += own_points(n)
        if not n.drop:
            n.all += n.chars
            n.all_links += n.links
        if n.up is not None:
            n.up.points += passed
            if not n.drop:
                n.up.all += n.all
                n.up.all_links += n.all_links


def best_block(blocks: list[_Node]) -> _Node | None:
    return max((n for n in blocks if not n.drop and n.points > 0), key=lambda n: n.points * (1 - _density(n)), default=None)


def _is_menu(node: _Node) -> bool:
    """A list of nothing but links. It counts as a menu only before the first paragraph."""
    return node.tag in ("ul", "ol") and len(node.kids) > 1 and _density(node) > 0.66


def _beside(n: _Node, best: _Node, least: float, paragraphs: set[int], heads: int, text: str) -> bool:
    """Whether a sibling of the best block belongs to the article: it scores like it, or is a headline, or holds paragraphs that are not mostly links."""
    own = n.points * (1 - _density(n))
    if n.tag in HEADING:
        return best.up.tag not in ("body", "html", "#root") or n.tag == "h1" and heads == 1
    if own >= least or n.tag == best.tag == "article" and own > 0:
        return True
    return id(n) in paragraphs and _density(n) < 0.25 and not RIGHTS.match(text)


def extract(page: str | None) -> str:
    """The main text of ``page``: blocks in page order, white space within and between them one space; empty if there is none."""
    if not page:
        return ""
    root, chunks, blocks = parse(page)
    settle(blocks)
    score(blocks)
    best = best_block(blocks)
    if best is None and any(n.tag == "form" and n.drop for n in blocks):
        settle(blocks, forms=True)
        score(blocks)
        best = best_block(blocks)
    if best is None:  # a page of nothing but headings
        if not any(n.tag in HEADING and not n.drop and n.chars > n.links for n in blocks):
            return ""
        best = root
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.up
    best = up or best
    least = max(5.0, 0.2 * best.points * (1 - _density(best)))
    paragraphs: set[int] = set()  # blocks that are or hold a paragraph with text besides links
    for n in reversed(blocks):
        if not n.drop and (n.tag == "p" and n.chars > n.links or id(n) in paragraphs):
            paragraphs.add(id(n))
            if n.up is not None:
                paragraphs.add(id(n.up))
    heads = sum(n.tag == "h1" and not n.drop for n in blocks)
    beside = best.up.kids if best.up is not None else [best]
    kept = [n for n in beside if n is best or not n.drop and not n.inline and _beside(n, best, least, paragraphs, heads, "".join(chunks[n.begin : n.end][:8]))]
    if best not in kept:  # it stands in an inline element
        kept = [best]
    out: list[str] = []
    begun = False  # whether a paragraph came before
    for n in kept:
        todo: list[tuple[_Node, int, int]] = [(n, 0, n.begin)]  # a node, its next child, and how far its text is taken
        while todo:
            node, k, at = todo.pop()
            if k == len(node.kids):
                out.extend(chunks[at : node.end])
                if not node.inline:
                    out.append(" ")
                continue
            kid = node.kids[k]
            out.extend(chunks[at : kid.begin])
            begun = begun or kid.tag == "p" and not kid.drop
            todo.append((node, k + 1, kid.end))
            if not (kid.drop or not begun and _is_menu(kid)):
                todo.append((kid, 0, kid.begin))
            elif not kid.inline:
                out.append(" ")
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` for every row of ``pages``.

    Null and empty pages, and pages without a paragraph outside menus and the like,
    have an empty text. Repeated rows are read each; columns that are not named are not
    read, so none clashes; an empty table gives an empty result; ids may be null or repeat.
    Of blocks of equal points the first is the best one. Time is linear in the page, also where end tags
    are missing. A ``<`` with a letter behind it begins a tag, as in the HTML standard.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [extract(p) for p in pdf.pop("__html")]
            yield pdf

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string"
    return (
        spread(pages.select(*keep, F.col(html_col).alias("__html")))
        .mapInPandas(run, schema)
        .withColumn("n_chars", F.length("text").cast("long"))
    )
