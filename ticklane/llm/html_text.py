"""Main text of web pages by composite text density.

A page becomes a tree of elements (closing tags that HTML lets authors leave out are supplied). What a browser doesn't show
as text (scripts, styles, hidden elements ...) is cut. Every other node gets a density: its characters per tag, adjusted by how
many of its characters and tags are links. Marked blocks (nav, aside, footer, forms, page headers, and
those whose class or id says advert, sidebar, comments and the like, and nothing else) count as links, so that their density
is 0; a block that holds an article or main, or, having blocks in it, most of the body's other characters, is not marked.
Reader comments are known by their shape, whatever they are called: two or more elements of one kind beside each other, without
headings, that each begin with a person's name (cite, address, or an element said to be an author) and go on with other text,
and that hold all the text of the element around them but its headings. They are marked if other text is left.

A head ends where something stands that can't be in one, and a body begins where it does, so no block moves or is lost for tags
that authors left out. Blocks with display:none or visibility:hidden are hidden with all in them.

A node's density sum is the sum over its children. The node with the largest sum is the main subtree; the threshold is the
least density on its path to the body, and each other branch at or above the threshold, on any level, gives the subtree of
largest sum inside it, and so on in what is left of the branch. Inside the outermost article or main around the main subtree
any density above 0 is enough. Text that stands directly in an element counts as a branch of its own. Marked blocks inside a
chosen subtree go if their density is below the threshold. A heading before a chosen subtree of the same parent is taken
too, and so is what stands between two chosen ones, if it isn't mostly links. The text is given out block by block, in page
order.

Null and empty pages and pages of links alone give the empty text; an empty table gives an empty result; very long and very
deep pages take time in proportion to their size; of nodes with equal sums the first in page order wins; rows repeat as often
as in the input; columns named as a result are replaced by it.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ticklane.llm.common import map_texts

#: HTML element names by what becomes of them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("script style noscript template iframe object svg canvas math head title button select textarea input audio video map".split())
#: Elements that a head may hold; any other one ends it.
METADATA = set("base link meta noscript script style template title".split())
#: Elements that are not the article, and those of them that can't hold most of it.
ASIDE = set("nav footer aside header menu dialog form".split())
NEVER_MOST = ASIDE - {"form"}
BLOCKS = set("address article blockquote body caption dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody tfoot thead tr ul".split())
#: A start tag of the key closes an open element of the values, if no element of the barrier lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
P_BARRIER = {"td", "th", "caption", "table", "html", "body", "button", "object"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class and id values that mark what is not the article, and words that may stand beside them.
UNWANTED = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login comment comments respond disqus share sharing social footer masthead header topbar toolbar pagination pager".split())
NEUTRAL = set("site page global main top bottom left right first last primary secondary sticky fixed inline inner outer box block area section container wrapper wrap list item items row col column slot unit widget bar panel form link links user reader post thread js legal privacy buttons button icons media".split()) | set("abcdefghijklmnopqrstuvwxyz")
UNWANTED_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Words of class, id, itemprop and rel values that say that an element names a person.
PERSON = set("author commenter commentator username vcard fn".split())
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "top", "cut", "marked", "inside", "person")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.cut, self.marked, self.person = tag, parent, [], False, False, False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.top: Node | None = None


class TreeBuilder(HTMLParser):
    """Children are nodes and strings. Where each kind of element is open is known at any time, so no tag costs a walk."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.body: Node | None = None
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]

    def handle_starttag(self, tag, attrs):
        if tag == "html" or (tag == "body" and self.body is not None) or (tag == "head" and len(self.open) > 1):
            return
        if tag not in METADATA and tag != "head":
            self._begin_body(tag)
        if tag in BLOCKS:
            self._close({"p"}, P_BARRIER)
        if tag in CLOSES:
            while self._close(CLOSES[tag], BARRIER[tag]):
                pass
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop(len(self.open) - 1)
        if tag == "br":
            self.open[-1].children.append(" ")
            return
        node = Node(tag, self.open[-1])
        node.cut = tag in NEVER or hidden(tag, attrs)
        node.marked = (tag in ASIDE and not (tag == "header" and node.inside)) or unwanted(tag, attrs, node.inside)
        node.person = names_person(tag, attrs)
        self.open[-1].children.append(node)
        if tag == "body":
            self.body = node
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BLOCKS:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path", "use") and self.open[-1].tag == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        at = self._last(tag)
        if at > 0 and tag not in ("body", "html") and (tag in BLOCKS or at > self.blocks[-1]):  # an inline end tag doesn't close blocks
            self._pop(at)

    def handle_data(self, data):
        if self.body is None and data.strip():
            self._begin_body("")
        self.open[-1].children.append(data)

    def _begin_body(self, tag: str) -> None:
        """What stands in the head or before any body, and belongs in neither, ends the one and begins the other."""
        if self.body is None and self.open[-1].tag in ("head", "html"):
            self._pop(1)
            if tag != "body":
                self.handle_starttag("body", [])

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()
        while self.blocks[-1] >= at > 0:
            self.blocks.pop()

    def _close(self, tags, barrier) -> bool:
        at = max(map(self._last, tags))
        if at <= max(map(self._last, barrier)) or at <= 0:
            return False
        self._pop(at)
        return True


def hidden(tag: str, attrs) -> bool:
    return tag not in ("html", "body") and any(
        name == "hidden" or (name == "aria-hidden" and (value or "").lower() == "true") or (name == "style" and HIDING.search(value or "") is not None) for name, value in attrs)


def words_of(value: str) -> set[str]:
    return {w.lower() for part in WORD.findall(value) for w in CAMEL.split(part)}


def compound(word: str) -> bool:
    """Two words written as one, such as commentlist: one for what is not the article and one that may stand beside it."""
    return any(word[:i] in UNWANTED and word[i:] in UNWANTED | NEUTRAL for i in range(2, len(word) - 2))


def names_person(tag: str, attrs) -> bool:
    return tag in ("cite", "address") or any(name in ("class", "rel", "itemprop") and value and not PERSON.isdisjoint(words_of(value)) for name, value in attrs)


def unwanted(tag: str, attrs, inside: bool) -> bool:
    """By role, or because a class or the id consists of words for what is not the article."""
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "role" and value and value.lower() in UNWANTED_ROLES:
            return True
        if name in ("class", "id") and value:
            for token in value.split():
                found = words_of(token)
                joined = {w for w in found if compound(w)}
                named = (found & UNWANTED) - ({"header"} if inside else set())
                if (named or joined) and found - joined <= UNWANTED | NEUTRAL:
                    return True
    return False


def settle_marks(body: Node) -> None:
    """Take the mark from elements that hold an article or main, or blocks and most of the body's characters outside links; and
    from forms that hold more than all that stands in no marked element."""
    order, stack, outer = [], [(body, False, False)], []
    while stack:
        node, link, under = stack.pop()
        link = link or node.tag == "a"
        order.append((node, link))
        if node.marked and not under:
            outer.append(node)
        stack.extend((c, link, under or node.marked) for c in node.children if not isinstance(c, str) and not c.cut)
    plain: dict[int, int] = {}
    holds: set[int] = set()
    wraps: set[int] = set()
    for node, link in reversed(order):
        n = 0 if link else sum(len(BLANK.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if not isinstance(c, str) and not c.cut]
        plain[id(node)] = n + sum(plain[id(c)] for c in below)
        if any(c.tag in ("article", "main") or id(c) in holds for c in below):
            holds.add(id(node))
        if any(c.tag in BLOCKS or id(c) in wraps for c in below):
            wraps.add(id(node))
    free = plain[id(body)] - sum(plain[id(node)] for node in outer)
    for node, _ in order:
        if node.marked:
            size_counts = id(node) in wraps or id(body) not in holds
            most = plain[id(node)] > free if node.tag == "form" else plain[id(node)] * 2 > plain[id(body)] and size_counts and node.tag not in NEVER_MOST
            node.marked = id(node) not in holds and not most


def mark_replies(body: Node) -> None:
    """Mark reader comments by their shape, with a heading right before them."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.cut)
    chars: dict[int, int] = {}
    named: dict[int, int] = {}  # characters of the name that a node's text begins with
    titles: dict[int, int] = {}  # characters in headings
    groups = []
    for node in reversed(order):
        shown = [c for c in node.children if isinstance(c, str) or not c.cut]
        n = sum(size(c) if isinstance(c, str) else chars[id(c)] for c in shown)
        below = [c for c in shown if not isinstance(c, str)]
        first = next((c for c in shown if (size(c) if isinstance(c, str) else chars[id(c)])), None)
        chars[id(node)] = n
        named[id(node)] = n if node.person else 0 if first is None or isinstance(first, str) else named[id(first)]
        titles[id(node)] = n if node.tag in HEADINGS else sum(titles[id(c)] for c in below)
        items = [c for c in below if 0 < named[id(c)] < chars[id(c)] and not titles[id(c)]]
        if len(items) > 1 and len({c.tag for c in items}) == 1 and sum(chars[id(c)] for c in items) == n - sum(chars[id(c)] for c in below if c.tag in HEADINGS):
            groups.append(node)
    alike, found, free, stack = {id(g) for g in groups if g is not body}, {}, 0, [body]
    while stack:
        node = stack.pop()
        if node.marked or node.tag == "a" or node.tag in HEADINGS:
            continue
        if id(node) in alike:
            found[id(node)] = node
            continue
        free += sum(size(c) for c in node.children if isinstance(c, str))
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.cut)
    if not free:
        return
    for parent in {id(g.parent): g.parent for g in found.values()}.values():
        before = None
        for c in parent.children:
            if isinstance(c, str):
                before = None if c.strip() else before
            elif not c.cut:
                if id(c) in found:
                    c.marked = True
                    if before is not None and before.tag in HEADINGS:
                        before.marked = True
                before = c


def measure(root: Node) -> list[Node]:
    """Count characters, tags, link characters and link tags below each node (cut ones left out); nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not c.cut]
        order.append(node)
        below = [c for c in node.children if not isinstance(c, str)]
        for c in below:
            c.marked |= node.marked
        stack.extend(reversed(below))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(BLANK.sub(" ", c).strip())
            else:
                node.chars, node.tags = node.chars + c.chars, node.tags + 1 + c.tags
                node.link_chars, node.link_tags = node.link_chars + c.link_chars, node.link_tags + (c.tag == "a" or c.marked) + c.link_tags
        if node.tag == "a" or node.marked:
            node.link_chars, node.link_tags = node.chars, node.tags
    return order


def linked(node: Node) -> bool:
    return node.link_chars * 2 >= node.chars


def densities(order: list[Node]) -> None:
    """Composite text density C/T * log_b((C+1)/(LC+1) * (T+1)/(LT+1)) with b = (C+1) * (T+1), so that text without links has its
    characters per tag and links alone 0; the density sums; and of each node the node at or below it with the largest sum that
    isn't mostly links."""
    for node in reversed(order):
        c, t = node.chars + 1, node.tags + 1
        if node.chars:
            node.density = node.chars / max(1, node.tags) * math.log(c / (node.link_chars + 1) * t / (node.link_tags + 1)) / math.log(c * t)
        below = [x for x in node.children if not isinstance(x, str)]
        node.total = sum(x.density for x in below) or node.density
        if not linked(node):
            node.top = node
        for x in below:
            if x.top is not None and (node.top is None or x.top.total > node.top.total):
                node.top = x.top


def keep_main(body: Node) -> None:
    """Leave below the body only what belongs to the main text."""
    order = measure(body)
    densities(order)
    best = max(order, key=lambda n: n.total)
    if not best.total and linked(body):
        body.children = []
        return
    threshold, container, up = best.density, None, best
    while up is not None:
        threshold = min(threshold, up.density)
        container = up if up.tag in ("article", "main") else container
        up = up.parent
    inside = {id(n) for n in nodes_below(container)} if container is not None else set()
    enough = lambda node, value: value > 0 and (value >= threshold or id(node) in inside)
    chosen: set[int] = set()
    above: set[int] = set()

    def lead_to(node: Node | None) -> None:
        while node is not None and id(node) not in above:
            above.add(id(node))
            node = node.parent

    def choose(node: Node) -> None:
        chosen.add(id(node))
        lead_to(node.parent)

    choose(best)
    stack = [body]
    while stack:
        node = stack.pop()
        if id(node) in chosen or not node.chars:
            continue
        if id(node) not in above and enough(node, node.density) and not linked(node):
            choose(node.top)
            if id(node) in above:
                stack.append(node)  # its other branches
        else:
            stack.extend(c for c in node.children if not isinstance(c, str))
            if node.tag != "a" and not node.marked and any(enough(node, size(c)) for c in node.children if isinstance(c, str)):
                lead_to(node)
    if id(body) not in chosen:
        prune(body, chosen, above, enough)
    for node in nodes_below(body):
        node.children = [c for c in node.children if isinstance(c, str) or not c.marked or id(c) in above or c.density >= threshold]


def prune(body: Node, chosen: set[int], above: set[int], enough) -> None:
    """Drop the branches off the paths to the chosen nodes, but chosen ones, headings before them and what lies between."""
    items, stack = [], [(body, c) for c in reversed(body.children)]
    while stack:
        parent, c = stack.pop()
        if not isinstance(c, str) and id(c) in above and id(c) not in chosen:
            stack.extend((c, x) for x in reversed(c.children))
        else:
            items.append((parent, c))
    kept = []
    ahead: set[int] = set()  # elements in which a chosen branch follows
    for parent, c in reversed(items):
        if isinstance(c, str):
            take = parent.tag != "a" and not parent.marked and enough(parent, size(c))
        else:
            take = id(c) in chosen or (id(parent) in ahead and heads(c))
        kept.append(take)
        up = parent if take else None
        while up is not None and id(up) not in ahead:
            ahead.add(id(up))
            up = up.parent
    kept.reverse()
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    left: dict[int, list] = {}
    for i, (parent, c) in enumerate(items):
        between = first < i < last and (isinstance(c, str) or not c.chars or c.tag in HEADINGS or not linked(c))
        if kept[i] or between:
            left.setdefault(id(parent), []).append(c)
    stack = [body]
    while stack:
        node = stack.pop()
        mine = iter(left.get(id(node), ()))
        at, children = next(mine, None), []
        for c in node.children:
            if c is at:
                children.append(c)
                at = next(mine, None)
            elif not isinstance(c, str) and id(c) in above and id(c) not in chosen:
                children.append(c)
                stack.append(c)
        node.children = children


def size(text: str) -> int:
    return len(BLANK.sub(" ", text).strip())


def heads(node: Node) -> bool:
    """A heading, or a block whose characters are mostly a heading's."""
    return node.tag in HEADINGS or sum(n.chars for n in nodes_below(node) if n.tag in HEADINGS) * 2 > node.chars


def nodes_below(node: Node) -> list[Node]:
    """The node and all below it, in page order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if not isinstance(c, str))
    return out


def block_texts(root: Node) -> list[str]:
    """Texts of the blocks below a node, in page order, white space collapsed, empty ones left out."""
    blocks: list[list[str]] = [[]]
    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag in BLOCKS:
            blocks.append([])
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            spaced = [" ", *x.children, " "] if x.tag in ("td", "th") else x.children
            stack.extend(reversed(spaced))
    texts = (BLANK.sub(" ", "".join(b)).strip() for b in blocks)
    return [t for t in texts if t]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    body = builder.body or builder.root
    body.parent = None
    settle_marks(body)
    mark_replies(body)
    keep_main(body)
    return "\n\n".join(block_texts(body))


def extract_main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add text (blocks joined by an empty line) and n_chars."""

    def start():
        def work(column):
            texts = [main_text(x) for x in column.to_pylist()]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return work

    return map_texts(pages, html, [c for c in pages.columns if c != html] if keep is None else keep, "text string, n_chars long", start)
