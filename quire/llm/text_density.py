"""HTML extraction by composite text density.

A lenient scanner builds the element tree (void elements, implied ends, raw text, unclosed and
stray tags). For every element it counts characters, link characters, tags and link tags
below it; the composite density is characters per tag, adjusted by the share of link text and
the number of link tags. A node's density sum is that of its children. The node of the largest
sum is taken; the least density on the path from it to the body is the threshold, and in every
subtree whose density reaches the threshold the descendant-or-self of largest sum is content.
What lies beside a content node in one parent belongs to it as well (headings, short or nested
sections) where that parent is part of an article or main element, or where, by density, the
parent's other text is plain and less than the node's; the body itself is never taken for that.

Elements that can't be article text are set aside before densities are computed: menus, page
headers, footers, sidebars, forms, scripts, styles, and elements whose class, id or role names
an advert, notice, menu, sidebar, form, or reader comments. A class or id such as has-sidebar
names a layout. A name alone doesn't set aside an element that holds the page's main element, all
its articles or most of its text, and inside an article an id, or a class or part of one that is
an ordinary word, does so only where the text is mostly links or list items.

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by a blank line in page order; a line break counts as white space.
Defined results: null, empty and content-free pages give ''. Malformed pages give the text of
what can be told apart; time grows with a page's length only, depth of nesting isn't limited
and nothing is cut, so that pages of megabytes are fine. Of nodes of equal density sum the
outermost, then first, is taken; repeated rows have equal results; an empty table gives no
rows. Columns of df with the output's name are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.kernels.html_tokens import END, START, TEXT, Scanner
from quire.llm.common import bounded_batches

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: What a start tag ends, if it is open and no element of the second set was opened since.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset("tr td th".split()), frozenset({"table"})),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset("select datalist".split())),
}
#: An open paragraph isn't looked for beyond these.
P_SCOPE = frozenset("td th table caption button object applet marquee html body article section div".split())
END_SCOPE = frozenset("table td th button object html".split())
ASIDE = frozenset("script style noscript template nav footer aside form button select textarea input iframe object embed canvas svg math audio video map dialog menu title head link meta xmp noembed noframes".split())
UNLIKE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|masthead|comments?|commentlist|disqus|replies|reply|respond|discussion|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|form|toolbar|pagination|pager|copyright|legal|widget\w*|skip|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
#: Names of a page's head, outside of an article.
UNLIKE_TOP = re.compile(r"(?:^|\s)(?:header|site-?header|top-?bar|top-?header)(?:$|\s)", re.I)
#: Class and id tokens of these beginnings tell what a layout has.
MODIFIER = re.compile(r"(?:has|no|with|without|hide|show)[-_]", re.I)
#: Ids of reader comments; ordinary words that article sections are named by as well, in part
#: of a class, and those which don't tell even as a whole one.
THREAD = re.compile(r"comments?(?:[-_](?:section|area|list))?|commentlist|disqus(?:_thread)?|respond", re.I)
ORDINARY = frozenset("notice notices notification alert overlay side reply replies respond discussion share sharing social related search form legal copyright skip subscription consent login menu comment banner".split())
PLAIN_WORDS = frozenset("overlay side discussion related search form legal copyright skip menu reply replies respond".split())
UNLIKE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "aside", "kept", "chars", "link_chars", "tags", "link_tags", "density", "total", "best", "best_total", "children", "parts", "named")

    def __init__(self, tag: str, parent: Node | None, aside: bool, kept: bool) -> None:
        self.tag, self.parent, self.aside, self.kept = tag, parent, aside, kept
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.density = self.total = 0.0
        self.named = ""


def token_names(token: str, attribute: str, within_article: bool) -> str:
    """'surely', 'thread' or 'maybe' where a class or id token names what isn't article text."""
    if MODIFIER.match(token) or not UNLIKE.search(token):
        return "surely" if not within_article and UNLIKE_TOP.search(token) else ""
    if THREAD.fullmatch(token):
        return "thread"
    if not within_article:
        return "surely"
    hits = {w.lower() for w in re.split(r"[-_]", token) if UNLIKE.search(w)}
    whole = attribute == "class" and len(re.split(r"[-_]", token)) == 1
    return "maybe" if attribute == "id" or hits <= (PLAIN_WORDS if whole else ORDINARY) else "surely"


def unlike(tag: str, attributes: str, within_article: bool) -> tuple[bool, str]:
    """Whether an element can't hold article text, and whether its name says that it doesn't."""
    if tag in ASIDE or tag == "header" and not within_article:
        return True, ""
    names: set[str] = set()
    if attributes and (within_article or tag not in ("body", "html", "article", "main")):
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                names |= {token_names(t, name, within_article) for t in value.split()}
            elif name == "role" and value.lower() in UNLIKE_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                return True, ""
    return False, next((n for n in ("surely", "thread", "maybe") if n in names), "")


def set_aside(nodes: list[Node]) -> None:
    """Sets named elements aside, unless what they hold says otherwise."""
    if not any(n.named for n in nodes):
        return
    text, links, items, held = ([0] * len(nodes) for _ in range(4))
    at = {id(n): k for k, n in enumerate(nodes)}
    named = [False] * len(nodes)
    for k, n in enumerate(nodes):
        named[k] = bool(n.named) or n.parent is not None and named[at[id(n.parent)]] and n.parent.kept and n.kept
        if not n.aside:
            text[k] = sum(len(" ".join(p.split())) for p in n.parts if p.__class__ is str)
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if n.aside:
            continue
        links[k] = text[k] if n.tag == "a" else links[k]
        items[k] = text[k] if n.tag == "li" else items[k]
        held[k] += n.tag in ("article", "main") and not named[k]
        if n.parent is not None:
            up = at[id(n.parent)]
            text[up] += text[k]
            links[up] += links[k]
            items[up] += items[k]
            held[up] += held[k]
    for k, n in enumerate(nodes):
        if n.parent is not None and n.parent.aside:
            n.aside = True
        elif n.named and not n.aside:
            if n.named == "maybe":
                n.aside = 2 * max(links[k], items[k]) > text[k]
            elif n.kept:
                n.aside = True
            elif held[0]:
                n.aside = held[k] < held[0]
            else:
                plain = text[k] - links[k]
                n.aside = not plain or plain <= (0.9 if n.named == "thread" else 0.5) * (text[0] - links[0])


#: Names under which the places of scopes' elements are kept as well.
SCOPES = {t: tuple(["#p"] * (t in P_SCOPE) + ["#end"] * (t in END_SCOPE)) for t in P_SCOPE | END_SCOPE}


class Open:
    """The open elements, with the places of each tag among them, so that none is searched for."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        here = len(self.nodes)
        self.places[node.tag].append(here)
        for name in SCOPES.get(node.tag, ()):
            self.places[name].append(here)
        self.nodes.append(node)

    def last(self, *names: str) -> int:
        """The innermost place of any of the names; 0 if there's none."""
        found = 0
        for n in names:
            if (own := self.places.get(n)) and own[-1] > found:
                found = own[-1]
        return found

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        for node in self.nodes[k:]:
            self.places[node.tag].pop()
            for name in SCOPES.get(node.tag, ()):
                self.places[name].pop()
        del self.nodes[k:]

    def begin(self, tag: str) -> None:
        """Closes what a start tag ends."""
        if tag in BLOCK and (k := self.last("p")) > self.last("#p"):
            self.cut(k)
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            after = self.last(*scope)
            found = [own[k] for t in ends if (own := self.places.get(t)) and (k := bisect_right(own, after)) < len(own)]
            if found:
                self.cut(min(found))

    def end(self, tag: str) -> None:
        k = self.last(tag)
        if k and (tag in END_SCOPE or k > self.last("#end")):
            self.cut(k)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree, and its nodes in page order."""
    root = Node("html", None, False, False)
    nodes, stack, scan = [root], Open(root), Scanner(page)
    for kind, value, attributes in scan:
        if kind == TEXT:
            stack.nodes[-1].parts.append(value)
            continue
        tag = value.lower()
        if kind == START:
            if tag == "html" or tag == "body" and stack.last("body"):
                continue
            stack.begin(tag)
            above = stack.nodes[-1]
            never, named = unlike(tag, attributes, above.kept)
            node = Node(tag, above, above.aside or never, above.kept or tag in ("article", "main"))
            node.named = named
            above.children.append(node)
            above.parts.append(node)
            nodes.append(node)
            if tag in RAW:
                text = scan.raw_text(tag)
                if tag == "textarea":
                    node.parts.append(text)
            elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "math", "path")):
                stack.push(node)
        elif kind == END and tag not in ("html", "body"):
            stack.end(tag)
    set_aside(nodes)
    return root, nodes


def measure(nodes: list[Node]) -> None:
    """Counts, densities and density sums, from the leaves up."""
    for n in nodes:
        if not n.aside:
            n.chars = sum(len(" ".join(p.split())) for p in n.parts if p.__class__ is str)
    for n in reversed(nodes):
        if n.tag == "a":
            n.link_chars = n.chars
        if (up := n.parent) is not None and not n.aside:
            up.chars += n.chars
            up.link_chars += n.link_chars
            up.tags += n.tags + 1
            up.link_tags += n.link_tags + (n.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.chars and not n.aside:
            tags = max(1, n.tags)
            odds = (n.chars / max(1, n.link_chars)) * (tags / max(1, n.link_tags))
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
            n.density = n.chars / tags * math.log(max(odds, 1.0)) / math.log(max(base, 2.0))
    for n in reversed(nodes):
        n.best, n.best_total = n, n.total
        for c in n.children:
            if not c.aside and c.best_total > n.best_total:
                n.best, n.best_total = c.best, c.best_total
        if n.parent is not None and not n.aside:
            n.parent.total += n.density


def lifted(pick: Node, body: Node, known: dict[int, Node]) -> Node:
    """The node that stands for a content node and what belongs to it; ``known`` keeps results
    of earlier climbs."""
    path = []
    n = pick
    while id(n) not in known and n.parent is not None and n is not body and n.parent is not body:
        up = n.parent
        rest, links = up.chars - n.chars, up.link_chars - n.link_chars
        inside = n.kept and n.tag not in ("article", "main")
        if not inside and (up.tag == "html" or rest > 0.5 * n.chars or 3 * links > rest or n.kept):
            break
        path.append(n)
        n = up
    out = known.get(id(n), n)
    for x in path:
        known[id(x)] = out
    return out


def content(root: Node, nodes: list[Node]) -> list[Node]:
    """The elements that hold the main text, in page order."""
    measure(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    top = body.best
    if not body.chars:
        return []
    if not body.best_total:
        return [body]
    threshold, n = top.density, top
    while n is not body and n.parent is not None:
        n = n.parent
        threshold = min(threshold, n.density)
    chosen: dict[int, Node] = {}
    known: dict[int, Node] = {}
    open_ = [body]
    while open_:
        n = open_.pop()
        if n.aside or n.density < threshold:
            continue
        pick = lifted(n.best if n.best_total else n, body, known)
        chosen[id(pick)] = pick
        open_ += reversed(n.children)
    # nodes stand in page order, so that a subtree is a run of them
    out, last = [], {id(n): k for k, n in enumerate(nodes)}
    for n in reversed(nodes):
        if n.parent is not None:
            last[id(n.parent)] = max(last[id(n.parent)], last[id(n)])
    end = -1
    for k, n in enumerate(nodes):
        if id(n) in chosen and k > end:
            out.append(n)
            end = last[id(n)]
    return out


def blocks(node: Node, out: list[str]) -> None:
    """The text blocks of an element, appended to out."""
    line: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    open_: list[Node | str | None] = [node]
    while open_:
        x = open_.pop()
        if x is None:
            close()
        elif x.__class__ is str:
            line.append(x)
        elif not x.aside:
            if x.tag in BLOCK:
                close()
                open_.append(None)
            elif x.tag == "br":
                line.append(" ")
            open_ += reversed(x.parts)
    close()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    out: list[str] = []
    for n in content(*parse(page)):
        blocks(n, out)
    return "\n\n".join(out)


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of its pages."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array(map(main_text, column.to_pylist()), pa.string())

    return df.withColumn(out, text(F.col(html)))
