"""Reader mode: the article of a page, by scores that paragraphs give their ancestors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quire.kernels.html_dom import Document, Element, parse
from quire.kernels.model import BLANK_LINES

#: Fixed values of the scoring: tags and name parts, thresholds.
STRIPPED = frozenset("script style noscript nav aside form button input select textarea iframe svg object embed".split())
UNLIKELY = (
    "-ad- ai2html banner breadcrumb combx comment community cover-wrap disqus extra footer gdpr header legends menu menubar "
    "related remark replies rss shoutbox sidebar skyscraper social sponsor supplemental ad-break agegate pagination pager popup "
    "yom-remote nav masthead modal cookie complementary contentinfo dialog share newsletter promo subscribe signup sign-up paywall"
).split()
MAYBE = "and article body column content main shadow post entry hentry h-entry".split()
POSITIVE = "article body content entry hentry h-entry main page pagination post text blog story column".split()
NEGATIVE = (
    "hidden banner combx comment com- contact foot footer footnote gdpr masthead media meta outbrain promo related scroll share "
    "shoutbox sidebar skyscraper sponsor shopping tags widget social modal popup"
).split()
BLOCK_CHILD = frozenset("div p section article ul ol dl table pre blockquote figure header footer aside nav h1 h2 h3 h4 h5 h6".split())
TABLE_PART = frozenset("td th tr tbody thead tfoot caption col colgroup".split())
KEPT_ALWAYS = frozenset("h1 h2 h3 h4 h5 h6 hr".split())
BASE = {"div": 5} | dict.fromkeys("pre td blockquote".split(), 3) | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
SHORT, ARTICLE = 25, 140
SHARES = (1.0, 2.0, 6.0)
#: What the fallback takes out of the whole body: elements, and links by their relation.
FALLBACK_TAGS = frozenset("noscript template iframe canvas style".split())
FALLBACK_RELS = frozenset("stylesheet preload modulepreload prefetch preconnect dns-prefetch".split())


@dataclass
class Readable:
    title: str
    content: str
    text_content: str
    length: int
    excerpt: str | None = None
    byline: str | None = None
    dir: str | None = None
    site_name: str | None = None
    lang: str | None = None


def names(e: Element, *keys: str) -> str:
    return " ".join(e.get(k) for k in keys).lower()


def has_any(text: str, parts: list[str]) -> bool:
    return any(p in text for p in parts)


def prune(body: Element) -> None:
    """Takes out, from the top down, what can't be an article by its tag or its names."""
    keep_children(body, lambda c: c.tag == "a" or c.tag not in STRIPPED and not unlikely(c))


def unlikely(e: Element) -> bool:
    own = names(e, "class", "id", "role")
    return has_any(own, UNLIKELY) and not has_any(own, MAYBE)


def keep_children(root: Element, wanted: Callable[[Element], bool]) -> None:
    """Takes the elements below root that aren't wanted out of the tree, with all they hold."""
    open_ = [root]
    while open_:
        e = open_.pop()
        own = [c for c in e.children if isinstance(c, str) or wanted(c)]
        if len(own) < len(e.children):
            e.children = own
        open_ += e.elements()


def base_score(e: Element) -> float:
    own = names(e, "class", "id")
    return BASE.get(e.tag, 0) - 25.0 * has_any(own, NEGATIVE) + 25.0 * has_any(own, POSITIVE)


def link_density(e: Element) -> float:
    total = len(e.text())
    links = sum(len(x.text()) for x in ([e] if e.tag == "a" else []) + list(e.descendants()) if x.tag == "a")
    return links / total if total else 0.0


def scoreable(e: Element) -> bool:
    return e.tag in ("p", "td", "pre") or e.tag == "div" and not any(c.tag in BLOCK_CHILD for c in e.elements())


def scored(body: Element) -> list[tuple[Element, float]]:
    """The candidates in the order in which they were first touched, with final scores."""
    scores: dict[int, float] = {}
    seen: list[Element] = []
    for e in body.descendants():
        if not scoreable(e):
            continue
        text = e.text()
        if len(text) < SHORT:
            continue
        gain = 1.0 + text.count(",") + min(len(text) // 100, 3)
        up = e.parent
        for share in SHARES:
            if up is None:
                break
            if id(up) not in scores:
                scores[id(up)] = base_score(up)
                seen.append(up)
            scores[id(up)] += gain / share
            up = up.parent
    return [(e, scores[id(e)] * (1 - link_density(e))) for e in seen]


def enclosing_table(e: Element) -> Element | None:
    if e.tag not in TABLE_PART | {"table"}:
        return None
    while e is not None and e.tag != "table":
        e = e.parent
    return e


def document_order(root: Element) -> dict[int, int]:
    return {id(e): k for k, e in enumerate([root, *root.descendants()])}


def assemble(best: Element, top: float, scores: dict[int, float]) -> Element:
    """The parent of the best element with those of its children that belong to an article."""
    anchor = enclosing_table(best) or best
    if anchor.tag == "body" or anchor.parent is None:
        root, anchor = anchor, None
    else:
        root = anchor.parent
    least = max(10.0, top * 0.2)
    kept: list[Element | str] = []
    for c in root.children:
        if isinstance(c, str):
            if not c.strip(BLANK_LINES):
                kept.append(c)
        elif c is anchor or c.tag in KEPT_ALWAYS or scores.get(id(c), float("-inf")) >= least or len(c.text()) >= SHORT and link_density(c) < 0.5:
            kept.append(c)
    root.children = kept
    return root


def outer_html(e: Element) -> str:
    from html import escape

    from quire.kernels.html_dom import RAW_TEXT, VOID

    attrs = "".join(f' {k}="{escape(v, quote=True)}"' for k, v in e.attrs.items())
    if e.tag in VOID:
        return f"<{e.tag}{attrs}>"
    inner = "".join(outer_html(c) if isinstance(c, Element) else c if e.tag in RAW_TEXT else escape(c, quote=False) for c in e.children)
    return f"<{e.tag}{attrs}>{inner}</{e.tag}>"


def cleaned(value: str | None) -> str | None:
    value = (value or "").strip(BLANK_LINES)
    return value or None


def metadata(doc: Document) -> dict[str, str | None]:
    """Title, byline, excerpt, site and language; the last of several equal keys counts."""
    prop: dict[str, str] = {}
    name: dict[str, str] = {}
    for e in doc.html.descendants():
        if e.tag == "meta" and (content := e.get("content")):
            for key, into in (("property", prop), ("name", name), ("itemprop", name)):
                if k := e.get(key).lower():
                    into[k] = content

    def first(*found: str | None) -> str | None:
        return next((c for x in found if (c := cleaned(x))), None)

    return {
        "title": first(prop.get("og:title"), name.get("twitter:title"), doc.title()),
        "byline": first(name.get("author"), prop.get("article:author"), name.get("dc.creator")),
        "excerpt": first(name.get("description"), prop.get("og:description")),
        "site_name": first(prop.get("og:site_name")),
        "lang": first(doc.html.get("lang")),
    }


def article(doc: Document) -> tuple[Element, Readable] | None:
    """The article's element and its reader-mode value; None if there's no confident one. The
    tree is changed. Of equal scores the element first in the document wins."""
    meta = metadata(doc)
    prune(doc.body)
    found = scored(doc.body)
    if not found:
        return None
    order = document_order(doc.html)
    best, top = min(found, key=lambda x: (-x[1], order[id(x[0])]))
    root = assemble(best, top, {id(e): s for e, s in found})
    text = root.text()
    if len(text) < ARTICLE:
        return None
    value = Readable(meta["title"] or "", outer_html(root), text, len(text), meta["excerpt"], meta["byline"], None, meta["site_name"], meta["lang"])
    return root, value


def fallback_removed(e: Element) -> bool:
    return e.tag in FALLBACK_TAGS or e.tag == "script" and e.get("type") != "application/ld+json" or e.tag == "link" and e.get("rel") in FALLBACK_RELS


def first_meta(doc: Document, *keys: str) -> str | None:
    """The content of the first meta element, in page order, that has one of the keys."""
    for e in doc.html.descendants():
        if e.tag == "meta" and {e.get("property").lower(), e.get("name").lower(), e.get("itemprop").lower()} & set(keys):
            if content := cleaned(e.get("content")):
                return content
    return None


def readable(page: str) -> Readable:
    """The reader-mode value of a page: its article, else its cleaned body."""
    if hit := article(parse(page)):
        return hit[1]
    doc = parse(page)
    keep_children(doc.body, lambda e: not fallback_removed(e))
    text = doc.body.text()
    return Readable(
        first_meta(doc, "og:title", "twitter:title") or cleaned(doc.title()) or "",
        outer_html(doc.body),
        text,
        len(text),
        first_meta(doc, "description", "og:description", "twitter:description"),
        first_meta(doc, "author", "article:author", "dc.creator"),
        None,
        first_meta(doc, "og:site_name"),
        cleaned(doc.html.get("lang")),
    )
