"""Reads web pages into blocks of text with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: all up to their end tag, or to the end of the page, is passed over.
RAW = frozenset("script style noscript template iframe textarea title xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div td th blockquote figure details center".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("nav footer aside form button fieldset menu dialog head".split())
#: Embedded content: not part of an article either. One that is left open ends where a block of the page begins.
EMBEDDED = frozenset("svg math object canvas audio video select".split())
#: Words of class, id and role values that name what is not the article.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adv sponsor sponsored sponsors promo promos promotion promoted banner "
    "banners cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe "
    "subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc pagination pager sidebar "
    "sidebars rail aside footer foot masthead topbar toolbar header share sharing social related recommended recommendations "
    "trending popular widget widgets comment comments comentarios kommentare commentaires commentlist disqus respond reply "
    "replies discussion feedback complementary contentinfo search form tags outbrain taboola skip hidden".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_LISTS = frozenset("ul ol dl table select".split())


@dataclass
class Element:
    tag: str
    path: int
    parent: int
    outside: bool
    named: bool
    container: int
    last: int = -1
    wraps: bool = False


@dataclass
class Block:
    element: int
    path: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def names_outside(attributes: str, in_article: bool) -> bool:
    """Whether class, id or role name something outside the article. Names that begin like "has" or "with" tell of
    something else in the page; a header inside an article is part of it."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for value in "".join(values).split():
                words = _NAME_PART.findall(_CAMEL.sub(r"\1 \2", value).lower())
                found = OUTSIDE_WORDS.intersection(words) - ({"header"} if in_article else set())
                if found and words[0] not in ("has", "with", "no", "without"):
                    return True
        elif name.lower() == "aria-hidden" and "true" in values:
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))


def read(page: str) -> tuple[list[Element], list[Block]]:
    """Elements in page order and the blocks of text that are not in an outside element.

    An element that is named like something outside the article, but holds a main or article element, is the frame of the page
    and not what its name says.
    """
    elements, blocks = parse(page)
    gone = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        gone[k] = gone[e.parent] or (e.named and not e.wraps)
    return elements, [b for b in blocks if not gone[b.element]]


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements, and blocks that are not in an element that is outside by its tag.

    A block ends at every tag that is not inline. Unclosed paragraphs, list items and cells end where the next begins, and
    stray end tags are passed over. A path is a number for the sequence of tags from the root; inline tags are not part
    of it.
    """
    elements, blocks, paths = [Element("#", 0, -1, False, False, 0)], [], {}
    stack, open_tags, block, links = [0], {}, None, 0
    at, size = 0, len(page)

    def close_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            element = elements[stack.pop()]
            element.last = len(elements) - 1
            open_tags[element.tag] -= 1
            links -= element.tag == "a"

    def text(piece: str) -> None:
        nonlocal block
        top = elements[stack[-1]]
        if piece and not top.outside:
            if block is None:
                if piece.isspace():
                    return
                block = Block(stack[-1], top.path)
                blocks.append(block)
            block.parts.append(piece)
            block.linked += len(piece.strip()) if links > 0 else 0

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag not in INLINE:
            block = None
        if closing:
            if tag == "br":
                block = None
            elif open_tags.get(tag):
                depth = len(stack) - 1
                while elements[stack[depth]].tag != tag:
                    depth -= 1
                close_to(depth)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _CLOSES_P and any(open_tags.get(x) for x in EMBEDDED):
            close_to(min(k for k, n in enumerate(stack) if elements[n].tag in EMBEDDED))
        if tag in _CLOSES_P and open_tags.get("p"):
            depth = len(stack) - 1
            while elements[stack[depth]].tag not in CONTAINERS | {"p", "#"}:
                depth -= 1
            if elements[stack[depth]].tag == "p":
                close_to(depth)
        same = _SAME.get(tag)
        if same and any(open_tags.get(x) for x in same):
            depth, found = len(stack) - 1, 0
            while elements[stack[depth]].tag not in _LISTS | {"#"}:
                found = depth if elements[stack[depth]].tag in same else found
                depth -= 1
            if found:
                close_to(found)
        parent = elements[stack[-1]]
        path = parent.path if tag in INLINE else paths.setdefault((parent.path, tag), len(paths) + 1)
        in_article = bool(open_tags.get("article") or open_tags.get("main"))
        outside = parent.outside or tag in OUTSIDE or tag in EMBEDDED or (tag == "header" and not in_article)
        named = not outside and tag not in ("html", "body", "main", "article") and names_outside(m.group(3), in_article)
        if tag in ("main", "article") and not outside:
            for k in stack:
                elements[k].wraps = True
        number = len(elements)
        elements.append(Element(tag, path, stack[-1], outside, named, number if tag in CONTAINERS else parent.container))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
        stack.append(number)
        if m.group(3).rstrip().endswith("/") and tag in INLINE:
            close_to(len(stack) - 1)
    close_to(1)
    elements[0].last = len(elements) - 1
    for b in blocks:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return elements, [b for b in blocks if b.text]
