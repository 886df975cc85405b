"""A tolerant HTML reader: text blocks, and the tree of block elements that holds them.

Time and memory are in proportion to the page, however deep or broken its markup.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head nav header footer aside form script style noscript template svg math canvas iframe object button select textarea input dialog menu audio video map datalist title rp".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that name what is not the article.
SKIPPED_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion cookie cookies notice notices consent gdpr comment comments"
    " commentlist reply replies respond disqus form login signup subscribe subscription newsletter share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager popup modal overlay"
    " toolbar masthead topbar skip copyright hidden".split()
)
EXEMPT = frozenset(("html", "body", "article", "main"))
#: A start tag closes open elements of these names, up to the barrier.
_P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_BARRIER = frozenset("ul ol dl table body html article section div main td th".split())

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/)?(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)""",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s|/)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I | re.S)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


#: Elements deeper than this belong to the one at this depth.
MAX_DEPTH = 40


@dataclass
class Element:
    name: str
    key: str
    skip: bool
    apart: bool = False  # an inline element to skip inside text that stays: the text around it is one block
    inside: str = ""  # "article" or "main" if it is or stands in one
    node: list | None = None  # the children of the nearest block element
    depth: int = 0


@dataclass(frozen=True)
class Block:
    text: str
    skip: bool
    inside: str
    #: How many of the characters stand in links.
    linked: int


def _element(name: str, attrs: str, parent_skip: bool) -> Element:
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return Element(name, name, parent_skip or name in SKIPPED)
    found = {}
    for k, a, b, c in _ATTR.findall(attrs):
        found.setdefault(k.lower(), a or b or c or "")
    words = set(_WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))
    named = next(iter(found.get("class", "").split()), "") or found.get("id", "")
    skip = (
        parent_skip or name in SKIPPED or found.get("role", "").lower() in SKIPPED_ROLES
        or name not in EXEMPT and bool(words & SKIPPED_WORDS)
        or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    )
    if found.get("role", "").lower() == "main":
        name = "main" if name not in EXEMPT else name
    return Element(name, f"{name}.{re.sub('[0-9]+', '0', named)}" if named else name, skip)


def read(page: str | None) -> tuple[list[Block], list]:
    """(text blocks in page order, tree).

    A block is the text between two boundaries of block elements, with character
    references decoded, white space turned into one space and trimmed.  The tree is the list of
    the top elements; an element is [key, children], a child an element or the index of a block.
    """
    blocks: list[Block] = []
    tree: list = []
    stack: list[Element] = []
    parts: list[str] = []
    held: list[list[str]] = []
    open_names: dict[str, int] = {}
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                (stack[-1].node if stack else tree).append(len(blocks))
                blocks.append(Block(text, bool(stack) and stack[-1].skip, stack[-1].inside if stack else "", min(linked, len(text))))
        linked = 0

    def close(index: int) -> None:
        while len(stack) > index:
            e = stack[-1]
            if e.name not in INLINE or e.apart:
                flush()
            stack.pop()
            for n in {e.name, e.key.split(".")[0]}:
                open_names[n] -= 1
            if e.apart:
                parts[:] = held.pop()

    page = page or ""
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            parts.append(m["text"])
            if open_names.get("a"):
                linked += len(m["text"].strip())
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1) if open_names.get(name) else ():
                if stack[k].name == name or stack[k].key.split(".")[0] == name:
                    close(k)
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break  # a stray inline end tag does not close blocks around it
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        wanted = _CLOSES.get(name, ())
        if name in _P_CLOSERS:
            wanted = (*wanted, "p")
        if wanted and any(open_names.get(w) for w in wanted):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in wanted:
                    close(k)
                    break
                if stack[k].name in _BARRIER and stack[k].name not in wanted:
                    break
        if name in ("html", "body") and open_names.get(name):
            continue
        if name == "body" and open_names.get("head"):
            for k, e in enumerate(stack):
                if e.name == "head":
                    close(k)
                    break
        if name not in INLINE:
            flush()
        parent = stack[-1] if stack else None
        element = _element(name, m["attrs"] or m["attrs2"] or "", parent is not None and parent.skip)
        if name in VOID:
            continue
        element.inside, element.node, element.depth = (parent.inside, parent.node, parent.depth) if parent else ("", tree, 0)
        if element.name in ("article", "main") and element.inside != "article" and not element.skip:
            element.inside = element.name
        if name not in INLINE:
            if element.depth < MAX_DEPTH:
                own: list = []
                element.node.append([element.key, own])
                element.node, element.depth = own, element.depth + 1
        elif element.skip and not (parent and parent.skip):
            element.apart = True
            held.append(parts[:])
            parts.clear()
        for n in {element.name, element.key.split(".")[0]}:
            open_names[n] = open_names.get(n, 0) + 1
        stack.append(element)
    flush()
    close(0)
    return blocks, tree
