"""Visible text blocks of an HTML page, and where each stands."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_MAIN = frozenset(("article", "main"))
#: Never part of an article.
_ASIDE = frozenset("aside button dialog footer form head menu nav object search select svg template".split())
_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related search share sharing "
    "sidebar sidebars skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Inside an article, elements that such a class, id or role drops; others are its text, whatever their anchors are called.
_CONTAINERS = frozenset("aside details div fieldset figure footer form header hgroup iframe ol section span table ul".split())
#: Inside an article, elements that differencing judges as a whole.
_BOXES = frozenset("details div dl fieldset figure ol section table ul".split())
#: A start tag that ends an open element of these names.
_ENDS = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

MAIN, OUTSIDE, DROPPED = 0, 1, 2


@dataclass(frozen=True)
class Block:
    text: str
    #: In an article or main element, outside of any, or in a part that is never content.
    place: int
    #: Within an article, the number of the outermost container (div, section, list, table) that it stands in; 0: the article's own.
    box: int = 0


def _is_aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in _ASIDE or (name == "header" and not in_main):
        return True
    if name in ("html", "body", "article", "main") or "=" not in attributes or (in_main and name not in _CONTAINERS):
        return False
    parts = r"\s+" if in_main else r"[\s_-]+"
    for found in _ATTRIBUTE.finditer(attributes):
        value = next(v for v in found.groups() if v is not None)
        if not _WORDS.isdisjoint(re.split(parts, value.lower())):
            return True
    return False


def blocks(source: str) -> list[Block]:
    """The page's text blocks in order: character references decoded, white space made one space, empty ones left out.

    Comments, declarations, scripts, styles and the like give no block. Elements that
    are left open end with the element around them or with the page.
    """
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = [("", OUTSIDE, 0)]
    opened: Counter[str] = Counter()
    boxes = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(text, *stack[-1][1:]))

    def close(at: int) -> None:
        opened.subtract(name for name, _, _ in stack[at:])
        del stack[at:]

    pos = 0
    while found := _TOKEN.search(source, pos):
        if found.start() > pos:
            parts.append(html.unescape(source[pos : found.start()]))
        pos = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            if name in _BLOCK:
                flush()
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0) if opened[name] > 0 else 0
            if at:
                if any(stack[i][1] != stack[at - 1][1] for i in range(at, len(stack))):
                    flush()
                close(at)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, pos)
            pos = end.end() if end else len(source)
            continue
        if name in _VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in _BLOCK:
            flush()
        if name in _ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _ENDS[name]:
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        _, place, box = stack[-1]
        if place != DROPPED:
            if _is_aside(name, found.group(3), place == MAIN):
                flush()
                place = DROPPED
            elif name in _MAIN:
                place = MAIN
            elif place == MAIN and not box and name in _BOXES:
                boxes += 1
                box = boxes
        stack.append((name, place, box))
        opened[name] += 1
    if pos < len(source):
        parts.append(html.unescape(source[pos:]))
    flush()
    return out
