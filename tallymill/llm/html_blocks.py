"""Leaf blocks of HTML pages with the features of a block: its ancestors, their class names, and the shape of its text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

# Elements that begin and end a block, elements without an end, those whose content is no text of the page, and
# those that hold text inside a block or blocks of their own and are ancestors of both.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre"
    " search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template textarea".split())
HOLDER_TAGS = frozenset("iframe math noembed noframes noscript object svg".split())
_FOREIGN = frozenset("math svg".split())
_SVG_TITLES = frozenset("desc text title tspan".split())
# Opening one of these ends the other, as pages leave out the end tags.
_ENDS_P = BLOCK_TAGS - frozenset("body head html button label legend option optgroup select".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = frozenset("ul ol dl table article section div form body html".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile("[a-z]+")
_NAME_END = re.compile(r"[\s/>]")
_NOTICE = re.compile(r"cookie|copyright|©|all rights reserved|subscribe|newsletter|sign up|log in|share this|read more|advert|sponsored", re.I)
# A tag, its quoted values as wholes; a quote counts only after an equals sign. No piece is tried twice.
_TAG = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>""")


@dataclass(frozen=True)
class Block:
    """Text of a leaf block and the names of its features."""

    text: str
    features: frozenset[str]


@lru_cache(maxsize=20_000)
def _own_features(tag: str, attributes: str) -> frozenset[str]:
    found = {f"in:{tag}"}
    for match in _NAMES.finditer(attributes):
        value = (match[1] or match[2] or match[3] or "").lower()
        found.update(f"name:{word}" for word in _WORD.findall(value) if len(word) > 1)
    return frozenset(found)


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])|</{tag}$", re.I)


def _tag_end(page: str, at: int) -> int:
    """Place after the tag that begins at ``at``; a ``>`` inside quotes does not end it, unless the quotes have no end.

    The page's end if nothing ends it.
    """
    first = page.find(">", at)
    if first < 0:
        return len(page)
    match = _TAG.match(page, at)
    return match.end() if match else first + 1


def _text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    share = linked / max(1, len(text))
    found = [f"words:{min(words.bit_length(), 7)}", f"links:{min(3, int(share * 4))}"]
    if text[-1] in ".!?…:;\"'»”)":
        found.append("ends")
    if _NOTICE.search(text):
        found.append("notice")
    return found


# A comment is empty if what ends it follows at once.
_COMMENT_END = re.compile("-?>")
_COMMENT_CLOSE = re.compile("--!?>")


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order. References are decoded, white space is one blank, blocks without text are left out.

    Comments, scripts, styles, text areas and templates are left out, up to the page's end where their end is missing. Formulas,
    drawings and what stands in for objects, frames and scripts are text like other; a block inside ends a formula or a drawing.
    """
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked, in_link = 0, 0
    at, size = 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                above = stack[-1][1] if stack else frozenset()
                inner = f"leaf:{stack[-1][0]}" if stack else "leaf:"
                found.append(Block(text, above.union(_text_features(text, linked), (inner,))))
            parts.clear()
        linked = 0

    def enter(tag: str, attributes: str) -> None:
        above = stack[-1][1] if stack else frozenset()
        stack.append((tag, above | _own_features(tag, attributes)))

    def leave(tag: str) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == tag:
                del stack[depth:]
                break

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        if start == size:
            break
        mark = page[start + 1 : start + 2]
        if mark == "!" or mark == "?":
            if page.startswith("<!--", start):
                match = _COMMENT_END.match(page, start + 4) or _COMMENT_CLOSE.search(page, start + 4)
                at = match.end() if match else size
            else:
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            continue
        closing = mark == "/"
        name_at = start + 1 + closing
        first = page[name_at : name_at + 1]
        if not (first.isascii() and first.isalpha()):
            if closing and first:  # an end tag without a name is a comment
                end = page.find(">", name_at)
                at = size if end < 0 else end + 1
                continue
            parts.append("<")
            at = start + 1
            continue
        end = _tag_end(page, start)
        stop = _NAME_END.search(page, name_at, end)
        tag = page[name_at : stop.start() if stop else end].lower()
        at = end
        if tag in RAW_TAGS:
            if not closing and page[end - 2 : end] != "/>":
                match = _raw_end(tag).search(page, end)
                at = _tag_end(page, match.start()) if match else size
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br" or (tag in _SVG_TITLES and stack and stack[-1][0] == "svg"):
            parts.append(" ")
        elif tag in HOLDER_TAGS:
            if tag != "math":
                parts.append(" ")
            if closing:
                leave(tag)
            elif page[end - 2 : end] != "/>":
                enter(tag, page[stop.start() : end] if stop else "")
        elif tag in BLOCK_TAGS:
            close()
            if closing:
                leave(tag)
            else:
                while stack and stack[-1][0] in _FOREIGN:
                    stack.pop()
                if tag in _ENDS_P and stack and stack[-1][0] == "p":
                    stack.pop()
                same = _SAME.get(tag)
                if same:
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in same:
                            del stack[depth:]
                            break
                        if stack[depth][0] in _WALLS:
                            break
                if tag not in VOID_TAGS:
                    enter(tag, page[stop.start() : end] if stop else "")
    close()
    return found
