"""Leaf blocks of a web page: runs of text between the borders of block elements.

The parser keeps the stack of open block elements, closes what HTML lets authors leave open
(paragraphs, list items, cells) and passes over comments, scripts and styles. Each block element
has words that describe it: its tag, the parts of its class, id and role. What they are worth adds
up along the stack, so a block costs the same at any depth.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Any, NamedTuple

_MARKUP = re.compile(
    r"""<(?:
        !--(?:>|->|.*?(?:--!?>|\Z))
      | (?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | /?(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)
      | [!?/][^>]*(?:>|\Z)
    )""",
    re.VERBOSE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup label legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
_SILENT = frozenset(("script", "style", "title", "template", "iframe", "noscript", "noembed", "noframes", "svg", "math", "object", "audio", "video", "canvas"))
_ENDS_P = BLOCKS - {"button", "caption", "label", "legend", "optgroup", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Starting one of these ends an open one of the second list, unless one of the third is in between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("optgroup",), ("select",)),
}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block(NamedTuple):
    text: str
    tag: str  # of the innermost block element, "" in none
    place: Any  # what the words of all block elements around it add up to
    own: Any  # what those of the innermost one are worth as such
    parent: Any  # ... and those of its parent as such
    links: int  # characters within links
    tie: int  # to the block before: 0 other parent element, 1 same parent and other tag, 2 same parent and tag


@lru_cache(1 << 14)
def _described(tag: str, more: str) -> tuple[str, ...]:
    words = [f"t:{tag}"]
    for name, value in _ATTRIBUTE.findall(more):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            for part in _PART.findall(value):
                part = part.lower()
                words.append(f"c:{part}")
                if len(part) > 4:
                    words.append(f"c:{part[:4]}*")
        elif name == "role":
            words.append(f"r:{value.lower()}")
        elif name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and "none" in value:
            words.append("hidden")
    return tuple(dict.fromkeys(words))


@lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE)


def described(words: tuple[str, ...]) -> tuple[str, ...]:
    """The plain worth of words: themselves."""
    return words


def own_words(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"own {word}" for word in words)


def parent_words(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"in {word}" for word in words)


Worth = Callable[[tuple[str, ...]], Any]


def leaf_blocks(page: str, worth: Worth = described, own: Worth = own_words, parent: Worth = parent_words, nothing: Any = ()) -> list[Block]:
    """The leaf blocks of ``page`` in page order. References are decoded, white space is one space.

    ``worth``, ``own`` and ``parent`` say what the words of an element are worth to blocks within it, to its own and to its children's.
    """
    out: list[Block] = []
    stack: list[tuple] = [("", nothing, nothing, nothing, 0)]  # tag, worth of all up to it, as own, as parent, number of the element
    n_open: dict[str, int] = {}
    pieces: list[str] = []
    link_text: list[str] = []
    link_depth = 0  # of the stack where the open link began
    count, before = 0, (-1, "")

    def close_block() -> None:
        nonlocal before
        if not pieces:
            return
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            tag, place, value, _, _ = stack[-1]
            above = stack[-2] if len(stack) > 1 else stack[0]
            links = len(" ".join(html.unescape("".join(link_text)).split())) if link_text else 0
            tie = (1 + (tag == before[1])) * (above[4] == before[0])
            out.append(Block(text, tag, place, value, above[3], min(links, len(text)), tie))
            before = above[4], tag
        link_text.clear()

    def pop() -> None:
        nonlocal link_depth
        n_open[stack.pop()[0]] -= 1
        if link_depth > len(stack):
            link_depth = 0

    def pop_to(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if any(n_open.get(name) for name in names):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] in names:
                    while len(stack) > at:
                        pop()
                    return
                if stack[at][0] in stops:
                    return

    def say(text: str) -> None:
        pieces.append(text)
        if link_depth:
            link_text.append(text)

    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["odd"]
        if name is None:
            continue
        name = name.lower()
        ends = page.startswith("</", found.start())
        if name in _SILENT:
            if not ends and not (found["more"] or "").endswith("/"):
                stop = _end_of(name).search(page, at)
                at = stop.end() if stop else size
                more = page.find(">", at)
                at = more + 1 if stop and more >= 0 else size
            continue
        if name in BLOCKS:
            close_block()
            if ends:
                if name in _HEADINGS:
                    pop_to(tuple(_HEADINGS), ("table", "td", "th"))
                else:
                    stops = () if name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else ("td", "th", "table")
                    pop_to((name,), stops)
                continue
            if name in _ENDS_P:
                pop_to(("p",), ("td", "th", "table", "button", "caption"))
            if name in _ENDS:
                pop_to(*_ENDS[name])
            words = _described(name, found["more"] or found["rest"] or "")
            count += 1
            stack.append((name, stack[-1][1] + worth(words), own(words), parent(words), count))
            n_open[name] = n_open.get(name, 0) + 1
        elif name == "a":
            link_depth = 0 if ends else len(stack)
        elif name == "hr" or name in ("body", "html", "head"):
            close_block()
        elif name in ("br", "wbr", "img", "input", "textarea"):
            if name == "br":
                say(" ")
            elif name == "textarea" and not ends:  # holds text only
                stop = _end_of(name).search(page, at)
                at = stop.start() if stop else size
    close_block()
    return out
