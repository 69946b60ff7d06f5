"""Pages as sequences of leaf blocks, each with its text and the path of elements that it stands in."""

from __future__ import annotations

import html
import re
import zlib

#: Elements without text of their own, left out with all they hold, up to their end tag.
SKIPPED = frozenset("script style noscript template title textarea svg iframe object canvas audio video math".split())
#: Elements that stand within a block; all others that HTML knows begin and end blocks. Unknown ones stand within.
BLOCKS = frozenset(
    "html head body address article aside blockquote button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, and where the search for it ends.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist"))}
#: How much less an element counts than the one that it holds, and how many count: those farther out weigh less than a thousandth.
DECAY, DEEP = 0.6, 14
#: Places of hashed elements, their names, and words.
HASHED = 4096

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++))")
_HUGE = re.compile(r"&#(?:[0-9]{20,}|[xX][0-9a-fA-F]{20,});?")
_NAME = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in SKIPPED}


def place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % HASHED


def names_in(attributes: str) -> list[str]:
    """The words of an element's class, id and role, in lower case."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            found += _NAME.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or ""))
    return [x.lower() for x in found]


class Element:
    """An open element: its tag, names, and what its path counts as (places with weights)."""

    __slots__ = ("tag", "names", "parent", "path", "inside")

    def __init__(self, tag: str, names: list[str], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        own = {place(f"<{tag}"), *(place(n) for n in names)}
        path = {k: w * DECAY for k, w in parent.path.items() if w * DECAY >= DECAY**DEEP} if parent else {}
        for k in own:
            path[k] = path.get(k, 0.0) + 1.0
        self.path = path
        self.inside: dict[tuple[str, str], Element] = {}

    def within(self, tag: str, attributes: str) -> Element:
        """An element in this one; one object for all that look alike."""
        found = self.inside.get((tag, attributes))
        if found is None:
            found = self.inside[tag, attributes] = Element(tag, names_in(attributes) if attributes else [], self)
        return found


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        #: linked: how many characters of the text stand in links
        self.text, self.element, self.linked = text, element, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order, in one pass from left to right.

    A block is the text between two borders of block elements: character references resolved, white
    space and ``<br>`` turned into one space each run, trimmed; empty ones are none. End tags may be missing, as HTML allows, and
    those that close nothing are ignored. Comments and SKIPPED elements are left out, when never closed up to the end of the page; text behind
    a ``<`` that begins no tag, or a tag that never ends, stays text.
    """
    out: list[Block] = []
    stack, open_tags = [Element("html", [], None)], {}
    text: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(raw)
            if in_link:
                linked += len(raw)

    def border() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            if "&" in raw:
                raw = html.unescape(_HUGE.sub("�", raw))
            if said := " ".join(raw.split()):
                out.append(Block(said, stack[-1], min(linked, len(said))))
            text.clear()
        linked = 0

    def close_to(size: int) -> None:
        while len(stack) > size:
            open_tags[stack.pop().tag] -= 1

    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        say(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 2)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i) or (page.startswith("</", i) and not page[i + 2 : i + 3].isascii()):
            end = page.find(">", i)
            if end < 0:
                at = i
                break
            at = end + 1
            continue
        tag = _TAG.match(page, i)
        if tag is None:
            if not ("a" <= page[i + 1 : i + 2].lower() <= "z" or page[i + 1 : i + 2] == "/"):
                say("<")
                at = i + 1
                continue
            if page[i + 1 : i + 2] == "/" and not "a" <= page[i + 2 : i + 3].lower() <= "z":
                end = page.find(">", i)
                if end >= 0:
                    at = end + 1
                    continue
            at = i
            break
        at, name = tag.end(), tag[2].lower()
        if name in SKIPPED:
            if not tag[1] and not (name in ("svg", "math", "object") and tag[3].endswith("/")):
                end = _CLOSE[name].search(page, at)
                done = page.find(">", end.end()) if end else -1
                at = n if done < 0 else done + 1
        elif name == "br":
            say(" ")
        elif name == "a":
            in_link = not tag[1]
        elif name not in BLOCKS:
            continue
        elif tag[1]:
            border()
            in_link = False
            if open_tags.get(name):
                size = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name)
                close_to(size)
        else:
            border()
            top = stack[-1].tag
            if top == "p" or (top in HEADINGS and name in HEADINGS):
                close_to(len(stack) - 1)
            if name in CLOSES:
                closed, walls = CLOSES[name]
                if any(open_tags.get(c) for c in closed):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in walls:
                            break
                        if stack[k].tag in closed:
                            close_to(k)
                            break
            if name != "hr":
                stack.append(stack[-1].within(name, tag[3]))
                open_tags[name] = open_tags.get(name, 0) + 1
    say(page[at:])
    border()
    return out
