"""A small forgiving HTML reader: a tree of block elements with their text, in page order."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select option button canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these kinds, looked for up to the given containers.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+))>", re.DOTALL
)
_ENDLESS = re.compile(r"<[!?].*", re.DOTALL)
# A name is tried where it begins only, and whole.
_ATTR = re.compile(r"""(?<![^\s"'>/=])([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "depth", "parts", "links")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.kids: list = []  # nodes and text blocks in page order
        self.parts: list[str] | None = None
        self.links = 0

    def tokens(self) -> set[str]:
        """Words of class, id, role and the like."""
        found = [v for k, *vs in _ATTR.findall(self.attrs) if k.lower() in ("class", "id", "role", "itemprop", "aria-label") for v in vs if v]
        return set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(found)).lower())) if found else set()


class Block:
    """A run of text without a block boundary inside."""

    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


def parse(page: str) -> Node:
    root = Node("html", "", None)
    top, stack = root, [root]
    held: dict[str, list[int]] = defaultdict(list)  # places of each tag on the stack
    open_inline: Counter[str] = Counter()
    run: list[str] = []
    linked = 0

    def flush():
        nonlocal run, linked
        if run:
            text = "".join(run)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                top.kids.append(Block(text, min(linked, len(text))))
            run, linked = [], 0

    def leave(k: int):
        nonlocal top
        for x in stack[k:]:
            held[x.tag].pop()
        del stack[k:]
        top = stack[-1]

    def latest(tags) -> int:
        return max((held[t][-1] for t in tags if held.get(t)), default=0)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        # Behind the last end of a tag only what needs no end is markup; a tag would be sought up to the end each time.
        m = (_TOKEN if at <= last else _ENDLESS).search(page, at)
        if not m:
            run.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            run.append(piece)
            if open_inline["a"] > 0:
                linked += len(piece)
        at = m.end()
        if m.re is _ENDLESS:
            break
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in INLINE:
                open_inline[name] = max(0, open_inline[name] - 1)
            elif name not in VOID:
                flush()
                if held.get(name):
                    leave(held[name][-1])
                    open_inline.clear()
            continue
        if name in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                close = re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(page, at)
                at = page.find(">", close.end()) + 1 if close else 0
                at = at or n
            if name not in ("option",):
                run.append(" ")
            continue
        if name in VOID:
            if name in ("br", "hr"):
                run.append(" ")
            continue
        if name in INLINE:
            open_inline[name] += 1
            if name == "a":
                top.links += 1
            continue
        if name in ("html", "body"):
            continue
        flush()
        if name in CLOSES_P and latest("p") >= max(1, len(stack) - 4):
            leave(latest("p"))
        elif name in IMPLIED:
            kinds, limits = IMPLIED[name]
            if latest(kinds - limits) > latest(limits - kinds):
                leave(latest(kinds - limits))
        node = Node(name, m["attrs"], top)
        top.kids.append(node)
        held[name].append(len(stack))
        stack.append(node)
        top = node
    flush()
    return root
