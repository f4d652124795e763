"""A small HTML tree: elements, whole texts, subtree digests, and which elements are not the article."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import xxhash

# Fixed values of HTML: elements without content, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav noscript ol optgroup option p"
    " pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that an opening tag of the key closes, up to the bounds of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot caption tr td th".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot caption tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot caption tr td th".split()), frozenset(["table"])),
    "option": (frozenset("option".split()), frozenset("select datalist optgroup".split())),
}
P_BOUNDS = frozenset("button td th caption object table html".split())

# What is never part of the article: by element, by role, by word of a class or identifier.
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video nav aside footer menu dialog"
    " button select textarea input label fieldset datalist search title".split()
)
ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar aside menu nav"
    " navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal newsletter"
    " subscribe subscription share sharing social related recommended comment comments discussion disqus reply replies"
    " pagination pager widget widgets toolbar copyright".split()
)
HEADS = frozenset("header masthead topbar banner".split())
NAMED = frozenset("article aside blockquote center dd details div dl figure footer form header li ol p section span table td ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAIL = re.compile(r"[\s/]*>?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

KEPT, DROPPED, SOFT, HEAD = 0, 1, 2, 3


class Element:
    """One element; children are elements and texts in page order."""

    __slots__ = ("tag", "parent", "children", "kind", "digest", "letters", "keeps")

    def __init__(self, tag: str, parent: Element | None, kind: int):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.children: list[Element | str] = []
        self.digest, self.letters, self.keeps = 0, 0, False


def kind_of(tag: str, attributes: str) -> int:
    """Whether element, role, name or visibility say that this is not the article."""
    if tag in NEVER:
        return DROPPED
    kind = HEAD if tag == "header" else SOFT if tag == "form" else KEPT
    if not attributes or tag in ("html", "body", "main") or not _TELLING.search(attributes):
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), unescape((m.group(2) or "").strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            return DROPPED
        if name == "role":
            low = value.lower()
            kind = SOFT if low in ROLES else HEAD if low == "banner" else kind
        elif name in ("class", "id") and tag in NAMED:
            parts = {p.lower() for p in _PART.findall(value)}
            if parts & NAMES:
                kind = SOFT
            elif parts & HEADS and kind == KEPT and tag != "article":
                kind = HEAD
    return kind


def tag_end(html: str, at: int) -> tuple[int, str]:
    """Where the tag whose name ends at ``at`` ends, and its attributes; quoted values may hold >."""
    close = html.find(">", at)
    if close < 0:
        return len(html), ""
    if '"' not in (plain := html[at:close]) and "'" not in plain:
        return close + 1, plain
    here = at
    while (m := _ATTRIBUTE.match(html, here)) and m.end() > here:
        here = m.end()
    return _TAIL.match(html, here).end(), html[at:here]


def parsed(html: str) -> list[Element]:
    """All elements in page order, a root first. Never fails: stray tags are dropped, open ones end late."""
    root = Element("", None, KEPT)
    out, stack = [root], [root]
    places: dict[str, list[int]] = {}  # of open elements on the stack, by name
    blocks = [0]
    pre_end = len(html)
    at, text_from = 0, 0

    def last(names: frozenset[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def shut(number: int) -> None:
        for e in stack[number:]:
            places[e.tag].pop()
            if e.tag in BLOCK:
                blocks.pop()
        del stack[number:]

    def text(begin: int, end: int) -> None:
        if end > begin:
            body = html[begin:end]
            stack[-1].children.append(unescape(body) if "&" in body else body)

    while True:
        lt = html.find("<", at)
        if lt < 0:
            text(text_from, pre_end)
            return out
        after = html[lt + 1 : lt + 2]
        if after == "!":
            text(text_from, lt)
            if html.startswith("<!--", lt):
                short = re.compile(r"-?>").match(html, lt + 4)
                ends = [e for e in (html.find("-->", lt + 4), html.find("--!>", lt + 4)) if e >= 0]
                at = short.end() if short else html.index(">", min(ends)) + 1 if ends else pre_end
            else:
                at = html.find(">", lt) + 1 or pre_end
            text_from = at
            continue
        if after == "?" or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
            text(text_from, lt)
            at = text_from = html.find(">", lt) + 1 or pre_end
            continue
        closing = after == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if name is None:  # an ordinary <
            at = lt + 1
            continue
        text(text_from, lt)
        tag = name.group().lower()
        at, attributes = tag_end(html, name.end())
        text_from = at
        if closing:
            open_ = places.get(tag)
            if open_ and (tag in BLOCK or open_[-1] > blocks[-1]):
                shut(open_[-1])
            continue
        if tag in BLOCK and places.get("p") and places["p"][-1] > last(P_BOUNDS):
            shut(places["p"][-1])
        if tag in CLOSES:
            ended, bounds = CLOSES[tag]
            bound = last(bounds)
            above = [own[bisect_right(own, bound)] for n in ended if (own := places.get(n)) and own[-1] > bound]
            if above:
                shut(min(above))
        element = Element(tag, stack[-1], kind_of(tag, attributes))
        stack[-1].children.append(element)
        out.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = text_from = pre_end if end is None else tag_end(html, end.end())[0]
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(element)


class Page:
    """A parsed page with subtree digests; texts of ``NEVER`` scripts and styles are not part of it."""

    def __init__(self, html: str):
        self.elements = parsed(html)
        for e in reversed(self.elements):
            pieces = [e.tag]
            for child in e.children:
                if isinstance(child, str):
                    body = child.strip()
                    if body:
                        pieces.append(body)
                        e.letters += len(body)
                elif child.letters:
                    pieces.append(f"\x00{child.digest}")
                    e.letters += child.letters
            if e.letters:
                e.digest = xxhash.xxh3_64_intdigest("\x00".join(pieces).encode("utf-8", "replace")) or 1
        never = self._below(lambda e: e.kind == DROPPED)
        open_ = [e for e in self.elements if e.letters and e.kind != SOFT and id(e) not in never]
        articles = [e for e in open_ if e.tag == "article"]
        mains = [e for e in open_ if e.tag == "main"]
        largest = max(articles, key=lambda e: e.letters, default=None)
        forms = [e for e in self.elements if e.tag == "h1"]
        for e in [*mains, *([largest] if largest else [])]:
            while e is not None and not e.keeps:
                e.keeps = True
                e = e.parent
        titled: set[int] = set()
        for e in forms:  # a form around the page's title is a wrapper
            while e is not None and id(e) not in titled:
                titled.add(id(e))
                e.keeps = e.keeps or (e.tag == "form" and e.kind == SOFT)
                e = e.parent
        lost = self._below(lambda e: e.kind != KEPT and not e.keeps)
        self.regions = [e for e in articles if id(e) not in lost] or [e for e in mains if id(e) not in lost]
        self.regions = self.regions or [self.elements[0]]
        outer = {id(e) for e in self.regions}
        nested = self._below(lambda e: e.parent is not None and id(e.parent) in outer)
        self.regions = [e for e in self.regions if id(e) not in nested]
        self.bounded = self.regions[0].parent is not None

    def _below(self, test) -> set[int]:
        """The elements that pass the test, with everything inside them."""
        found: set[int] = set()
        for e in self.elements:
            if id(e.parent) in found or test(e):
                found.add(id(e))
        return found

    def key(self) -> int:
        """Digest of the article, so that copies of a page count once."""
        state = xxhash.xxh3_64()
        for e in self.regions:
            state.update(e.digest.to_bytes(8, "little"))
        return state.intdigest()

    def removable(self) -> set[int]:
        """Digests of block subtrees with text that may be a template: prose of an article is none."""
        regions = {id(r) for r in self.regions} if self.bounded else set()
        inside = self._below(lambda e: id(e) in regions)
        return {
            e.digest
            for e in self.elements[1:]
            if e.letters and not e.keeps and e.tag in BLOCK and not (id(e) in inside and (e.tag in PROSE or e.tag == "article"))
        }

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        """The article's text without templates: blocks joined by a space, white space made one space."""
        removable = self.removable() & templates if templates else frozenset()
        parts: list[str] = []
        # (element or text, inside an article's header: headings only)
        todo: list[tuple[Element | str, bool]] = [(r, False) for r in reversed(self.regions)]
        regions = {id(r) for r in self.regions}
        while todo:
            item, heads = todo.pop()
            if isinstance(item, str):
                if not heads:
                    parts.append(item)
                continue
            if id(item) not in regions and not item.keeps:
                if item.digest in removable and item.tag in BLOCK and not (self.bounded and item.tag in PROSE):
                    continue
                if item.kind in (DROPPED, SOFT) or (item.kind == HEAD and not self.bounded):
                    continue
                heads = (heads or item.kind == HEAD) and item.tag not in HEADINGS
            if item.tag in BLOCK or item.tag in ("br", "hr"):
                parts.append(" ")
                todo.append((" ", False))
            todo.extend((c, heads) for c in reversed(item.children))
        return " ".join("".join(parts).split())
