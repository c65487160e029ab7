"""A page's HTML as structural tokens and text runs: a small forgiving reader for one page at a time.

A structural token is the opening or the end of a block element, told apart by its path (names,
classes and ids without digits of the elements around it).  A text run is the text between two
tags; a run knows its element, whether it is link text, whether an element around it is named as
boilerplate, and how clearly one is named as the article.  Elements left open are ended where HTML
implies it, or at the end of the page.
"""

from __future__ import annotations

import html
import re

import xxhash

# Names of HTML elements by how they are shown, and the words sites name their parts with.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
                  "head header hgroup hr html legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul "
                  "video audio canvas".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
ENDS_P = BLOCK - frozenset("html head body caption tbody td tfoot th thead tr option optgroup legend summary".split())
OWN_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "optgroup": "option optgroup", "tbody": "thead tbody tr td th",
            "tfoot": "tbody tr td th"}
SCOPES = frozenset("ul ol dl table select body html article section div main aside nav".split())
BOXES = frozenset("html body main article section div td center form table details".split())
BAD_ELEMENTS = frozenset("nav footer aside form head template svg button select dialog menu object video audio canvas search fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsors sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header "
                      "masthead topbar footer bottombar sidebar aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
                      "share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies feedback form search searchbox toolbar pagination pager legal copyright".split())
GOOD_WORDS = frozenset("article articlebody post postbody blogpost entry story content maincontent main text body".split())
OF_ARTICLE, OF_MAIN, OF_NAME = 3, 2, 1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_hashes: dict[tuple, int] = {}


def hashed(*key) -> int:
    """64 bits, signed, the same in every task and run."""
    h = _hashes.get(key)
    if h is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        h = xxhash.xxh3_64_intdigest("\x00".join(map(str, key)).encode("utf-8", "surrogatepass"))
        h = h - (1 << 64) if h >= 1 << 63 else h
        _hashes[key] = h
    return h


NEVER, OUTSIDE, ALWAYS = 0, 1, 2  # boilerplate: not, unless it stands in an article or main element, in any case
_facts: dict[tuple[str, str], tuple[str, int, int]] = {}


def facts(name: str, attributes: str) -> tuple[str, int, int]:
    """(sign in the path, level, boilerplate) of an element by its own name and attributes."""
    known = _facts.get((name, attributes))
    if known is not None:
        return known
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    sign = re.sub(r"\d+", "", f"{found.get('class', '')} {found.get('id', '')}").strip()
    words = {w.lower() for w in _WORD.findall(sign)}
    roles = found.get("role", "").lower().split()
    level, bad = 0, NEVER
    if name == "article" or "articlebody" in found.get("itemprop", "").lower():
        level = OF_ARTICLE
    elif name == "main" or "main" in roles:
        level = OF_MAIN
    elif words & GOOD_WORDS and name not in ("html", "body"):
        level = OF_NAME
    if name not in ("html", "body", "article", "main"):
        cues = words & BAD_WORDS
        if (cues - {"header"} or name in BAD_ELEMENTS or any(r in BAD_ROLES for r in roles) or "hidden" in found
                or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", ""))):
            bad = ALWAYS
        elif name == "header" or cues and not words & GOOD_WORDS:  # the head of an article is part of it
            bad = OUTSIDE
    elif "hidden" in found or name == "article" and words & BAD_WORDS:  # a comment or a teaser marked up as an article
        bad = ALWAYS
    if len(_facts) > 100_000:
        _facts.clear()
    _facts[name, attributes] = sign, level, bad
    return sign, level, bad


class Node:
    """An open element: its path, and what it and those around it are named as."""

    __slots__ = ("name", "parent", "path", "bad", "level", "link", "box", "depth", "chars")

    def __init__(self, name: str, parent: "Node | None", attributes: str):
        self.name, self.parent, self.chars = name, parent, 0
        if parent is None:
            self.bad, self.level, self.link, self.box, self.path, self.depth = False, 0, False, self, 0, 0
            return
        sign, level, bad = facts(name, attributes)
        self.level = max(parent.level, level)
        self.bad = parent.bad or bad == ALWAYS or bad == OUTSIDE and parent.level < OF_MAIN
        self.link = parent.link or name == "a"
        self.path, self.depth, self.box = parent.path, parent.depth, parent.box
        if name not in INLINE:
            self.path = hashed(parent.path, name, sign)
            self.depth += 1
            if name in BOXES:
                self.box = self


class Run:
    """Text between two tags; ``block`` numbers the page's blocks."""

    __slots__ = ("text", "node", "block", "size")

    def __init__(self, text: str, node: Node, block: int):
        self.text, self.node, self.block = text, node, block
        self.size = len(text.strip())

    def token(self) -> int:
        """The text's token: its words at this path."""
        h = xxhash.xxh3_64_intdigest(" ".join(self.text.split()).encode("utf-8", "surrogatepass"), self.node.path & (1 << 64) - 1)
        return h - (1 << 64) if h >= 1 << 63 else h


def end_token(path: int) -> int:
    return hashed(path, "end")


def read_page(source: str) -> tuple[list, list[Run], dict[Node, int]]:
    """(events, runs, boxes): events are structural tokens (int) and runs in page order; boxes the
    text under each box element that is neither boilerplate by name nor link text."""
    root = Node("", None, "")
    stack, open_, events, runs, boxes = [root], {}, [], [], {}
    block, at, n = 0, 0, len(source)

    def close(k: int) -> None:
        """End the elements from place ``k`` of the stack on."""
        nonlocal block
        while len(stack) > k:
            node = stack.pop()
            open_[node.name] -= 1
            if node.name not in INLINE:
                events.append(end_token(node.path))
                block += 1
            if node.box is node:
                boxes[node] = node.chars
            node.parent.chars += node.chars

    def text(value: str) -> None:
        node = stack[-1]
        run = Run(html.unescape(value) if "&" in value else value, node, block)
        if run.size and not node.bad and not node.link:
            node.chars += run.size
        events.append(run)
        runs.append(run)

    def end_implied(names: str, stop: frozenset) -> None:
        names = names.split()
        if any(open_.get(x) for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    close(k)
                    return end_implied(" ".join(names), stop)
                if stack[k].name in stop:
                    return None
        return None

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at: m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if name == "br":
                text(" ")
            elif open_.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close(k)
                        break
            elif name == "p":
                block += 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else n
            continue
        if name in ENDS_P and open_.get("p"):
            end_implied("p", SCOPES - {"ul", "ol", "dl"} | {"button", "td", "th"})
        if name in OWN_ENDS:
            end_implied(OWN_ENDS[name], SCOPES)
        if name in ("html", "body") and open_.get(name):
            continue
        if name in BLOCK:
            block += 1
        if name in VOID:
            continue
        node = Node(name, stack[-1], m[3] or m[6] or "")
        stack.append(node)
        open_[name] = open_.get(name, 0) + 1
        if name not in INLINE:
            events.append(node.path)
    close(1)
    return events, runs, boxes


def blocks(runs: list[Run]) -> str:
    """The runs' text: white space inside a block one space, blocks joined by a line feed."""
    out, last, parts = [], None, []
    for r in [*runs, None]:
        if r is None or r.block != last:
            joined = " ".join("".join(parts).split())
            if joined:
                out.append(joined)
            if r is None:
                break
            last, parts = r.block, []
        parts.append(r.text)
    return "\n".join(out)
