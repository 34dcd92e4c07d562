"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Set
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataframe.llm.common import in_small_batches, table, text_of
from strataframe.runtime import cut

#: Elements that flow inside a line; they leave no mark in a token stream.  Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.  Fixed values.
DROPPED = frozenset("nav footer aside form script style noscript template svg math button select option textarea input iframe object canvas dialog menu head title audio video map fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of classes and ids that name page furniture.  Fixed values.
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social "
    "related recommended recommendations widget comment comments disqus reply replies respond pager pagination toolbar masthead skip tags hidden".split()
)
#: Words that tell only what kind of box a furniture word makes: ``share-buttons`` is furniture, ``related-work`` is not.
BOXES = frozenset(
    "area articles bar block body bottom box boxes button buttons container content entry form group header heading icon icons inner item items label left line link links list main "
    "module outer panel placeholder post posts right row section slot stories text title top unit wrap wrapper".split()
)
HEADERS = frozenset(("header", "masthead", "topbar"))
MAIN = frozenset("article articlebody main content maincontent post entry story body text".split())
#: A start of one of these closes an open one of those, as in HTML's implied end tags.  Fixed values.
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|template|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Nodes of a host's wrapper; beyond it the optional parts seen on fewest pages are left out of it (not out of the
#: pages, nor articles and ``main`` parts), their characters added to the parent.
WRAPPER_NODES = 1500
#: A text is constant where it is the same on this many pages of a host and on half of them at least.
CONSTANT_PAGES = 3
#: Depth of a page's tree, at most.
MAX_DEPTH = 160
#: Hosts whose partial wrappers a task holds before it passes them on.
OPEN_HOSTS = 500
RULES_BYTES, SALTS = 32 << 20, 32


#: Cells of the table that aligns two lists of elements; longer lists are aligned by their next equal keys.
TABLE_CELLS = 1 << 20


class Node:
    """A block element: key, children, and its own text as runs (text, position among the children).

    ``named`` tells that only the words of its class or id make it furniture; ``sure`` that it lies in
    furniture by its tag, role or style.
    """

    __slots__ = ("furniture", "key", "kids", "named", "runs", "sure", "tag", "up", "words")

    def __init__(self, tag: str, words: tuple[str, ...] = (), furniture: bool = False, named: bool = False, up: Node | None = None):
        self.tag, self.words, self.furniture, self.named, self.up = tag, words, furniture, named, up
        self.sure = furniture and not named or up is not None and up.sure
        self.key = ".".join((tag, *words))
        self.kids: list[Node] = []
        self.runs: list[list] = []  # [position among the kids, text pieces, link characters]


@lru_cache(maxsize=4096)
def _parts(word: str) -> frozenset[str]:
    return frozenset(re.split(r"[^a-z0-9]+", word)) - {""}


def _plainly(words: tuple[str, ...]) -> bool:
    """Whether a whole class or id names furniture: every part of it is such a word, or the kind of a box."""
    return any(_parts(w) & FURNITURE and _parts(w) <= FURNITURE | BOXES for w in words)


def _named(tag: str, attributes: str) -> tuple[tuple[str, ...], bool, bool]:
    """Words of class, id and role; whether the element is furniture; whether only its words say so."""
    words: list[str] = []
    bad = tag in DROPPED
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                words += [re.sub(r"\d+", "0", w) for w in value.split()]
            elif name == "role":
                bad |= value in ROLES
                words += ["role=main"] * (value == "main")
            elif name == "itemprop":
                words += ["articlebody"] * (value == "articlebody")
            elif name == "style":
                bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif name == "hidden" or value == "true":
                bad = True
    named = not bad and any(_parts(w) & FURNITURE for w in words) and tag not in ("html", "body")
    return tuple(sorted(set(words))), bad or named, named


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or "role=main" in node.words


def _chars(node: Node) -> int:
    """Characters below a node, other than in what is furniture by its tag, role or style."""
    total, open_ = 0, [node]
    while open_:
        n = open_.pop()
        if not n.sure:
            total += sum(len(t) for r in n.runs for t in r[1])
            open_ += n.kids
    return total


def _own_up(root: Node, mains: list[Node]) -> None:
    """Words never take an article away that holds most of the page: where what holds it is named furniture, it stays.

    An article that is itself named so, a reader's comment say, is no such article.
    """

    def above(node: Node) -> Iterator[Node]:
        up = node.up
        while up is not None:
            yield up
            up = up.up

    mains = [n for n in mains if not n.sure]
    if not mains or not all(n.furniture or any(u.furniture for u in above(n)) for n in mains):
        return
    mains = [n for n in mains if not n.furniture]
    if 2 * sum(_chars(n) for n in mains if not any(_is_main(u) for u in above(n))) >= _chars(root):
        for node in mains:
            for up in above(node):
                up.furniture = False


def _mostly_links(node: Node) -> bool:
    """Whether links hold half of the characters below a node, or more."""
    linked, total, open_ = 0, 0, [node]
    while open_:
        n = open_.pop()
        linked += sum(r[2] for r in n.runs)
        total += sum(len(t) for r in n.runs for t in r[1])
        open_ += n.kids
    return total > 0 and 2 * linked >= total


def _unclosed(token: str, raw: str | None) -> bool:
    """Whether a comment or a raw text element runs to the end of the page."""
    if raw:
        return not re.search(rf"</{raw}\s*>\Z", token[-64:], re.I)
    return token.startswith("<!--") and not token.endswith("-->")


def parse(html: str) -> Node:
    """The block tree of a page's token stream; broken markup is closed as browsers imply.

    Elements nested deeper than ``MAX_DEPTH`` give their text to the element at that depth, as browsers
    also bound their trees; nothing behind the last ``>`` can be a tag, so it is not searched for one.
    Inside an article or ``main`` part, words make an element furniture only if a whole class or id says so, or
    if links hold half of its text.
    """
    root = Node("#root")
    stack, run, at, link = [root], None, 0, 0
    deep: list[tuple[str, bool]] = []  # open elements below the greatest depth, and whether they are furniture
    bad, inside = 0, Counter()  # of those: furniture, and names
    mains: list[Node] = []
    doubted: list[Node] = []

    def say(text: str) -> None:
        nonlocal run
        if bad:
            return
        top = stack[-1]
        if run is None:
            run = [len(top.kids), [], 0]
            top.runs.append(run)
        run[1].append(text)
        if link:
            run[2] += len(text)

    def leave(name: str) -> None:
        """Close the last of the deep elements of a name, with what is open inside it."""
        nonlocal bad
        while True:
            last, furniture = deep.pop()
            inside[last] -= 1
            bad -= furniture
            if last == name:
                return

    end, swallowed = html.rfind(">") + 1, False
    for m in _TOKEN.finditer(html, 0, end):
        if m.start() > at:
            say(unescape(html[at : m.start()]) if "&" in html[at : m.start()] else html[at : m.start()])
        at = m.end()
        swallowed = at == end and _unclosed(m[0], m[1])
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name == "br":
            say(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
        if closing:
            if name in INLINE and not any(n.tag == name for n in stack[-3:]):
                continue
            if inside[name]:
                leave(name)
                run = None
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    bad, inside = 0, Counter()
                    deep.clear()
                    run = None
                    break
            continue
        if name in VOID:
            if name == "hr":
                run = None
            continue
        words, furniture, named = _named(name, attributes)
        doubtful = named and not _plainly(words) and any(map(_is_main, stack))
        furniture, named = furniture and not doubtful, named and not doubtful
        if name in INLINE and not furniture:
            continue
        if len(stack) > MAX_DEPTH:
            run = None
            if deep and deep[-1][0] == name and (name == "p" or name in IMPLIED):
                leave(name)
            deep.append((name, furniture))
            inside[name] += 1
            bad += furniture
            continue
        if name in _P_CLOSERS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif name in IMPLIED:
            closes, within = IMPLIED[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in closes.split():
                    del stack[i:]
                    break
        run = None
        node = Node(name, words, furniture, named, stack[-1])
        stack[-1].kids.append(node)
        if _is_main(node):
            mains.append(node)
        if doubtful:
            doubted.append(node)
        if not attributes.endswith("/") or name not in ("svg", "math"):
            stack.append(node)
    tail = "" if swallowed else html[max(at, 0) :].partition("<!--")[0]
    if tail:
        say(unescape(tail))
    for node in reversed(doubted):
        if not any(map(_is_main, node.kids)) and _mostly_links(node):
            node.furniture = node.named = True
    _own_up(root, mains)
    return root


class Part:
    """A node of a wrapper: an element that is constant, optional or repeated, with its text slot's figures."""

    __slots__ = ("chars", "furniture", "key", "kids", "link", "many", "maybe", "pages", "text")

    def __init__(self, key: str, furniture: bool):
        self.key, self.furniture = key, furniture
        self.maybe = self.many = False
        self.pages, self.chars, self.link = 1, 0, 0
        self.text: str | None = None  # the constant text, or None for a slot
        self.kids: list[Part] = []

    def pack(self) -> list:
        return [self.key, int(self.furniture), int(self.maybe), int(self.many), self.pages, self.chars, self.link, self.text, [k.pack() for k in self.kids]]

    @staticmethod
    def unpack(v: list) -> Part:
        p = Part(v[0], bool(v[1]))
        p.maybe, p.many, p.pages, p.chars, p.link, p.text = bool(v[2]), bool(v[3]), v[4], v[5], v[6], v[7]
        p.kids = [Part.unpack(k) for k in v[8]]
        return p

    def expression(self) -> str:
        """The wrapper as a union-free expression: ( )? optional, ( )+ repeated, # a text slot."""
        inner = (f'"{self.text}"' if self.text else "#" if self.chars else "") + "".join(k.expression() for k in self.kids)
        body = f"<{self.key}>{inner}</>"
        return f"({body}){'*' if self.maybe and self.many else '+' if self.many else '?'}" if self.maybe or self.many else body


def _said(node: Node) -> str:
    return " ".join(" ".join("".join(r[1]).split()) for r in node.runs).strip()


def _mark(said: str) -> str:
    """A text as a wrapper holds it: a long one as its beginning and a hash of the whole."""
    return said if len(said) <= 80 else f"{said[:48]}\u2026{blake2b(said.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


def of_page(node: Node) -> Part:
    part = Part(node.key, node.furniture)
    said = _said(node)
    part.chars, part.link = len(said), sum(r[2] for r in node.runs)
    part.text = _mark(said)
    part.kids = folded([of_page(k) for k in node.kids])
    return part


def folded(parts: list[Part]) -> list[Part]:
    """Turn runs of equal neighbours into one repeated part, the instances aligned with each other."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].key == p.key:
            out[-1] = aligned(out[-1], p, same_pages=True)
            out[-1].many = True
        else:
            out.append(p)
    return out


def _resynced(x: list[Part], y: list[Part]) -> list[tuple[int, int]]:
    """Matches of two long lists in one pass: where keys differ, the side that is sooner at the other's key goes on to it."""
    places: tuple[dict[str, list[int]], ...] = ({}, {})
    for found, parts in zip(places, (x, y), strict=True):
        for i, part in enumerate(parts):
            found.setdefault(part.key, []).append(i)

    def ahead(side: int, key: str, at: int) -> int | None:
        found = places[side].get(key, [])
        k = bisect_left(found, at)
        return found[k] if k < len(found) else None

    p, q, out = 0, 0, []
    while p < len(x) and q < len(y):
        if x[p].key == y[q].key:
            out.append((p, q))
            p, q = p + 1, q + 1
            continue
        left, right = ahead(0, y[q].key, p), ahead(1, x[p].key, q)
        if left is None and right is None:
            p, q = p + 1, q + 1
        elif right is None or left is not None and left - p <= right - q:
            p = left
        else:
            q = right
    return out


def _matches(a: list[Part], b: list[Part]) -> list[tuple[int, int]]:
    """A longest common subsequence of keys; equal ends are matched first, so it is a table over the middle only.

    A middle of more than ``TABLE_CELLS`` pairs is aligned in one pass instead, which may match less.
    """
    i = 0
    while i < min(len(a), len(b)) and a[i].key == b[i].key:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j].key == b[-1 - j].key:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(x) * len(y) > TABLE_CELLS:
        middle = [(i + p, i + q) for p, q in _resynced(x, y)]
        return [*((k, k) for k in range(i)), *middle, *((len(a) - j + k, len(b) - j + k) for k in range(j))]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x) - 1, -1, -1):
        for q in range(len(y) - 1, -1, -1):
            best[p][q] = best[p + 1][q + 1] + 1 if x[p].key == y[q].key else max(best[p + 1][q], best[p][q + 1])
    p, q, middle = 0, 0, []
    while p < len(x) and q < len(y):
        if x[p].key == y[q].key:
            middle.append((i + p, i + q))
            p, q = p + 1, q + 1
        elif best[p + 1][q] >= best[p][q + 1]:
            p += 1
        else:
            q += 1
    return [*((k, k) for k in range(i)), *middle, *((len(a) - j + k, len(b) - j + k) for k in range(j))]


def _names(key: str) -> set[str]:
    """The parts of a key's class, id and role words."""
    return set(re.split(r"[^a-z0-9]+", key.partition(".")[2]))


def _common(a: str, b: str) -> str:
    """The key of two keys of one tag: shared words, and ``*`` for the words that differ."""
    if a == b:
        return a
    tag, *words = a.split(".")
    others = set(b.split(".")[1:])
    return ".".join((tag, *(w for w in words if w in others and w != "*"), "*"))


def _alike_by(p: Part) -> list[str]:
    """What an unmatched element shares with its like on the other side, as where the id is the page's own.

    Its tag for an article or ``main`` part, and every word of class, id or role that names the main part.
    """
    if p.furniture:
        return []
    tag, *words = p.key.split(".")
    return [f"{tag}.{w}" for w in words if w != "*" and _parts(w) & MAIN] + [tag] * (tag in ("article", "main"))


def aligned(a: Part, b: Part, same_pages: bool = False) -> Part:
    """Align two expressions of one element.

    A text that differs becomes a slot, so do the differing names of a container, parts that only one
    side has become optional, and what then stands next to its like becomes repeated.
    Two instances from the ``same_pages`` do not add up in the number of pages.
    """
    out = Part(_common(a.key, b.key), a.furniture and b.furniture)
    out.maybe, out.many = a.maybe or b.maybe, a.many or b.many
    out.pages, out.chars, out.link = max(a.pages, b.pages) if same_pages else a.pages + b.pages, a.chars + b.chars, a.link + b.link
    out.text = a.text if a.text == b.text else None
    kids: list[Part] = []
    i = j = 0

    def alone(parts: list[Part]) -> None:
        for p in parts:
            p.maybe = True
            kids.append(p)

    def between(left: list[Part], right: list[Part]) -> None:
        at, places = 0, {}
        for k, q in enumerate(right):
            for name in _alike_by(q):
                places.setdefault(name, []).append(k)
        for p in left:
            later = [found[i] for found in (places.get(name, []) for name in _alike_by(p)) if (i := bisect_left(found, at)) < len(found)]
            k = min(later, default=None)
            if k is None:
                alone([p])
            else:
                alone(right[at:k])
                kids.append(aligned(p, right[k], same_pages))
                at = k + 1
        alone(right[at:])

    for x, y in [*_matches(a.kids, b.kids), (len(a.kids), len(b.kids))]:
        between(a.kids[i:x], b.kids[j:y])
        if x < len(a.kids):
            kids.append(aligned(a.kids[x], b.kids[y], same_pages))
        i, j = x + 1, y + 1
    out.kids = folded(kids)
    return out


def pruned(root: Part) -> Part:
    """Keep a wrapper within WRAPPER_NODES by leaving out nodes of optional parts, those of fewest pages first.

    Parts that are not optional stay, however many, and so do articles and ``main`` parts with what holds
    them.  The characters of a node that is left out go to its parent, so every container keeps its share.
    """
    total, loose = 0, []

    def count(p: Part, depth: int, optional: bool) -> bool:
        nonlocal total
        total += 1
        keep = p.key.partition(".")[0] in ("article", "main")
        for k in p.kids:
            keep |= count(k, depth + 1, optional or k.maybe)
        if optional and not keep:
            loose.append((p.pages, -depth, len(loose), p))
        return keep

    count(root, 0, False)
    gone = {id(p) for *_, p in sorted(loose, key=lambda v: v[:3])[: max(0, total - WRAPPER_NODES)]}

    def without(p: Part) -> None:
        left = []
        for k in p.kids:
            without(k)
            if id(k) not in gone:
                left.append(k)
            elif not k.furniture:
                p.chars, p.link, p.text = p.chars + k.chars, p.link + k.link, None
                left += k.kids
        p.kids = left

    if gone:
        without(root)
    return root


def _mass(p: Part) -> int:
    """Characters of text slots below a part; furniture, links and texts known to be constant are not counted."""
    own = 0 if p.text is not None and p.pages >= CONSTANT_PAGES else max(0, p.chars - p.link)
    return 0 if p.furniture else own + sum(map(_mass, p.kids))


def constants(root: Part) -> list[list[str]]:
    """``[tag above, key, text]`` of every element whose text the host's pages repeat; none if all they hold is constant."""
    out: list[list[str]] = []

    def look(p: Part, above: str) -> None:
        if p.furniture:
            return
        if p.text and p.pages >= CONSTANT_PAGES and 2 * p.pages >= root.pages:
            out.append([above, p.key, p.text])
        for k in p.kids:
            look(k, p.key.partition(".")[0])

    if _mass(root) > 0:
        look(root, "")
    return out


def _ranked(p: Part, whole: int) -> int | None:
    """How surely a part is the container of main text, 0 first; None if nothing says so."""
    tag, _, words = p.key.partition(".")
    named = _names(p.key)
    return 0 if tag == "article" else 1 if tag == "main" or "role=main" in words or "articlebody" in named else 2 if named & MAIN and _mass(p) * 5 >= 2 * whole else None


def _steps(kids: list[Part]) -> Iterator[tuple[Part, str | list]]:
    """Parts with their step of a path: a key, or a key with open words and the keys beside it that it leaves out."""
    for k in kids:
        if not k.furniture:
            tag = k.key.partition(".")[0]
            yield k, [k.key, sorted({o.key for o in kids if o.key.partition(".")[0] == tag and not o.key.endswith(".*")})] if k.key.endswith(".*") else k.key


def rules(root: Part) -> list[list]:
    """Where the main text of a host lies: paths of steps to all its containers, best first, then the walk.

    An ``article`` comes first, then ``main``, then parts whose class, id or role says so and that hold
    two fifths of the text; of equals the one with the most slot text.  The last path serves pages without
    any of them: it goes down from the top as long as one child holds two thirds of the text.
    """
    found: list[tuple[int, int, list]] = []
    whole = _mass(root)

    def look(p: Part, path: list) -> None:
        rank = _ranked(p, whole)
        if rank is not None and (mass := _mass(p)) > 0:
            found.append((rank, -mass, path))
        for k, step in _steps(p.kids):
            look(k, [*path, step])

    look(root, [])
    ways = [path for _, _, path in sorted(found, key=lambda f: f[:2])]
    p, path = root, []
    while True:
        big, step = max(_steps(p.kids), key=lambda k: _mass(k[0]), default=(None, ""))
        if big is None or _mass(big) * 3 < 2 * _mass(p) or _mass(big) == 0 or big.tag_is_text():
            break
        p, path = big, [*path, step]
    return [*ways, path]


def _tag_is_text(self: Part) -> bool:
    return self.key.partition(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "pre", "blockquote")


Part.tag_is_text = _tag_is_text


def _fits(node: Node, step: str | list) -> bool:
    if isinstance(step, str):
        return node.key == step
    tag, *words = step[0].split(".")
    return node.tag == tag and node.key not in step[1] and set(words[:-1]) <= set(node.key.split(".")[1:])


def _at(nodes: list[Node], path: list) -> list[Node]:
    for step in path:
        nodes = [k for n in nodes for k in n.kids if not k.furniture and _fits(k, step)]
    return nodes


def main_text(root: Node, ways: list[list], constant: Set[tuple[str, str, str]] = frozenset()) -> str:
    """Blocks of the first container that the page has and that holds text, in page order.

    The host's containers are asked first, then the page's own, then the host's walk and the page's own;
    a walk leaves out page headers.  An article or ``main`` part is taken whole, whatever other pages say, so a page
    gives the same article alone or among others.  Elsewhere ``constant`` texts of the host are left out, unless
    nothing else is there.
    """
    own: list[list] | None = None
    for walk in (False, True):
        for of_host in (True, False):
            if not of_host and own is None:
                own = rules(of_page(root))
            paths = ways if of_host else own
            for path in paths[-1:] if walk else paths[:-1]:
                blocks: list[str] = []
                for n in _at([root], path):
                    _blocks(n, blocks, not walk, frozenset() if _is_main(n) else constant)
                if not blocks and constant:
                    for n in _at([root], path):
                        _blocks(n, blocks, not walk, frozenset())
                if blocks:
                    return "\n".join(blocks)
    return ""


def _blocks(node: Node, out: list[str], inside: bool, constant: Set[tuple[str, str, str]], above: str = "") -> None:
    runs, at = node.runs, 0
    if _is_main(node):
        constant = frozenset()
    if constant and runs and (above, node.key, _mark(_said(node))) in constant:
        runs = []
    inside = inside or node.tag in ("article", "main", "section")
    for i, kid in enumerate([*node.kids, None]):
        while at < len(runs) and runs[at][0] <= i:
            if line := " ".join("".join(runs[at][1]).split()):
                out.append(line)
            at += 1
        if kid is None or kid.furniture or not inside and (kid.tag == "header" or HEADERS & {p for w in kid.words for p in re.split(r"[^a-z0-9]+", w)}):
            continue
        _blocks(kid, out, inside, constant, node.tag)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _merge(parts: Iterator[str]) -> Part:
    root: Part | None = None
    for packed in parts:
        p = Part.unpack(json.loads(packed))
        root = p if root is None else pruned(aligned(root, p))
    return root


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, wrapper, rules)``: one union-free expression per host, from all its pages.

    Each task aligns the pages of a host that it reads, one after the other, and passes on one partial
    wrapper per host; partial wrappers are aligned in two steps, salted first, so a host with a third of
    all pages sends a few rows to a task, never its pages.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Part] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(p.pack())) for h, p in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                h, page = host.as_py(), of_page(parse(html.as_py()))
                held[h] = pruned(aligned(held[h], page)) if h in held else page
                if len(held) > OPEN_HOSTS:
                    yield out()
        yield out()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, packed = [], []
        for batch in batches:
            for host, parts in zip(batch.column(0), batch.column(1), strict=True):
                hosts.append(host.as_py())
                packed.append(json.dumps(_merge(sorted(p.as_py() for p in parts)).pack()))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(packed, pa.string())], ["host", "wrapper"])
            hosts, packed = [], []

    source = pages.select(host_of(url).alias("host"), text_of(html).alias("html"))
    partial = in_small_batches(source).mapInArrow(fold, "host string, wrapper string")
    salted = partial.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(16)).alias("salt")).agg(F.collect_list("wrapper").alias("w")).select("host", "w").mapInArrow(join, "host string, wrapper string")
    merged = salted.groupBy("host").agg(F.collect_list("wrapper").alias("w")).mapInArrow(join, "host string, wrapper string")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [Part.unpack(json.loads(w.as_py())) for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.expression() for p in parts], pa.string()), pa.array([json.dumps([rules(p), constants(p)]) for p in parts], pa.string())], ["host", "wrapper", "rules"])

    return merged.mapInArrow(decide, "host string, wrapper string, rules string")


def extract_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``text``, the main text of every page, to ``pages``; a clashing column is replaced.

    The wrappers of the hosts say where the main text lies and which texts their pages repeat.  Null html and pages without main text give
    an empty text; null urls form a host of their own; very long and very deep pages are read in proportion; repeated rows are extracted one by one; an empty
    table gives no rows.  The rules of all hosts are broadcast while they measure under ``RULES_BYTES``;
    beyond it pages meet them in a shuffle salted ``SALTS`` ways.
    """
    known = cut(infer_wrappers(pages, url, html).select(F.col("host").alias("_host"), F.col("rules").alias("_rules")))
    size = known.agg(F.sum(F.length("_rules") + F.length("_host") + 64)).first()[0] or 0
    kept = [c for c in pages.columns if c != "text"]
    hosted = pages.select(*kept).withColumn("_h", host_of(url))
    if size <= RULES_BYTES:
        joined = hosted.join(F.broadcast(known), F.col("_h") == F.col("_host"), "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(html)), F.lit(SALTS))
        spread = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        joined = hosted.withColumn("_salt", salt).join(spread, (F.col("_h") == F.col("_host")) & (F.col("_salt") == F.col("_s")), "left")
    joined = joined.select(*kept, text_of(html).alias("_page"), "_rules")
    schema = pages.select(*kept).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[list], Set[tuple[str, str, str]]]] = {}
        for batch in batches:
            texts = []
            for page, packed in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                key = packed.as_py() or "[[[]], []]"
                if key not in known:
                    if len(known) > OPEN_HOSTS:
                        known.clear()
                    ways, constant = json.loads(key)
                    known[key] = ways, frozenset(map(tuple, constant))
                root = parse(page.as_py())
                texts.append(main_text(root, *known[key]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(texts, pa.string())], [*kept, "text"])

    return in_small_batches(joined).mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
SQL: dict[str, str] = {}
