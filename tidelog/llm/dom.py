"""A small tolerant DOM: parsing, page furniture by role, and simple tree matching."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import xxhash

START = re.compile(r"<(?=[a-zA-Z!?/])")
ASCII_LETTER = re.compile(r"[a-zA-Z]")
#: Possessive, so that every page is read in time that grows with its length.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag of the key ends open elements of the first set, up to one of the second.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: An end tag doesn't reach past these.
WALLS = frozenset("table td th article main body html section aside nav header footer".split())

FURNITURE_TAGS = frozenset("nav header footer aside form button select dialog menu noscript svg canvas object audio video map datalist".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FURNITURE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended "
    "comment comments disqus reply replies widget login search pagination pager toolbar copyright disclaimer skip".split()
)
#: Of an article's surroundings only these make it furniture.
COMMENT_WORDS = frozenset("comment comments disqus reply replies related recommended sidebar sponsored advert".split())
CONTENT_TAGS = frozenset(("article", "main"))

#: Cells of a table by which two lists of children are matched; larger ones are halved, with the same result.
MOST_CELLS = 1 << 20


class Node:
    """An element, or a text (label #text) of one block."""

    __slots__ = ("label", "parent", "depth", "wall", "children", "words", "bag", "role", "hidden", "hash", "link_chars")

    def __init__(self, label: str, parent: Node | None):
        self.label, self.parent, self.depth = label, parent, parent.depth + 1 if parent else 0
        #: The depth of the wall that the node is in, or is.
        self.wall = self.depth if label in WALLS else parent.wall if parent else 0
        self.children: list[Node] = []
        self.words, self.bag, self.role, self.hidden, self.hash, self.link_chars = "", frozenset(), "", False, 0, 0


DEPTH = attrgetter("depth")


def _attributes(node: Node, raw: str) -> None:
    bag = []
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            bag.append(html.unescape(value))
        elif name == "role":
            node.role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            node.hidden = True
    if bag:
        node.bag = frozenset(w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(bag)).lower()) if w)


def parse(source: str) -> Node:
    """The root of a page's block elements and block texts; inline elements leave their text only.

    Open elements are found by their names, so the time grows with the page's
    length, however deep its elements are nested.
    """
    root = Node("#root", None)
    at = root
    opened: dict[str, list[Node]] = defaultdict(list)
    text: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                leaf = Node("#text", at)
                leaf.words, leaf.link_chars = words, linked
                leaf.hash = xxhash.xxh64_intdigest(words) >> 1
                at.children.append(leaf)
        text, linked = [], 0

    def close(to: Node) -> None:
        nonlocal at
        flush()
        while at is not to:
            opened[at.label].pop()
            at = at.parent
        opened[to.label].pop()
        at = to.parent

    p, n = 0, len(source)
    while p < n:
        start = START.search(source, p)
        end = start.start() if start else n
        if end > p:
            text.append(source[p:end])
            if in_link:
                linked += end - p
        if not start:
            break
        m = TAG.match(source, end)
        if not m:
            if source.startswith("<!--", end):
                stop, size = source.find("-->", end + 2), 3
            elif source[end + 1] in "!?" or source[end + 1] == "/" and not ASCII_LETTER.match(source, end + 2):
                stop, size = source.find(">", end), 1
            else:
                stop, size = -1, 0
            if stop < 0:
                break  # a tag, comment or declaration that doesn't end takes the rest
            p = stop + size
            continue
        p = m.end()
        ends, name, attributes = m[1], m[2].lower(), m[3]
        if name in RAW:
            if not ends:
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, p)
                p = n if not stop else (source.find(">", stop.start()) + 1 or n)
            continue
        if name in INLINE:
            if name == "a":
                in_link = not ends
            continue
        if name == "br":
            text.append(" ")
            continue
        if ends:
            same = opened[name]
            if same and (name in WALLS or same[-1].depth > at.wall):
                close(same[-1])
            elif name == "p":
                flush()
            continue
        if name in CLOSES_P and opened["p"] and opened["p"][-1].depth > at.wall:
            close(opened["p"][-1])
        if name in SIBLINGS:
            own, walls = SIBLINGS[name]
            wall = max((opened[w][-1].depth for w in walls if opened[w]), default=0)
            outermost = [x for o in own for x in opened[o][bisect_right(opened[o], wall, key=DEPTH) :][:1]]
            if outermost:
                close(min(outermost, key=DEPTH))
        flush()
        if name in VOID:
            continue
        node = Node(name, at)
        if attributes:
            _attributes(node, attributes)
        at.children.append(node)
        opened[name].append(node)
        at = node
    flush()
    return root


def is_furniture(node: Node) -> bool:
    return (
        node.hidden
        or node.label in FURNITURE_TAGS
        or node.role in FURNITURE_ROLES
        or bool(node.bag and node.label not in ("html", "body") and node.label not in CONTENT_TAGS and node.bag & FURNITURE_WORDS)
    )


def content_roots(root: Node) -> list[Node]:
    """The outermost article or main elements that aren't in furniture, in page order."""
    found: list[Node] = []
    stack = list(reversed(root.children))
    while stack:
        node = stack.pop()
        if node.label == "#text" or node.hidden or node.label in FURNITURE_TAGS or node.role in FURNITURE_ROLES:
            continue
        if node.bag and node.label not in ("html", "body") and node.bag & COMMENT_WORDS:
            continue
        if node.label in CONTENT_TAGS or node.role == "main":
            found.append(node)
        else:
            stack.extend(reversed(node.children))
    return found


def below(root: Node) -> list[Node]:
    """The nodes below a node."""
    out, stack = [], list(root.children)
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(node.children)
    return out


def main_texts(root: Node) -> list[Node]:
    """The block texts that may be the article's: below the content roots, or of the whole page, without furniture."""
    roots = content_roots(root)
    out: list[Node] = []
    stack = [c for r in reversed(roots or [root]) for c in reversed(r.children)]
    while stack:
        node = stack.pop()
        if node.label == "#text":
            if roots or 2 * node.link_chars <= len(node.words):
                out.append(node)
        elif not is_furniture(node):
            stack.extend(reversed(node.children))
    return out


def links(source: str) -> list[str]:
    """The addresses of a page's links: href of a start tags, references decoded, without empty ones; not in comments, scripts and the like."""
    out: list[str] = []
    p = 0
    while start := START.search(source, p):
        at = start.start()
        m = TAG.match(source, at)
        if not m:
            if source.startswith("<!--", at):
                stop, size = source.find("-->", at + 2), 3
            elif source[at + 1] in "!?" or source[at + 1] == "/" and not ASCII_LETTER.match(source, at + 2):
                stop, size = source.find(">", at), 1
            else:
                stop, size = -1, 0
            if stop < 0:
                break
            p = stop + size
            continue
        p, name = m.end(), m[2].lower()
        if name in RAW and not m[1]:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, p)
            if not stop:
                break
            p = stop.start()
        elif name == "a" and not m[1]:
            href = next((v for k, v in ATTRIBUTE.findall(m[3]) if k.lower() == "href"), "")
            if address := html.unescape(href.strip("\"'")).strip():
                out.append(address)
    return out


# ---- trees for matching: (labels, depths, hashes) in preorder; label of a text is #


def flat(root: Node) -> tuple[list[str], list[int], list[int], list[Node]]:
    labels, depths, hashes, nodes = [], [], [], []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        labels.append("#" if node.label == "#text" else node.label)
        depths.append(depth)
        hashes.append(node.hash)
        nodes.append(node)
        stack.extend((c, depth + 1) for c in reversed(node.children))
    return labels, depths, hashes, nodes


class Tree:
    """A tree in preorder with, for each node, its children and the number of the shape of what is below it."""

    __slots__ = ("labels", "hashes", "children", "shape")

    def __init__(self, labels: list[str], depths: list[int], hashes: list[int], shapes: Shapes):
        self.labels, self.hashes = labels, hashes
        self.children: list[list[int]] = [[] for _ in labels]
        path: list[int] = []
        for i, d in enumerate(depths):
            del path[d:]
            if path:
                self.children[path[-1]].append(i)
            path.append(i)
        self.shape = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            self.shape[i] = shapes.number(labels[i], tuple(self.shape[c] for c in self.children[i]))


class Shapes:
    """Numbers for shapes of trees, and the sizes of their matches."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.sizes: list[int] = []
        self.matched: dict[tuple[int, int], int] = {}

    def number(self, label: str, children: tuple[int, ...]) -> int:
        own = self.numbers.setdefault((label, children), len(self.parts))
        if own == len(self.parts):
            self.parts.append((label, children))
            self.sizes.append(1 + sum(self.sizes[c] for c in children))
        return own

    def known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        if self.parts[a][0] != self.parts[b][0]:
            return 0
        return self.matched.get((a, b))

    def match_size(self, a: int, b: int) -> int:
        """Simple tree matching of two shapes: the size of the largest top-down, order-keeping match."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if self.known(x, y) is not None:
                stack.pop()
                continue
            _, _, xs, ys = trimmed(self.parts[x][1], self.parts[y][1])
            missing = [(p, q) for p in dict.fromkeys(xs) for q in dict.fromkeys(ys) if self.known(p, q) is None]
            if missing:  # each is of a lower level
                stack += missing
            else:
                self.matched[x, y] = 1 + sum(self.known(self.parts[x][1][i], self.parts[y][1][j]) for i, j in self.pairs(self.parts[x][1], self.parts[y][1]))
        return self.known(a, b)

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The best order-keeping pairs of two lists of shapes; equal ones at both beginnings, or both ends, belong to a best match."""
        head, tail, left, right = trimmed(xs, ys)
        out = [(i, i) for i in range(head)] + [(len(xs) - 1 - k, len(ys) - 1 - k) for k in range(tail)]
        if left and right:
            columns = {y: k for k, y in enumerate(dict.fromkeys(right))}
            weights = {x: np.array([self.match_size(x, y) for y in columns], np.int64) for x in dict.fromkeys(left)}
            place = np.array([columns[y] for y in right])
            out += [(head + i, head + j) for i, j in best_pairs(list(left), weights, place)]
        return out


def trimmed(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
    """How many are equal at the beginnings and at the ends, and what is left of each."""
    n, m, head, tail = len(xs), len(ys), 0, 0
    while head < min(n, m) and xs[head] == ys[head]:
        head += 1
    while tail < min(n, m) - head and xs[n - 1 - tail] == ys[m - 1 - tail]:
        tail += 1
    return head, tail, xs[head : n - tail], ys[head : m - tail]


def best_row(last: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The next row of the table of best sums."""
    row = np.zeros_like(last)
    np.maximum.accumulate(np.maximum(last[:-1] + weight, last[1:]), out=row[1:])
    return row


def best_pairs(xs: list[int], weights: dict[int, np.ndarray], place: np.ndarray) -> Iterator[tuple[int, int]]:
    """Order-keeping pairs (i, j) with the greatest sum of weights[xs[i]][place[j]], by dynamic programming.

    The table is kept if it is small; else the first list is halved where the
    best sums of both halves meet, so memory grows with the lists and not with
    their product.
    """
    stack = [(0, len(xs), 0, len(place))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if i0 == i1 or j0 == j1:
            continue
        own = place[j0:j1]
        if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > MOST_CELLS:
            mid = (i0 + i1) // 2
            down, up = np.zeros(len(own) + 1, np.int64), np.zeros(len(own) + 1, np.int64)
            for i in range(i0, mid):
                down = best_row(down, weights[xs[i]][own])
            for i in range(i1 - 1, mid - 1, -1):
                up = best_row(up, weights[xs[i]][own[::-1]])
            j = j0 + int(np.argmax(down + up[::-1]))
            stack += [(i0, mid, j0, j), (mid, i1, j, j1)]
            continue
        rows = [np.zeros(len(own) + 1, np.int64)]
        for i in range(i0, i1):
            rows.append(best_row(rows[-1], weights[xs[i]][own]))
        i, j = i1 - i0, j1 - j0
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield i0 + i, j0 + j


#: Shapes that a matcher holds before it begins anew, which changes no result.
SHAPES_KEPT = 100_000


class Matcher:
    """Aligns trees with a reference tree, each given as labels, depths and hashes."""

    def __init__(self, *reference: list):
        self.reference = reference
        self._begin()

    def _begin(self) -> None:
        self.shapes = Shapes()
        self.tree = Tree(*self.reference, self.shapes)

    def align(self, labels: list[str], depths: list[int], hashes: list[int]) -> dict[int, int]:
        """text of the reference -> text of the tree that it is matched with."""
        if len(self.shapes.parts) + len(self.shapes.matched) > SHAPES_KEPT:
            self._begin()
        a, b = self.tree, Tree(labels, depths, hashes, self.shapes)
        out: dict[int, int] = {}
        stack = [(0, 0)] if a.labels and b.labels and a.labels[0] == b.labels[0] else []
        while stack:
            x, y = stack.pop()
            if a.labels[x] == "#":
                out[x] = y
                continue
            xs, ys = a.children[x], b.children[y]
            stack.extend((xs[i], ys[j]) for i, j in self.shapes.pairs(tuple(a.shape[c] for c in xs), tuple(b.shape[c] for c in ys)))
        return out


def skeleton(labels: list[str], depths: list[int], inside: list[bool]) -> int:
    """A hash of a page's layout: the set of its label paths outside the content roots."""
    seen: set[int] = set()
    path: list[int] = []
    for label, depth, main in zip(labels, depths, inside):
        del path[depth:]
        path.append(xxhash.xxh64_intdigest(label, path[-1] if path else 0))
        if not main:
            seen.add(path[-1])
    return xxhash.xxh64_intdigest(",".join(map(str, sorted(seen)))) >> 1
