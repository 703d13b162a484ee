"""HTML extraction by wrapper induction.

Pages of one host share a template, which is made of all of them. A text may be template if all
pages of a host that have its place (the labels from the root down) have it there, `SUPPORT` different contents at least;
this is counted over all pages, and hosts without such a text need no wrapper. (So a line that some articles share is none,
though a skeleton has room for it beside their other lines.) Of every page of the other hosts there remains its tree with
these texts, their places and what is above them, less what is no content wherever it stands. A host's skeleton is
one such tree with the nodes that all others add, by simple tree matching: the largest order- and
ancestor-preserving mapping of nodes with equal labels, of these one with most equal texts; very long lists of
children are aligned whole, by longest common subsequences of labels and texts, then of labels. Pages are dealt to slots
of a host by their hashes; each slot makes a skeleton of its trees in the order of hashes, and those of the slots are
merged the same way. Then every tree of the host is aligned with the skeleton. A node whose text is the same on all pages
it was matched on, with `SUPPORT` different contents at least, is template; the rest are slots. Pages of one content (the
text by page roles alone) count once, so copies of an article under other menus are no template.
A page is aligned with its host's wrapper and loses template text; of the slots, those with a page role (navigation, header, footer, aside,
form, advert, notice, comments ...) are not content, and an article or main element, if any, bounds what is.
Hosts without template text need no alignment, so only wrappers with some travel to their pages. Tags may nest to any depth.

Defined results: null or empty html gives the empty text; a null url is a host of its own; markup that
never closes ends with the page; repeated rows are pages of their own; a table without rows gives none.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlsift.llm.common import BROADCAST_BYTES, chunks, column, lean, pieces, schema_with, stored, table, without

SUPPORT = 3
#: Pages of a host that make one slot of it, and the most slots (beyond these, slots have more pages).
SLOT_PAGES, SLOTS = 512, 256
#: What a node counts in a matching; equal texts count 1.
NODE = 1 << 24
#: Lists of children of more pairs than this are aligned by their longest common subsequences, without comparing what is below.
CELLS = 40_000
#: Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template svg textarea title xmp noembed noframes object canvas audio video select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
#: What a start tag ends if it is open above the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
DROPPED = frozenset("head nav footer aside form button dialog menu script style".split()) | RAW
ROLES = re.compile(r'\brole\s*=\s*["\']?(?:navigation|banner|contentinfo|complementary|search|alert|alertdialog|dialog|form)\b', re.I)
HIDDEN = re.compile(r'(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["\']?true|display\s*:\s*none', re.I)
NAMED = re.compile(r'\b(?:class|id)\s*=\s*(?:"([^"]*)"|\'([^\']*)\'|([^\s>]+))', re.I)
#: Words of class names and ids that name a part of a page that is no content, and words that such names are composed with.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription"
    " sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist replies reply respond disqus related recommended share sharing social widget widgets login signup search pagination pager tags".split()
)
WITH_PARTS = frozenset("site page main global top bottom left right primary secondary list lists box bar block wrap wrapper container inner outer area section posts links buttons icons item items form slot unit".split())
#: Names that are no content within an article either, if they are all that an element is called.
IN_ARTICLES = PARTS - frozenset("header footer side search notice banner tags respond reply login".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z][^>]*(?:>|\Z)|<!?(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)


class Node:
    __slots__ = ("_key", "_kids", "attrs", "items", "label", "tag")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.items, self._key, self._kids = tag, attrs, [], None, None
        names = " ".join(a or b or c for a, b, c in NAMED.findall(attrs)) if attrs else ""
        self.label = f"{tag} {names}" if names else tag

    def children(self) -> list["Node"]:
        if self._kids is None or len(self.items) != self._kids[0]:
            self._kids = len(self.items), [x for x in self.items if isinstance(x, Node)]
        return self._kids[1]

    def own(self) -> str:
        return " ".join(" ".join(x for x in self.items if isinstance(x, str)).split())

    def key(self) -> int:
        """A hash of the node's own text; 0 without text."""
        if self._key is None:
            own = self.own()
            self._key = xxhash.xxh3_64_intdigest(own) or 1 if own else 0
        return self._key


def parse(page: str) -> Node:
    root = Node("html", "")
    stack, at, end, deepest = [root], 0, len(page), 0
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            stack[-1].items.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m.group(2) is None or m[0].startswith("<!"):
            if m[0].startswith("<![CDATA["):
                stack[-1].items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body" and not any(n.tag == "body" for n in stack):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "head":
                        del stack[k:]
                        break
            else:
                continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "button", "object"):
                    break
        if tag in ENDS:
            ends, stops = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stops:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        node = Node(tag, m.group(3) or "")
        stack[-1].items.append(node)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else (end if tag in ("script", "style", "title", "textarea") else at)
        elif tag not in VOID and not (m.group(3) or "").endswith("/"):
            stack.append(node)
            deepest = max(deepest, len(stack))
    # walks take some frames a level; frames of Python functions lie on the heap
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000 + 4 * deepest))
    return root


def _common(xs: list, ys: list) -> list[tuple[int, int]]:
    """The positions of a longest common subsequence: bit-parallel, with every sqrt(n)-th row kept."""
    lo, end_x, end_y = 0, len(xs), len(ys)
    while lo < end_x and lo < end_y and xs[lo] == ys[lo]:
        lo += 1
    while end_x > lo and end_y > lo and xs[end_x - 1] == ys[end_y - 1]:
        end_x, end_y = end_x - 1, end_y - 1
    tail = [(end_x + k, end_y + k) for k in range(len(xs) - end_x)]
    n, m = end_x - lo, end_y - lo
    full = (1 << m) - 1
    at: dict = {}
    for j, y in enumerate(ys[lo:end_y]):
        at.setdefault(y, []).append(j)
    masks = {}
    for y, found in at.items():
        row = bytearray(m // 8 + 1)
        for j in found:
            row[j >> 3] |= 1 << (j & 7)
        masks[y] = int.from_bytes(row, "little")

    def below(v: int, x) -> int:
        u = v & masks.get(x, 0)
        return ((v + u) | (v - u)) & full

    every, v = max(1, int(n**0.5)), full
    kept = []
    for i in range(n):
        if i % every == 0:
            kept.append(v)
        v = below(v, xs[lo + i])
    pairs, i, j = [], n, m
    while i and j and kept:
        first = (len(kept) - 1) * every
        rows = [kept.pop()]
        for k in range(first, i):
            rows.append(below(rows[-1], xs[lo + k]))
        # a zero bit j of row i: the longest subsequence grows from j to j + 1
        rows = [r.to_bytes(m // 8 + 1, "little") for r in rows]
        while i > first and j:
            if rows[i - first][(j - 1) >> 3] >> ((j - 1) & 7) & 1:
                j -= 1
            elif not rows[i - 1 - first][(j - 1) >> 3] >> ((j - 1) & 7) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((lo + i, lo + j))
    return [(k, k) for k in range(lo)] + pairs[::-1] + tail


def _long(xs: list, ys: list) -> list[tuple[int, int]]:
    """An alignment of two long lists of children: first those of equal label and text, then between them those of equal label."""
    with_text = [k for k, x in enumerate(xs) if x[1]], [k for k, y in enumerate(ys) if y.key()]
    fixed = [(with_text[0][i], with_text[1][j]) for i, j in _common([(xs[k][0], xs[k][1]) for k in with_text[0]], [(ys[k].label, ys[k].key()) for k in with_text[1]])]
    out, i, j = [], 0, 0
    for x, y in [*fixed, (len(xs), len(ys))]:
        if i < x and j < y:
            out += [(i + a, j + b) for a, b in _common([c[0] for c in xs[i:x]], [c.label for c in ys[j:y]])]
        out.append((x, y))
        i, j = x + 1, y + 1
    return out[:-1]


def matching(a: list, b: Node) -> list[tuple[list, Node]]:
    """The pairs of a largest simple tree matching of a skeleton and a page; of these, one with most equal texts."""

    def match(x, y) -> tuple[int, list]:
        if x[0] != y.label:
            return 0, []
        xs, ys = x[2], y.children()
        own = NODE + (x[1] != 0 and x[1] == y.key())
        if not xs or not ys:
            return own, [(x, y)]
        if len(xs) * len(ys) > CELLS:
            pairs = [(x, y)]
            for i, j in _long(xs, ys):
                got = match(xs[i], ys[j])
                own += got[0]
                pairs += got[1]
            return own, pairs
        size = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        each = {}
        others = [(y.label, y.key(), not y.children()) for y in ys]
        for i, (lx, kx, cx) in enumerate(xs):
            row, before, best = size[i + 1], size[i], 0
            for j, (ly, ky, leaf) in enumerate(others):
                if before[j + 1] > best:
                    best = before[j + 1]
                if lx == ly:
                    if leaf or not cx:  # most nodes have nothing below
                        each[i, j] = got = (NODE + 1 if kx and kx == ky else NODE, None)
                    else:
                        each[i, j] = got = match(xs[i], ys[j])
                    if before[j] + got[0] > best:
                        best = before[j] + got[0]
                row[j + 1] = best
        pairs, i, j = [(x, y)], len(xs), len(ys)
        while i and j:
            if (got := each.get((i - 1, j - 1))) and size[i][j] == size[i - 1][j - 1] + got[0]:
                pairs += got[1] or [(xs[i - 1], ys[j - 1])]
                i, j = i - 1, j - 1
            elif size[i][j] == size[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return own + size[-1][-1], pairs

    return match(a, b)[1]


class Tree:
    """A node of a tree that is not parsed from a page, as `matching` takes it."""

    __slots__ = ("below", "label", "text")

    def __init__(self, label: str, text: int):
        self.label, self.text, self.below = label, text, []

    def children(self) -> list["Tree"]:
        return self.below

    def key(self) -> int:
        return self.text


def bare(n: Node | Tree) -> list:
    """A node of a skeleton: label, hash of the text, children."""
    return [n.label, n.key(), [bare(c) for c in n.children()]]


def grown(out: list | None, tree: Tree) -> list:
    """The skeleton `out` with the nodes that another tree adds."""
    if out is None:
        return bare(tree)
    pairs = matching(out, tree)
    partner = {id(y): x for x, y in pairs}
    for x, y in pairs:
        at = 0
        for c in y.children():
            if (mate := partner.get(id(c))) is None:
                x[2].insert(at, bare(c))
            else:
                while x[2][at] is not mate:
                    at += 1
            at += 1
    return out


def skeleton(trees) -> list:
    """The first of some trees with the nodes that the others add."""
    out = None
    for tree in trees:
        out = grown(out, tree)
    return out


def _nodes(tree: list):
    """The nodes of a skeleton in preorder."""
    left = [tree]
    while left:
        yield (n := left.pop())
        left += reversed(n[2])


def packed(tree: list) -> str:
    """A skeleton as JSON: its nodes in preorder, each with its number of children."""
    return json.dumps([[n[0], n[1], len(n[2])] for n in _nodes(tree)])


def unpacked(text: str) -> list:
    top: list = []
    open_nodes = [(top, 1)]
    for label, key, many in json.loads(text):
        while not open_nodes[-1][1]:
            open_nodes.pop()
        kids, more = open_nodes[-1]
        open_nodes[-1] = kids, more - 1
        kids.append(node := [label, key, []])
        open_nodes.append((node[2], many))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000 + 4 * len(open_nodes)))
    return top[0]


def outline(root: Node) -> str:
    """A page's tree, as `packed` gives one, without what is no content wherever it stands."""
    out, left = [], [root]
    while left:
        n = left.pop()
        apart = n.tag in DROPPED or n.attrs and _apart(n, True) and _apart(n, False)
        kids = [] if apart else n.children()
        out.append([n.label, 0 if apart else n.key(), len(kids)])
        left += reversed(kids)
    return json.dumps(out)


def places(nodes: list):
    """Of the nodes of a packed tree, the hashes of the place above (0 at the root), of the place (labels from the root down), and of place and text, 0 without text."""
    above = [[0, 1]]
    for label, key, many in nodes:
        while not above[-1][1]:
            above.pop()
        above[-1][1] -= 1
        over = above[-1][0]
        place = xxhash.xxh3_64_intdigest(label, seed=over)
        above.append([place, many])
        yield over, place, xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"), seed=place) if key else 0


def reduced(nodes: list, held: set[int]) -> str:
    """A packed tree less the places that are not in `held`, and the texts that are not in their places."""
    out: list = []
    above = [[None, 1]]
    for (label, key, many), (_, place, there) in zip(nodes, places(nodes)):
        while not above[-1][1]:
            above.pop()
        above[-1][1] -= 1
        node = None
        if place in held:  # so is what it lies below
            node = [label, key if there in held else 0, 0]
            out.append(node)
            if above[-1][0]:
                above[-1][0][2] += 1
        above.append([node, many])
    return json.dumps(out)


def grounded(text: str) -> Tree | None:
    """A packed tree; None without nodes."""
    top: list[Tree] = []
    above, deepest = [[top, 1]], 0
    for label, key, many in json.loads(text):
        while not above[-1][1]:
            above.pop()
        above[-1][1] -= 1
        above[-1][0].append(node := Tree(label, key))
        above.append([node.below, many])
        deepest = max(deepest, len(above))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000 + 4 * deepest))
    return top[0] if top else None


class Held:
    """Of each place, and of each text in a place: what it is in, whether it is a text, the number of pages that have it, `SUPPORT` contents at most (more decide nothing)."""

    def __init__(self):
        self.rows: dict[int, list] = {}

    def add(self, nodes: list, content: int):
        here: dict[int, tuple[int, bool]] = {}
        for over, place, there in places(nodes):
            here[place] = over, False
            if there:
                here[there] = place, True
        for k, (over, is_text) in here.items():
            row = self.rows.get(k)
            if row is None:
                row = self.rows[k] = [over, is_text, 0, set()]
            row[2] += 1
            if len(row[3]) < SUPPORT:
                row[3].add(content)


def along(texts: dict[int, int], parents: dict[int, int]) -> set[int]:
    """Texts (by the places they are in), their places, and the places above these."""
    out = set(texts)
    for p in texts.values():
        while p and p not in out:
            out.add(p)
            p = parents.get(p, 0)
    return out


class Counts:
    """Of one host's trees: the nodes of its skeleton that some tree contradicts, and contents that confirm the others."""

    def __init__(self, tree: list):
        self.tree = tree
        self.number = {id(w): k for k, w in enumerate(_nodes(tree)) if w[1]}
        self.bad: set[int] = set()
        self.contents: dict[int, set[int]] = {}

    def add(self, tree: Tree, contents):
        for w, n in matching(self.tree, tree):
            k = self.number.get(id(w))
            if k is None or k in self.bad:
                continue
            if n.key() != w[1]:
                self.bad.add(k)
                self.contents.pop(k, None)
            elif len(found := self.contents.setdefault(k, set())) < SUPPORT:  # more decide nothing
                found.update(contents)


def template(tree: list, good: set[int]) -> str | None:
    """The wrapper: the skeleton as JSON with the hashes of template texts only; None without any."""
    return json.dumps([[n[0], n[1] if k in good else 0, len(n[2])] for k, n in enumerate(_nodes(tree))]) if good else None


def content_of(root: Node) -> int:
    return xxhash.xxh3_64_intdigest(main_text(root, set())) - (1 << 63)


def induce(pages: list[str]) -> str | None:
    """The wrapper of same-host pages, all in memory and one slot."""
    held, trees = Held(), []
    for page in sorted(pages, key=xxhash.xxh3_64_intdigest):
        root = parse(page)
        trees.append((json.loads(outline(root)), content_of(root)))
        held.add(*trees[-1])
    enough = {k: row for k, row in held.rows.items() if len(row[3]) >= SUPPORT}
    parents = {k: row[0] for k, row in enough.items() if not row[1]}
    texts = {k: row[0] for k, row in enough.items() if row[1] and row[2] == enough[row[0]][2]}
    if not texts:
        return None
    use = along(texts, parents)
    small = [(grounded(reduced(nodes, use)), content) for nodes, content in trees]
    counts = Counts(skeleton(t for t, _ in small))
    for tree, content in small:
        counts.add(tree, [content])
    return template(counts.tree, {k for k, found in counts.contents.items() if len(found) >= SUPPORT})


def _is_part(name: str) -> bool:
    """Whether a class or id names a part of a page that is no content: as a whole, never by one word of several."""
    words = [w for w in re.split(r"[_-]+", name.lower()) if w]
    return any(w in PARTS for w in words) and all(w in PARTS or w in WITH_PARTS for w in words)


def _apart(n: Node, inside: bool) -> bool:
    """Whether a node's role keeps it out of the content. Within an article only elements of such a kind do, and names that say nothing else."""
    if n.tag in DROPPED or n.tag == "header" and not inside:
        return True
    if not n.attrs or n.tag in ("html", "body", "article", "main"):
        return False
    if ROLES.search(n.attrs) or HIDDEN.search(n.attrs):
        return True
    names = [a or b or c for a, b, c in NAMED.findall(n.attrs)]
    if inside:
        return any(x.strip().lower() in IN_ARTICLES for x in names)
    return any(_is_part(w) for x in names for w in x.split())


def _mains(n: Node, found: list[Node]) -> list[Node]:
    for c in n.children():
        if _apart(c, False):
            continue
        if c.tag in ("article", "main") or c.attrs and ("articleBody" in c.attrs or re.search(r'role\s*=\s*["\']?main\b', c.attrs)):
            found.append(c)
        else:
            _mains(c, found)
    return found


_OWN_PLACE = re.compile(r'\bhref\s*=\s*["\']?#', re.I)


def _linked(n: Node, inside: bool = False) -> tuple[int, int]:
    """Characters of text, and of these inside links to other pages."""
    inside = inside or n.tag == "a" and not _OWN_PLACE.search(n.attrs)
    total = link = 0
    for x in n.items:
        a, b = (len(x.strip()), len(x.strip()) if inside else 0) if isinstance(x, str) else _linked(x, inside)
        total, link = total + a, link + b
    return total, link


def main_text(root: Node, template: set[int]) -> str:
    """The text of a tree by page roles, less that of the nodes (by id) in `template`."""
    mains = _mains(root, [])
    for m in mains:
        if m.tag == "main" and (inner := _mains(m, [])):
            mains = [x for x in mains if x is not m] + inner
    blocks: list[list[str]] = [[]]

    def walk(n: Node, inside: bool):
        block = n.tag in BLOCK
        if block:
            blocks.append([])
        if n.tag == "br":
            blocks[-1].append(" ")
        for x in n.items:
            if isinstance(x, str):
                if id(n) not in template:
                    blocks[-1].append(x)
            elif not _apart(x, inside) and not (not inside and x.tag in ("ul", "ol", "table") and (k := _linked(x)) and 2 * k[1] > k[0]):
                walk(x, inside)
        if block:
            blocks.append([])

    for m in mains or [root]:
        walk(m, bool(mains))
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def extract(page: str | None, wrapper: list | str | None = None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    pairs = matching(unpacked(wrapper) if isinstance(wrapper, str) else wrapper, root) if wrapper else []
    return main_text(root, {id(n) for w, n in pairs if w[1] and w[1] == n.key()})


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _outlines(batches):
    """The trees of pages. Within a task, pages that are the same byte for byte give one."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        for part in chunks(batch, "html"):
            rows = []
            for host, page in zip(column(part, "host").to_pylist(), column(part, "html").to_pylist()):
                k = xxhash.xxh3_64_intdigest(page)
                if (host, k) in seen:
                    continue
                seen.add((host, k))
                root = parse(page)
                rows.append((host, k - (1 << 63), content_of(root), outline(root)))
            yield _batch(rows, host=pa.string(), hash=pa.int64(), content=pa.int64(), tree=pa.string())
        if len(seen) > 1 << 17:
            seen = set()


def _held(batches):
    """Of the trees of a task, by host: `Held`, a row for each content."""
    hosts: dict[str, Held] = {}
    kinds = {"host": pa.string(), "key": pa.int64(), "above": pa.int64(), "is_text": pa.bool_(), "n": pa.int64(), "content": pa.int64()}

    def out():
        for host, h in hosts.items():
            rows = ((k, row, i, c) for k, row in h.rows.items() for i, c in enumerate(row[3]))
            yield _batch([(host, k - (1 << 63), row[0] - (1 << 63), row[1], 0 if i else row[2], c) for k, row, i, c in rows], **kinds)

    for batch in batches:
        for host, content, tree in zip(*(column(batch, c).to_pylist() for c in ("host", "content", "tree"))):
            hosts.setdefault(host, Held()).add(json.loads(tree), content)
        if sum(len(h.rows) for h in hosts.values()) > 1 << 18:
            yield from out()
            hosts = {}
    yield from out()


def _slots(batches, *names: str):
    """The rows of each (host, slot), which come in order, one after another: `first` is whether a row begins one."""
    now = None
    for batch in batches:
        for host, slot, *row in zip(*(column(batch, c).to_pylist() for c in ("host", "slot", *names))):
            yield (host, slot) != now, host, slot, *row
            now = host, slot


_MERGED = {"host": pa.string(), "slot": pa.int32(), "whole": pa.bool_(), "tree": pa.string(), "contents": pa.list_(pa.int64())}


def _merge(batches):
    """Of each slot: its skeleton (`whole`), and its different trees with contents, `SUPPORT` at most. A slot's texts and places, with what they are in, come before its trees."""
    at, texts, parents, use, trees = None, {}, {}, None, {}

    def out():
        rows = [(*at, False, t, sorted(c)) for t, c in trees.items()]
        if rows:
            yield _batch([*rows, (*at, True, packed(skeleton(map(grounded, trees))), None)], **_MERGED)

    for first, host, slot, k, content, is_text, tree in _slots(batches, "hash", "content", "is_text", "tree"):
        if first:
            yield from out()
            at, texts, parents, use, trees = (host, slot), {}, {}, None, {}
        if tree is None:
            (texts if is_text else parents)[k + (1 << 63)] = content + (1 << 63)
            continue
        if use is None:
            use = along(texts, parents)
        if len(found := trees.setdefault(reduced(json.loads(tree), use), set())) < SUPPORT:
            found.add(content)
    yield from out()


def _skeleton(t: pa.Table) -> pa.Table:
    """The skeleton of a host: those of its slots, merged."""
    parts = [x for _, x in sorted(zip(t["slot"].to_pylist(), t["tree"].to_pylist()))]
    return pa.table({"host": [t["host"][0].as_py()], "skeleton": [parts[0] if len(parts) == 1 else packed(skeleton(map(grounded, parts)))]})


def _count(batches):
    """Of each slot, by node: whether a tree contradicts, and contents that confirm, `SUPPORT` at most. A slot's skeleton comes before its trees."""
    at, skeleton, trees = None, None, {}

    def out():
        if not trees:
            return
        counts = Counts(unpacked(skeleton))
        for tree, contents in trees.items():
            counts.add(grounded(tree), contents)
        yield _batch([(at, k, k in counts.bad, sorted(counts.contents.get(k, ()))[:SUPPORT]) for k in sorted(counts.bad | counts.contents.keys())], host=pa.string(), node=pa.int32(), bad=pa.bool_(), contents=pa.list_(pa.int64()))

    for first, host, _, whole, tree, contents in _slots(batches, "whole", "tree", "contents"):
        if first:
            yield from out()
            at, trees = host, {}
        if whole:
            skeleton = tree
        elif len(found := trees.setdefault(tree, set())) < SUPPORT:
            found.update(contents)
    yield from out()


def _finish(batches):
    for batch in batches:
        rows = [(h, template(unpacked(t), set(nodes))) for h, t, nodes in zip(*(column(batch, c).to_pylist() for c in ("host", "skeleton", "nodes")))]
        rows = [r for r in rows if r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["host", "wrapper"])


def _met(pages: DataFrame, found: DataFrame, text: str, how: str) -> DataFrame:
    """`pages` joined with what was found of their hosts, which travels if it is small."""
    small = (found.agg(F.sum(F.length(text) + F.length(found.columns[0]) + 64)).first()[0] or 0) <= BROADCAST_BYTES // 4  # characters of 4 bytes at most
    return pages.join(F.broadcast(found) if small else found, found.columns[0], how)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of the hosts whose pages share template text; `pages` has host and html."""
    pages = pages.filter("html <> ''").select("host", "html")
    trees = stored(pages.mapInArrow(lean(_outlines), "host string, hash long, content long, tree string"), "trees")
    kinds = "host string, key long, above long, is_text boolean, n long, content long"
    held = trees.mapInArrow(lean(_held), kinds).repartition("host", "key").groupBy("host", "key", "above", "is_text")
    held = held.agg(F.sum("n").alias("n"), F.count_distinct("content").alias("contents")).filter(F.col("contents") >= SUPPORT)
    held = stored(held.drop("contents"), "held")
    places = held.filter("not is_text")
    met = places.select("host", F.col("key").alias("above"), F.col("n").alias("pages"))
    texts = stored(held.filter("is_text").join(met, ["host", "above"]).filter("n = pages").select("host", "key", "above", "is_text"), "texts")
    slots = trees.join(texts.select("host").distinct(), "host", "left_semi").groupBy("host").agg(F.least(F.ceil(F.count_distinct("hash") / SLOT_PAGES), F.lit(SLOTS)).cast("int").alias("slots"))
    slots = stored(slots, "slots")
    heads = texts.unionByName(places.select(*texts.columns)).join(slots, "host")
    heads = heads.select("host", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("key").alias("hash"), F.col("above").alias("content"), "is_text", F.lit(None).cast("string").alias("tree"))
    dealt = trees.join(slots, "host").select("host", F.pmod("hash", "slots").cast("int").alias("slot"), "hash", "content", F.lit(None).cast("boolean").alias("is_text"), "tree")
    dealt = heads.unionByName(dealt)
    parts = pieces(trees, 1 << 20, 32)  # of few bytes, but much work each
    dealt = dealt.repartition(parts, "host", "slot").sortWithinPartitions("host", "slot", F.col("tree").isNotNull(), "hash")
    merged = stored(dealt.mapInArrow(lean(_merge), "host string, slot int, whole boolean, tree string, contents array<long>"), "merged")
    skeletons = stored(merged.filter("whole").groupBy("host").applyInArrow(_skeleton, "host string, skeleton string"), "skeletons")
    # now equal trees of a host come to one slot
    heads = skeletons.join(slots, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(True).alias("whole"), F.col("skeleton").alias("tree"), F.lit(None).cast("array<long>").alias("contents"))
    dealt = merged.filter("not whole").join(slots, "host").withColumn("slot", F.pmod(F.xxhash64("tree"), "slots").cast("int")).select(*merged.columns)
    dealt = heads.unionByName(dealt).repartition(parts, "host", "slot").sortWithinPartitions("host", "slot", F.col("whole").desc())
    counts = dealt.mapInArrow(lean(_count), "host string, node int, bad boolean, contents array<long>")
    nodes = counts.groupBy("host", "node").agg(F.max("bad").alias("bad"), F.array_distinct(F.flatten(F.collect_set("contents"))).alias("contents"))
    good = nodes.filter(~F.col("bad") & (F.size("contents") >= SUPPORT)).groupBy("host").agg(F.collect_list("node").alias("nodes"))
    return skeletons.join(good, "host").select("host", "skeleton", "nodes").mapInArrow(_finish, "host string, wrapper string")


def _extract(batches):
    wrappers: dict[str, list] = {}
    for batch in batches:
        for part in chunks(batch, "html"):
            text = []
            for page, w in zip(column(part, "html").to_pylist(), column(part, "__wrapper").to_pylist()):
                if w and w not in wrappers:
                    if len(wrappers) >= 256:
                        wrappers.clear()
                    wrappers[w] = unpacked(w)
                text.append(extract(page, wrappers[w] if w else None))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*part.schema.names, "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Every row of `pages` (url, html, ...) with text and n_chars; input columns of these names are replaced, others stay, whatever their names."""
    pages = without(pages, "text", "n_chars")
    outer, low = pages.columns, [c.lower() for c in pages.columns]
    plain = pages.toDF(*[c if c in ("url", "html") and low.index(c) == k else f"__{k}" for k, c in enumerate(low)])
    found = wrappers(plain.select(host_of("url").alias("host"), "html")).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    joined = _met(plain.withColumn("__host", host_of("url")), stored(found, "wrappers"), "__wrapper", "left")
    joined = joined.select(*plain.columns, "__wrapper")
    out = joined.mapInArrow(lean(_extract), schema_with(joined, text=T.StringType(), n_chars=T.LongType()))
    return out.drop("__wrapper").toDF(*outer, "text", "n_chars")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
