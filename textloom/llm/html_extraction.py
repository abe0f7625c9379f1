"""HTML extraction by wrappers: union-free regular expressions inferred from the token streams of a host's pages.

A page's token stream, with markup inside text taken as text, is read as nested elements. Two streams of a host are
aligned element by element: text that differs becomes a slot, elements that one side lacks become optional, and
elements that come again, or in another order, become repeated groups. Every page of a host takes part: each task
folds its own pages into one wrapper for each host, and these partial wrappers are folded in turn, in two levels, so
that a host with a third of all pages is never one long row of merges.

The wrapper decides what is text of an article. Slots that vary between the host's pages and hold running text are
content; text that is the same on all pages, and groups that are mostly links, are template. The article stands in the
host's <article> or <main> where these hold the better part of the content, else in the lowest element that holds all
of it. Names of classes only break ties: a small varying part beside or inside the article goes if its name says that
it is an advert, a comment and so on; a part with that name that holds the better part of the content stays. Every page
is then matched against its host's wrapper, and the text of the places that are content is its main text.

No step recurses, and scanning, aligning and matching take time in proportion to the page (times a logarithm).
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, batch, hold

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>=]")
GAP = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
WALLS = frozenset("html body table ul ol dl article section main aside div nav header footer form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text themselves; a name alone says little about them.
LEAVES = frozenset("p li td th dd dt blockquote pre figcaption caption".split())
#: Elements that are no part of an article by their meaning in HTML; a <header> inside an article is.
APART = frozenset("nav footer aside button dialog menu".split())
#: Words of class, id or role. The first kind names parts that go wherever they are small, the second kind containers.
PLAIN_NAMES = frozenset("ad ads adv advert advertisement advertising adsbygoogle breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr nav navbar navigation newsletter paywall promo promoted promotion sidebar sidenav sponsor sponsored subnav topnav".split())
NAMES = frozenset("banner complementary contentinfo alert header hidden login masthead menu modal notice notices overlay pager pagination popup related search share sharing signup skip social subscribe subscription toolbar tooltip widget widgets".split())
COMMENTS = frozenset("comment commentform commentlist comments disqus replies reply respond".split())
HEADERS = frozenset("header masthead banner".split())
ALL_NAMES = PLAIN_NAMES | NAMES | COMMENTS
#: From so many different pages on, text that is the same on all of them is template.
PAGES = 3
#: Siblings of one tag with more labels than this are told apart by their tag alone.
LABELS = 64


class Element:
    __slots__ = ("children", "label", "tag", "texts")

    def __init__(self, tag: str, words: tuple[str, ...] = ()):
        self.tag, self.children, self.texts = tag, [], 0  # texts: 1 outside of links, 2 inside, 3 both
        self.label = ".".join((tag, *words))


def _words(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and itemprop, sorted; numbers left out; `!` for hidden parts."""
    if not attributes or attributes.isspace():
        return ()
    out: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden":
            if name == "hidden" or "true" in value:
                out.add("!")
        elif name == "itemprop":
            out.update(value.strip("\"'").lower().replace(".", " ").split())
        else:
            out.update(w.lower() for w in PART.findall(value) if not w.isdigit())
    return tuple(sorted(out))


def _tag(label: str) -> str:
    return label.partition(".")[0]


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag, comments and declarations with the name "".

    A quote counts behind = only, as in browsers. Where the page ends inside a tag, tags end at the next > from there on.
    """
    at, n = 0, len(page)
    last, last_quote, loose = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}, False
    find = page.find
    while (lt := find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            end = n if end < 0 else end + 3
            yield lt, end, "", False, ""
            at = end
            continue
        if lt >= last:
            return
        if page[lt + 1] in "!?":
            at = find(">", lt) + 1
            yield lt, at, "", False, ""
            continue
        closing = page[lt + 1] == "/"
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            at = lt + 1
            continue
        i = name.end()
        while not loose:
            stop = STOP.search(page, i)
            if not stop:
                loose = True
            elif page[stop.start()] == ">":
                i = stop.start()
                break
            else:
                i = GAP.match(page, stop.end()).end()
                q = page[i : i + 1]
                if q in last_quote and i < last_quote[q]:
                    i = find(q, i + 1) + 1
        if loose:
            i = find(">", name.end())
            if i < 0:
                return
        yield lt, i + 1, name[0].lower(), closing, page[name.end() : i]
        at = i + 1


_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


def parse(page: str) -> Element:
    """The page as nested elements; unclosed, stray and crossed tags are put right the way browsers do, in the main.

    A block whose text is all in links is an element of its own kind: its label ends in `.~`.
    """
    root = Element("")
    stack, walls, order = [root], [0], []
    places: dict[str, list[int]] = {}  # of each tag, where it is open in the stack

    def cut(i: int) -> None:
        for e in stack[i:]:
            places[e.tag].pop()
        del stack[i:]
        while walls[-1] >= i:
            walls.pop()

    def text(a: int, b: int) -> None:
        s = page[a:b]
        stack[-1].children.append(s)
        if not s.isspace():
            stack[-1].texts |= 2 if places.get("a") else 1

    at = skip = 0
    for start, end, tag, closing, attributes in tags(page):
        if start < skip:
            continue
        if start > at:
            text(at, start)
        at = end
        if not tag:
            continue
        if closing:
            if (open_at := places.get(tag)) and (tag in WALLS or open_at[-1] > walls[-1]):
                cut(open_at[-1])
            continue
        if tag in CLOSES_P or tag in SAME:
            for t in (*SAME.get(tag, ()), *(("p",) if tag in CLOSES_P else ())):
                while (open_at := places.get(t)) and open_at[-1] > walls[-1]:
                    cut(open_at[-1])
        e = Element(tag, _words(attributes))
        order.append((e, stack[-1]))
        stack[-1].children.append(e)
        if attributes.endswith("/"):
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            at = skip = found.end() if found else len(page)
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in WALLS:
                walls.append(len(stack))
            stack.append(e)
    if at < len(page):
        text(at, len(page))
    for e, parent in reversed(order):
        parent.texts |= e.texts
        if e.texts == 2 and e.tag not in INLINE and e.tag not in HEADINGS:
            e.label += ".~"
    return root


class Node:
    """A part of a wrapper: an element, or with a label that begins with # the text behind an element (or at the front).

    opt: not on all pages. rep: repeated. join: in one repeated group with the sibling before. text, links: code points
    of the text on all pages, and of that in links. fixed: a hash of the text where all pages agree, else 0. seen: up to
    PAGES hashes of pages with this text.
    """

    __slots__ = ("fixed", "join", "kids", "label", "links", "opt", "rep", "seen", "text")

    def __init__(self, label: str):
        self.label, self.opt, self.rep, self.join, self.text, self.links, self.fixed, self.seen, self.kids = label, 0, 0, 0, 0, 0, 0, (), []


def _mix(a: int, b: int) -> int:
    return (a * 0x100000001B3 + b) % ((1 << 61) - 1) or 1


def _dissolves(e: Element) -> bool:
    """Whether an element is markup inside text."""
    return e.tag in INLINE and ("." not in e.label or ("!" not in e.label and ALL_NAMES.isdisjoint(e.label.split(".")[1:])))


def shape(root: Element) -> Node:
    """The wrapper of one page."""
    top = Node(root.label)
    order, texts, whole = [top], [], 1
    stack = [(iter(root.children), top, False)]
    while stack:
        it, at, link = stack[-1]
        for c in it:
            if isinstance(c, str):
                s = " ".join(c.split())
                if not s:
                    continue
                kids = at.kids
                if not kids or kids[-1].label[:1] != "#":
                    t = Node("#" + (kids[-1].label if kids else ""))
                    texts.append(t)
                    kids.append(t)
                t = kids[-1]
                h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) >> 3
                t.text, t.links, t.fixed, whole = t.text + len(s), t.links + len(s) * link, _mix(t.fixed, h), _mix(whole, h)
            elif c.tag in RAW or c.tag == "head":
                continue
            elif _dissolves(c):
                stack.append((iter(c.children), at, link or c.tag == "a"))
                break
            else:
                k = Node(c.label)
                at.kids.append(k)
                order.append(k)
                stack.append((iter(c.children), k, link or c.tag == "a"))
                break
        else:
            stack.pop()
    for t in texts:
        t.seen = (whole,)
    for k in reversed(order):
        todo: list[tuple[Node, Node]] = []
        k.kids = fold(k.kids, todo)
        _merge(todo, same_page=True)
    return top


def fold(kids: list[Node], todo: list[tuple[Node, Node]]) -> list[Node]:
    """Siblings of which no two have one label. From the first to the last place of a label that comes again, all is one
    repeated group; its members of the same label are to be merged (`todo`)."""
    if len(kids) > LABELS:
        many = {t for t, n in Counter(_tag(x) for x in {k.label for k in kids}).items() if n > LABELS}
        for k in kids:
            if _tag(k.label) in many:
                k.label = _tag(k.label) + ".*"
    last = {k.label: i for i, k in enumerate(kids)}
    if len(last) == len(kids):
        return kids
    out: list[Node] = []
    i, n = 0, len(kids)
    while i < n:
        group: dict[str, Node] = {}
        reach, a = last[kids[i].label], i
        while i <= reach:
            k = kids[i]
            reach = max(reach, last[k.label])
            i += 1
            if i < n and kids[i].join:
                reach = max(reach, i)
            if k.label in group:
                todo.append((group[k.label], k))
                group[k.label].rep = 1
            else:
                group[k.label] = k
        for j, k in enumerate(group.values()):
            if len(group) > 1:
                k.opt, k.join = 1, int(j > 0)
            elif i - a > 1:
                k.join = 0
            out.append(k)
    return out


def merge_into(a: Node, b: Node) -> None:
    """Align the wrapper b with a, and keep the result in a."""
    _merge([(a, b)], same_page=False)


def _merge(todo: list[tuple[Node, Node]], same_page: bool) -> None:
    while todo:
        a, b = todo.pop()
        a.opt, a.rep = a.opt | b.opt, a.rep | b.rep
        if a.label[:1] == "#":
            a.text, a.links = a.text + b.text, a.links + b.links
            a.fixed = _mix(a.fixed, b.fixed) if same_page and a.fixed and b.fixed else a.fixed if a.fixed == b.fixed else 0
            if a.seen != b.seen:
                a.seen = tuple(sorted({*a.seen, *b.seen})[:PAGES])
        else:
            a.kids = align(a.kids, b.kids, todo)


def align(xs: list[Node], ys: list[Node], todo: list[tuple[Node, Node]]) -> list[Node]:
    """One sequence that covers both. Of the labels on both sides, the longest run in the order of both is matched; what
    else there is becomes optional, and labels that stand in another order become a repeated group."""
    if [x.label for x in xs] == [y.label for y in ys]:
        for x, y in zip(xs, ys, strict=True):
            x.join |= y.join
            todo.append((x, y))
        return xs
    place = {y.label: j for j, y in enumerate(ys)}
    both = [(i, place[x.label]) for i, x in enumerate(xs) if x.label in place]
    ends: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for q, (_, j) in enumerate(both):
        k = bisect_left(ends, j)
        before.append(tops[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j)
            tops.append(q)
        else:
            ends[k], tops[k] = j, q
    run: list[tuple[int, int]] = []
    q = tops[-1] if tops else -1
    while q >= 0:
        run.append(both[q])
        q = before[q]
    out: list[Node] = []
    at_x, at_y = [0] * len(xs), [0] * len(ys)  # where in `out` each of them is
    i = j = 0
    for a, b in [*reversed(run), (len(xs), len(ys))]:
        for side, at, first, end in ((xs, at_x, i, a), (ys, at_y, j, b)):
            for q in range(first, end):
                side[q].opt = 1
                at[q] = len(out)
                out.append(side[q])
        if a < len(xs):
            todo.append((xs[a], ys[b]))
            at_x[a] = at_y[b] = len(out)
            out.append(xs[a])
        i, j = a + 1, b + 1
    # what stands inside a repeated group of either side is in that group
    steps = [0] * (len(out) + 1)
    for side, at in ((xs, at_x), (ys, at_y)):
        for q in range(1, len(side)):
            if side[q].join:
                steps[at[q - 1] + 1] += 1
                steps[at[q] + 1] -= 1
    depth = 0
    for q, k in enumerate(out):
        depth += steps[q]
        k.join = int(depth > 0)
    return fold(out, todo)


def expression(w: Node) -> str:
    """The wrapper as a union-free regular expression: #text for slots, (...)? for optional, (...)+ for repeated parts."""
    out: list[str] = []
    stack: list[Node | str] = [w]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
            continue
        if k.label[:1] == "#":
            body: list[Node | str] = [f"#{k.fixed:x}" if k.fixed else "#text"]
        else:
            body = [f"<{k.label}>"] if k.label else []
            for i, x in enumerate(k.kids):
                joined = i + 1 < len(k.kids) and k.kids[i + 1].join
                body += ["("] if joined and not x.join else []
                body.append(x)
                body += [")+"] if x.join and not joined else []
            body += [f"</{_tag(k.label)}>"] if k.label else []
        if k.opt or k.rep:
            body = ["(", *body, ")" + ("*" if k.opt and k.rep else "?" if k.opt else "+")]
        stack.extend(reversed(body))
    return "".join(out)


def dump(w: Node) -> str:
    """The wrapper as text, for another task to go on with."""
    out, stack = [], [w]
    while stack:
        k = stack.pop()
        out.append([k.label, k.opt + 2 * k.rep + 4 * k.join, k.text, k.links, k.fixed, k.seen, len(k.kids)])
        stack.extend(reversed(k.kids))
    return json.dumps(out, separators=(",", ":"))


def load(s: str) -> Node:
    top = Node("")
    stack = [(top, 1)]
    for label, flags, text, links, fixed, seen, n in json.loads(s):
        k = Node(label)
        k.opt, k.rep, k.join, k.text, k.links, k.fixed, k.seen = flags & 1, flags >> 1 & 1, flags >> 2, text, links, fixed, tuple(seen)
        parent, left = stack.pop()
        parent.kids.append(k)
        if left > 1:
            stack.append((parent, left - 1))
        if n:
            stack.append((k, n))
    return top.kids[0]


class _Judge:
    """What of a host's wrapper is content. `parts` are the nodes in page order, children behind their parents."""

    def __init__(self, top: Node, constants: bool = True):
        self.parts, self.up, self.kids = [], [], []
        stack = [(top, -1)]
        while stack:
            k, up = stack.pop()
            me = len(self.parts)
            self.parts.append(k)
            self.up.append(up)
            self.kids.append([])
            if up >= 0:
                self.kids[up].append(me)
            stack.extend((x, me) for x in reversed(k.kids))
        n = len(self.parts)
        self.tag = [_tag(k.label) for k in self.parts]
        self.names = [frozenset(k.label.split(".")[1:]) if k.label[:1] != "#" else frozenset() for k in self.parts]
        self.inside = [""] * n  # the nearest <article> or <main> around it
        heading = [False] * n
        self.text, self.links, self.running, self.title = [0] * n, [0] * n, [0] * n, [0] * n
        self.constant = [False] * n
        for i in range(1, n):
            u = self.up[i]
            self.inside[i] = self.tag[u] if self.tag[u] in ("article", "main") else self.inside[u]
            heading[i] = heading[u] or self.tag[i] in HEADINGS
        for i in range(n - 1, -1, -1):
            k = self.parts[i]
            if self.tag[i][:1] == "#":
                title = self.tag[self.up[i]] == "h1" and bool(self.inside[i])
                self.constant[i] = constants and bool(k.fixed) and len(k.seen) >= PAGES and not title
                self.text[i], self.links[i] = k.text, k.links
                self.running[i] = 0 if self.constant[i] else k.text if heading[i] else k.text - k.links
                self.title[i] = self.running[i] if heading[i] and self.tag[self.up[i]] in ("h1", "h2") else 0
            if (u := self.up[i]) >= 0:
                for mass in (self.text, self.links, self.running, self.title):
                    mass[u] += mass[i]
        self.named = [self._named(i) for i in range(n)]
        self.apart = [self._apart(i) for i in range(n)]

    def _apart(self, i: int) -> bool:
        return self.tag[i] in APART or "!" in self.names[i] or (self.tag[i] == "header" and not self.inside[i])

    def _named(self, i: int) -> bool:
        names, tag = self.names[i], self.tag[i]
        if tag == "form":
            return True
        if not names or tag in HEADINGS or names.isdisjoint(ALL_NAMES):
            return False
        if not names.isdisjoint(COMMENTS) or not names.isdisjoint(PLAIN_NAMES):
            return True
        if tag in LEAVES:  # one of NAMES among other words says little
            return len(names) == 1 or 2 * self.links[i] > self.text[i]
        return not (names.isdisjoint(NAMES - HEADERS) and self.title[i] and 2 * self.links[i] <= self.text[i])

    def free(self, top: int) -> tuple[list[int], dict[int, int]]:
        """Running text below `top` that is in no part set apart or named: by node; and that of the named parts."""
        out, named = [0] * len(self.parts), {}
        order, stack = [], [top]
        while stack:
            i = stack.pop()
            if i != top and self.apart[i]:
                continue
            if i != top and self.named[i]:
                if self.names[i].isdisjoint(COMMENTS):
                    named[i] = self.running[i]
                continue
            order.append(i)
            stack.extend(self.kids[i])
        for i in reversed(order):
            out[i] = self.running[i] if self.tag[i][:1] == "#" else sum(out[x] for x in self.kids[i])
        return out, named

    def rescue(self, top: int) -> list[int]:
        """A named part that holds more running text than all that isn't named is content, whatever its name."""
        while True:
            mass, named = self.free(top)
            best = max(named, key=lambda i: (named[i], -i), default=None)
            if best is None or named[best] <= mass[top]:
                return mass
            self.named[best] = False

    def places(self) -> list[int]:
        """Where the article stands."""
        mass, _ = self.free(0)
        for tag in ("article", "main"):
            found, stack = [], [0]
            while stack:
                i = stack.pop()
                if i and (self.apart[i] or self.named[i]):
                    continue
                if self.tag[i] == tag and self.running[i] > 0:
                    found.append(i)
                else:
                    stack.extend(self.kids[i])
            if found and 2 * sum(self.running[i] for i in found) >= mass[0]:
                for i in found:
                    self.rescue(i)
                return found
        mass = self.rescue(0)
        at = 0
        while True:
            inside = [i for i in self.kids[at] if mass[i] > 0]
            if len(inside) != 1 or self.tag[inside[0]][:1] == "#":
                return [at]
            at = inside[0]

    def plan(self) -> list | None:
        """A tree of decisions, [label, keep, number of kids] in page order: keep is 1 for parts that are kept, 0 for
        those that aren't; kids are the parts below that differ from it. None if no text is content."""
        places = set(self.places())
        keep = [0] * len(self.parts)
        some = False
        for i in range(len(self.parts)):
            u = self.up[i]
            if i in places:
                keep[i] = 1
            elif u >= 0 and keep[u]:
                keep[i] = int(self._kept(i))
            some = some or bool(keep[i] and self.tag[i][:1] == "#")
        if not some:
            return None
        mixed = [False] * len(self.parts)
        for i in range(len(self.parts) - 1, 0, -1):
            u = self.up[i]
            if keep[i] != keep[u] or mixed[i]:
                mixed[u] = True
        out, stack = [], [0]
        while stack:
            i = stack.pop()
            kids = [x for x in self.kids[i] if keep[x] != keep[i] or mixed[x]]
            out.append([self.parts[i].label, keep[i], len(kids)])
            stack.extend(reversed(kids))
        return out

    def _kept(self, i: int) -> bool:
        if self.tag[i][:1] == "#":
            return not self.constant[i]
        if self.apart[i] or self.named[i]:
            return False
        linked = 2 * self.links[i] > self.text[i] and self.tag[i] not in HEADINGS and self.text[i] > 0
        return not (linked and not self.inside[i] and not self.title[i])


def decisions(w: Node) -> list:
    """The plan of a host's wrapper; where nothing varies, also text that is the same on all pages is content, and where
    all text is in named or linked parts, all that is in no part set apart."""
    return _Judge(w).plan() or _Judge(w, constants=False).plan() or [[w.label, 1, 0]]


class Plan:
    """A plan as nested dictionaries: keep, and {label: Plan} for the kids that differ."""

    __slots__ = ("keep", "kids")

    def __init__(self, keep: int):
        self.keep, self.kids = keep, {}

    @staticmethod
    def of(flat: list) -> Plan:
        top = None
        stack: list[list] = []
        for label, keep, n in flat:
            p = Plan(keep)
            if stack:
                stack[-1][0].kids[label] = p
                stack[-1][1] -= 1
            else:
                top = p
            if n:
                stack.append([p, n])
            while stack and not stack[-1][1]:
                stack.pop()
        return top

    def below(self, label: str) -> Plan:
        if not self.kids:
            return self
        found = self.kids.get(label) or self.kids.get(_tag(label) + ".*")
        return found or (KEEP if self.keep else DROP)


KEEP, DROP = Plan(1), Plan(0)


def blocks(root: Element, plan: Plan) -> list[str]:
    """Texts of the blocks of a page in page order, of the places that its plan keeps."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        s = " ".join("".join(now).split())
        now.clear()
        if s:
            out.append(s)

    # a frame of a block: its children, its plan, the label of its last block child; inline elements share the frame
    stack = [(iter(root.children), [plan, ""], False)]
    while stack:
        it, frame, is_block = stack[-1]
        here = frame[0]
        for c in it:
            if isinstance(c, str):
                if (here.below("#" + frame[1]) if here.kids else here).keep:
                    now.append(html_lib.unescape(c))
            elif c.tag in RAW or c.tag == "head":
                continue
            elif _dissolves(c):
                if c.tag == "br":
                    now.append(" ")
                elif c.children:
                    stack.append((iter(c.children), frame, False))
                    break
            else:
                frame[1] = c.label
                inner = here.below(c.label)
                if c.tag not in INLINE:
                    flush()
                if inner is DROP or not (inner.keep or inner.kids):
                    continue
                stack.append((iter(c.children), [inner, ""], c.tag not in INLINE))
                break
        else:
            if is_block:
                flush()
            stack.pop()
    flush()
    return out


def extract(page: str | None, plan: Plan | None = None) -> str:
    """Main text of a page by its host's plan; a page that has nothing there goes by its own wrapper; null is empty."""
    if not page:
        return ""
    root = parse(page)
    found = blocks(root, plan) if plan else []
    if not found:
        found = blocks(root, Plan.of(decisions(shape(root))))
    return "\n".join(found)


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), "://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", ways: int = 64) -> DataFrame:
    """(host, n_pages, wrapper, plan): a row for each host, from all its pages; pages without html take no part.

    wrapper is the expression, plan the decisions as JSON. The partial wrappers of a host are merged in `ways` groups,
    then into one.
    """

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            b = batch(host=pa.array(list(have), pa.string()), n=pa.array([v[0] for v in have.values()], pa.int64()), wrapper=pa.array([dump(v[1]) for v in have.values()], pa.string()))
            have.clear()
            return b

        for b in it:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if page:
                    w = shape(parse(page))
                    if host in have:
                        merge_into(have[host][1], w)
                        have[host][0] += 1
                    else:
                        have[host] = [1, w]
            if len(have) > 1000:
                yield out()
        yield out()

    def again(rows) -> object:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            host, n, w = None, 0, None
            done: list[tuple[str, int, Node]] = []
            for b in it:
                for h, k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if h == host:
                        merge_into(w, load(s))
                        n += k
                    else:
                        if host is not None:
                            done.append((host, n, w))
                        host, n, w = h, k, load(s)
                if len(done) > 1000:
                    yield rows(done)
                    done = []
            if host is not None:
                done.append((host, n, w))
            yield rows(done)

        return run

    def partial(done: list[tuple[str, int, Node]]) -> pa.RecordBatch:
        return batch(host=pa.array([h for h, _, _ in done], pa.string()), n=pa.array([n for _, n, _ in done], pa.int64()), wrapper=pa.array([dump(w) for _, _, w in done], pa.string()))

    def final(done: list[tuple[str, int, Node]]) -> pa.RecordBatch:
        plans = [json.dumps(decisions(w), separators=(",", ":")) for _, _, w in done]
        return batch(host=pa.array([h for h, _, _ in done], pa.string()), n_pages=pa.array([n for _, n, _ in done], pa.int64()), wrapper=pa.array([expression(w) for _, _, w in done], pa.string()), plan=pa.array(plans, pa.string()))

    some = "host string, n long, wrapper string"
    parts = arrow_pass(pages.select(_host(url_col).alias("host"), html_col), first, some).withColumn("way", F.pmod(F.spark_partition_id(), F.lit(ways)))
    parts = parts.repartition("host", "way").sortWithinPartitions("host", "way", "n", "wrapper").select("host", "n", "wrapper")
    met = arrow_pass(parts, again(partial), some).repartition("host").sortWithinPartitions("host", "n", "wrapper")
    return arrow_pass(met, again(final), "host string, n_pages long, wrapper string, plan string")


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = 16 << 20) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages: the main text, blocks joined by one line feed.

    Null and empty html give an empty text. A null url, or one without a host, belongs to the host "". Repeated rows
    stay, and count once where texts of different pages are compared; other columns are left aside. An empty table
    gives an empty result. The hosts' plans are broadcast if they have `most_broadcast` bytes at most, and joined by
    host otherwise.
    """
    found = hold(wrappers(pages, url_col, html_col)).select("host", "plan")
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("plan") + 64)).first()[0] or 0
    id_type = pages.schema[id_col].dataType.simpleString()
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    joined = p.join(F.broadcast(found) if size <= most_broadcast else found, "host", "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Plan | None] = {None: None}

        def of(s: str | None) -> Plan | None:
            if s not in known:
                if len(known) > 2000:
                    known.clear()
                    known[None] = None
                known[s] = Plan.of(json.loads(s))
            return known[s]

        for b in it:
            texts = [extract(h, of(s)) for h, s in zip(b.column("html").to_pylist(), b.column("plan").to_pylist(), strict=True)]
            yield batch(**{id_col: b.column("id")}, url=b.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()))

    return arrow_pass(joined.select("id", "url", "html", "plan"), run, f"`{id_col}` {id_type}, url string, text string, n_chars long")
