"""A forgiving HTML reader that gives block nodes, their features and their text in page order."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
GONE = frozenset("head script style noscript template svg math iframe object canvas audio video button select textarea title datalist map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot html body".split())
#: An element of the key is ended by the start of one of the values.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
TAGS = ("p", "h", "li", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "body", "inline")
KIND = {"p": 0, **{f"h{i}": 1 for i in range(1, 7)}, "li": 2, "dt": 2, "dd": 2, "ul": 3, "ol": 3, "dl": 3, "menu": 3, "div": 4, "center": 4, "section": 5, "article": 6, "main": 7, "nav": 8, "header": 9, "hgroup": 9, "footer": 10, "aside": 11, "form": 12, "fieldset": 12, "table": 13, "tbody": 13, "thead": 13, "tr": 13, "td": 13, "th": 13, "blockquote": 14, "pre": 14, "figure": 15, "figcaption": 15, "body": 16, "html": 16}
GROUPS = {
    "nav": "nav menu breadcrumb pager pagination toc skip toolbar topbar navigation tabs",
    "head": "header masthead logo site branding",
    "foot": "footer copyright legal colophon",
    "side": "sidebar aside widget rail complementary",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner promoted",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe paywall dialog",
    "form": "form login signup search register contact",
    "comment": "comment comments reply replies respond disqus discussion reviews responses",
    "related": "related recommended trending popular more latest also",
    "share": "share social sharing follow facebook twitter",
    "meta": "meta byline author date tags tag category timestamp",
    "text": "article content main post entry body story text prose",
}
GROUP = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
STEMS = tuple(sorted(((w, i) for w, i in GROUP.items() if len(w) >= 5), key=lambda x: -len(x[0])))
_seen: dict[str, frozenset] = {}


def groups_of(attrs: str) -> frozenset:
    """The groups that an element's names (class, id, role and so on) belong to."""
    if attrs not in _seen:
        if len(_seen) > 50_000:
            _seen.clear()
        out = set()
        for m in NAMES.finditer(attrs):
            for part in PART.findall(m[1]):
                w = part.lower()
                g = GROUP.get(w)
                if g is None:
                    g = next((i for s, i in STEMS if w.startswith(s)), None)
                if g is not None:
                    out.add(g)
        _seen[attrs] = frozenset(out)
    return _seen[attrs]


@dataclass
class Tree:
    """Nodes in page order, a parent before its children; pieces: (node, text, whether a space comes before it)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    groups: list[frozenset] = field(default_factory=list)
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of link text right in a node
    links: list[int] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)  # elements right in a node

    def add(self, tag: str, parent: int, groups: frozenset) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.groups.append(groups)
        for x in (self.linked, self.links, self.tags):
            x.append(0)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    t = Tree()
    stack: list[tuple[str, int, bool]] = [("", t.add("html", -1, frozenset()), False)]  # tag, node, dropped
    open_at: dict[str, list[int]] = {}  # where elements of a name stand in the stack
    gap, link, at = True, 0, 0

    def text(raw: str) -> None:
        nonlocal gap
        if not raw:
            return
        _, node, dropped = stack[-1]
        if dropped:
            return
        s = html.unescape(raw) if "&" in raw else raw
        parts = s.split()
        if not parts:
            gap = True
            return
        t.pieces.append((node, " ".join(parts), gap or s[0].isspace()))
        gap = s[-1].isspace()
        if link:
            t.linked[node] += len(s)

    def pop_to(i: int) -> None:
        nonlocal gap, link
        for tag, _, _ in stack[i:]:
            gap |= tag in BLOCK
            link -= tag == "a"
            open_at[tag].pop()
        del stack[i:]

    def innermost(names: set[str] | frozenset) -> int:
        return max((x[-1] for n in names if (x := open_at.get(n))), default=0)

    def close(names: set[str], limits: set[str] | frozenset = frozenset()) -> None:
        i = innermost(names)
        if i and i > innermost(limits):
            pop_to(i)

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if tag == "br":
                gap = True
            elif tag == "p" and not open_at.get("p"):
                gap = True
            else:
                close({tag})
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in BLOCK and tag != "html" and stack[-1][2] and (x := open_at.get("head")):
            pop_to(x[0])
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button"})
        for name, by in ENDED.items():
            if tag in by:
                close({name}, LIMITS.get(name, frozenset()))
        _, node, dropped = stack[-1]
        t.tags[node] += 1
        block = tag in BLOCK
        gap |= block or tag == "br"
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            gap |= tag == "title"
            continue
        groups = groups_of(attrs) if attrs.strip() else frozenset()
        gone = dropped or tag in GONE
        if tag == "a":
            close({"a"}, {"td", "th"})
            _, node, dropped = stack[-1]
            link += 1
            t.links[node] += 1
        if not gone and (block and tag != "html" or groups):
            node = t.add(tag if block else "inline", node, groups)
        if not attrs.rstrip().endswith("/") or tag in BLOCK or tag == "a":
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, gone))
    text(page[at:])
    return t


FEATURES = (
    *[f"tag_{t}" for t in TAGS], *[f"own_{g}" for g in GROUPS], *[f"above_{g}" for g in GROUPS], *[f"in_{t}" for t in ("article", "main", "nav", "header", "footer", "aside", "form")],
    "depth", "chars", "own_chars", "link_share", "links", "density", "tags", "stops", "siblings", "place", "alike", "page_share", "parent_share", "before", "p_below", "neighbours",
)
INSIDE = {6: 0, 7: 1, 8: 2, 9: 3, 10: 4, 11: 5, 12: 6}


def features(t: Tree) -> list[list[float]]:
    """One row for each node: its tag and names, those above it, depth, subtree density and siblings."""
    n = len(t.tag)
    kind = [KIND.get(x, 17) for x in t.tag]
    chars, own, stops, before = [0] * n, [0] * n, [0] * n, [0] * n
    total, seen = 0, set()
    for node, s, _ in t.pieces:
        if node not in seen:
            seen.add(node)
            before[node] = total
        own[node] += len(s)
        stops[node] += s.count(". ") + s.count(", ") + s.endswith((".", "!", "?"))
        total += len(s)
    for i in range(n):
        chars[i] = own[i]
    linked, links, tags, paragraphs = t.linked[:], t.links[:], t.tags[:], [1 if k == 0 else 0 for k in kind]
    first = [before[i] if i in seen else -1 for i in range(n)]
    children: list[int] = [0] * n
    place = [0] * n
    alike: dict[tuple[int, int], int] = {}
    for i in range(1, n):
        p = t.parent[i]
        place[i] = children[p]
        children[p] += 1
        alike[p, kind[i]] = alike.get((p, kind[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        for x in (chars, stops, linked, links, tags, paragraphs):
            x[p] += x[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    depth = [0] * n
    above: list[frozenset] = [frozenset()] * n
    inside: list[frozenset] = [frozenset()] * n
    last: dict[int, int] = {}
    rows = []
    log = math.log1p
    for i in range(n):
        p = t.parent[i]
        row = [0.0] * len(FEATURES)
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = above[p] | t.groups[p] if t.groups[p] else above[p]
            inside[i] = inside[p] | {INSIDE[kind[p]]} if kind[p] in INSIDE else inside[p]
        row[kind[i]] = 1.0
        b = len(TAGS)
        for g in t.groups[i]:
            row[b + g] = 1.0
        b += len(GROUPS)
        for g in above[i]:
            row[b + g] = 1.0
        b += len(GROUPS)
        for g in inside[i]:
            row[b + g] = 1.0
        b += 7
        c = chars[i]
        prev = last.get(p, -1)
        row[b:] = [
            min(depth[i], 40), log(c), log(own[i]), linked[i] / (c + 1), log(links[i]), log(c / (tags[i] + 1)), log(tags[i]), log(stops[i]), log(children[p] if p >= 0 else 1),
            place[i] / children[p] if p >= 0 else 0.0, log(alike.get((p, kind[i]), 1)), c / (total + 1), c / (chars[p] + 1) if p >= 0 else 1.0, max(first[i], 0) / (total + 1), log(paragraphs[i]), log(chars[prev]) if prev >= 0 else 0.0,
        ]
        last[p] = i
        rows.append(row)
    return rows


def kept(t: Tree, log_in: list[float], log_out: list[float]) -> list[bool]:
    """The likeliest choice of nodes in which nothing under a dropped node is kept: best(node) is all of its subtree dropped, or itself kept and the best of each child."""
    n = len(t.tag)
    out, best, keep = log_out[:], log_in[:], [False] * n
    for i in range(n - 1, -1, -1):
        keep[i] = best[i] > out[i]
        p = t.parent[i]
        if p >= 0:
            best[p] += max(best[i], out[i])
            out[p] += out[i]
    for i in range(1, n):
        keep[i] = keep[i] and keep[t.parent[i]]
    return keep


def text_of(t: Tree, keep: list[bool]) -> str:
    out: list[str] = []
    gap = False
    for node, s, space in t.pieces:
        gap |= space
        if keep[node]:
            if out and gap:
                out.append(" ")
            out.append(s)
            gap = False
        else:
            gap = True
    return "".join(out)
