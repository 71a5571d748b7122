"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts, held as a tree. Its regular expression
starts as the page itself; repeated runs of siblings become groups with ``+``,
and aligning it with the next page of the host turns what one of them lacks into
optional groups (``?``, ``*``) and texts that differ into slots. A wrapper is
small whatever the number of pages, and two wrappers align like two pages, so
each partition infers its own and they are merged in a tree.

The wrapper tells template from content: a text that all pages of a host repeat
at one place is no slot, and the article is looked for in the part of the wrapper
that holds most of the slots' text. Tags and names are hints inside that part;
they decide alone for hosts of fewer than TEMPLATE_PAGES pages only.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, batch

#: Items of one level of a wrapper; longer levels have one item a key, and all keys.
LEVEL = 48
#: Levels that a wrapper describes; what lies deeper is read, but isn't aligned.
DEPTH = 120
#: Open elements that a start tag looks through for those that it closes.
REACH = 1000
#: Wrappers go to the tasks by broadcast up to so many bytes, beyond that by a join.
SENT_BYTES = 32 << 20
#: Pages of a host that have to share a text before it counts as template.
TEMPLATE_PAGES = 3

# Fixed values of the HTML standard: elements without content, with raw content, blocks, and what closes an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = set("head script style template iframe svg canvas embed form button input select option textarea label title nav footer aside dialog menu xmp noembed noframes audio video".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Words of class, id and role that mark what isn't the article.
AROUND = set("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets pagination pager skip toolbar search searchbox contentinfo complementary".split())
# First parts of names that tell of something else than the element: has-sidebar, no-comments.
ABOUT = set("has have no not non with without".split())
# Words of AROUND that are subjects too (social-science, search-theory), and parts of names that tell that no subject is meant.
SUBJECTS = set("social search share notice alert promotion".split())
FURNITURE = set("area bar block box btn button buttons container content count danger field follow form global header icon icons info inner input item items label link links list main media message mobile network networks page panel post row section site success text this title top warning wrap wrapper".split())
HEADER = {"header", "pageheader", "siteheader", "topbar"}
MAIN = set("article content main post entry story articlebody postcontent entrycontent maincontent articlecontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.DOTALL)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Node:
    __slots__ = ("tag", "key", "around", "main", "children", "place")

    def __init__(self, tag: str, key: str = "", around: int = 0, main: int = 0, above: int = 0):
        self.tag, self.key, self.around, self.main, self.children = tag, key or tag, around, main, []
        #: Stands for the keys from the root to here, within a process.
        self.place = hash((above, self.key))


_known: dict[str, tuple[str, int, int]] = {}


def _beside(value: str) -> bool:
    """Whether a class, id or role marks what isn't the article: whole names go before parts of names."""
    whole = value.split()
    if any(v in AROUND for v in whole):
        return True
    if any(_SPLIT.sub("", v) in MAIN for v in whole):
        return False
    return any(_marks(parts) for v in whole if (parts := _SPLIT.split(v))[0] not in ABOUT)


def _marks(parts: list[str]) -> bool:
    """Whether the parts of one name mark what isn't the article; a subject alone doesn't, unless the rest names furniture or a number."""
    marks = [p for p in parts if p in AROUND]
    if len(marks) == 1 and marks[0] in SUBJECTS:
        return all(p in FURNITURE or p.isdigit() or p in ("", marks[0]) for p in parts)
    return bool(marks)


def _looks(tag: str, token: str) -> tuple[str, int, int]:
    """Key of a start tag in the stream, whether it is around the article (1 by its names, which may err, 2 surely), and how surely it is the article."""
    known = _known.get(token)
    if known is None:
        names, around, main = [], 2 * (tag in NO_TEXT), {"article": 3, "main": 2}.get(tag, 0)
        for a in _ATTRIBUTE.finditer(token[1 + len(tag) :]):
            name, value = (a[1] or a[5]).lower(), html.unescape(a[2] or a[3] or a[4] or "").lower()
            if name in ("class", "id", "role"):
                parts = [p for v in value.split() for p in (v, *_SPLIT.split(v))]
                names += [f"{name}={v}" for v in sorted(value.split())] if name != "id" else []
                if tag not in ("html", "body"):
                    around = around or int(_beside(value) and not (tag in ("article", "main") and "comment" not in value))
                    if any(p in HEADER for p in parts) and tag == "div":
                        names.append("header")
                    joined = {_SPLIT.sub("", v) for v in value.split()}
                    main = main or (2 if name == "role" and value in ("main", "article") else int(bool(joined & MAIN)))
            elif name == "itemprop" and value == "articlebody":
                main = 2
            elif name == "hidden" or (name, value) == ("aria-hidden", "true") or name == "style" and re.search(r"display\s*:\s*none", value):
                around = 2
        known = "~" * (around == 1) + re.sub(r"\d+", "0", ".".join([tag, *names])), around, 0 if around else main
        if len(_known) < 50_000:
            _known[token] = known
    return known


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended, anything parses."""
    root = Node("#root")
    stack = [root]
    open_: Counter = Counter()

    def close(i: int) -> None:
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or len(token) == 1:
            last = stack[-1].children
            if last and isinstance(last[-1], str):
                last[-1] += token
            else:
                last.append(token)
            continue
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("table", "article", "main") and tag not in ("body", "html", "article", "main", "section", "div", "table"):
                    break
            continue
        closed = CLOSED_BY.get(tag)
        if closed:
            for i in range(len(stack) - 1, max(0, len(stack) - REACH), -1):
                if stack[i].tag in closed:
                    close(i)
                elif stack[i].tag in SCOPE[tag]:
                    break
        elif tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1) if open_["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        node = Node(tag, *_looks(tag, token), stack[-1].place)
        stack[-1].children.append(node)
        if tag in RAW:
            over = _RAW_END[tag].search(page, at)
            at = over.start() if over else end
        if tag not in VOID and not token.endswith("/>"):
            stack.append(node)
            open_[tag] += 1
    return root


# A wrapper item is [key, quantifier, pages, items, text, chars, repeats]: of an element its items and the keys that one element has twice or more;
# keys of elements that are around by their names begin with "~"; of a text slot ("#") the text as by _same, null if it differs, and its characters over all pages.
# The root has one more: the smallest digests of the texts of up to TEMPLATE_PAGES pages that differ.


def _same(text: str) -> str:
    """Stands for a whole text: itself if short, or its start, length and 128-bit digest (longer than any short one)."""
    text = text.strip()
    return text if len(text) <= 64 else f"{text[:40]}...{len(text)}:{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def _page(page: str) -> list:
    """The wrapper of a single page."""
    root = parse(page)
    whole = hashlib.blake2b(_text([root], set()).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return [*_item(root), [whole]]


def _item(node: Node, level: int = 0) -> list:
    items = []
    for c in node.children if level < DEPTH else ():
        if isinstance(c, str):
            if not c.isspace():
                items.append(["#", "1", 1, [], _same(c), len(c), []])
        elif c.around < 2:
            items.append(_item(c, level + 1))
        else:
            items.append([c.key, "1", 1, [], None, 0, []])
    repeats = sorted(k for k, n in Counter(x[0] for x in items).items() if n > 1)
    return [node.key, "1", 1, _squares(items, repeats), None, 0, repeats]


def _merged(a: list, b: list, repeated: bool = False, within: bool = False) -> list:
    """What matches both items: as siblings (``repeated``), below such siblings (``within``: of one page), or of two pages."""
    order = "1?+*"
    optional = a[1] in "?*" or b[1] in "?*"
    many = repeated or a[1] in "+*" or b[1] in "+*"
    text = a[4] if a[4] == b[4] else None
    within = within or repeated
    repeats = sorted({*a[6], *b[6]})
    out = [a[0], order[optional + 2 * many], max(a[2], b[2]) if within else a[2] + b[2], aligned(a[3], b[3], within, repeats), text, a[5] + b[5], repeats]
    return [*out, sorted({*a[7], *b[7]})[:TEMPLATE_PAGES]] if len(a) > 7 else out


def _squares(items: list, repeats: list, within: bool = True) -> list:
    """Repeats of up to four siblings next to each other as one repeated item each; only of keys that repeat in one element."""
    for width in (1, 2, 3, 4):
        out, i = [], 0
        while i < len(items):
            run = items[i : i + width]
            keys = [x[0] for x in run]
            j = i + width
            while len(run) == width and "#" not in keys[:1] and all(k in repeats for k in keys) and [x[0] for x in items[j : j + width]] == keys:
                run = [_merged(x, y, True) for x, y in zip(run, items[j : j + width], strict=True)]
                j += width
            if j > i + width:
                out += run if width == 1 else [["(" + " ".join(keys) + ")", "+", 1, run, None, 0, []]]
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    if len(items) > LEVEL:
        # texts that no page lacks stay apart; items of a key that no element repeats are of different pages, so that these add up
        by: dict[tuple, list] = {}
        for x in (x for xs in _flat(items).values() for x in xs):
            key = x[0], x[4] if x[0] == "#" and x[1] == "1" else None
            by[key] = _merged(by[key], x, x[0] in repeats or x[0] == "#", within) if key in by else x
        items = [x if k[1] is not None else [x[0], "*" if x[0] in repeats else "?", *x[2:]] for k, x in by.items()]
    return items


def aligned(a: list, b: list, within: bool = False, repeats: list = ()) -> list:
    """Align two levels: what one lacks becomes optional, what both have is merged; mismatches between them stand side by side as optionals."""
    keys, others = [x[0] for x in a], [x[0] for x in b]
    if keys == others:
        return [_merged(x, y, False, within) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if keys[i] == others[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    optional = lambda x: [x[0], "?" if x[1] in "1?" else "*", *x[2:]]
    while i < n or j < m:
        if i < n and j < m and keys[i] == others[j]:
            out.append(_merged(a[i], b[j], False, within))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return _squares(out, repeats, within)


def regular_expression(item: list) -> str:
    """The wrapper as text: tags, ``#`` for slots, quoted constants and quantifiers."""
    if item[0] == "#":
        body = "#" if item[4] is None else json.dumps(item[4], ensure_ascii=False)
    else:
        inner = " ".join(regular_expression(x) for x in item[3])
        body = f"({inner})" if item[0][0] == "(" else f"<{item[0]}> {inner} </>" if inner else f"<{item[0]}/>"
    return body + (item[1] if item[1] != "1" else "")


def _flat(items: list) -> dict[str, list]:
    """Items of a level by key, groups opened; the texts of several slots apart."""
    out: dict[str, list] = {}
    for x in items:
        if x[0][0] == "(":
            for key, y in _flat(x[3]).items():
                out.setdefault(key, []).extend(y)
        else:
            out.setdefault(x[0], []).append(x)
    return out


def _shared(wrapper: list | None) -> set[tuple[int, str]]:
    """Texts that all pages have at a place, wherever the alignment has put them, with the place."""
    pages: dict[tuple[int, str], int] = {}

    def read(item: list, above: int, once: bool) -> None:
        if item[0] == "#":
            if item[4]:
                known = pages.get((above, item[4]), 0)
                # items that no element repeats are of different pages
                pages[above, item[4]] = known + item[2] if once else max(known, item[2])
            return
        place = above if item[0][0] == "(" else hash((above, item[0]))
        for x in item[3]:
            read(x, place, once and item[0][0] != "(" and x[0] not in item[6])

    if wrapper:
        read(wrapper, 0, True)
    return {x for x, n in pages.items() if n >= wrapper[2]}


def _chars(item: list, above: int, shared: set[tuple[int, str]], beside: bool = False) -> tuple[int, int]:
    """Characters of the texts below an item: of slots, and of texts that all pages share; none around the article, but for the item itself with ``beside``."""
    if item[0][0] == "~" and not beside:
        return 0, 0
    if item[0] == "#":
        return (0, item[5]) if (above, item[4]) in shared else (item[5], 0)
    place = above if item[0][0] == "(" else hash((above, item[0]))
    both = [_chars(x, place, shared) for x in item[3]]
    return sum(x for x, _ in both), sum(y for _, y in both)


def content_path(wrapper: list | None) -> list[str]:
    """Keys from the root down to the part that holds at least 80% of the slots' text."""
    return _region(wrapper, _shared(wrapper))[0]


def _region(wrapper: list | None, shared: set[tuple[int, str]]) -> tuple[list[str], int, int, int | None]:
    """The content path, the characters of slots and of shared texts in the part it leads to, and the place of what isn't around there, whatever its name, for holding most of the slots' text."""
    path: list[str] = []
    at, above = [wrapper] if wrapper else [], 0
    total, constant = _chars(wrapper, 0, shared) if wrapper else (0, 0)
    while at:
        above = hash((above, at[0][0]))
        below: dict[str, list] = {}
        for key, xs in ((k, xs) for x in at for k, xs in _flat(x[3]).items() if k != "#"):
            below.setdefault(key, []).extend(xs)
        chars = {k: tuple(map(sum, zip(*(_chars(x, above, shared, True) for x in xs), strict=True))) for k, xs in below.items()}
        beside = max((k for k in chars if k[0] == "~"), key=lambda k: (chars[k], k), default=None)
        if beside and chars[beside][0] >= 4 * max(total, 1):
            return path, total + chars[beside][0], constant + chars[beside][1], hash((above, beside))
        chars = {k: n for k, n in chars.items() if k[0] != "~"}
        best = max(chars, key=lambda k: (chars[k], k), default=None)
        # a repeated item is one of many paragraphs, not the region itself
        if best is None or not total or any(best in x[6] for x in at) or chars[best][0] < 0.8 * total or best.split(".")[0] in ("p", "span", "pre", "blockquote"):
            break
        path.append(best)
        at, (total, constant) = below[best], chars[best]
    return path, total, constant, None


def _regions(node: Node, level: int, out: list[Node], named: bool = False) -> None:
    """Parts of a level or more; with ``named`` inside elements too that only their names call other than the article."""
    todo = node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and (not c.around or named and c.around == 1) and c.tag != "header":
            if c.main >= level:
                out.append(c)
            else:
                todo += c.children[::-1]


def _marked(node: Node) -> tuple[int, list[Node]]:
    """The parts below a node that tags, roles and names mark as the article: article, then main, then names like ``content``."""
    for level, named in ((3, False), (2, False), (3, True), (2, True), (1, False)):
        found: list[Node] = []
        _regions(node, level, found, named)
        # what lies in elements named otherwise has to be more than what lies outside
        if found and (not named or len(_text(found, set())) > len(_text([node], set()))):
            return level, found
    return 0, []


_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _blocks(node: Node, shared: set[tuple[int, str]], out: list[list[str]]) -> None:
    """Pieces of text of each block below a node, without the texts ``shared`` by the host's pages at their places."""
    todo = [(node, c, False) for c in reversed(node.children)]
    while todo:
        above, c, in_header = todo.pop()
        if c is None:
            out.append([])
        elif isinstance(c, str):
            if not in_header or above.tag in _HEADING:
                if not (shared and (above.place, _same(c)) in shared):
                    out[-1].append(html.unescape(c))
        elif c.tag == "br":
            out[-1].append("\n")
        elif not c.around:
            if c.tag in BLOCK:
                out.append([])
                todo.append((above, None, False))
            inside = (in_header and c.tag not in _HEADING) or c.tag == "header" or c.key.endswith(".header")
            todo += [(c, x, inside) for x in reversed(c.children)]


def _content(found: list[Node], shared: set[tuple[int, str]]) -> str:
    """The text without the template's, unless that is all of it or holds all of its headings: near copies share those."""
    whole = _text(found, set())
    rest = _text(found, shared) if shared else whole
    if not rest:
        return whole
    if rest != whole:
        headings = {c.place for node in found for c in _headings(node)}
        kept = {x for x in shared if x[0] not in headings}
        if len(kept) < len(shared) and not any((c.place, _same(t)) not in shared for node in found for c in _headings(node) for t in c.children if isinstance(t, str) and not t.isspace()):
            return _text(found, kept)
    return rest


def _headings(node: Node) -> list[Node]:
    """The headings of a part and what they hold."""
    out, todo = [], [(node, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in _HEADING
        out += [n] if inside else []
        todo += [(c, inside) for c in n.children if isinstance(c, Node) and not c.around]
    return out


def _text(found: list[Node], shared: set[tuple[int, str]]) -> str:
    out: list[list[str]] = [[]]
    for node in found:
        out.append([])
        _blocks(node, shared, out)
    lines = (" ".join("".join(b).split()) for b in out)
    return "\n".join(x for x in lines if x)


class Reading:
    """What a host's wrapper says of its pages: where the content is, and the template's texts with their places."""

    def __init__(self, wrapper: list | None):
        shared = _shared(wrapper)
        self.path, slots, constant, self.opened = _region(wrapper, shared)
        self.enough = bool(wrapper) and wrapper[2] >= TEMPLATE_PAGES
        # copies of a page share all of it, near copies most, which tells nothing of a template
        self.shared = shared if self.enough and len(wrapper[7]) >= TEMPLATE_PAGES and constant < slots else set()


def _open(node: Node, place: int) -> None:
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if c.place == place:
                    c.around = 0
                todo.append(c)


def extract(page: str, wrapper: list | Reading | None = None) -> str:
    """The main text of a page: its blocks, white space collapsed, joined by line breaks.

    The host's wrapper leads to the part with the most slot text. The article is
    what the tags, roles and names mark on the way there or inside it (article,
    then main, then names like ``content``), else that part itself, without the
    texts that all pages of the host share (whole texts, where at least
    TEMPLATE_PAGES pages differ; not if they are half of the host's part or all of
    the page's headings). A host of too few pages, and a page that has no text in its
    host's part, are read by the marks first.
    """
    root = parse(page)
    r = wrapper if isinstance(wrapper, Reading) else Reading(wrapper)
    if r.opened:
        _open(root, r.opened)
    way = [root]
    for key in r.path:
        down = next((c for c in way[-1].children if isinstance(c, Node) and c.key == key), None)
        if down is None:
            break
        way.append(down)
    if r.enough:
        on = max(way, key=lambda n: n.main)
        level, found = _marked(way[-1])
        text = _content([on] if on.main and on.main >= level else found or way[-1:], r.shared)
        if text:
            return text
    return _content(_marked(root)[1] or way[-1:], r.shared)


def host(url: str | None) -> str:
    """The host of a url, lower-cased; empty if there is none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one wrapper for each host, as JSON, from all of its pages.

    Partitions infer a wrapper a host, which is merged with those of 64 slices of
    partitions and then with the rest, so a host of any share of the pages is
    never in one task as pages.
    """
    ddl = "host string, part int, wrapper string"

    def run(batches):
        import pyspark

        schema = arrow_schema(ddl)
        part = pyspark.TaskContext.get().partitionId()
        held: dict[str, list] = {}

        def flush():
            out = batch(schema, list(held), [part] * len(held), [json.dumps(w) for w in held.values()])
            held.clear()
            return out

        for b in batches:
            for url, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if text:
                    item = _page(text.decode())
                    name = host(url)
                    held[name] = _merged(held[name], item) if name in held else item
                    if len(held) >= 5000:
                        yield flush()
        yield flush()

    def merge(key, rows):
        import pandas as pd

        whole = None
        for w in rows.sort_values("wrapper")["wrapper"]:
            item = json.loads(w)
            whole = item if whole is None else _merged(whole, item)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [rows["part"].iloc[0]], "wrapper": [json.dumps(whole)]})

    out = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, ddl)
    for fan in (64, 1):
        out = out.withColumn("part", F.pmod("part", F.lit(fan))).groupBy("host", "part").applyInPandas(merge, ddl)
    return out.select("host", "wrapper")


def main_text(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null html is empty; empty pages and pages without main text have an empty
    text. Pages of a host without a wrapper are read by their tags alone. Null
    or odd urls share one host; repeated rows each get their result; an empty
    table gives an empty result.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    ddl = "page_id long, url string, text string, n_chars long"
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    small = size <= SENT_BYTES
    if small:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
        p = p.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        sent = None
        name = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", _HOST.pattern, 1), F.lit("")), F.lit("")))
        w = wrappers.withColumnRenamed("host", "host_")
        p = p.withColumn("host_", name).join(w, "host_", "left").drop("host_")

    def run(batches):
        schema = arrow_schema(ddl)
        known: dict[str, Reading] = {}
        for b in batches:
            ids, urls, own = (b.column(i).to_pylist() for i in (0, 1, 3))
            out, start, held = [], 0, 0
            for i, text in enumerate(as_bytes(b.column(2))):
                raw = sent.value.get(host(urls[i])) if sent is not None else own[i]
                if len(known) > 1000:
                    known.clear()
                if raw is not None and raw not in known:
                    known[raw] = Reading(json.loads(raw))
                out.append(extract(text.decode(), known.get(raw)) if text else "")
                held += len(out[-1])
                if held > 4 << 20:
                    yield batch(schema, ids[start : i + 1], urls[start : i + 1], out, list(map(len, out)))
                    out, start, held = [], i + 1, 0
            yield batch(schema, ids[start:], urls[start:], out, list(map(len, out)))

    return p.select("page_id", "url", "html", "wrapper").mapInArrow(run, ddl)
