"""Main text of web pages by union-free wrapper inference.

A page is a stream of tags (with class and id) and texts.  From all pages of
a host a wrapper is inferred: streams are aligned one after the other; texts
that differ become slots, and tag mismatches are resolved into repeated groups
(the segment before the mismatch recurs) or optional ones.  The pages are
matched against the wrapper: a text that all of them hold at a position is a
constant of the template, other texts are slots.

What a wrapper says of a matched page: the content region is the smallest
container that holds most of the slots' text outside links, with what lies
beside it in no container of its own; and blocks that hold nothing but
constants are template.  Elements that HTML itself names have the first word:
an article or main element is the region, whatever it begins with, and menus,
headers, footers, sidebars, notices, adverts, forms and comments are never in
it.  Where no wrapper matches, the whole page is the region, or containers that
are named like content.

Texts don't change how streams are aligned, so of pages with the same tags one
shape is aligned, the most frequent first.  The shapes of a host are dealt out,
and aligned again are only those that changed the wrapper of their part: few,
however many pages a host has.  Constants are told from all different pages,
counted where they lie and merged.
"""

from __future__ import annotations

import functools
import hashlib
import html
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Parts that a host's shapes are dealt to, and the longest run of tokens that may become a group.
PARTS, GROUP = 16, 400
#: Different pages that must hold a text at a position before it counts as a constant.
LEAST = 3
#: Percent of the slots' text that the content region holds.
MOST = 60

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp)\b(?P<rawattr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button select dialog menu template head svg canvas object audio video map datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe signup sidebar sidenav menu nav navbar navigation navi breadcrumb breadcrumbs footer header masthead comment comments disqus respond social share sharing related recommended widget popup modal overlay alert toolbar pagination pager tagcloud login search".split())
MAIN_NAMES = frozenset("content article post entry story body text main articlebody".split())
NEUTRAL = frozenset("has with no is".split())
#: Elements that may be a content region, and those that set their text apart from it.
REGIONS = frozenset("article center div main section td".split())
CONTAINERS = REGIONS | frozenset("aside blockquote details dl fieldset figure footer form header menu nav ol table ul".split())
CLOSED_BY_LIKE = frozenset("li dt dd option tr td th".split())


def tokens(page: str) -> list[tuple]:
    """("<", tag, hints) | (">", tag) | ("t", text) of a page; scripts, styles, titles and comments are left out."""
    out: list[tuple] = []
    put = out.append
    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            text = m["text"]
            if out and out[-1][0] == "t":
                out[-1] = ("t", out[-1][1] + text)
            else:
                put(("t", text))
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                put((">", tag))
            else:
                attr = m["attr"]
                put(("<", tag, _hints(attr.strip()) if attr and not attr.isspace() else ()))
    return out


@functools.lru_cache(4096)
def _hints(attr: str) -> tuple:
    found = []
    for m in _ATTR.finditer(attr):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role", "itemprop"):
            found += [(name, v) for v in value.split()]
        elif name == "hidden" and m.start() and attr[m.start() - 1].isspace() or name == "hidden" and not m.start():
            found.append(("hidden", ""))
        elif (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "aria-hidden" and value == "true"):
            found.append(("hidden", ""))
    return tuple(sorted(set(found)))


@functools.lru_cache(4096)
def _kind(tag: str, hints: tuple) -> str:
    """drop, header, article, main, named or plain, for an element."""
    if tag in DROPPED:
        return "drop"
    strong = tag in ("html", "body", "article", "main", "h1")
    for name, value in hints:
        if name == "hidden" or name == "role" and value in DROPPED_ROLES:
            return "drop"
        if name in ("class", "id") and not (strong and tag in ("html", "body", "h1")):
            parts = re.split(r"[-_]+", value)
            if parts[0] not in NEUTRAL and (parts[0] in DROPPED_NAMES or parts[-1] in DROPPED_NAMES):
                return "header" if "header" in (parts[0], parts[-1]) else "drop"
    if tag == "header":
        return "header"
    if tag == "article" or ("itemprop", "articlebody") in hints:
        return "article"
    if tag == "main" or ("role", "main") in hints:
        return "main"
    if tag in ("div", "section", "td") and any(n in ("class", "id") and (p := re.split(r"[-_]+", v)) and (p[0] in MAIN_NAMES or p[-1] in MAIN_NAMES) for n, v in hints):
        return "named"
    return "plain"


def classify(stream: list[tuple]) -> tuple[str, list[bool], list[bool]]:
    """The kind of the content region (empty: the page), whether each token lies in it, and whether it is in no dropped element.

    Of article elements, main elements and containers named like content, the
    first kind that holds text decides; else all text outside dropped elements
    is main.  A header belongs to the text only within such an element.
    """
    stack: list[tuple[str, str]] = []
    open_tags: Counter = Counter()
    places: list[tuple[bool, frozenset]] = []
    drop, inside = 0, {"article": 0, "main": 0, "named": 0}

    def pop(to: int) -> None:
        nonlocal drop
        while len(stack) > to:
            tag, kind = stack.pop()
            open_tags[tag] -= 1
            if kind == "drop":
                drop -= 1
            elif kind in inside:
                inside[kind] -= 1

    for token in stream:
        if token[0] == "<":
            tag = token[1]
            if tag not in VOID:
                if tag in BLOCK and open_tags["p"]:
                    for j in range(len(stack) - 1, -1, -1):
                        if stack[j][0] == "p":
                            pop(j)
                            break
                        if stack[j][0] in BLOCK:
                            break
                if tag in CLOSED_BY_LIKE and open_tags[tag]:
                    for j in range(len(stack) - 1, -1, -1):
                        if stack[j][0] == tag:
                            pop(j)
                            break
                        if stack[j][0] in ("ul", "ol", "dl", "table", "select"):
                            break
                kind = _kind(tag, token[2])
                if kind == "header":
                    kind = "plain" if inside["article"] or inside["main"] else "drop"
                if kind == "drop":
                    drop += 1
                elif kind in inside:
                    inside[kind] += 1
                stack.append((tag, kind))
                open_tags[tag] += 1
        elif token[0] == ">":
            tag = token[1]
            for j in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[j][0] == tag:
                    pop(j)
                    break
                if stack[j][0] in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                    break
        places.append((not drop, frozenset(k for k, n in inside.items() if n)))
    for kind in ("article", "main", "named"):
        if any(ok and kind in at for (ok, at), token in zip(places, stream, strict=True) if token[0] in "ts" and (token[0] == "s" or not token[1].isspace())):
            return kind, [ok and kind in at for ok, at in places], [ok for ok, _ in places]
    kept = [ok for ok, _ in places]
    return "", kept, kept


# A wrapper is a list of nodes: ("<", tag, hints), (">", tag), ("t", text),
# ("s",) for a slot, ("?", nodes) for an optional and ("+", nodes) for a
# repeated group.


def _same(a: tuple, b: tuple) -> bool:
    return a == b or a[0] in "ts" and b[0] in "ts"


def _join(a: tuple, b: tuple) -> tuple:
    return a if a == b else ("s",)


def _take(nodes: list, stream: list, j: int) -> int:
    """Where a greedy match of nodes that starts at j ends; -1 without one."""
    for node in nodes:
        if node[0] == "?":
            k = _take(node[1], stream, j)
            j = k if k >= 0 else j
        elif node[0] == "+":
            k, n = _take(node[1], stream, j), 0
            while k > j:
                j, n = k, n + 1
                k = _take(node[1], stream, j)
            if not n:
                return -1
        elif j < len(stream) and _same(node, stream[j]):
            j += 1
        else:
            return -1
    return j


def _square(done: list, rest: list, i: int) -> tuple[list, int, int] | None:
    """(group, its length at the end of done, where rest goes on) if rest[i:] repeats the end of done."""
    if not done or done[-1][0] in "?+":
        return None
    last = done[-1]
    for e in range(i, min(i + GROUP, len(rest))):
        if _same(rest[e], last) and rest[e][0] == last[0]:
            size = e - i + 1
            if size <= len(done) and all(_same(a, b) for a, b in zip(done[-size:], rest[i : e + 1], strict=True)):
                return [_join(a, b) for a, b in zip(done[-size:], rest[i : e + 1], strict=True)], size, e + 1
            return None
    return None


#: Elements whose end tag may be missing.
OPEN_ENDED = CLOSED_BY_LIKE | VOID | {"p", "b", "i"}


def _whole(nodes: list) -> bool:
    """Whether a segment closes the elements that it opens, and no others."""
    stack: list[str] = []
    for node in _flat(nodes):
        if node[0] == "<":
            stack.append(node[1])
        elif node[0] == ">":
            while stack and stack[-1] != node[1] and stack[-1] in OPEN_ENDED:
                stack.pop()
            if not stack or stack.pop() != node[1]:
                return False
    return all(t in OPEN_ENDED for t in stack)


def align(wrapper: list, stream: list) -> list | None:
    """The wrapper, generalised to match the stream as well; None if they can't be aligned."""
    out: list = []
    i = j = 0
    while i < len(wrapper) or j < len(stream):
        a = wrapper[i] if i < len(wrapper) else None
        b = stream[j] if j < len(stream) else None
        if a and a[0] in "?+":
            k, n = _take(a[1], stream, j), 0
            while k > j and (not n or a[0] == "+"):
                j, n = k, n + 1
                k = _take(a[1], stream, j)
            out.append(a if n or a[0] == "?" else ("?", [a]))
            i += 1
            continue
        if a and b and _same(a, b):
            out.append(_join(a, b))
            i, j = i + 1, j + 1
            continue
        if a and a[0] in "ts":
            out.append(("?", [("s",)]))
            i += 1
            continue
        if b and b[0] == "t":
            out.append(("?", [("s",)]))
            j += 1
            continue
        if b and (found := _square(out, stream, j)):
            group, size, j = found
            while len(out) >= 2 * size and all(_same(x, y) for x, y in zip(out[-2 * size : -size], group, strict=True)):
                del out[-size:]
            out[-size:] = [("+", group)]
            while (k := _take(group, stream, j)) > j:
                j = k
            continue
        if a and (found := _square(out, wrapper, i)):
            group, size, i = found
            while len(out) >= 2 * size and all(_same(x, y) for x, y in zip(out[-2 * size : -size], group, strict=True)):
                del out[-size:]
            out[-size:] = [("+", group)]
            while (k := _take(group, wrapper, i)) > i:
                i = k
            continue
        to_b = next((k for k in range(j, min(j + GROUP, len(stream))) if a and _same(a, stream[k])), None)
        to_a = next((k for k in range(i, min(i + GROUP, len(wrapper))) if b and wrapper[k][0] not in "?+" and _same(b, wrapper[k])), None)
        # A well-formed segment makes a better optional than a shorter one that cuts through elements.
        cost_b = to_b is not None and (not _whole(stream[j:to_b]), to_b - j)
        cost_a = to_a is not None and (not _whole(wrapper[i:to_a]), to_a - i)
        if to_b is not None and (to_a is None or cost_b <= cost_a):
            out.append(("?", stream[j:to_b]))
            j = to_b
        elif to_a is not None:
            out.append(("?", wrapper[i:to_a]))
            i = to_a
        elif b is None and len(wrapper) - i <= GROUP:
            out.append(("?", wrapper[i:]))
            i = len(wrapper)
        elif a is None and len(stream) - j <= GROUP:
            out.append(("?", stream[j:]))
            j = len(stream)
        else:
            return None
    return out


def grown(wrapper: list, shape: list) -> tuple[list, bool]:
    """The wrapper, generalised to match the shape as well, and whether it didn't before; a shape that can't be aligned is left to itself."""
    if not wrapper:
        return shape, True
    if _take(wrapper, shape, 0) == len(shape):
        return wrapper, False
    return align(wrapper, shape) or wrapper, True


def fold(shapes: Iterable[list]) -> list:
    """A wrapper of the shapes, in this order."""
    return functools.reduce(lambda wrapper, s: grown(wrapper, s)[0], shapes, [])


def infer(pages: list[str]) -> list:
    """A wrapper of the pages, whose texts are all slots."""
    shapes = Counter(s for p in dict.fromkeys(pages) if (s := skeleton(p)[0]))
    return fold(_stream(s) for s in sorted(shapes, key=lambda s: (-shapes[s], s)))


def _flat(nodes: list) -> list:
    return [x for n in nodes for x in (_flat(n[1]) if n[0] in "?+" else [n])]


def _marked(nodes: list, marks) -> list:
    return [(n[0], _marked(n[1], marks)) if n[0] in "?+" else (n, next(marks)) for n in nodes]


def _plain(text: str) -> str:
    return " ".join(text.split())


def _key(text: str) -> str:
    """What stands for a text among constants: itself if it is short, else its hash."""
    return text if len(text) <= 32 else "\0" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def skeleton(page: str) -> tuple[str, list]:
    """The shape of a page (JSON of its stream without the texts; empty without tokens), and of each text its key, length, and whether it lies in the content region and in kept elements (None: white space)."""
    stream = tokens(page)
    _, flags, kept = classify(stream)
    shape = json.dumps([["s"] if t[0] == "t" else t for t in stream], separators=(",", ":")) if stream else ""
    texts = [(t[1], main, ok) for t, main, ok in zip(stream, flags, kept, strict=True) if t[0] == "t"]
    return shape, [(_key(text), len(text), main, ok) if (text := _plain(raw)) else None for raw, main, ok in texts]


def _stream(shape: str) -> list:
    return _tuples(json.loads(shape))


def _places(nodes: list, shape: list) -> list[int] | None:
    """The nodes of _flat(nodes) that the texts of a shape match; None if it doesn't match."""
    at: list = []
    if _match(_marked(nodes, itertools.count()), shape, 0, at) != len(shape):
        return None
    return [k for k, token in zip(at, shape, strict=True) if token[0] == "s"]


def _add(seen: dict, k: int, pages: int, texts: dict, differ: bool, total: int, main: bool) -> None:
    """Add to what is known of node k: pages with a text there, texts that all hold and their lengths in kept elements, whether pages differ, the length of all texts in kept elements, whether some lie in the content region."""
    if k not in seen:
        seen[k] = [pages, texts, differ, total, main]
        return
    had = seen[k]
    both = {t: had[1][t] + n for t, n in texts.items() if t in had[1]}
    seen[k] = [had[0] + pages, both, had[2] or differ or had[1].keys() != texts.keys(), had[3] + total, had[4] or main]


def _note(seen: dict, places: list[int], texts: list) -> None:
    """Add a page, the texts of which match the nodes at places."""
    here: dict[int, list] = {}
    for k, t in zip(places, texts, strict=True):
        if t:
            here.setdefault(k, []).append(t)
    for k, some in here.items():
        held: Counter = Counter()
        for key, n, _, ok in some:
            held[key] += n if ok else 0
        _add(seen, k, 1, dict(held), False, sum(held.values()), any(t[2] for t in some))


def _told(nodes: list, matched: int, seen: dict) -> tuple[list[list[str]], list[bool] | None]:
    """Of each node of _flat(nodes), its constants and whether it lies in the content region (None: no region stands out).

    Constants are the texts that the different pages matched all hold there.
    At least LEAST pages, and more than half of those matched, must have the
    node.  Without a slot in kept elements, a text of which differs between
    pages, the pages tell nothing.
    """
    flat = _flat(nodes)
    if not any(main and differ for _, _, differ, _, main in seen.values()):
        return [[] for _ in flat], None
    each = [seen.get(k, (0, {}, False, 0, False)) for k in range(len(flat))]
    same = [sorted(texts) if n >= LEAST and 2 * n > matched else [] for n, texts, *_ in each]
    mass = [total - sum(texts[t] for t in c) for (_, texts, _, total, _), c in zip(each, same, strict=True)]
    return same, region(flat, mass) if matched >= LEAST else None


def learned(nodes: list, pages: list[str]) -> tuple[list[list[str]], list[bool] | None]:
    """Constants and region that the pages tell of the nodes."""
    seen: dict = {}
    matched = 0
    for shape, texts in map(skeleton, dict.fromkeys(pages)):
        if shape and (places := _places(nodes, _stream(shape))) is not None:
            matched += 1
            _note(seen, places, texts)
    return _told(nodes, matched, seen)


def region(flat: list, mass: list[int]) -> list[bool] | None:
    """Whether each node lies in the smallest container with MOST of the mass outside links, or beside it in no container of its own."""
    spans: list[list] = []  # tag, first node, node after the last, parent
    inside: list[int] = []  # innermost element of each node; -1: none
    stack: list[int] = []
    for k, node in enumerate(flat):
        if node[0] == ">":
            if any(spans[e][0] == node[1] for e in stack):
                while spans[stack[-1]][0] != node[1]:
                    spans[stack.pop()][2] = k
                inside.append(stack[-1])
                spans[stack.pop()][2] = k + 1
                continue
        elif node[0] == "<" and node[1] not in VOID:
            spans.append([node[1], k, len(flat), stack[-1] if stack else -1])
            stack.append(len(spans) - 1)
        inside.append(stack[-1] if stack else -1)

    def above(e: int) -> list[int]:
        out = []
        while e >= 0:
            out.append(e)
            e = spans[e][3]
        return out

    free = [m if m and not any(spans[e][0] == "a" for e in above(inside[k])) else 0 for k, m in enumerate(mass)]
    fit = [e for e, (tag, low, high, _) in enumerate(spans) if tag in REGIONS and 100 * sum(free[low:high]) >= MOST * sum(free)]
    if not fit or not sum(free):
        return None
    best = min(fit, key=lambda e: spans[e][2] - spans[e][1])
    path = set(above(best))
    apart = lambda e: next((x not in path for x in above(e) if spans[x][0] in CONTAINERS), False)
    return [spans[best][1] <= k < spans[best][2] or not apart(e) for k, e in enumerate(inside)]


def wrapper_of(pages: list[str]) -> str:
    """JSON of the pages' wrapper, its nodes, their constants and the content region."""
    nodes = infer(pages)
    return json.dumps([nodes, *learned(nodes, pages)])


@functools.lru_cache(256)
def _compiled(wrapper: str | bytes) -> tuple[list, bool]:
    """Nodes marked with their constants and whether they lie in the region, and whether there is one."""
    nodes, texts, within = _loaded(wrapper)
    return _marked(_tuples(nodes), zip(map(frozenset, texts), within or [True] * len(texts), strict=True)), within is not None


def _loaded(x: str | bytes):
    """What JSON says, as it stands or deflated."""
    return json.loads(zlib.decompress(x) if isinstance(x, bytes) else x)


def _dumped(x) -> bytes:
    return zlib.compress(json.dumps(x, separators=(",", ":")).encode())


def _tuples(x):
    return [(n[0], _tuples(n[1])) if n[0] in "?+" else ("<", n[1], tuple(map(tuple, n[2]))) if n[0] == "<" else tuple(n) for n in x]


def _match(nodes: list, stream: list, j: int, out: list) -> int:
    """As _take, for marked nodes; appends the mark of each token."""
    for node in nodes:
        kind = node[0]
        if kind == "?":
            n = len(out)
            k = _match(node[1], stream, j, out)
            if k < 0:
                del out[n:]
            else:
                j = k
        elif kind == "+":
            times = 0
            while True:
                n = len(out)
                k = _match(node[1], stream, j, out)
                if k <= j:
                    del out[n:]
                    break
                j, times = k, times + 1
            if not times:
                return -1
        elif j < len(stream) and _same(node[0], stream[j]):
            out.append(node[1])
            j += 1
        else:
            return -1
    return j


def extract(page: str, wrapper: str | bytes | None = None) -> tuple[str, bool]:
    """Main text of a page, and whether the wrapper matched it."""
    stream = tokens(page)
    marks: list[tuple[frozenset, bool]] = []
    nodes, stands_out = _compiled(wrapper) if wrapper else ([], False)
    matched = bool(wrapper) and _match(nodes, stream, 0, marks) == len(stream)
    kind, flags, kept = classify(stream)
    known = [m[0] for m in marks] if matched and kind != "article" else [frozenset()] * len(stream)
    if matched and stands_out and kind in ("", "named"):
        flags = [ok and m[1] for ok, m in zip(kept, marks, strict=True)]
    blocks, now, slot = [], [], False
    for token, main, texts in zip(stream, flags, known, strict=True):
        if token[0] == "t":
            if main:
                now.append(token[1])
                slot = slot or not token[1].isspace() and (not texts or _key(_plain(token[1])) not in texts)
        elif token[1] in BLOCK:
            blocks.append(now if slot else [])
            now, slot = [], False
        elif token[1] == "br":
            now.append(" ")
    blocks.append(now if slot else [])
    done = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(b for b in done if b), matched


def _rows(batches, size: int = 256):
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, size).columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def _skeletons(batches):
    schema = pa.schema({"host": pa.string(), "page": pa.binary(), "shape": pa.string(), "texts": pa.binary()})
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = [(name, page, *skeleton(page)) for name, page in _rows([batch.slice(k, 256)])]
            if made := [(name, hashlib.blake2b(page.encode(), digest_size=16).digest(), shape, _dumped(texts)) for name, page, shape, texts in some if shape]:
                yield _batch(made, schema)


def _folds(batches):
    """Of each host and part, in order of these and of turn, the shapes that change the wrapper."""
    schema = pa.schema({"host": pa.string(), "pages": pa.int64(), "shape": pa.string()})
    for _, rows in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
        wrapper: list = []
        for name, _, pages, shape in rows:
            wrapper, new = grown(wrapper, _stream(shape))
            if new:
                yield _batch([(name, pages, shape)], schema)


def _inferred(batches):
    """The wrapper of each host, from its shapes in order of turn."""
    schema = pa.schema({"host": pa.string(), "nodes": pa.binary()})
    for name, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        yield _batch([(name, _dumped(fold(_stream(r[2]) for r in rows)))], schema)


@functools.lru_cache(256)
def _nodes(nodes: bytes) -> list:
    return _tuples(_loaded(nodes))


@functools.lru_cache(512)
def _placed(nodes: bytes, shape: str) -> list[int] | None:
    return _places(_nodes(nodes), _stream(shape))


def _noted(batches):
    """What a task's pages say of their hosts' wrappers, given out whenever it has pages of 256 hosts."""
    schema = pa.schema({"host": pa.string(), "nodes": pa.binary(), "matched": pa.int64(), "seen": pa.binary()})
    notes: dict = {}

    def out():
        return _batch([(name, nodes, n, _dumped([[k, *v] for k, v in seen.items()])) for (name, nodes), (n, seen) in notes.items()], schema)

    for name, shape, texts, nodes in _rows(batches):
        if (places := _placed(nodes, shape)) is None:
            continue
        if (name, nodes) not in notes and len(notes) == 256:
            yield out()
            notes.clear()
        note = notes.setdefault((name, nodes), [0, {}])
        note[0] += 1
        _note(note[1], places, _loaded(texts))
    if notes:
        yield out()


def _concluded(batches):
    schema = pa.schema({"host": pa.string(), "wrapper": pa.binary()})
    for (name, nodes), rows in itertools.groupby(_rows(batches, 16), key=lambda r: r[:2]):
        matched, seen = 0, {}
        for _, _, n, some in rows:
            matched += n
            for one in _loaded(some):
                _add(seen, *one)
        tree = _tuples(_loaded(nodes))
        yield _batch([(name, _dumped([tree, *_told(tree, matched, seen)]))], schema)


def host(url):
    """Lower-case host of a URL column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (deflated JSON) of every host with a page that has tokens and is matched.

    Pages are read once, into a table of the different ones' shapes and keys of texts.
    """
    rows = pages.filter("html is not null").select(host(F.col("url")).alias("host"), "html")
    bare = rows.mapInArrow(_skeletons, "host string, page binary, shape string, texts binary")
    bare = materialise(bare.dropDuplicates(["host", "page"]).select("host", "shape", "texts"), "skeletons")
    shapes = bare.groupBy("host", "shape").agg(F.count("*").alias("pages"))
    turn = [F.desc("pages"), F.asc("shape")]
    dealt = shapes.select("host", F.pmod(F.xxhash64("shape"), F.lit(PARTS)).alias("part"), "pages", "shape").repartition("host", "part").sortWithinPartitions("host", "part", *turn)
    told = dealt.mapInArrow(_folds, "host string, pages long, shape string").repartition("host").sortWithinPartitions("host", *turn)
    nodes = materialise(told.mapInArrow(_inferred, "host string, nodes binary"), "nodes")
    notes = bare.join(nodes, "host").select("host", "shape", "texts", "nodes").mapInArrow(_noted, "host string, nodes binary, matched long, seen binary")
    merged = notes.repartition("host").sortWithinPartitions("host").mapInArrow(_concluded, "host string, wrapper binary")
    return materialise(merged, "wrappers")


def _extracted(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            texts, matched = [], []
            for page, wrapper in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                text, ok = extract(page or "", wrapper)
                texts.append(text), matched.append(ok)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string()), pa.array(matched)], ["row", "text", "matched"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, matched of every page; null and empty pages have an empty text."""
    rows = pages.select("page_id", "url", "html")
    joined = rows.withColumn("host", host(F.col("url"))).join(wrappers(rows), "host", "left")
    joined = joined.select(F.struct("page_id", "url").alias("row"), "html", "wrapper")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_extracted, f"row {kind}, text string, matched boolean")
    return out.select("row.*", "text", F.length("text").cast("long").alias("n_chars"), "matched")
