"""Main text of web pages by wrappers that are inferred from pages of the same host.

A wrapper is a union-free regular expression over a page's tokens: start and end tags, text
slots ``#``, optional parts ``(...)?`` and repeated groups ``(...)+``.  It starts as the
tokens of one page and is aligned with the next, level by level of the balanced tags.  Equal tokens stay, and text that differs makes
a slot.  Mismatches are resolved: runs of a tag of different length become one repeated
group, what only one side has becomes optional, and a tag that keeps coming back amid optional ones spans a repeated group.
Runs that have the same length on all pages stay apart, so slots are known by
their place and not only by the names around them.  Merging is associative enough to go in any
order: each batch merges its pages, and expressions of a host merge in groups of about ``MERGE_GROUP``, so that a host with a third of all
pages is merged by many tasks.  An expression has at most ``MAX_ITEMS`` parts a level (beyond that
it generalises to repeated groups, then to tags without classes, then to any tag) and ``MAX_DEPTH`` levels, whatever the pages.

Each slot sums what its texts are like: on how many pages, how many characters in and outside links, whether all are the same.  They say what of a host's
pages is its article: the ``article`` or ``main`` elements of the expression, else the
deepest element that holds nearly all varying text outside links.  Inside it, slots with one and the same text on all of at
least ``MIN_CONSTANT`` different pages are template text.  Each page is aligned with its host's expression, and the
blocks in slots that vary inside the article are its main text.
Only then do names count: elements that are menus, headers, footers, sidebars, notices, adverts, forms or comments by
their tag, role, class or id never are article text, and a page that has nothing in such slots falls back on its own
``article`` or ``main``, then on its body.

Defined results: null and empty html have empty text; a page without a url belongs to the host
``''``; repeated rows are extracted alike and count once where they are equal; other columns are
ignored; pages of any length are read whole, in time in proportion to their length; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .html_blocks import Block, read
from .scratch import stored
from .url_rules import host_of

MERGE_GROUP = 64
MAX_ITEMS = 48
MIN_CONSTANT = 5
#: The share of the varying text that an element must hold to be looked into further.
MOST = 0.95
#: Wrappers of all hosts together that may be sent to every task; beyond it they are joined by host.
BROADCAST_CHARS = 4_000_000

#: [key, optional, repeated, body]: a slot's body is [pages, characters outside links, characters in links, least and
#: greatest crc of its texts, skipped], an element's or a group's a list of items.
Item = list
TEXT, GROUP, ANY = "#", "(", "*"


def _bare(key: str) -> str:
    return key.split(".")[0]


def _known(key: str, keys) -> str | None:
    """The key under which a level with these keys has an element."""
    return key if key in keys else _bare(key) if _bare(key) in keys else ANY if ANY in keys and key not in (TEXT, GROUP) else None


def _merge_item(a: Item, b: Item, one_page: bool) -> Item:
    if a[0] == TEXT:
        x, y = a[3], b[3]
        body = [max(x[0], y[0]) if one_page else x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4]), x[5] and y[5]]
    elif a[0] == GROUP:
        body = _distinct([*a[3], *b[3]], one_page)
    else:
        body = merge(a[3], b[3], one_page)
    return [a[0], a[1] or b[1], a[2] or b[2], body]


def _one(run: list[Item], one_page: bool) -> Item:
    """A run of one key as one repeated item; halves merge first, which keeps long runs cheap."""
    while len(run) > 1:
        run = [_merge_item(*run[k : k + 2], one_page) if k + 1 < len(run) else run[k] for k in range(0, len(run), 2)]
    return [run[0][0], run[0][1], True, run[0][3]]


def _runs(items: list[Item]) -> list[list[Item]]:
    out: list[list[Item]] = []
    for x in items:
        if out and out[-1][0][0] == x[0]:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _distinct(items: list[Item], one_page: bool) -> list[Item]:
    """The body of a repeated group: each key once, more general keys if there are too many."""
    flat: list[Item] = []
    for x in items:
        flat.extend(x[3] if x[0] == GROUP else [x])
    for general in (lambda k: k, _bare, lambda k: k if k == TEXT else ANY):
        keys = {general(x[0]) for x in flat}
        if len(keys) <= MAX_ITEMS:
            break
    by: dict[str, list[Item]] = {}
    for x in flat:
        by.setdefault(_known(general(x[0]), keys), []).append([general(x[0]), True, True, x[3]])
    return [[k, *_one(own, one_page)[1:]] for k, own in by.items()]


def _settled(items: list[Item], one_page: bool) -> list[Item]:
    """Neighbours of one key with a mismatch among them fold; keys that come back amid optional ones span a repeated group."""
    out = []
    for run in _runs(items):
        if len(run) > 1 and any(x[1] or x[2] for x in run):
            optional = all(x[1] for x in run)
            run = [_one(run, one_page)]
            run[0][1] = optional
        out.append(run)
    places: dict[str, list[int]] = {}
    for k, run in enumerate(out):
        places.setdefault(run[0][0], []).append(k)
    spans = [(at[0], at[-1]) for key, at in places.items() if key != GROUP and len(at) > 2 and any(x[1] for k in at for x in out[k])]
    if len(places.get(GROUP, ())) > 1:
        spans.append((places[GROUP][0], places[GROUP][-1]))
    if spans:
        low, high = min(a for a, _ in spans), max(b for _, b in spans)
        out = [*out[:low], [[GROUP, False, True, _distinct([x for run in out[low : high + 1] for x in run], one_page)]], *out[high + 1 :]]
    flat = [x for run in out for x in run]
    return _bounded(flat, one_page)


def _bounded(items: list[Item], one_page: bool) -> list[Item]:
    if len(items) > MAX_ITEMS:
        items = [run[0] if len(run) == 1 else _one(run, one_page) for run in _runs(items)]
    if len(items) > MAX_ITEMS:
        items = [[GROUP, False, True, _distinct(items, one_page)]]
    return items


def _with_group(items: list[Item], keys: set[str], one_page: bool) -> list[Item]:
    """items with all from the first to the last whose key is among a group's as one group."""
    at = [k for k, x in enumerate(items) if x[0] == GROUP or _known(x[0], keys)]
    if not at:
        return items
    return [*items[: at[0]], [GROUP, False, True, _distinct(items[at[0] : at[-1] + 1], one_page)], *items[at[-1] + 1 :]]


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two short lists of keys, as pairs of places."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def merge(a: list[Item], b: list[Item], one_page: bool = False) -> list[Item]:
    """An expression that generalises both."""
    keys = {x[0] for side in (a, b) for g in side if g[0] == GROUP for x in g[3]}
    if keys:
        a, b = _with_group(a, keys, one_page), _with_group(b, keys, one_page)
    if [x[0] for x in a] == [y[0] for y in b]:
        return [_merge_item(x, y, one_page) for x, y in zip(a, b)]
    one, two = _runs(a), _runs(b)
    out: list[Item] = []
    i = j = 0
    for p, q in [*_aligned([r[0][0] for r in one], [r[0][0] for r in two]), (len(one), len(two))]:
        out += [[x[0], True, x[2], x[3]] for run in (*one[i:p], *two[j:q]) for x in run]
        if p < len(one):
            x, y = one[p], two[q]
            out += [_merge_item(u, v, one_page) for u, v in zip(x, y)] if len(x) == len(y) else [_merge_item(_one(x, one_page), _one(y, one_page), one_page)]
        i, j = p + 1, q + 1
    return _settled(out, one_page)


def of_page(children: list, blocks: list[Block]) -> list[Item]:
    """The expression of one page: its own tokens."""
    out = []
    for c in children:
        if isinstance(c, int):
            b = blocks[c]
            crc = zlib.crc32(b.text.encode("utf-8", "surrogatepass"))
            out.append([TEXT, False, False, [1, len(b.text) - b.linked, b.linked, crc, crc, b.skip]])
        else:
            out.append([c[0], False, False, of_page(c[1], blocks)])
    return _bounded(out, True)


def as_text(items: list[Item]) -> str:
    """The expression as text."""
    out = []
    for key, optional, repeated, body in items:
        inner = TEXT if key == TEXT else as_text(body) if key == GROUP else f"<{key}>{as_text(body)}</{key}>"
        mark = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
        out.append(f"({inner}){mark}" if mark else inner)
    return "".join(out)


def _slots(items: list[Item]) -> Iterator[list]:
    for x in items:
        if x[0] == TEXT:
            yield x[3]
        else:
            yield from _slots(x[3])


def _named(items: list[Item], name: str) -> Iterator[list[Item]]:
    """The bodies of the outermost elements of a name that have text to take."""
    for x in items:
        if x[0] != TEXT:
            if _bare(x[0]) == name and any(not s[5] for s in _slots(x[3])):
                yield x[3]
            else:
                yield from _named(x[3], name)


def kept_slots(wrapper: list[Item], pages: int) -> set[int]:
    """The ids (of the objects) of the slots that hold article text, if the host has this many different pages."""
    constant = lambda s: pages >= MIN_CONSTANT and s[0] >= MIN_CONSTANT and s[3] == s[4]
    weight = lambda items: sum(s[1] for s in _slots(items) if not s[5] and not constant(s))
    parts = [*_named(wrapper, "article")] or [*_named(wrapper, "main")]
    if not parts:
        inside, whole = wrapper, weight(wrapper)
        while whole:
            nearly = [x for x in inside if x[0] != TEXT and not x[2] and weight(x[3]) >= MOST * whole]
            if not nearly:
                break
            inside = nearly[0][3]
        parts = [inside]
    own = [s for p in parts for s in _slots(p) if not s[5]]
    return {id(s) for s in own if not constant(s)} or {id(s) for s in own}


def assign(children: list, items: list[Item], found: dict[int, list]) -> None:
    """The slot of each block of a page, by aligning its tokens with the wrapper's."""
    top = {x[0] for x in items if x[0] != GROUP}
    grouped = {x[0]: x for g in items if g[0] == GROUP for x in g[3]}
    key = lambda c: TEXT if isinstance(c, int) else c[0]

    def put(c, item: Item) -> None:
        if isinstance(c, int):
            found[c] = item[3]
        else:
            assign(c[1], item[3], found)

    # Runs of children and of items that have a place of their own.
    own: list[tuple[str | None, list]] = []
    for c in children:
        k = _known(key(c), top)
        if own and own[-1][0] == k and (k is not None or key(own[-1][1][-1]) == key(c)):
            own[-1][1].append(c)
        else:
            own.append((k, [c]))
    runs = _runs([x for x in items if x[0] != GROUP])
    placed = set()
    if len(own) * len(runs) <= 64 * MAX_ITEMS * MAX_ITEMS:
        for p, q in _aligned([k or "" for k, _ in own], [r[0][0] for r in runs]):
            placed.add(p)
            for n, c in enumerate(own[p][1]):
                put(c, runs[q][min(n, len(runs[q]) - 1)])
    for p, (_, run) in enumerate(own):
        if p not in placed:
            for c in run:
                # In the repeated group, else in any item of the key.
                k = _known(key(c), grouped)
                item = grouped[k] if k else next((x for x in items if x[0] == _known(key(c), top)), None)
                if item is not None:
                    put(c, item)


def main_text(blocks: list[Block], tree: list, wrapper: list[Item], kept: set[int]) -> str:
    found: dict[int, list] = {}
    assign(tree, wrapper, found)
    # A block without a slot, on a page that its wrapper does not know, stays if it stands in an article.
    some = [b.text for k, b in enumerate(blocks) if not b.skip and (id(found[k]) in kept if k in found else bool(b.inside))]
    for name in ("article", "main"):
        some = some or [b.text for b in blocks if not b.skip and b.inside == name]
    return "\n\n".join(some or [b.text for b in blocks if not b.skip])


#: The least crcs of different pages that say whether a host has enough of them.
_LEAST = 2 * MIN_CONSTANT
_SHAPES = "host string, shape string"


def _dumps(wrapper: list[Item], pages: set[int]) -> str:
    return json.dumps([wrapper, sorted(pages)[:_LEAST]], separators=(",", ":"))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The expressions of a batch, merged by host; equal pages count once."""
    for batch in batches:
        found: dict[str, list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = page.as_py() or ""
            crc = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            own = found.setdefault(host, [None, set()])
            if crc not in own[1]:
                blocks, tree = read(text)
                new = of_page(tree, blocks)
                own[0] = new if own[0] is None else merge(own[0], new)
                own[1].add(crc)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([_dumps(w, p) for w, p in found.values()], pa.string())], names=["host", "shape"])


def _merge_shapes(group: pd.DataFrame) -> pd.DataFrame:
    wrapper, pages = None, set()
    for shape in sorted(group["shape"]):
        own, crcs = json.loads(shape)
        wrapper = own if wrapper is None else merge(wrapper, own)
        pages.update(crcs)
    return pd.DataFrame({"host": group["host"].iloc[:1], "shape": [_dumps(wrapper, pages)]})


def infer_wrappers(pages: DataFrame, merge_group: int = MERGE_GROUP) -> DataFrame:
    """host and shape (the wrapper, and the least crcs of its pages, as JSON) for each host of pages (host, html)."""
    shapes = stored(pages.select("host", "html").mapInArrow(K.releasing(_shapes), _SHAPES), "shapes")
    while True:
        most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return shapes
        salts = -(-most // merge_group)
        salted = shapes.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(salts)))
        shapes = stored(salted.groupBy("host", "salt").applyInPandas(_merge_shapes, _SHAPES), "merged-shapes")


class _Hosts:
    """Wrappers by their JSON, with what each keeps; the last ones stay read."""

    def __init__(self) -> None:
        self.read: dict[str, tuple[list[Item], set[int]]] = {}

    def get(self, shape: str | None) -> tuple[list[Item], set[int]]:
        if shape not in self.read:
            if len(self.read) >= 256:
                self.read.clear()
            wrapper, pages = json.loads(shape) if shape else ([], [])
            self.read[shape] = wrapper, kept_slots(wrapper, len(pages))
        return self.read[shape]


def _extract(shapes: dict[str, str] | None):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts()
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            texts = []
            own = (shapes.get(h) for h in get("host").to_pylist()) if shapes is not None else (s.as_py() for s in get("shape"))
            for page, shape in zip(get("html"), own):
                blocks, tree = read(page.as_py())
                texts.append(main_text(blocks, tree, *hosts.get(shape)))
            yield pa.RecordBatch.from_arrays([get("page_id"), get("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


def extract_main_text(pages: DataFrame, sent_chars: int = BROADCAST_CHARS) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host_of(F.col("url")))
    wrappers = stored(infer_wrappers(rows), "wrappers")
    size = wrappers.agg(F.sum(F.length("host") + F.length("shape"))).first()[0] or 0
    out = "page_id long, url string, text string, n_chars long"
    if size <= sent_chars:
        return rows.mapInArrow(K.releasing(_extract({r["host"]: r["shape"] for r in wrappers.collect()})), out)  # at most sent_chars
    return rows.join(wrappers, "host", "left").mapInArrow(K.releasing(_extract(None)), out)
