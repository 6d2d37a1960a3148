"""HTML extraction: nearest-URL page differencing.

Pages stand in the order of host, path and URL, cut into ranges of bounded size; the pages next to a range's two ends
come along as guests, so what a page is compared with does not depend on the cuts. A page is compared with the nearest
of up to REACH different pages on either side of it on its host (the longest common beginning of the paths; ties go to
the former one). Both pages' lines (blocks of text) are aligned by longest common subsequence, and shared lines go. A
page that shares more than COPY of its characters is a copy, which tells nothing: the next nearest one is taken.

Elements that hold no main text (menus, headers, footers, forms, scripts ...) and whole names of adverts, notices or
comments go whatever the comparison says, inline ones without cutting the line they stand in. An article element protects
its lines, since articles quote each other; in it ids are no names, as they say what a passage is about, and headings
are never judged by a name. Differencing decides all other lines, on pages with an article element too.

Null html is empty text; pages without a neighbour, or with copies alone around them, are judged by their markup;
repeated rows count as one page for the comparison and are all returned; null urls have no host; further columns are
left alone; an empty table gives an empty result. A long page takes the memory of its lines, and at most
2 * REACH + 1 pages are held at a time.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Different pages on either side that a page may be compared with; share of its characters above which one is a copy.
REACH, COPY = 2, 0.8
#: Bytes of html a range should hold, and ranges at most (what the driver holds of each is a few URLs).
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000
#: Rows with the same key are spread over so many parts.
SALTS = 4096

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>",
    re.S,
)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas"}
_SKIP = {"nav", "footer", "aside", "form", "button", "select", "option", "label", "dialog", "menu", "head"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words in names of furniture, and words that may stand beside them in such a name ("share-link", not "share-price").
_FURNITURE = re.compile(
    r"ads?|advert\w*|banners?|sponsor\w*|promos?|promotions?|promoted|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|newsletters?|subscribe|subscription|"
    r"share|shares|sharing|social|sidebars?|sidenav|widgets?|menus?|nav|navs|navbar|navigation|breadcrumbs?|headers?|footers?|masthead|toolbars?|comments?|disqus|reply|replies|"
    r"related|recommended|recommendations?|pagination|pager|login|signup|signin|search"
)
_BESIDE = set(
    "box link links bar block wrapper wrap container list item items btn button buttons icon icons text title label slot unit area section inner outer top bottom left right"
    " site page global primary secondary mobile desktop sticky fixed row col column group panel card post posts article articles story stories entry more thread count toggle"
    " form field input image img logo zone module region user reader site inline follow media google js".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_NAMES = re.compile(r"(?<![\w-])(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|dialog|alert|menu)\b", re.I)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articleBody\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")

NEUTRAL, ARTICLE, FURNITURE = 0, 1, 2


def _furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _SKIP or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("body", "html"):
        return False
    if _ROLE.search(attrs) or _HIDDEN.search(attrs):
        return True
    if tag in _HEADINGS:
        return False
    for m in _NAMES.finditer(attrs):
        if in_article and m[1].lower() == "id":
            continue
        if any(_names_furniture(token, in_article) for token in next(g for g in m.groups()[1:] if g is not None).split()):
            return True
    return False


def _names_furniture(token: str, in_article: bool) -> bool:
    """Whether every part of a name speaks of furniture. In an article a header belongs to it."""
    parts = [x.lower() for x in _PARTS.split(token) if x and not x.isdigit()]
    named = [bool(_FURNITURE.fullmatch(x)) and not (in_article and x in ("header", "headers")) for x in parts]
    return any(named) and all(n or x in _BESIDE or len(x) == 1 for n, x in zip(named, parts, strict=True))


def blocks(page: str) -> list[tuple[str, int]]:
    """The page's lines in order, with the zone each stands in. Inline furniture within a line is a line of its own."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    text: list[tuple[str, int]] = []
    zone, at = NEUTRAL, 0

    def flush() -> None:
        for z in dict.fromkeys(z for _, z in text):
            line = _SPACE.sub(" ", html.unescape("".join(t for t, own in text if own == z))).strip()
            if line:
                out.append((line, z))
        text.clear()

    low = None
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            text.append((page[at : m.start()], zone))
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append((" ", zone))
            continue
        if not closing and tag in _RAW:
            if not attrs.rstrip().endswith("/"):
                low = low if low is not None else page.lower()
                end = low.find(f"</{tag}", at)
                stop = low.find(">", end) if end >= 0 else -1
                at = len(page) if stop < 0 else stop + 1
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _BLOCK or not any(t in _BLOCK for t, _ in stack[k + 1 :]):
                        zone = stack[k][1]
                        del stack[k:]
                    break
        elif tag not in _VOID and not attrs.rstrip().endswith("/"):
            if tag in _BLOCK and tag != "p" and stack and stack[-1][0] == "p":
                zone = stack.pop()[1]
            if tag == "p":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        zone = stack[k][1]
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
            before = zone
            if zone != FURNITURE:
                if _furniture(tag, attrs, zone == ARTICLE):
                    zone = FURNITURE
                elif tag in ("article", "main") or (attrs and _MAIN.search(attrs)):
                    zone = ARTICLE
            stack.append((tag, before))
    text.append((page[at:], zone))
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of lines of a and b."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    found = {*range(lo), *range(ea, len(a))}
    where = defaultdict(list)
    for j in range(eb - 1, lo - 1, -1):
        where[b[j]].append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(lo, ea):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    node = links[-1] if links else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def cut_lines(own: list[str], zones: list[int], near: list[list[str]]) -> tuple[list[str], int]:
    """Own lines that are main text, and how many went because the nearest page that is no copy has them too."""
    shared: set[int] = set()
    size = [len(t) if z != FURNITURE else 0 for t, z in zip(own, zones, strict=True)]
    for other in near:
        found = common_lines(own, other)
        if sum(size[i] for i in found) <= COPY * sum(size):
            shared = found
            break
    kept = [t for i, (t, z) in enumerate(zip(own, zones, strict=True)) if z == ARTICLE or (z == NEUTRAL and i not in shared)]
    return kept, sum(zones[i] != ARTICLE for i in shared)


KEY = ("host", "path", "link", "print")


def _keyed(pages: DataFrame) -> DataFrame:
    """pages with the columns that order them; equal rows are told apart by a salt alone."""
    link = F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        "url",
        "html",
        F.lower(F.regexp_extract(link, r"^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(link, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"),
        link.alias("link"),
        F.xxhash64("url", "html").alias("print"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
    )


def _edges(keyed: DataFrame, ranges: int) -> list[dict]:
    """For each range of keys, in order: its first key, and the first and last REACH different pages in it."""
    slim = keyed.select(*KEY, "salt").repartitionByRange(ranges, *KEY, "salt").sortWithinPartitions(*KEY, "salt")

    def run(batches):
        start, first, last = None, [], deque(maxlen=REACH)
        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in (*KEY, "salt")), strict=True):
                start = start or key
                page = key[: len(KEY)]
                if not last or last[-1] != page:
                    last.append(page)
                    if len(first) < REACH:
                        first.append(page)
        if start:
            page = pa.struct([("host", pa.string()), ("path", pa.string()), ("link", pa.string()), ("print", pa.int64())])
            rows = [[dict(zip(KEY, p, strict=True)) for p in side] for side in ([start[: len(KEY)]], first, last)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r], pa.list_(page)) for r in rows), pa.array([start[-1]], pa.int32())], names=["start", "first", "last", "salt"]
            )

    page = "array<struct<host:string,path:string,link:string,print:long>>"
    found = [
        {"start": (*r["start"][0], r["salt"]), "first": [tuple(x) for x in r["first"]], "last": [tuple(x) for x in r["last"]]}
        for r in map_arrow(slim, run, f"start {page}, first {page}, last {page}, salt int").collect()
    ]
    return sorted(found, key=lambda r: r["start"])


def guests(edges: list[dict]) -> dict[tuple, set[int]]:
    """Pages that other ranges need besides their own: the REACH different ones before each range and after it."""
    out: dict[tuple, set[int]] = defaultdict(set)
    for step, side, own in ((-1, "last", "first"), (1, "first", "last")):
        for i, e in enumerate(edges):
            edge, seen, k = e[own][0 if step < 0 else -1], set(), i + step
            while 0 <= k < len(edges) and len(seen) < REACH:
                for page in edges[k][side][::step]:
                    if page != edge and len(seen) < REACH:
                        seen.add(page)
                if edges[k][side][0][0] != edge[0]:  # another host
                    break
                k += step
            for page in seen:
                out[page].add(i)
    return out


@dataclass
class _Page:
    key: tuple
    lines: list[str]
    zones: list[int]
    rows: list[tuple] = field(default_factory=list)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_shared (lines that went because the page compared with has them)."""
    keyed = _keyed(pages)
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = _edges(keyed, max(1, min(MOST_RANGES, max(least, -(-size // RANGE_BYTES)))))
    starts, others = [e["start"] for e in edges], guests(edges)
    id_kind = dict(pages.dtypes)["page_id"]

    def parse(batches):
        sent: set[tuple] = set()  # guests that this task has sent already
        for b in batches:
            at, where, guest, lines, zones = [], [], [], [], []
            for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in (*KEY, "salt")), strict=True)):
                found = blocks(b.column("html")[k].as_py() or "")
                page = key[: len(KEY)]
                away = others.get(page, ()) if page not in sent else ()
                sent.update([page] if away else ())
                for r in (bisect_right(starts, key) - 1, *away):
                    guest.append(len(guest) > 0 and at[-1:] == [k])
                    at.append(k)
                    where.append(max(r, 0))
                    lines.append([t for t, _ in found])
                    zones.append([z for _, z in found])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where, pa.int32()),
                    *(b.column(c).take(take) for c in (*KEY, "page_id", "url")),
                    pa.array(guest, pa.bool_()),
                    pa.array(lines, pa.list_(pa.string())),
                    pa.array(zones, pa.list_(pa.int8())),
                ],
                names=["range", *KEY, "page_id", "url", "guest", "lines", "zones"],
            )

    parsed = map_arrow(
        keyed,
        parse,
        f"range int, host string, path string, link string, print long, page_id {id_kind}, url string, guest boolean, lines array<string>, zones array<byte>",
    )
    dealt = parsed.repartition(max(1, len(edges)), "range").sortWithinPartitions("range", *KEY)

    def compare(batches):
        kind = None
        held: deque[_Page] = deque()  # up to REACH pages done, the one that waits, those after it
        todo, rows = 0, []  # place in held of the first page that has not been compared

        def finish(k: int) -> None:
            own = held[k]
            if own.rows:
                near = [p for p in list(held)[max(0, k - REACH) : k + REACH + 1] if p is not own and own.key[1] and p.key[:2] == own.key[:2]]
                near.sort(key=lambda p: -len(commonprefix((p.key[2], own.key[2]))))
                kept, cut = cut_lines(own.lines, own.zones, [p.lines for p in near])
                text = "\n\n".join(kept)
                rows.extend((*r, text, len(text), cut) for r in own.rows)

        def made():
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            out = [pa.array(c, t) for c, t in zip(cols, (kind, pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars", "n_shared"])

        for b in batches:
            kind = b.schema.field("page_id").type
            for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in ("range", *KEY)), strict=True)):
                if not held or held[-1].key != key:
                    held.append(_Page(key, b.column("lines")[k].as_py(), b.column("zones")[k].as_py()))
                    while len(held) - 1 - todo > REACH:
                        finish(todo)
                        todo += 1
                        if todo > REACH:
                            held.popleft()
                            todo -= 1
                if not b.column("guest")[k].as_py():
                    held[-1].rows.append((b.column("page_id")[k].as_py(), b.column("url")[k].as_py()))
            yield made()
        if held:
            for k in range(todo, len(held)):
                finish(k)
            yield made()

    return map_arrow(dealt, compare, f"page_id {id_kind}, url string, text string, n_chars long, n_shared long")
