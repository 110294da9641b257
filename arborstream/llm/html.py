"""Main text of web pages by nearest-URL page differencing, guarded by the page's own structure.

A page's text blocks are aligned with those of the page nearest to it by URL
path within its host; blocks that both share are the site's frame and go.
Differencing alone gives wrong results in two ways: a frame may differ from
page to page (menus of other words, a footer with a changing line), and two
pages may truly share lines of their articles.  So marked-up frames go whatever
the neighbour holds, and blocks inside an article stay.  A mark is an element,
a role, a hidden state or a whole class; where a word is only part of a class,
the neighbour decides.  A third: a page's nearest page may be a copy of it,
which shares everything.  So pages of one path and query, or of nearly the same
text, that follow each other are a run, and each page of a run is differenced
against the pages beside the run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import pairwise
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .neighbours import AFTER, BEFORE, OWN, deal, ranges, unsqueeze

#: Text, frame, whether it is the article's.
Block = tuple[str, int, bool]

# Elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav header footer aside form script style noscript template head title select button textarea iframe object svg canvas dialog menu search".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT = frozenset("article main".split())
#: Classes and ids (whole ones) that mark frames.
FRAME_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary contentinfo cookie cookies footer header menu menubar "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted related search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget".split()
)
#: Classes and ids of reader comments, which are often articles themselves.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: Roles that mark frames, and those that mark the article.
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
KEPT_ROLES = frozenset("article main".split())
#: Pages that share this part of their text outside marked frames (by characters, of the longer one) are copies.
COPY = 0.9
#: Of a block: the article's or none of these; in a frame by its class alone; in a frame by its element, role or state.
PLAIN, MARKED, FRAME = 0, 1, 2
# a quote opens a value only right after the equals sign
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*+))*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S*)))?""")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def attributes_of(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of repeated ones the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _signs(tag: str, text: str) -> tuple[int, bool, bool]:
    """What an element says of its blocks: frame (PLAIN, MARKED or FRAME), whether it is the article, whether a part of a class is a frame word.

    An article's own classes say nothing of its text, but for reader comments.
    """
    if tag in DROPPED:
        return FRAME, False, False
    kept = tag in KEPT
    if not text or not _TELLING.search(text):
        return PLAIN, kept, False
    own = attributes_of(text)
    roles = set(own.get("role", "").lower().split())
    kept = kept or not roles.isdisjoint(KEPT_ROLES)
    hidden = own.get("hidden", "until-found").lower() != "until-found" or own.get("aria-hidden", "").lower() == "true" or _NONE.search(own.get("style", ""))
    names = set(f"{own.get('class', '')} {own.get('id', '')}".lower().split())
    if tag in ("html", "body"):
        return PLAIN, kept, False
    if hidden or not roles.isdisjoint(FRAME_ROLES) or not names.isdisjoint(COMMENT_WORDS):
        return FRAME, kept, False
    if kept:
        return PLAIN, True, False
    if not names.isdisjoint(FRAME_WORDS):
        return MARKED, False, False
    return PLAIN, False, any(not (FRAME_WORDS | COMMENT_WORDS).isdisjoint(_WORD.findall(n)) for n in names)


def blocks(html: str) -> list[Block]:
    """Text blocks in page order: (text, PLAIN, MARKED or FRAME, whether the article's).

    One pass over the markup.  Character references are decoded and white
    space is one space; empty blocks are left out.  Unclosed elements end with
    the element around them.  A class outside an article says nothing of the
    article's blocks; a class of which only a part is a frame word takes its
    element out of the article, so that the neighbour decides.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []
    text: list[str] = []
    frame, kept, at, n = PLAIN, False, 0, len(html)

    def flush() -> None:
        if text:
            block = _SPACE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if block:
                out.append((block, frame, kept))

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS or tag in DROPPED:
                flush()
            for j in range(len(stack) - 1, -1, -1):
                if stack[j][0] == tag:
                    frame, kept = stack[j][1:]
                    del stack[j:]
                    break
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and any(s[0] == tag for s in stack[-3:]):
            # an element of this kind ends the open one; what inline elements it holds end with it
            for j in range(len(stack) - 1, -1, -1):
                if stack[j][0] == tag:
                    if not any(s[0] in BLOCKS for s in stack[j + 1 :]):
                        frame, kept = stack[j][1:]
                        del stack[j:]
                    break
        stack.append((tag, frame, kept))
        own, article, suspect = _signs(tag, m[3])
        if article and frame == MARKED:
            frame = PLAIN
        frame = max(frame, own)
        kept = article or (kept and not suspect)
    flush()
    return out


def _steps(state: int, n: int) -> int:
    """Length of the longest common subsequence with the last n lines."""
    return n - (state & ((1 << n) - 1)).bit_count()


def shared_lines(page: list[str], other: list[str]) -> set[int]:
    """Places in `page` of the lines of a longest common subsequence with `other`."""
    found: set[int] = set()
    a, b = 0, 0
    while a < min(len(page), len(other)) and page[a] == other[a]:
        found.add(a)
        a += 1
    while b < min(len(page), len(other)) - a and page[-1 - b] == other[-1 - b]:
        found.add(len(page) - 1 - b)
        b += 1
    x, y = page[a : len(page) - b], other[a : len(other) - b]
    # bit q of rows[i] says whether line len(y) - 1 - q lengthens the longest common subsequence of x[i:] and what follows it in y
    m = len(y)
    full = (1 << m) - 1
    at: dict[str, int] = {}
    for j, line in enumerate(y):
        at[line] = at.get(line, 0) | 1 << (m - 1 - j)

    def back(v: int, lo: int, hi: int) -> list[int]:
        """States of rows hi - 1 down to lo, from that of row hi."""
        out = []
        for line in reversed(x[lo:hi]):
            both = v & at.get(line, 0)
            v = ((v + both) | (v - both)) & full
            out.append(v)
        return out

    # every step-th state is kept and those between are made again, so memory is lines times the root of lines, in bits
    step = isqrt(len(x)) + 1
    kept = {len(x): full}
    for hi in range(len(x), 0, -step):
        kept[max(0, hi - step)] = back(kept[hi], max(0, hi - step), hi)[-1]
    i = j = 0
    for lo, hi in pairwise(sorted(kept)):
        rows = [*reversed(back(kept[hi], lo, hi)), kept[hi]]
        while i < hi and j < m:
            if x[i] == y[j]:
                found.add(a + i)
                i, j = i + 1, j + 1
            # a bit that is 0 in the state is a step up of the length
            elif j + 1 == m or _steps(rows[i + 1 - lo], m - j) >= _steps(rows[i - lo], m - j - 1):
                i += 1
            else:
                j += 1
    return found


def main_text(page: list[Block], other: list[Block] | None) -> tuple[str, int]:
    """The page's text, and how many lines the neighbour shares.

    Where nothing stands outside frames that only a class marks, the classes
    are those of the whole page, and the neighbour alone decides.
    """
    shared = shared_lines([b[0] for b in page], [b[0] for b in other]) if other else set()
    least = MARKED if all(frame for _, frame, _ in page) else PLAIN
    lines = [b for i, (b, frame, kept) in enumerate(page) if frame <= least and (kept or i not in shared)]
    return "\n".join(lines), len(shared)


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


class _Page:
    """A page in order; the blocks of one that waits are made again from its squeezed bytes."""

    __slots__ = ("page_id", "url", "packed", "host", "path", "held", "sketch")

    def __init__(self, page_id: int | None, url: str | None, packed: bytes | None, host: str, path: str) -> None:
        self.page_id, self.url, self.packed, self.host, self.path = page_id, url, packed, host, path
        self.held: list[Block] | None = self.blocks()
        self.sketch = sketch(self.held)

    def blocks(self) -> list[Block]:
        return getattr(self, "held", None) or blocks(unsqueeze(pa.array([self.packed], pa.binary()))[0] or "")


def sketch(page: list[Block]) -> Counter[str]:
    """Characters of each line outside marked frames, by a hash of the line."""
    out: Counter[str] = Counter()
    for line, frame, _ in page:
        if not frame:
            out[blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()] += len(line)
    return out


def copies(host: str, path: str, a: Counter[str], other_host: str, other_path: str, b: Counter[str]) -> bool:
    """Whether two pages of a host have the same path and query or nearly the same text."""
    if host != other_host:
        return False
    longer = max(a.total(), b.total())
    return path == other_path or (longer > 0 and (a & b).total() >= COPY * longer)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [" ".join(f"{h}:{n}" for h, n in sketch(blocks(t or "")).items()) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], names=[*batch.schema.names[1:], "sketch"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, path, page_id, sketch, __part, __edge) by range and key to one a range.

    __part; whether its first row begins a run; the first row that begins one;
    the row before the last that does (nulls: none).
    """
    got: list[tuple] = []
    last: tuple | None = None
    for batch in batches:
        columns = [unsqueeze(batch.column(j)) if j == 3 else batch.column(j).to_pylist() for j in range(6)]
        for host, path, pid, text, part, edge in zip(*columns, strict=True):
            if edge == AFTER or (edge == BEFORE and part == 0):  # the order is no ring here
                continue
            now = (host, path, pid), Counter({h: int(n) for h, n in (x.split(":") for x in text.split())}), part
            if last is not None and last[2] != part:
                last = None
            if edge == OWN:
                begins = last is None or not copies(*now[0][:2], now[1], *last[0][:2], last[1])
                if not got or got[-1][0] != part:
                    got.append((part, begins, None, None))
                if begins:
                    got[-1] = (part, got[-1][1], got[-1][2] or now[0], last and last[0])
            last = now
    key = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64())])
    named = [[r[0], r[1], *[k and dict(zip(("host", "path", "page_id"), k, strict=True)) for k in r[2:]]] for r in got]
    kinds = (pa.int32(), pa.bool_(), key, key)
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in named], k) for j, k in enumerate(kinds)], names=["part", "begins", "first", "before"])


def beside_runs(rows: DataFrame, keys: list[str], edges: list[tuple[tuple, tuple]]) -> list[tuple[tuple | None, tuple | None]]:
    """For each range the keys of the row before the run that holds its first row, and of the row after the run that holds its last one."""
    kinds = "host string, path string, page_id long"
    sketches = rows.select("html", *keys).mapInArrow(_sketches, f"{kinds}, sketch string")
    dealt = deal(sketches, keys, edges, "sketch")
    ordered = dealt.sortWithinPartitions("__part", F.col("__edge") != BEFORE, *[F.asc_nulls_first(k) for k in keys])
    key = f"struct<{kinds.replace(' string', ':string').replace(' long', ':long')}>"
    found = {r.part: r for r in ordered.mapInArrow(_runs, f"part int, begins boolean, first {key}, before {key}").collect()}  # one row a range
    left: list[tuple | None] = []
    right: list[tuple | None] = []
    carried = None
    for p in range(len(edges)):
        left.append(edges[p - 1][1] if p and found[p].begins else carried)
        if found[p].first is not None:
            carried = found[p].before and tuple(found[p].before)
    carried = None
    for p in reversed(range(len(edges))):
        right.append(carried)
        if found[p].first is not None:
            carried = tuple(found[p].first)
    return list(zip(left, reversed(right), strict=True))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, host, path, __part, __edge) by range, host, path: each with the nearer of the two pages beside its run."""
    part: int | None = None
    ahead: _Page | None = None
    last: _Page | None = None
    run: list[_Page] = []

    def one(page: _Page, beside: list[_Page | None]) -> tuple:
        near = [(-_alike(page.path, r.path), k, r) for k, r in enumerate(beside) if r is not None and r.host == page.host and not same(page, r)]
        best = min(near, key=lambda x: x[:2])[2] if near else None
        text, shared = main_text(page.blocks(), best.blocks() if best else None)
        return page.page_id, page.url, text, len(text), shared

    def same(a: _Page, b: _Page) -> bool:
        return copies(a.host, a.path, a.sketch, b.host, b.path, b.sketch)

    def finish(right: _Page | None) -> Iterator[pa.RecordBatch]:
        for r in (ahead, right):
            if r is not None:
                r.held = r.blocks()
        for a in range(0, len(run), 512):
            rows = [one(page, [ahead, right]) for page in run[a : a + 512]]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["page_id", "url", "text", "n_chars", "shared_lines"])
        run.clear()

    for batch in batches:
        for pid, url, packed, host, path, p, edge in zip(*[batch.column(j).to_pylist() for j in range(7)], strict=True):
            page = _Page(pid, url, packed, host, path)
            if p != part:
                yield from finish(None)
                part, ahead, last = p, None, None
            if edge == BEFORE:
                ahead = page
                continue
            if edge == AFTER:
                yield from finish(page)
                continue
            if last is not None and not same(page, last):
                yield from finish(page)
                ahead = last
            if run:
                page.held = None
            run.append(page)
            last = page
    yield from finish(None)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, shared_lines for every page.

    Pages lie in order of host, path (with its query) and id; pages that follow
    each other with one path, or nearly the same text, are a run.  Each page is differenced
    against the one of the two pages beside its run, on its host and no copy of
    it, with more leading path segments in common (the earlier one on a tie).
    A page without any is not differenced.  A
    null html is empty and gives an empty text; a null url is a host of its
    own.  Repeated rows are separate pages.  A page is read whole, however
    long; aligning n lines with n others takes n times the root of n bits.  A
    run of any length spreads over ranges of pages, and a task holds the part
    of it in its range, compressed.  An empty table gives no rows; other
    columns are ignored.
    """
    arrow_rows(pages.sparkSession, 512)
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1).alias("path"),
    )
    keys = ["host", "path", "page_id"]
    edges = ranges(rows.select(*keys))
    dealt = deal(rows, keys, edges, "html", beside_runs(rows, keys, edges))
    place = F.when(F.col("__edge") == BEFORE, 0).when(F.col("__edge") == AFTER, 2).otherwise(1)
    ordered = dealt.sortWithinPartitions("__part", place, *[F.asc_nulls_first(k) for k in keys], "html")
    return ordered.mapInArrow(_pairs, "page_id long, url string, text string, n_chars long, shared_lines long")
