"""Main text of web pages by element rules, and by differencing where a page has no article element.

Pages are cut into lines, one for each block. Pages of a host lie in the order of their URL paths, and
each is paired with the neighbour whose path is nearest. The lines of a pair are aligned by a longest
common subsequence; what both pages say is their template and is deleted. Elements that declare what
they are (navigation, footers, adverts, forms, comments) are deleted on any page. Articles quote each
other, so a line that an article element holds is template only if four neighbours repeat it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and words of class, id and role attributes.
SILENT = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "select", "title")
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "datalist", "fieldset"}
CONTAINERS = DROPPED | {"header", "article", "main", "div", "section", "ul", "ol", "table", "figure", "details", "body", "p", "span", "li"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "img", "ruby", "rb", "rt", "rp", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb",
         "breadcrumbs", "footer", "sidebar", "aside", "complementary", "contentinfo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
         "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "disqus", "replies",
         "respond", "related", "recommended", "recommendations", "pagination", "pager", "search", "widget", "widgets", "copyright", "toolbar", "skip", "hidden"}
OUTER_MARKS = {"header", "masthead", "banner", "topbar"}
ARTICLE, OPEN, GONE = 2, 1, 0
WITNESSES = 4  # neighbours that must all repeat a line of an article element before it is template
NEAREST = 2 * WITNESSES  # different pages a page is compared with at most

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[\s/]*+[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+\s*+/>"  # empty; in HTML no other silent element can be
    rf"|<({'|'.join(SILENT)})\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>?"
    r"|<[a-zA-Z][^>]*\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
APART = re.compile(r"[^a-z0-9]+")


def _declared(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element says that it is no part of the article."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    marks = MARKS if inside_article else MARKS | OUTER_MARKS
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and not marks.isdisjoint(APART.split(value)):
            return True
    return False


@dataclass
class Page:
    lines: list[str]
    kinds: list[int]


def read_page(source: str) -> Page:
    """Lines of a page in order, each in the article, open, or in an element that is deleted."""
    lines, kinds, chunks = [], [], []
    stack: list[tuple[str, int]] = []  # open containers with the kind of what they hold
    kind, at = OPEN, 0

    def ended() -> None:
        if chunks:
            text = " ".join("".join(chunks).split())
            if text:
                lines.append(text)
                kinds.append(kind)
            chunks.clear()

    for token in TOKEN.finditer(source):
        if token.start() > at:
            text = source[at:token.start()]
            chunks.append(entities.unescape(text) if "&" in text else text)
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            ended()
        if token[2] or token[5]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1] != kind or len(stack) - i > 1:
                        ended()
                    del stack[i:]
                    kind = stack[-1][1] if stack else OPEN
                    break
        elif tag in CONTAINERS and tag not in VOID:
            attributes = token[4] or token[7] or ""
            if tag in ("p", "li"):  # a paragraph or item ends the one before
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        kind = stack[-1][1] if stack else OPEN
                        break
                    if stack[i][0] not in ("p", "span"):
                        break
            inner = kind
            if _declared(tag, attributes, kind == ARTICLE):
                inner = GONE
            elif kind != GONE and (tag in ("article", "main") or 'role="main"' in attributes):
                inner = ARTICLE
            if inner != kind:
                ended()
            stack.append((tag, inner))
            kind = inner
    if at < len(source):
        text = source[at:]
        chunks.append(entities.unescape(text) if "&" in text else text)
    ended()
    return Page(lines, kinds)


def _row(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of `a` with each beginning of `b`, bit by bit in parallel."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[str], b: list[str]) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`, in linear space."""
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, k, j, m = work.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append(k)
        if i == k or j == m or set(a[i:k]).isdisjoint(b[j:m]):
            continue
        if k - i == 1:
            out.append(i)
            continue
        half = (i + k) // 2
        ahead = _row(a[i:half], b[j:m])
        back = _row(a[half:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int((ahead + back).argmax())
        work += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def main_text(page: Page, others: list[Page]) -> str:
    """The article of a page, given the pages of the nearest URLs, nearest first.

    The lines of the page outside deleted elements are aligned with those of each nearest page; a page of the
    same lines is a copy, not a witness of the template. Without an article element, the lines are kept that
    the nearest page does not share. Where a page shares more than four fifths of these, it may be a revision
    or the template may be long: then the next one decides, and if all share so much, what all of them share
    goes. Of the lines of an article element, those go that WITNESSES nearest pages share, all of them; a page
    that shares more than a fifth of the article quotes or revises it and is no witness."""
    mine, article = shown(page), held(page)
    if not any(article):
        return _text(mine, _template(mine, others))
    notices = _notices(mine, article, others)
    return _text(mine, {i for i, own in enumerate(article) if not own or i in notices})


def _text(lines: list[str], gone: set[int]) -> str:
    return " ".join(t for i, t in enumerate(lines) if i not in gone)


def _template(mine: list[str], others: list[Page]) -> set[int]:
    """Positions of the lines of a page without an article element that its neighbours say too."""
    size = sum(map(len, mine))
    by_all: set[int] | None = None
    for other in others:
        theirs = shown(other)
        if theirs == mine:
            continue
        shared = set(common(mine, theirs))
        by_all = shared if by_all is None else by_all & shared
        if 5 * sum(len(mine[i]) for i in shared) <= 4 * size:
            by_all = shared
            break
    return by_all or set()


def _notices(mine: list[str], article: bytes, others: list[Page]) -> set[int]:
    """Positions of the article lines that all of WITNESSES neighbours say too; none with fewer witnesses."""
    size = sum(len(t) for t, own in zip(mine, article, strict=True) if own)
    by_all: set[int] | None = None
    seen = 0
    for other in others:
        theirs = shown(other)
        if theirs == mine:
            continue
        shared = {i for i in common(mine, theirs) if article[i]}
        if 5 * sum(len(mine[i]) for i in shared) > size:
            continue
        by_all = shared if by_all is None else by_all & shared
        seen += 1
        if not by_all or seen == WITNESSES:
            break
    return by_all if by_all and seen == WITNESSES else set()


def shown(page: Page) -> list[str]:
    """The lines outside deleted elements."""
    return [t for t, k in zip(page.lines, page.kinds, strict=True) if k != GONE]


def held(page: Page) -> bytes:
    """For each shown line whether an article element holds it."""
    return bytes(k == ARTICLE for k in page.kinds if k != GONE)


@dataclass
class Run:
    """Neighbouring rows of one host whose pages have the same shown lines: the first and last path, and the rows
    not told yet, each with which of the lines its article elements hold."""

    host: str | None
    lines: list[str]
    first: str
    last: str
    rows: list[tuple]

    @property
    def open_page(self) -> Page:
        return Page(self.lines, [OPEN] * len(self.lines))


def nearest(path: str, earlier: list[Run], later: list[Run]) -> list[int]:
    """Numbers of the nearest runs, by the beginning that their paths share: -1 is the first before, 1 the first after."""
    back = [len(commonprefix([r.last, path])) for r in earlier]
    ahead = [len(commonprefix([r.first, path])) for r in later]
    out, i, j = [], 0, 0
    while len(out) < NEAREST and (i < len(back) or j < len(ahead)):
        if j == len(ahead) or i < len(back) and back[i] >= ahead[j]:
            i += 1
            out.append(-i)
        else:
            j += 1
            out.append(j)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Pages are sorted by host, path and id in ranges, so a host with a third of all pages is spread; a
    task reads its range as a stream and holds the lines of seventeen different pages, and ids and URLs of their
    copies. A page's neighbours are the nearest of its range, before and after, that have other lines. A page without one or
    with a null URL is read by its elements alone. Null
    or empty html: an empty text. Broken markup: elements end where their parents end, a torn tag at the
    end is dropped. Repeated rows are each other's copies: a row each. Null ids: ordered first. Empty
    table: no rows. Other columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1).alias("path"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past: list[Run] = []  # runs told, the nearest first
        ahead: list[Run] = []  # runs not told yet, in order

        def decided() -> Iterator[tuple]:
            """Tells the first run that is left, by up to NEAREST different pages of its host on each side."""
            run = ahead.pop(0)
            same = [] if run.host is None else [r for r in past if r.host == run.host]
            later = [] if run.host is None else [r for r in ahead if r.host == run.host]
            told_: dict[tuple, str] = {}
            for page_id, url, path, article in run.rows:
                by = nearest(path, same, later)
                key = (article, *by)
                if key not in told_:
                    page = Page(run.lines, [ARTICLE if own else OPEN for own in article])
                    told_[key] = main_text(page, [(same[-k - 1] if k < 0 else later[k - 1]).open_page for k in by])
                yield page_id, url, told_[key]
            run.rows.clear()
            past.insert(0, run)
            del past[NEAREST:]

        def rows_() -> Iterator[tuple]:
            masks: dict[bytes, bytes] = {}
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "host", "path")]
                sources = batch.column("html")
                for page_id, url, host, path, i in zip(*columns, range(batch.num_rows), strict=True):
                    page, path = read_page(sources[i].as_py()), path or ""
                    lines, article = shown(page), held(page)
                    if not ahead or ahead[-1].host != host or ahead[-1].lines != lines:
                        while ahead and (len(ahead) > NEAREST or ahead[0].host != host):
                            yield from decided()
                        ahead.append(Run(host, lines, path, path, []))
                        masks.clear()
                    ahead[-1].last = path
                    ahead[-1].rows.append((page_id, url, path, masks.setdefault(article, article)))
            while ahead:
                yield from decided()

        out, size = [], 0
        for row in rows_():
            out.append(row)
            size += len(row[2])
            if len(out) >= 1000 or size > 4_000_000:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    kind = pages.schema[id_col].dataType.simpleString()
    ids = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()
    made = _output(ids)
    return rows.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id").mapInArrow(told, f"page_id {kind}, url string, text string, n_chars long")


def _output(ids: pa.DataType):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], ids), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()),
            pa.array([len(r[2]) for r in rows], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return batch
