"""Main-text extraction from HTML by line-block distribution.

Markup is stripped into lines, one for each block element. Lines of menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments weigh nothing, nor do lines that are mostly links outside an article; the others
weigh their length. Where a page marks an ``<article>`` or ``<main>``, lines outside it weigh nothing. Weights are summed over
sliding windows of ``window`` lines; a region of text runs from the surge, where the sum rises above the smaller of
``threshold`` and a quarter of the page's largest, to the dive, where it falls to zero. Short lines at a region's ends that stand
in another container than its heaviest line are no part of it, headings excepted. The lines of these regions are kept, and so
are all that stand in the same container (article) as a kept region, so that a last short paragraph behind an advert stays. An element whose class only sounds like boilerplate (``share-price-table``) is
judged by its own line blocks: it stays if they pass the threshold.

Every page is handled on its own in one pass without a shuffle; time is linear in the page's length, whatever is broken.
Edge cases: null or empty html, or a page without article text, gives the empty string; repeated rows and ties are kept as
they are; other columns of ``pages`` are dropped; unclosed comments, scripts and tags reach to the end of the page; from the
first tag that has no end outside quotes, tags end at the next ``>``.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_START = re.compile(r"<(?:[!?]|/?[A-Za-z])")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_DROP = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "template", "noscript", "object", "svg", "canvas", "audio", "video", "map", "datalist", "fieldset"}
#: Words of class names, ids and roles that stand for boilerplate.
_MARKS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "colophon", "sidebar", "aside", "widget", "widgets",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended",
    "recommendations", "comment", "comments", "disqus", "respond", "reply", "replies", "login", "search", "searchbox", "form", "copyright", "pagination", "pager", "toolbar", "skip",
    "complementary", "contentinfo", "dialog",
}
#: Words beside them that change nothing; any other word leaves the judgement to the line blocks.
_BESIDE = {"site", "main", "top", "bottom", "left", "right", "box", "list", "area", "block", "section", "container", "wrapper", "wrap", "inner", "outer", "posts", "post", "articles", "links", "link", "button", "buttons",
           "bar", "item", "items", "primary", "secondary", "global", "page", "slot", "unit", "body", "text", "title", "content", "group", "row", "col", "column", "footer", "mobile", "desktop", "reader", "readers", "user", "users", "policy", "icons", "media", "thread", "js", "ui"}
_READERS = {"comment", "comments", "disqus", "respond", "reply", "replies", "related", "recommended"}
_LAYOUT = {"has", "no", "with", "without", "layout"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARAGRAPHS = _HEADINGS | {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption"}


def _kind(name: str, attrs: str, in_article: bool) -> int:
    """2 for a boilerplate element, 1 for one whose class only has a word of one, 0 for others."""
    if name in _DROP or name == "header" and not in_article:
        return 2
    if "=" not in attrs and "hidden" not in attrs:
        return 0
    found = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if not words & _MARKS or words & _LAYOUT:
                    continue
                if name in ("html", "body", "main", "article", "h1"):
                    found = max(found, 2 * (name == "article" and bool(words & _READERS)))
                else:
                    found = max(found, 2 if words <= _MARKS | _BESIDE or any(w.isdigit() for w in words) and {w for w in words if not w.isdigit()} <= _MARKS | _BESIDE else 1)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return found


def lines_of(page: str) -> list[tuple[str, int, int, int, float, bool]]:
    """Blocks of the page in order: text, kind (2 in boilerplate, 1 in what may be), number of its article (0: none) and of its container, share of link text, whether it is a heading."""
    out: list[tuple[str, int, int, int, float, bool]] = []
    names: list[str] = []  # open elements, outermost first
    flags: list[int] = []
    ids: list[int] = []
    where: dict[str, list[int]] = defaultdict(list)  # places of each name among them
    blocks: list[int] = []  # places of block elements
    boxes: list[int] = [0]  # numbers of open containers
    hard = soft = linked = link_chars = number = 0
    article: list[int] = []
    parts: list[str] = []

    def end_line() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, 2 if hard else 1 if soft else 0, article[0] if article else 0, boxes[-1], link_chars / len(text), bool(blocks) and names[blocks[-1]] in _HEADINGS))
            parts.clear()
        link_chars = 0

    def pop(until: int) -> None:
        nonlocal hard, soft, linked
        while len(names) > until:
            name, flag, own = names.pop(), flags.pop(), ids.pop()
            where[name].pop()
            hard -= flag == 2
            soft -= flag == 1
            linked -= name == "a"
            if name in ("article", "main"):
                article.pop()
            if own:
                boxes.pop()
            if name not in _INLINE:
                blocks.pop()

    def push(name: str, flag: int) -> None:
        nonlocal hard, soft, linked, number
        where[name].append(len(names))
        if name not in _INLINE:
            blocks.append(len(names))
        names.append(name)
        flags.append(flag)
        hard += flag == 2
        soft += flag == 1
        linked += name == "a"
        number += 1
        own = number if name not in _INLINE and name not in _PARAGRAPHS else 0
        ids.append(own)
        if own:
            boxes.append(own)
        if name in ("article", "main"):
            article.append(number)

    at, n, strict, last = 0, len(page), True, page.rfind(">")
    while at < n:
        m = _START.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            parts.append(page[at:begin])
            if linked:
                link_chars += begin - at
        if not m:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", begin):
            end = page.find("]]>", begin)
            parts.append(page[begin + 9:end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        if last <= begin:  # a tag without an end
            break
        if page[begin + 1] in "!?":
            at = page.index(">", begin) + 1
            continue
        found = _NAME.match(page, begin + 1)
        rest = _REST.match(page, found.end()) if strict else None
        if rest is None:
            strict = False
            end = page.index(">", found.end()) + 1
        else:
            end = rest.end()
        at, name, attrs = end, found[1].lower(), page[found.end():end - 1]
        if name not in _INLINE:
            end_line() if name != "br" else parts.append(" ")
        if page[begin + 1] == "/":
            if where[name]:
                place = where[name][-1]
                if name not in _INLINE or not blocks or blocks[-1] < place:
                    pop(place)
            continue
        if name in _RAW:
            end_ = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = end_.start() if end_ else n
            push(name, 2)
            continue
        if name in _VOID or attrs.endswith("/") and name in _INLINE:
            continue
        if name not in _INLINE and blocks and names[blocks[-1]] in _CLOSES.get(name, set()) | {"p"}:
            pop(blocks[-1])
        push(name, _kind(name, attrs, bool(article)))
    end_line()
    return out


def main_text(page: str | None, window: int = 3, threshold: int = 80) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    marked = any(article and kind < 2 for _, kind, article, _, _, _ in lines)
    weights = [0 if kind == 2 or (not article if marked else links > 0.5) else len(text) for text, kind, article, _, links, _ in lines]
    homes = [article or -box for _, _, article, box, _, _ in lines]
    # each container that may be boilerplate is a stretch of its own: its window sums hold no line of others
    stretch = [box if kind == 1 else 0 for _, kind, _, box, _, _ in lines]
    sums, running, size = [0] * len(lines), 0, 0
    for i in range(len(lines) - 1, -1, -1):
        if i + 1 < len(lines) and stretch[i] != stretch[i + 1]:
            running = size = 0
        running, size = running + weights[i], size + 1
        if size > window:
            running, size = running - weights[i + window], window
        sums[i] = running
    least = min(threshold, max(sums, default=0) // 4)
    kept = [False] * len(lines)
    chosen: set[int] = set()
    i = 0
    while i < len(lines):
        if not weights[i] or sums[i] <= least:
            i += 1
            continue
        surge = dive = i
        while dive < len(lines) and sums[dive] > 0 and stretch[dive] == stretch[i]:
            dive += 1
        i = dive
        home = homes[max(range(surge, dive), key=weights.__getitem__)]
        mass: Counter = Counter()
        for j in range(surge, dive):
            mass[homes[j]] += weights[j]
        outside = lambda j: homes[j] != home and mass[homes[j]] <= least and not lines[j][5]  # noqa: B023, E731
        while outside(surge):
            surge += 1
        while outside(dive - 1):
            dive -= 1
        for j in range(surge, dive):
            if weights[j]:
                kept[j] = True
                if not stretch[j] and (homes[j] == home or mass[homes[j]] > least):
                    chosen.add(homes[j])
    return " ".join(x[0] for x, keep, w, apart, home in zip(lines, kept, weights, stretch, homes, strict=True) if keep or w and not apart and home in chosen)


def extract_pages(pages: DataFrame, window: int = 3, threshold: int = 80) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), window, threshold) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
