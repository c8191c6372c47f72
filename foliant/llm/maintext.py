"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page. A line weighs as many characters as it has outside links, and nothing
if its element says that it is no article text (menus, forms, notices and the like). Weights are summed over sliding windows of
lines; where the sums surge over a threshold the main text begins, where they dive below it ends. Lines between are kept, and those
beside them that share their parent, or are the heading before them.

A page that marks its article needs no guess about where text is dense: then only lines of the article weigh, links included, and any
text is above the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: A surge reaches this many characters, or this share of the page's highest sum if that is less.
SURGE, SHARE = 80, 0.3
#: Spans with at least this share of the largest one's characters are kept beside it.
BESIDE = 0.3

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements by what they mean in HTML.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "template", "xmp", "svg"}
NEVER = {"head", "nav", "footer", "aside", "button", "select", "dialog", "menu", "object", "video", "audio", "canvas"}
UNLESS_AROUND = {"header", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An element of the first kind ends where one of the second begins, unless one of the third lies between.
ENDED_BY = {
    "p": (BLOCKS - {"body", "html"}, {"td", "th", "div", "li", "article", "section"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr"}, {"table"}),
    "th": ({"td", "th", "tr"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "head": ({"body"}, set()),
}
#: What begins ends these.
ENDS = {name: [k for k, (by, _) in ENDED_BY.items() if name in by] for name in BLOCKS}

# Words of class names, ids and roles by which pages name what is no article text.
NOT_TEXT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "submenu", "menubar",
    "breadcrumb", "breadcrumbs", "sidebar", "complementary", "header", "masthead", "footer", "contentinfo", "comment", "comments", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "alertdialog", "dialog", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "search", "copyright",
}
OF_READERS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
#: Beside these words a name tells of the layout ("has-sidebar") or of the article's own heading ("entry-header").
LAYOUT, OWN = {"has", "with", "no", "without"}, {"article", "entry", "post", "story", "content", "main"}


def names_no_text(attributes: str, article: bool) -> bool:
    """Whether an element's class, id or role names it as none of the article's text, or it is hidden."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                words = {w.lower() for w in WORD.findall(one)}
                found = words & NOT_TEXT
                if article:
                    found = words & OF_READERS if len(words) == 1 else set()
                if found and not words & LAYOUT and not (found == {"header"} and words & OWN):
                    return True
    return False


class Lines:
    """The blocks of a page: texts, characters outside links, parents, and the elements around them that decide what they are."""

    def __init__(self, html: str):
        self.text: list[str] = []
        self.plain: list[int] = []
        self.parent: list[int] = []
        self.heading: list[bool] = []
        self.article: list[int] = []
        self.doubtful: list[tuple[int, ...]] = []
        self.around: dict[int, tuple[int, ...]] = {}
        self.mains: set[int] = set()
        self.in_main: list[bool] = []
        self._read(html)

    def _read(self, html: str) -> None:
        open_: list[tuple[str, int]] = []
        state = [(0, 0, (), False, False, False)]  # parent block, article, doubtful elements, in main, never text, in a link
        held: list[tuple[str, bool]] = []
        at = n = 0

        def flush() -> None:
            if not held:
                return
            parent, article, doubtful, main, never, _ = state[-1]
            text = plain = "" if never else " ".join(unescape("".join([t for t, _ in held])).split())
            if text and any([linked for _, linked in held]):
                plain = " ".join(unescape("".join([t for t, linked in held if not linked])).split())
            held.clear()
            self.text.append(text)
            self.plain.append(len(plain))
            self.heading.append(any([name == "h1" for name, _ in open_[-3:]]))
            self.parent.append(parent)
            self.article.append(article)
            self.doubtful.append(doubtful)
            self.in_main.append(main)

        def close(k: int) -> None:
            if held and (open_[k][0] in BLOCKS or any([name in BLOCKS for name, _ in open_[k + 1 :]])):
                flush()
            del open_[k:], state[k + 1 :]

        while at < len(html):
            found = TAG.search(html, at)
            if not found:
                held.append((html[at:], state[-1][5]))
                break
            if found.start() > at:
                held.append((html[at : found.start()], state[-1][5]))
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
                if k is not None:
                    close(k)
                elif name in BLOCKS:
                    flush()
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if name == "br":
                held.append((" ", state[-1][5]))
                continue
            if name in BLOCKS:
                flush()
                for ended in ENDS[name]:
                    for k in range(len(open_) - 1, -1, -1):
                        if open_[k][0] == ended:
                            close(k)
                            break
                        if open_[k][0] in ENDED_BY[ended][1]:
                            break
            if name in VOID or found[3].endswith("/") and name not in BLOCKS:
                continue
            n += 1
            parent, article, doubtful, main, never, link = state[-1]
            attributes = found[3]
            is_article, is_main = name == "article" or 'role="article"' in attributes, name == "main" or 'role="main"' in attributes
            if name in NEVER:
                never = True
            elif name in UNLESS_AROUND and not (name == "header" and article) or name not in ("html", "body") and not is_main and attributes and names_no_text(attributes, is_article):
                doubtful = (*doubtful, n)
            if is_article:
                article = n
                self.around[n] = doubtful
            if is_main:
                main = True
                self.around[n] = doubtful
                self.mains.add(n)
            if name in BLOCKS and name not in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
                parent = n
            open_.append((name, n))
            state.append((parent, article, doubtful, main, never, link or name == "a"))
        flush()


def spans(weights: list[int], threshold: float) -> list[tuple[int, int]]:
    """Stretches (first, end) of lines from a surge of the window sums over the threshold to their dive below it.

    A stretch begins with the first line of its first window, and ends with the last one of its last, that weighs a line's share of the threshold.
    """
    total = [0, *accumulate(weights)]
    n, share = len(weights), threshold / WINDOW
    high = [total[min(i + WINDOW, n)] - total[i] >= threshold for i in range(n)]
    found: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if not high[i]:
            i += 1
            continue
        first = next(k for k in range(i, n) if weights[k] >= share)
        while i < n and high[i]:
            i += 1
        end = 1 + next(k for k in range(min(i - 2 + WINDOW, n - 1), -1, -1) if weights[k] >= share)
        if found and first < found[-1][1]:
            first = found.pop()[0]
        found.append((first, end))
    return found


def _chosen(lines: Lines) -> tuple[list[bool] | None, set[int]]:
    """Lines of the page's article, if it marks one, and the doubtful elements around it, which are none then."""
    articles: dict[int, int] = {}
    for text, article, doubtful in zip(lines.text, lines.article, lines.doubtful, strict=True):
        if article and doubtful == lines.around[article]:
            articles[article] = articles.get(article, 0) + len(text)
    # An article of readers, or in a list of other articles, is in doubt itself.
    sure = {a: n for a, n in articles.items() if n and not lines.around[a]} or {a: n for a, n in articles.items() if n}
    in_main = sum(len(t) for t, m, d, a in zip(lines.text, lines.in_main, lines.doubtful, lines.article, strict=True) if m and not d and not a)
    if sure:
        best = max(sure, key=lambda a: sure[a])
        if sure[best] >= BESIDE * in_main:
            return [a == best for a in lines.article], set(lines.around[best])
    if in_main:
        return [m and not a for m, a in zip(lines.in_main, lines.article, strict=True)], set().union(*[lines.around[m] for m in lines.mains])
    return None, set()


def main_text(html: str | None) -> str:
    """The main text of a page, one line for each block; empty if there is none."""
    if not html:
        return ""
    lines = Lines(html)
    for trusting in (False, True):
        marked, around = _chosen(lines)
        allowed = [trusting or not set(d) - around for d in lines.doubtful]
        if marked:
            weights = [len(t) if m and ok else 0 for t, m, ok in zip(lines.text, marked, allowed, strict=True)]
            kept = spans(weights, 1)
        else:
            weights = [n if ok else 0 for n, ok in zip(lines.plain, allowed, strict=True)]
            total = [0, *accumulate(weights)]
            peak = max((total[min(i + WINDOW, len(weights))] - total[i] for i in range(len(weights))), default=0)
            kept = _beside(lines, weights, spans(weights, max(1, min(SURGE, SHARE * peak))))
        if kept:
            break
    inside = [lines.text[i] for first, end in kept for i in range(first, end) if allowed[i] and (not marked or marked[i])]
    return "\n".join(t for t in inside if t)


def _beside(lines: Lines, weights: list[int], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that hold enough text beside the largest, each with the lines next to it that share a parent with its own, or are the page's heading before it."""
    sums = [sum(weights[a:b]) for a, b in found]
    kept, last = [], 0
    for (a, b), size in zip(found, sums, strict=True):
        if size < BESIDE * max(sums):
            continue
        parents = {lines.parent[i] for i in range(a, b) if weights[i] >= SHARE * max(weights[a:b])}
        while a > last and weights[a - 1] and (lines.parent[a - 1] in parents or lines.heading[a - 1]):
            a -= 1
        while b < len(weights) and weights[b] and lines.parent[b] in parents:
            b += 1
        a, last = max(a, last), max(b, last)
        if a < b:
            kept.append((a, b))
    return kept


def _extracted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        html = batch.column(1)
        for k in range(0, batch.num_rows, 200):
            texts = [main_text(b.as_py().decode("utf-8", "replace")) for b in html[k : k + 200]]
            yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 200], pa.array(texts, pa.string())], names=["_row", "_text"])


def extract(pages: DataFrame, html: str = "html", to: str = "main_text") -> DataFrame:
    """Adds the main text of each page to its row.

    Null and empty pages, and pages without text, have the empty text. Null ids and repeated rows stay as rows of their own. Other columns pass
    through; one of the new column's name is replaced. No shuffle: a page is read in the task that holds its row.
    """
    kept = [c for c in pages.columns if c != to]
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("_html"))
    row = held.schema["_row"].dataType.simpleString()
    found = held.mapInArrow(_extracted, f"_row {row}, _text string")
    return found.select([F.col(f"_row.`{c}`").alias(c) for c in kept] + [F.col("_text").alias(to)])
