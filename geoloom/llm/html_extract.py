"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|</?\Z",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "title", "select", "canvas", "video", "audio"}
#: Without an end tag these run to the end of the page; of the others only the tag is left out.
_TO_END = {"script", "style"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "html", "body", "head"}
_CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "label", "search", "fieldset", "header"}
_CHROME_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Parts of class names and ids that stand for furniture, and parts that may stand beside them.
_FURNITURE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification "
    "notifications newsletter subscribe subscription popup modal overlay sidebar side widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead "
    "footer header topbar comment comments commentlist replies reply disqus respond related recommended recommendations share sharing social pagination pager toolbar "
    "login signup banner".split()
)
_BESIDE = set(
    "a area and bar block body bottom box btn button buttons center col column container content foot form global group holder icon icons inner item items js left link links "
    "list main media module outer page panel post posts primary right row secondary section site slot small sticky tag tags the to top unit us wrap wrapper".split()
)
_READERS = {"comment", "comments", "commentlist", "replies", "reply", "disqus", "respond"}
_BODY_NAME = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post|post-?content|entry|entry-?content|story|content|main|main-?content|body-?text)(?:$|[\s_-])", re.I)
_OPEN = {"article", "main"}


class _Page:
    """The page's lines in order, and the tree of its elements but paragraphs, by number (0 is the page itself)."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.linked: list[int] = []  # characters of a line inside links
        self.chrome: list[bool] = []  # page furniture by name, role or tag
        self.at: list[int] = []  # the element a line stands in
        self.parent: list[int] = [-1]
        self.tag: list[str] = [""]
        self.named: list[bool] = [False]  # named as one that holds an article

    def up(self, element: int) -> Iterator[int]:
        while element >= 0:
            yield element
            element = self.parent[element]


def _is_furniture(value: str) -> str:
    """The name among ``value`` (a class or id) that stands for furniture: all its parts do, or may stand beside; or ""."""
    for name in value.lower().replace("side-bar", "sidebar").replace("top-bar", "topbar").split():
        parts = [x for x in re.split(r"[-_\d]+", name) if x]
        if any(x in _FURNITURE for x in parts) and all(x in _FURNITURE or x in _BESIDE for x in parts):
            return name
    return ""


def _is_chrome(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in _CHROME and not (tag == "header" and inside_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in _CHROME_ROLE:
            return True
        if name in ("class", "id") and (found := _is_furniture(value)):
            parts = set(re.split(r"[-_\d]+", found))
            if tag in _OPEN and not parts & (_READERS | {"related", "recommended", "promo", "sponsored", "advert", "advertisement"}):
                continue
            if inside_article and parts <= {"header", "page", "post", "content", ""}:
                continue
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def read_page(page: str) -> _Page:
    """Lines and elements of a page; markup, scripts and styles are stripped, and character references decoded."""
    out = _Page()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, element (a paragraph has its parent's), furniture, in an article
    opened: dict[str, int] = {}
    unended: set[str] = set()
    text: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.text.append(line)
                out.linked.append(linked)
                out.chrome.append(bool(stack) and stack[-1][2])
                out.at.append(stack[-1][1] if stack else 0)
            text.clear()
        linked = 0

    def close(k: int) -> None:
        for gone in stack[k:]:
            opened[gone[0]] -= 1
        del stack[k:]

    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(piece)
            if opened.get("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened.get(tag):
                if tag in _BLOCK or stack[-1][2]:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            elif tag in _BLOCK:
                flush()
            continue
        attrs = m[3] or ""
        if tag in _RAW and not attrs.endswith("/"):
            end = None if tag in unended else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in _TO_END:
                at = len(page)
            else:
                unended.add(tag)
            continue
        if tag in _BLOCK:
            flush()
        if tag in _CLOSES_P and (opened.get("p") or tag == "li"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or tag == stack[k][0] == "li":
                    close(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        if tag in _VOID or attrs.endswith("/"):
            continue
        before = stack[-1] if stack else ("", 0, False, False)
        chrome = before[2] or _is_chrome(tag, attrs, before[3])
        if chrome and not before[2]:
            flush()
        number = before[1]
        if tag in _BLOCK and tag != "p":
            number = len(out.parent)
            out.parent.append(before[1])
            out.tag.append(tag)
            out.named.append(not chrome and (tag in _OPEN or any(
                a[1].lower() in ("class", "id", "itemprop", "role") and _BODY_NAME.search(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(attrs)
            )))
        stack.append((tag, number, chrome, before[3] or tag in _OPEN))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def _core(size: np.ndarray, window: int, surge: int) -> tuple[int, int]:
    """First and last line of the heaviest run between a surge and a dive of the text per window.

    A run surges where a window's text exceeds the threshold, and dives where the windows that follow are empty again. The
    threshold is ``surge`` characters, or a quarter of the fullest window where the page has less text than that asks for.
    """
    sums = np.convolve(size, np.ones(window, np.int64))[window - 1 :]  # of each line and those that follow it
    threshold = min(surge, int(sums.max()) // 4)
    edges = np.flatnonzero(np.diff(np.r_[False, sums > 0, False]))
    runs = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if sums[a:b].max() > threshold]
    first, dive = max(runs, key=lambda r: size[r[0] : r[1]].sum())
    first += int(np.argmax(sums[first:dive] > threshold))
    inside = first + np.flatnonzero(size[first : dive + window - 1])
    return int(inside[0]), int(inside[-1])


def _holder(page: _Page, size: np.ndarray, low: int, high: int, most: float) -> int:
    """The innermost element with at least ``most`` of the core's text, widened to parents that add nothing like a menu."""
    n = len(page.parent)
    weight, menus = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, at in enumerate(page.at):
        menus[at] += 2 * page.linked[k] > len(page.text[k])
        if low <= k <= high:
            weight[at] += size[k]
    for e in range(n - 1, 0, -1):  # a parent has a smaller number
        weight[page.parent[e]] += weight[e]
        menus[page.parent[e]] += menus[e]
    heavy = page.at[low + int(np.argmax(size[low : high + 1]))]
    found = next(e for e in page.up(heavy) if e == 0 or weight[e] >= most * weight[0])
    named = [e for e in page.up(heavy) if page.named[e] and 2 * weight[e] >= weight[0]]
    tagged = [e for e in named if page.tag[e] in _OPEN]
    if tagged:
        return tagged[0]
    if holds := [e for e in named if weight[e] >= most * weight[0]]:
        return holds[0]
    while found and page.tag[up := page.parent[found]] not in ("", "html", "body") and menus[up] == menus[found]:
        found = up
    return 0 if page.tag[found] in ("", "html", "body") else found


def main_text(page: str | None, *, window: int = 3, surge: int = 86, most: float = 0.7) -> str:
    """Text of the article.

    Lengths of text outside links are summed over windows of ``window`` lines. The heaviest run of lines between a surge
    (a window of over ``surge`` characters) and the next dive (empty windows) is the core; no name or role of an element
    has a part in this. The core is then rounded to whole elements, so that short first and last paragraphs and parts
    behind an advert stay in: to the article element around it, or the innermost element with ``most`` of its text. Where
    the article lies open in the page's body, the core's neighbours are kept up to lines that are mere links. Last,
    furniture inside it goes by tag, role and name. If that takes most of the core (a long discussion below a short
    article), the core is sought once more without furniture.
    """
    read = read_page(page or "")
    chrome = np.array(read.chrome, bool)
    size = np.array([max(0, len(t) - n) for t, n in zip(read.text, read.linked, strict=True)], np.int64)
    for size in (size, np.where(chrome, 0, size)):
        if not size.any():
            return ""
        low, high = _core(size, window, surge)
        held = _holder(read, size, low, high, most)
        if held:
            inside = np.zeros(len(read.parent), bool)
            inside[held] = True
            for e in range(held + 1, len(inside)):
                inside[e] = inside[read.parent[e]]
            keep = [k for k, at in enumerate(read.at) if inside[at]]
        else:
            own = np.flatnonzero(~chrome)
            low, high = int(np.searchsorted(own, low)), int(np.searchsorted(own, high, "right")) - 1
            while 0 < low < len(own) and size[own[low - 1]]:
                low -= 1
            while 0 <= high < len(own) - 1 and size[own[high + 1]]:
                high += 1
            keep = own[low : high + 1].tolist()
        kept = [k for k in keep if not chrome[k]]
        if 2 * size[kept].sum() >= size[keep].sum() and kept:
            break
    return " ".join(read.text[k] for k in kept)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text and n_chars (code points of text).

    Null or empty markup, and pages of nothing but furniture, give an empty text. Unclosed, misnested and cut-off markup
    is read as far as it goes, and an element whose end is missing takes nothing with it (a script or style takes the rest
    of the page). Work grows in proportion to a page's length. Repeated rows are all kept; further columns are ignored.
    """
    need(pages, id_col, url_col, html_col)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(p) for p in batch["html"]]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": text, "n_chars": np.array([len(t) for t in text], np.int64)})

    kind = pages.schema[id_col].dataType.simpleString()
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    found = picked.mapInPandas(rows, f"id {kind}, url string, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
