"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element ends a line.  Lines inside
elements that never hold main text (navigation, headers, footers, sidebars,
adverts, forms, notices, comments) are taken out first, so a box inside the
article, however long, leaves no gap.  The distribution of the other lines is
the text length, without link text, summed over a sliding window of lines;
what counts is how far it stands above a low level, and the stretch with the
greatest sum is the main text: it starts where the distribution surges and
ends where it dives for good.  Lines inside an article or main element weigh
double; where one such element holds at least half of the stretch's text, its
lines, all of them, are the main text.  An article inside a wrapper whose class
sounds like a sidebar or the like counts if it outweighs all text outside.

White space inside a block becomes one space; character references are
decoded; blocks are joined by a line feed.  Null html gives an empty text, and
so does a page without text.  Unclosed elements end where an enclosing element
ends.  Rows are independent, nothing is shuffled, other columns are ignored,
whole pages are read however long they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terraloom.llm.common import table

# Every alternative either ends before the next "<" or takes the rest of the page, so no place is read twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>])*+)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)|([^<]+|<)", re.S)
#: Elements whose content is no markup, with the pattern of their end.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "textarea", "select", "iframe")}
ATTR = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: What hides an element from readers; quoted values are blanked before the first, so that a word in one doesn't count.
HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])""", re.I)
UNSEEN = re.compile(r"""(?<![\w-])(?:style\s*=\s*(?:"[^"]*?(?:display\s*:\s*none|visibility\s*:\s*hidden)|'[^']*?(?:display\s*:\s*none|visibility\s*:\s*hidden))|aria-hidden\s*=\s*["']?true)""", re.I)
QUOTES = re.compile(r""""[^"]*"|'[^']*'""")
SPACE = re.compile(r"\s+")

#: Elements that don't end a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text.
NEVER = frozenset("head title nav header footer aside form button input dialog menu object applet canvas audio video".split())
#: Words that mark such elements if a class, id or role is one of them, or starts or ends with one (``site-footer``, ``comment-list``).
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: First words of names that only tell what a wrapper has (``has-sidebar``).
TELLS = frozenset("has with without no is not show hide".split())
OUT, PLAIN, MAIN, INNER = 0, 1, 2, 3
LEVEL = 80


def _around(marks: list[str]) -> bool:
    for mark in marks:
        words = re.split(r"[_-]+", mark)
        if words[0] not in TELLS and (words[0] in AROUND or words[-1] in AROUND):
            return True
    return False


def _hidden(attrs: str) -> bool:
    low = attrs.lower()
    return ("hidden" in low or "none" in low) and bool(UNSEEN.search(attrs) or HIDDEN.search(QUOTES.sub('""', attrs)))


def lines(page: str) -> list[tuple[str, int, int, int]]:
    """The page's lines with text: text, where it stands, its article or main element (0: none), length without links.

    Where: OUT, PLAIN, MAIN (in an article or main element) or INNER (in one inside a wrapper that is OUT by its name).
    """
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, tuple[int, int, bool]]] = []
    parts: list[str] = []
    where, region, by_name, regions = PLAIN, 0, False, 0
    linked, in_links = False, 0

    def flush() -> None:
        nonlocal in_links
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", entities.unescape(raw)).strip()
            if text:
                out.append((text, where, region, round(len(text) * (1 - in_links / len(raw)))))
            parts.clear()
            in_links = 0

    open_: dict[str, int] = {}  # how many elements of a name are open

    def close() -> str:
        nonlocal where, region, by_name
        top, (where, region, by_name) = stack.pop()
        open_[top] -= 1
        return top

    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        text = m[4]
        if text is not None:
            parts.append(text)
            in_links += len(text) if linked else 0
            continue
        name = m[2]
        if name is None:
            continue
        name, end, attrs = name.lower(), m[1], m[3]
        if name in RAW:
            if not end and not attrs.endswith("/"):
                stop = RAW[name].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in INLINE:
            if name == "a":
                linked = not end and "href" in attrs.lower()
            continue
        flush()
        if name in VOID:
            continue
        if end:
            linked = False
            if name == "p":
                if stack and stack[-1][0] == "p":
                    close()
            elif open_.get(name):
                while close() != name:
                    pass
        elif not attrs.endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                close()
            stack.append((name, (where, region, by_name)))
            open_[name] = open_.get(name, 0) + 1
            if where != OUT or by_name:
                marks = " ".join(x or y or z for _, x, y, z in ATTR.findall(attrs)).lower().split() if "=" in attrs else []
                own_header = where in (MAIN, INNER) and name == "header"
                if own_header:
                    marks = [x for x in marks if "header" not in x]
                if (name in NEVER and not own_header) or _hidden(attrs):
                    where, by_name = OUT, False
                elif name in ("body", "html"):
                    pass
                elif marks and _around(marks):
                    # what is in a comment or an advert that is an article itself stays out
                    where, by_name = OUT, name not in ("article", "main")
                elif name in ("article", "main") or (name in ("div", "section", "td") and "main" in marks):
                    if where in (OUT, PLAIN):
                        regions += 1
                        where, region = INNER if where == OUT else MAIN, regions
    flush()
    return out


def _stretch(sizes: list[int], window: int) -> tuple[int, int]:
    """First and last + 1 of the lines over which the distribution stands above its level by the greatest sum."""
    before = window // 2
    # blocks[i]: text in the window of lines around i
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    blocks = [sums[min(len(sizes), i + window - before)] - sums[max(0, i - before)] for i in range(len(sizes))]
    level = min(LEVEL, sum(b * n for b, n in zip(blocks, sizes)) / sums[-1] / 8)
    best, at, total, start = 0.0, (0, len(sizes)), 0.0, 0
    for i, b in enumerate(blocks):
        if total <= 0:
            total, start = 0.0, i
        total += b - level
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, window: int = 3) -> str:
    """Text between the surge and the dive of the line-block distribution."""
    every = lines(page or "")
    weight: dict[int, int] = {}
    for t, w, r, n in every:
        if w == INNER:
            weight[r] = weight.get(r, 0) + n
    outside = sum(n for _, w, _, n in every if w in (PLAIN, MAIN))
    found = [x for x in every if x[1] in (PLAIN, MAIN) or (x[1] == INNER and weight[x[2]] > outside)]
    if not found:
        return ""
    if not any(n for *_, n in found):  # nothing but links
        found = [(t, w, r, len(t)) for t, w, r, _ in found]
    sizes = [n * 2 if r else n for _, _, r, n in found]
    start, end = _stretch(sizes, window)
    held: dict[int, int] = {}
    for (_, _, r, _), n in zip(found[start:end], sizes[start:end]):
        held[r] = held.get(r, 0) + n
    most = max((r for r in held if r), key=lambda r: held[r], default=0)
    if most and held[most] >= sum(n for r, n in held.items() if r != most and r) + 2 * held.get(0, 0):
        return "\n".join(t for t, _, r, _ in found if r == most)
    return "\n".join(t for t, *_ in found[start:end])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, window) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return own.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
