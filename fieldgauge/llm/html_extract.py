"""Main text of web pages: nearest-URL page differencing, guarded by what the markup says.

Pages are sorted by host and URL path, so that a page's neighbours are those of the nearest URLs within its host. The text lines
of a page and of its nearer neighbour are aligned by a longest common subsequence, and lines that both have are deleted.

Differencing alone can't give right results: menus and adverts that differ from page to page would stay, and lines that two articles
share would go (README has figures). Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments that are
marked as such never count. Every page is differenced; where a page marks its article (``article`` or ``main``), that check follows line
by line: what differencing deleted inside is restored, and what it left outside is removed. ``n_shared`` counts the lines that
differencing deleted, ``n_restored`` and ``n_removed`` those that the check changed.

Defined results: a null html is an empty page with empty text; a null or odd url has no host and no neighbours; equal pages are
neighbours, and where a page shares all its lines with its neighbour nothing is deleted (it would leave no text); an empty table gives
no rows; further columns are carried along, and own columns win where names clash. A page at the border of two tasks has one neighbour.
"""
from __future__ import annotations

import bisect
import html as entities
import os.path
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import added

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul").split())
_AWAY = frozenset("aside audio button canvas dialog footer form head iframe label menu nav noscript object script select style svg template textarea video".split())
_RAW = frozenset("script style textarea title template noscript iframe svg".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
# words of class and id that mark parts beside the article
_BESIDE = frozenset(("ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
                     "gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promotion related "
                     "replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget").split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
MADE = ("text", "n_chars", "n_shared", "n_restored", "n_removed")
_GAP = re.compile(r"\s+")


def _beside(tag: str, rest: str, in_article: bool) -> bool:
    """Does this element hold something beside the article?"""
    if tag in _AWAY or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main") or not rest:
        return False
    for name, value in _ATTR.findall(rest):
        marks = re.split(r"[^a-z0-9]+", value.lower())
        if any(m in (_ROLES if name.lower() == "role" else _BESIDE) for m in marks):
            return True
    return False


def lines_of(html: str | None) -> list[tuple[str, bool]]:
    """The page's lines that are not marked as beside the article, in page order, each with whether it is inside an article or main element."""
    found: list[tuple[str, bool]] = []
    text, open_, away, inside, at = [], [], 0, 0, 0
    html = html or ""

    def end_line():
        line = _GAP.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if line:
            found.append((line, inside > 0))

    def close(n):
        nonlocal away, inside
        for tag, was_away in open_[n:]:
            away -= was_away
            inside -= tag in ("article", "main") and not was_away
        del open_[n:]

    while at < len(html):
        m = _TAG.search(html, at)
        if not away:
            text.append(html[at:m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        ends, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCK and not away:
            end_line()
        if ends:
            n = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if n is not None:
                close(n)
        elif tag in _RAW and not rest.endswith("/"):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
        elif tag not in _VOID and not rest.endswith("/"):
            is_away = _beside(tag, rest, inside > 0)
            if is_away and not away:
                end_line()
            open_.append((tag, is_away))
            away += is_away
            inside += tag in ("article", "main") and not is_away
    end_line()
    return found


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``: a longest rising run through the places where lines are equal."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - last - 1, first - 1, -1):
        places.setdefault(b[j], []).append(j)
    tails, runs = [], []  # for each length: the least place in b that ends such a run, and the run itself, linked backwards
    for i in range(first, len(a) - last):
        for j in places.get(a[i], ()):
            k = bisect.bisect_left(tails, j)
            tails[k:k + 1], runs[k:k + 1] = [j], [(i, runs[k - 1] if k else None)]
    out, at = {*range(first), *range(len(a) - last, len(a))}, runs[-1] if runs else None
    while at:
        out.add(at[0])
        at = at[1]
    return out


def main_text(page: list[tuple[str, bool]], neighbour: list[tuple[str, bool]] | None, markup: bool = True) -> tuple[str, int, int, int]:
    """The text of a page's lines beside its nearest neighbour or None, and how many lines differencing deleted, the check restored and removed."""
    lines, marked = [x for x, _ in page], markup and any(inside for _, inside in page)
    beside = [x for x, inside in neighbour or () if marked or not markup or not inside]
    gone = shared_lines(lines, beside) if neighbour else set()
    if len(gone) == len(lines):
        gone = set()
    kept = [i for i in range(len(lines)) if i not in gone]
    if not marked:
        return "\n".join(lines[i] for i in kept), len(gone), 0, 0
    removed = sum(not page[i][1] for i in kept)
    restored = [i for i in gone if page[i][1]]
    text = sorted([i for i in kept if page[i][1]] + restored)
    return "\n".join(lines[i] for i in text), len(gone), len(restored), removed


def extract(pages: DataFrame, markup: bool = True, keep_html: bool = True) -> DataFrame:
    """``pages`` plus text, n_chars, n_shared, n_restored and n_removed. ``markup=False`` leaves all to differencing, to show what it does alone."""
    carried = [c for c in pages.columns if c not in MADE]
    kept = [c for c in carried if keep_html or c != "html"]
    place = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", 2)
    rows = pages.select(*[F.col(c).alias(f"in_{c}") for c in carried], F.lower(place).alias("_host"), path.alias("_path"), F.col("page_id").alias("_id"))
    rows = rows.repartitionByRange("_host", "_path", "_id").sortWithinPartitions("_host", "_path", "_id")

    def start():
        last: list = []

        def work(htmls, hosts, paths):
            done = [*last, *[(host, path, lines_of(h)) for h, host, path in zip(htmls, hosts, paths)]]
            texts = []
            for i in range(len(last), len(done)):
                host, path, page = done[i]
                near = [done[j] for j in (i - 1, i + 1) if host and 0 <= j < len(done) and done[j][0] == host]
                best = max(near, key=lambda x: len(os.path.commonprefix([x[1], path])), default=None)
                texts.append(main_text(page, best and best[2], markup))
            last[:] = done[-1:]
            return {"text": [t[0] for t in texts], "n_chars": [len(t[0]) for t in texts], **{c: [t[i] for t in texts] for i, c in enumerate(MADE[2:], 1)}}
        return work

    # the page itself moves once and returns from Python only if it is wanted
    out = added(rows, "text string, n_chars long, n_shared long, n_restored long, n_removed long", start, ["in_html", "_host", "_path"], ("_host", "_path", "_id", *[f"in_{c}" for c in carried if c not in kept]))
    return out.select(*[F.col(f"in_{c}").alias(c) for c in kept], *MADE)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), keep_html=False).select("page_id", "url", *MADE)
