"""Main text of web pages by consensus: pages vote for the container path of their host, then all are read again by it.

A page is cut into tags and texts once; every element has a path of tags with generalised classes. Each page scores the
smallest container that holds all its running text; the votes of a host's pages are added up in Spark, and the winning path
is used on those of the host's pages whose running text it holds. Any other page uses its own container, so that only
boilerplate and blocks of mere links are left out.
"""
from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linktrust import host_of
from .shared import map_frames

#: Elements whose content is no text, that are boilerplate, that end a block, that have no end tag.
RAW = frozenset("script style noscript template textarea iframe svg math canvas object select title noembed noframes xmp".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog fieldset label input".split())
BLOCK = frozenset(("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre "
                   "figure figcaption address hr center details summary " + " ".join(BOILERPLATE)).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words in a class or id that mark boilerplate.
MARKED = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|popups?|modals?|nav(?:bar|igation)?|"
                    r"menus?|breadcrumbs?|header|masthead|footer|foot|sidebars?|aside|widgets?|comments?|replies|responses|disqus|respond|share|sharing|social|related|recommend(?:ed|ations)?|"
                    r"newsletter|subscribe|signup|login|search|pagination|pager|skip|toolbar|copyright|legal)(?=$|[\s_-]|\d)")
#: Class names that tell what an element has, lacks or is filed under, not what it is.
ABOUT = re.compile(r"(?i)(?:^|(?<=[\s_-]))(?:has|no|with|without|category|tag)[_-]\S*")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"[\s ]+")
CLOSED_BY_BLOCK = "p"
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORD, HREF = re.compile(r"\w"), re.compile(r"\bhref\s*=", re.I)


def _events(page: str):
    """(kind, name, attributes or text): start and end tags and texts; content of RAW elements is left out."""
    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "end", name, ""
            else:
                yield "start", name, m[3]
                if name in RAW:
                    close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                    if close is not None:
                        at = close.end()
                    elif name in ("script", "style"):
                        return
                    yield "end", name, ""
                elif name in VOID or m[3].rstrip().endswith("/"):
                    yield "end", name, ""


def blocks(page: str) -> list[tuple[tuple[int, ...], str, int]]:
    """Text blocks as (ids of open containers, text, characters of running text) without boilerplate, and the containers' paths.

    Running text is what lies outside links; mere separators between links are none. An element with a marked class or id
    is boilerplate unless it holds an unmarked article, a main, an h1 or most of the page's running text; the latter does not
    count beside an article or main that has text of its own, as of an ad that is longer than a short article.
    """
    stack: list[tuple[str, int | None, bool, bool, int | None]] = []  # name, container, boilerplate, link, mark
    paths: list[str] = []
    cut: list[tuple[tuple[int, ...], list[tuple[str, bool, tuple[int, ...]]]]] = []  # containers and pieces of every block
    content: list[bool] = []  # marked elements that hold an article, main or h1
    inner: list[bool] = []  # marked elements inside an article or main
    story = False
    pieces: list[tuple[str, bool, tuple[int, ...]]] = []  # text, in a link, marks around it
    marks: tuple[int, ...] = ()
    hidden, in_link = 0, 0

    def flat(parts: list[str]) -> str:
        return SPACE.sub(" ", html.unescape("".join(parts))).strip()

    def in_story() -> bool:
        return any(m is None and name in ("article", "main") for name, _, _, _, m in stack)

    def flush() -> None:
        nonlocal story, pieces
        if pieces:
            cut.append((tuple(c for _, c, _, _, _ in stack if c is not None), pieces))
            story = story or any(not link and not text.isspace() for text, link, _ in pieces) and in_story()
            pieces = []

    def pop() -> None:
        nonlocal hidden, in_link, marks
        _, _, boiler, link, mark = stack.pop()
        hidden -= boiler
        in_link -= link
        if mark is not None:
            marks = marks[:-1]

    for kind, name, rest in _events(page):
        if kind == "text":
            if not hidden:
                pieces.append((rest, in_link > 0, marks))
            continue
        if name in BLOCK:
            flush()
        elif name == "br" and kind == "start" and not hidden:
            pieces.append((" ", in_link > 0, marks))
        if kind == "start":
            closes = SIBLINGS.get(name, ())
            if name in BLOCK:
                for spot in range(len(stack) - 1, -1, -1):
                    if stack[spot][0] == CLOSED_BY_BLOCK or stack[spot][0] in closes:
                        while len(stack) > spot:
                            pop()
                        break
                    if stack[spot][0] in BLOCK and not closes:
                        break
                    if stack[spot][0] in ("ul", "ol", "table", "dl"):
                        break
            found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(rest)} if rest else {}
            label = f"{found.get('class', '')} {found.get('id', '')}"
            boiler = name in BOILERPLATE or name in RAW or found.get("role", "").lower() in ROLES
            marked = not boiler and name not in ("html", "body", "main", "h1") and len(label) > 1 and MARKED.search(ABOUT.sub("", label)) is not None
            if not hidden and not boiler and not marked and name in ("article", "main", "h1"):
                for m in marks:
                    content[m] = True
            container = None
            if name in CONTAINER and not hidden and not boiler:
                above = next((paths[c] for _, c, _, _, _ in reversed(stack) if c is not None), "")
                first = re.sub(r"[\d_-]+", "", found.get("class", "").split(" ")[0].lower())
                container = len(paths)
                paths.append(f"{above}/{name}.{first}" if first else f"{above}/{name}")
            link = name == "a" and HREF.search(rest) is not None
            mark = len(content) if marked else None
            if marked:
                content.append(False)
                inner.append(in_story())
                marks += (mark,)
            stack.append((name, container, boiler, link, mark))
            hidden += boiler
            in_link += link
        else:
            for spot in range(len(stack) - 1, -1, -1):
                if stack[spot][0] == name:
                    while len(stack) > spot:
                        pop()
                    break
                if stack[spot][0] in CONTAINER and name not in BLOCK:
                    break
    flush()
    if content:
        held, total = [0] * len(content), 0
        for text, link, around in (piece for _, found in cut for piece in found):
            running = 0 if link else len("".join(text.split()))
            total += running
            for m in around:
                held[m] += running
        shown = [c or 2 * n > total and (i or not story) for c, n, i in zip(content, held, inner)]
        cut = [(inside, [piece for piece in found if all(shown[m] for m in piece[2])]) for inside, found in cut]
    out = []
    for inside, found in cut:
        text = flat([piece for piece, _, _ in found])
        if text:
            linked = any(link for _, link, _ in found)
            running = flat([piece for piece, link, _ in found if not link]) if linked else text
            out.append((inside, text, len(running) if not linked or WORD.search(running) else 0))
    return out, paths


def _held(found, paths: list[str]) -> tuple[dict[str, int], int]:
    """Running text in the containers of every path, and of the page."""
    held: dict[str, int] = {}
    for inside, _, running in found:
        for c in inside:
            held[paths[c]] = held.get(paths[c], 0) + running
    return held, sum(running for _, _, running in found)


def _smallest(held: dict[str, int], total: int) -> str:
    return max((p for p, n in held.items() if n == total), key=lambda p: (p.count("/"), p), default="") if total else ""


def best_path(page: str) -> tuple[str, int]:
    """The path of the smallest container that holds all of a page's running text, and that text's length."""
    held, total = _held(*blocks(page))
    path = _smallest(held, total)
    return (path, total) if path else ("", 0)


def main_text(page: str, path: str | None) -> str:
    """Blocks of the containers at ``path`` if they hold all running text, or of the page's own container, joined by line breaks."""
    found, paths = blocks(page)
    held, total = _held(found, paths)
    if not path or not total or held.get(path, 0) < total:
        path = _smallest(held, total)
    return "\n".join(text for inside, text, _ in found if not path or any(paths[c] == path for c in inside))


def _vote(batches):
    for pdf in batches:
        found = [best_path(t) if isinstance(t, str) else ("", 0) for t in pdf.html]
        yield pd.DataFrame({"host": pdf.host, "path": [p for p, _ in found], "votes": [n for _, n in found]})


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the winner of every host's votes; equal votes go to the smaller path."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = rows.mapInPandas(_vote, "host string, path string, votes long").where("votes > 0")
    sums = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct((-F.col("votes")).alias("v"), F.col("path"))).alias("path"))


def _extract(batches):
    for pdf in batches:
        text = [main_text(t, p) if isinstance(t, str) else "" for t, p in zip(pdf.html, pdf.path)]
        yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; null html is empty text, repeated rows come out once each.

    ``winners`` (a saved table, one short row per host) is broadcast up to 100,000 hosts; beyond that it is joined on host and
    one of 16 shares of the host's pages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                        host_of(F.col("url")).alias("host"))
    if winners.count() <= 100_000:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        spread = winners.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(15))))
        rows = rows.withColumn("share", F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int")).join(spread, ["host", "share"], "left")
    return map_frames(rows.select("page_id", "url", "html", "path"), _extract, "page_id long, url string, text string, n_chars long")
