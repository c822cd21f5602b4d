"""HTML main-text extraction by consensus host paths.

Pass 1 parses each page, takes the container that holds its text, and votes with the
container's generalised path (tags and classes from the root, digits out) for its host; Spark
counts the votes.  Pass 2 parses each page again and extracts from the containers that its
host's winning paths name, best first, all those of one path together; a page where none of
them holds text uses its own container.  A page's own container is the smallest that holds
all elements meant for articles, or else the deepest with SHARE of the text; either grows by
headings beside it, the latter by paragraphs, lists and quotes beside it too.

Within the container, boilerplate goes: menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, told by element, role or a word of the
class or id; within an article a class or id counts only if all its words may, so
"notice-of-award" stays there.  The rest stays whole.  Block elements part the text into blocks; references are
decoded, white space within a block becomes one space, and blocks are joined by a line feed.

Null or empty html: empty text.  Null or odd url: no host, the page stands alone.  Rows are
judged one by one, repeated rows and null ids included; an empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values of HTML: elements without content, with raw content, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Which open elements a start tag ends, and where the search for them stops.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
SKIPPED = frozenset("head nav footer aside form button select textarea noscript iframe svg canvas template object audio video dialog menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that mark boilerplate.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promotion promoted "
    "related share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that stand beside them in a class or id; within an article only names made of both count.
BESIDE = frozenset(
    "area bar block bottom box boxes button buttons center col column container content entries feed footer form group header holder icon icons inline inner item items label left link links list "
    "main nav outer page panel post posts region right rail row section sidebar site slot small thread title top unit wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = HEADINGS | frozenset("p blockquote pre ul ol dl figure table".split())
SHARE = 0.8  # of a page's text: the deepest container that holds it
MEANT_SHARE = 0.5  # of a page's text, in the elements meant for it
WINNERS = 3
SMALL_ROWS = 200_000
SALTS = 32

_ATTRS = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+"""  # a quote quotes only after "="
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>script|style|xmp|noembed|noframes)\b{_ATTRS}(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Page:
    """A page's elements, in the order in which they open, and its text blocks, boilerplate left
    out.  What an element inherits is kept with it, so work follows the page's length whatever
    its nesting."""

    def __init__(self, source: str):
        self.tag, self.parent, self.key, self.skip, self.meant = ["#"], [-1], [""], [False], [False]
        self.inner, self.block, self.place = [False], [0], [0]  # in an article; nearest block; number of the path
        self.places: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parse(source)

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        found = {k.lower(): html.unescape((v or "").strip("\"'")).lower() for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
        classes, role, up = found.get("class", ""), found.get("role", ""), stack[-1]
        inner = self.inner[up]
        skip = (
            self.skip[up] or tag in SKIPPED or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
            or tag == "header" and not inner
            or tag not in ("html", "body", "article", "main") and _marked(f"{classes} {found.get('id', '')}", inner)
            or bool(_HIDDEN.search(found.get("style", "")))
        )
        shape = ".".join(sorted({re.sub(r"[\d>]+", "", c) for c in classes.split()} - {""}))
        key = f"{tag}.{shape}" if shape else tag
        self.tag.append(tag)
        self.parent.append(up)
        self.key.append(key)
        self.skip.append(skip)
        self.meant.append(tag in ("article", "main") or role in ("article", "main") or found.get("itemprop") == "articlebody")
        self.inner.append(inner or tag in ("article", "main"))
        self.block.append(len(self.block) if tag in BLOCKS else self.block[up])
        self.place.append(self.places.setdefault((self.place[up], key), len(self.places) + 1))
        stack.append(len(self.tag) - 1)

    def _parse(self, source: str) -> None:
        stack, parts, linked, links = [0], [], 0, 0
        held: Counter[str] = Counter()  # open elements by tag

        def flush():
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((self.block[stack[-1]], text, linked))
                parts.clear()
            linked = 0

        def close_to(i):
            nonlocal links
            for x in stack[i:]:
                held[self.tag[x]] -= 1
                links -= self.tag[x] == "a"
            del stack[i:]

        for m in _TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                if not self.skip[stack[-1]]:
                    text = html.unescape(text)
                    parts.append(text)
                    if links:
                        linked += len(text)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "br":
                    parts.append(" ")
                    continue
                for i in range(len(stack) - 1, 0, -1) if held[tag] else ():
                    if self.tag[stack[i]] == tag:
                        if any(self.tag[x] in BLOCKS for x in stack[i:]) or self.skip[stack[-1]]:
                            flush()
                        close_to(i)
                        break
                    if tag not in BLOCKS and self.tag[stack[i]] in BLOCKS:
                        break  # an inline end tag does not end a block
                continue
            if tag in BLOCKS or tag in SKIPPED:
                flush()
            if tag in BLOCKS:
                for i in range(len(stack) - 1, 0, -1) if held["p"] else ():  # a block ends an open paragraph
                    if self.tag[stack[i]] == "p":
                        close_to(i)
                        break
                    if self.tag[stack[i]] in BLOCKS:
                        break
            if tag in CLOSES:
                ended, stop = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1) if any(held[x] for x in ended) else ():
                    if self.tag[stack[i]] in stop:
                        break
                    if self.tag[stack[i]] in ended:
                        close_to(i)
                        if tag != "tr" or self.tag[stack[-1]] != "tr":
                            break
            if tag == "br":
                parts.append(" ")
            if tag in VOID or m["attrs"].rstrip().endswith("/") and tag not in BLOCKS:
                continue
            if tag == "body" and any(self.tag[i] == "head" for i in stack):
                close_to(next(i for i, x in enumerate(stack) if self.tag[x] == "head"))
            self._open(stack, tag, m["attrs"])
            held[tag] += 1
            links += tag == "a"
        flush()

    def path(self, at: int) -> str:
        keys = []
        while at > 0:
            keys.append(self.key[at])
            at = self.parent[at]
        return ">".join(reversed(keys))

    def _sums(self, weight) -> list[float]:
        """What each element holds, with all in it, of a block's weight (text, linked)."""
        held = [0.0] * len(self.tag)
        for at, text, linked in self.blocks:
            held[at] += weight(text, linked)
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        return held

    def _ends(self) -> list[int]:
        """The number behind the last element in each element."""
        ends = [i + 1 for i in range(len(self.tag))]
        for i in range(len(ends) - 1, 0, -1):
            ends[self.parent[i]] = max(ends[self.parent[i]], ends[i])
        return ends

    def best(self) -> int:
        """The container of the page's text; 0, the whole page, if there is no better one."""
        mass = self._sums(lambda text, linked: max(0, len(text) - linked))
        if not mass[0]:
            return 0
        under = [False] * len(mass)  # an element meant for text is above
        for i in range(1, len(mass)):
            under[i] = under[self.parent[i]] or self.meant[self.parent[i]]
        meant = [i for i in range(1, len(mass)) if self.meant[i] and not self.skip[i] and mass[i] > 0]
        outer = [i for i in meant if not under[i]]
        if outer and sum(mass[i] for i in outer) >= MEANT_SHARE * mass[0]:
            at, ends = outer[0], self._ends()
            while ends[at] <= outer[-1]:
                at = self.parent[at]
            if len(outer) == 1:
                at = max((i for i in meant if mass[i] == mass[at]), default=at)  # of equals the deepest
            return self._grown(at, HEADINGS)
        full = [i for i in range(len(mass)) if mass[i] >= SHARE * mass[0] and (i == 0 or self.tag[i] in BLOCKS and self.tag[i] != "p")]
        return self._grown(full[-1], PROSE) if full else 0

    def _grown(self, at: int, kinds: frozenset[str]) -> int:
        """The highest container above ``at`` with a child of these kinds that holds unlinked text."""
        inside, up = {at}, at
        while up > 0:
            up = self.parent[up]
            inside.add(up)
        plain = self._sums(lambda text, linked: linked < len(text))
        found = [self.parent[i] for i in range(1, len(self.tag)) if i not in inside and self.parent[i] in inside and self.parent[i] != at and plain[i] and self.tag[i] in kinds]
        return min([at, *found])

    def find(self, paths: list[str]) -> list[int]:
        """The containers with text of the first path that has any."""
        held = self._sums(lambda text, linked: len(text))
        for path in paths:
            place = 0
            for key in path.split(">"):
                place = self.places.get((place, key), -1)
            found = [i for i in range(1, len(self.tag)) if self.place[i] == place and not self.skip[i] and held[i]]
            if found:
                return found
        return []

    def text(self, containers: list[int]) -> str:
        inside = [False] * len(self.tag)
        for at in containers:
            inside[at] = True
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return "\n".join(text for at, text, _ in self.blocks if inside[at])


def _marked(names: str, inner: bool) -> bool:
    """Does a class or id mark boilerplate?  Within an article only if all its words may."""
    if not inner:
        return not WORDS.isdisjoint(_PARTS.findall(names))
    for name in names.split():
        parts = set(_PARTS.findall(name))
        if not WORDS.isdisjoint(parts) and parts <= WORDS | BESIDE:
            return True
    return False


def _vote(batch: pa.RecordBatch) -> pa.RecordBatch:
    hosts, paths = [], []
    for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        page = Page(source)
        if at := page.best():
            hosts.append(host)
            paths.append(page.path(at))
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])


def extract(source: str | None, paths: list[str] | None) -> str:
    """A page's main text, given its host's winning paths, best first."""
    if not source:
        return ""
    page = Page(source)
    return page.text(page.find(paths or []) or [page.best()])


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [extract(s, p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    sizes = pa.array([len(t) for t in texts], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths) from pages (host, html): the paths with the most votes, best first."""
    votes = pages.where("host <> '' and html <> ''").select("host", "html").mapInArrow(lambda bs: map(_vote, bs), "host string, path string")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))
    top = counted.withColumn("i", rank).where(F.col("i") <= WINNERS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "path"))), lambda x: x["path"]).alias("paths"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    scratch = Scratch(pages.sparkSession)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    winners = scratch.save(winning_paths(pages))
    if winners.count() <= SMALL_ROWS:
        joined = pages.join(F.broadcast(winners), "host", "left")
    else:  # a host may hold a third of all pages: deal its pages over salts, and repeat its paths
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(lambda bs: map(_extract, bs), "page_id long, url string, text string, n_chars long")
