"""HTML main text by site template removal.

Every page is read into a tree of elements; each block element gets a hash of its subtree (tags
and text, no attributes), wherever it stands: in the article, beside it, or in a part that markup
names as no content.  Spark counts, per host, with how many different article bodies a subtree
occurs, so the pages that copy one article count once and can't make it a template.  A subtree
that occurs with at least ``MIN_BODIES`` bodies and ``SHARE`` of the host's is part of the site's
template and is deleted from the host's pages.  Parts of a table go only with their table, list
items of fewer than ``ITEM_WORDS`` words only with their list.  The running text of a marked article
(paragraphs, quotes, preformatted text) goes by itself only if it occurs with ``TEXT_SHARE`` of the
bodies, its headings never: a line that many articles open with is theirs, a box around it is not.

In addition, what markup names as no content (navigation, headers, footers, asides, forms,
scripts, adverts, comments, notices, hidden elements) is deleted on pages of every host, since a
menu that differs on each page recurs nowhere.  If a page marks its article (article or main
element) the text is taken from there.

Of the remaining text character references are decoded, white space inside a block becomes one
space, blocks are joined by a line feed in page order.

Equal (host, subtree, body) rows fold before and after a shuffle dealt by all three, and the
counts of (host, subtree) are added up in two steps, so a host with a third of all pages, or a
menu on all of them, lands in no single task.  The recurring subtrees of a host are at most as many
as a page of it holds on average, ``1 / SHARE`` times; they are joined to the pages by host, and
the planner broadcasts them only below its size threshold.

Limits that follow from the method: a box on less than a quarter of a host's bodies, or on a
host of fewer than four, is found by markup only; a paragraph that most of a host's different
articles share is taken for a template.

Defined results: null html is an empty page with empty text; text without markup is its own
block; broken or unclosed markup never fails, open elements end with the page; a null or odd url
forms the host ``''``; rows that repeat a page_id are pages of their own; other columns are never
read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch

MIN_BODIES = 4
SHARE = 0.25
TEXT_SHARE = 0.6
ITEM_WORDS = 3

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
DROP_TAGS = frozenset("head script style title textarea noscript iframe xmp noembed noframes template nav footer aside form button select option svg canvas object audio video dialog menu map math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"body", "html", "head"}
ENDS = {  # an opening tag ends these open elements, up to the given containers
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
# Words in class, id and role that name no content.
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side nav navbar navigation navi menu breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended widget popup modal overlay pagination pager toolbar copyright disclaimer skip search contentinfo complementary dialog menubar hidden".split()
)
ARTICLE_NAMES = frozenset("comment comments reply replies related recommended teaser promo ad ads advert advertisement sponsored".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^><]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TABLE_PARTS = frozenset("caption tbody td tfoot th thead tr".split())
ITEMS = frozenset("dd dt li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
RUNNING = frozenset("blockquote p pre".split())

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _dropped(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no content: (by its tag, by its attributes)."""
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True, False
    if tag in ("html", "body", "main") or not attributes:
        return False, False
    names = ARTICLE_NAMES if tag == "article" else DROP_NAMES
    for m in _ATTR.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attributes[m.start() - 1 : m.start()] not in ("", " ", "\t", "\n", "\r", "\f", "/", '"', "'"):
            continue
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and _HIDDEN.search(value)):
            return False, True
        if kind in ("class", "id", "role"):
            words = [w.lower() for w in _NAME.findall(value)]
            if in_article:  # an article's own header or notice text may carry such a class
                words = [w for w in words if w not in ("header", "side", "search", "skip", "banner")]
            if any(w in names for w in words):
                return False, True
    return False, False


class Page:
    """Blocks of a page: text, the block elements around it, and whether it lies in the article.

    ``digest`` holds the hash of every element's subtree; parts that markup names as no content
    have one too, but give no block and don't change the hash of what is around them.
    """

    def __init__(self, html: str):
        self.parent: list[int] = [-1]
        self.digest: list[int] = [0]
        self.apart: set[int] = set()
        self.headings: set[int] = set()
        self.running: set[int] = set()
        self.blocks: list[tuple[str, int, bool]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        # stack entries: tag, element number, cause (0 none, 1 tag, 2 attributes), in article, hash parts
        stack: list[list] = [["", 0, 0, False, []]]
        drops = {1: 0, 2: 0}
        text: list[str] = []
        unnamed: list[str] = []  # text of parts that are no content

        def add(piece: str) -> None:
            (unnamed if drops[1] or drops[2] else text).append(piece)

        def flush() -> None:
            if unnamed:
                joined = " ".join(entities.unescape("".join(unnamed)).split())
                unnamed.clear()
                if joined and (drops[1] or drops[2]):  # else an inline part within a block
                    stack[-1][4].append(joined)
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if joined:
                    top = stack[-1]
                    self.blocks.append((joined, top[1], top[3]))
                    top[4].append(joined)

        def close() -> None:
            tag, number, cause, _, parts = stack.pop()
            if cause:
                drops[cause] -= 1
            if tag in BLOCK and parts:
                self.digest[number] = xxhash.xxh64_intdigest("\x00".join([tag, *parts])) >> 1
                if tag not in TABLE_PARTS and (tag not in ITEMS or sum(len(p.split()) for p in parts) >= ITEM_WORDS):
                    self.apart.add(self.digest[number])
                if not cause:
                    stack[-1][4].append(f"\x01{self.digest[number]}")
            elif parts and not cause:
                stack[-1][4].extend(parts)

        at, end = 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                add(entities_escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag in BLOCK:
                    flush()
                if tag == "br":
                    text.append(" ")
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        while len(stack) > depth:
                            if stack[-1][0] in BLOCK:
                                flush()
                            close()
                        break
                continue
            if tag in BLOCK:
                flush()
            if tag in CLOSES_P:
                self._end(stack, frozenset({"p"}), frozenset({"button", "td", "th", "table", "article", "section", "div", "main", "li", "blockquote"}), close)
            if tag in ENDS:
                self._end(stack, *ENDS[tag], close)
            if tag in VOID:
                if tag == "br":
                    add(" ")
                continue
            if tag in RAW and not attributes.endswith("/"):
                close_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close_at.end() if close_at else end
                continue
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            by_tag, by_name = _dropped(tag, attributes, stack[-1][3])
            if tag in ("article", "main") and not (by_tag or by_name) and drops[2] and not drops[1]:
                for entry in stack:  # a wrapper whose class merely mentions a part holds the article
                    if entry[2] == 2 and not entry[3]:
                        entry[2] = 0
                        drops[2] -= 1
            cause = 1 if by_tag else 2 if by_name else 0
            number = stack[-1][1]
            if tag in BLOCK:
                number = len(self.parent)
                self.parent.append(stack[-1][1])
                self.digest.append(0)
                if stack[-1][3] and tag in HEADINGS:
                    self.headings.add(number)
                elif stack[-1][3] and tag in RUNNING:
                    self.running.add(number)
            if cause:
                drops[cause] += 1
            stack.append([tag, number, cause, stack[-1][3] or tag in ("article", "main"), []])
        flush()
        while len(stack) > 1:
            close()

    @staticmethod
    def _end(stack, tags, containers, close) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in containers:
                return
            if stack[depth][0] in tags:
                while len(stack) > depth:
                    close()
                return

    def used(self) -> list[tuple[str, int, bool]]:
        """The blocks of the article if the page marks one with text, else all blocks."""
        inside = [b for b in self.blocks if b[2]]
        return inside or self.blocks

    def body(self) -> int:
        """Hash of the article: of the blocks that are used, before templates go."""
        return xxhash.xxh64_intdigest("\n".join(b[0] for b in self.used())) >> 1

    def subtrees(self) -> set[int]:
        """Hashes of all element subtrees that may go by themselves."""
        return self.apart

    def text(self, template: set[int] | frozenset[int] = frozenset(), frequent: set[int] | frozenset[int] = frozenset()) -> str:
        """The used blocks outside the template; ``frequent`` is the part of it that running text can be, too."""
        kept = []
        for joined, number, _ in self.used():
            while number > 0 and not self._goes(number, template, frequent):
                number = self.parent[number]
            if number <= 0:
                kept.append(joined)
        return "\n".join(kept)

    def _goes(self, number: int, template: set[int] | frozenset[int], frequent: set[int] | frozenset[int]) -> bool:
        digest = self.digest[number]
        return digest in template and digest in self.apart and number not in self.headings and (number not in self.running or digest in frequent)


def entities_escape(text: str) -> str:
    return text.replace("&", "&amp;")


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_bodies: int = MIN_BODIES, share: float = SHARE, text_share: float = TEXT_SHARE) -> DataFrame:
    """(host, template, frequent): hashes of the subtrees that recur over a host's article bodies; pages hold host and html.

    ``frequent`` lists those of the template that occur with ``text_share`` of the bodies.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = {
                    (name, subtree, body)
                    for name, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for page in (Page(html or ""),)
                    for body in (page.body(),)
                    for subtree in (-1, *page.subtrees())  # -1: the page itself
                }
                names, subtrees, bodies = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch(
                    [pa.array(names, pa.string()), pa.array(subtrees, pa.int64()), pa.array(bodies, pa.int64())], names=["host", "subtree", "body"]
                )

    found = (
        pages.select("host", "html")
        .mapInArrow(run, "host string, subtree long, body long")
        .groupBy("host", "subtree")
        .agg(F.countDistinct("body").alias("bodies"))
        .filter(F.col("subtree").eqNullSafe(-1) | (F.col("bodies") >= min_bodies))
    )
    found = scratch.written(found, "subtrees")
    totals = found.filter("subtree = -1").select("host", F.col("bodies").alias("total"))
    return (
        found.filter("subtree <> -1")
        .join(totals, "host")
        .filter(F.col("bodies") >= share * F.col("total"))
        .groupBy("host")
        .agg(  # bounded by a page's elements / share
            F.collect_list("subtree").alias("template"),
            F.collect_list(F.when(F.col("bodies") >= text_share * F.col("total"), F.col("subtree"))).alias("frequent"),
        )
    )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bodies: int = MIN_BODIES, share: float = SHARE, text_share: float = TEXT_SHARE) -> DataFrame:
    """page_id, url and text of every row."""
    scratch.ready(pages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    found = scratch.written(templates(rows, min_bodies, share, text_share), "templates")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [
                    Page(html or "").text(frozenset(template or ()), frozenset(frequent or ()))
                    for html, template, frequent in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)))
                ]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.join(found, "host", "left").select("page_id", "url", "html", "template", "frequent").mapInArrow(run, "page_id long, url string, text string")
