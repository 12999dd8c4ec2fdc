"""Main text of web pages: rules on elements, then removal of site templates.

Rules drop what is no article by its element or by its class, id or role. Then the site's own templates go: every remaining
element's subtree gets a hash, Spark counts for each host on how many different pages a hash is found, and subtrees that
recur on a large share of a host's pages are deleted from its pages. Pages with the same text count once, so that copies of
an article do not turn it into a template; and a page that would lose all its text keeps it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.llm._common import written

# Elements by what a page's text does with them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("applet aside audio button canvas datalist dialog embed footer form frameset head iframe input menu nav noembed noframes noscript object option search select svg template textarea video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark an element as no part of the article.
HINTS = frozenset("ad ads adsbygoogle advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Open elements of these names end when one of the names opens (within the nearest of SCOPES).
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Blocks that end the search for an open element: for a paragraph, any but paragraphs; for its end tag, those that hold no list items or cells alone.
FENCES = {"p": BLOCKS - {"p"}, "outer": BLOCKS - {"p", "li", "dt", "dd", "td", "th", "tr", "option"}}
TOKEN = re.compile(r"<!--(?:(?!-->).)*+(?:-->|$)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass(frozen=True)
class Template:
    """A subtree is a template if it is on at least `pages` different pages of its host and on this share of them."""

    pages: int = 10
    share: float = 0.5
    #: Hosts with templates, and templates of all of them, that are broadcast at most.
    broadcast_hosts: int = 20_000
    broadcast_hashes: int = 2_000_000


def _marked(tag: str, raw: str, in_article: bool) -> bool:
    """The attributes mark the element as no part of an article."""
    for name, *values in ATTRIBUTE.findall(raw):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        words = set(re.split(r"[^a-z0-9]+", value)) if name in ("class", "id", "role") else ()
        if not HINTS.isdisjoint(words) or not in_article and ("header" in words or name == "role" and value == "banner"):
            return True
    return False


class Page:
    """A page's blocks of text, each in an element, and the elements that hold them."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.content = [""], [-1], [False], [[]]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._stack = [0]
        #: Places on the stack of open elements: of each name, and of the blocks that end a search for another element.
        self._open_at: dict[str, list[int]] = {}
        self._fences: dict[str, list[int]] = {"p": [], "outer": []}
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                node = self._stack[-1]
                self.blocks.append((node, text))
                self.content[node].append(text)
            self._text.clear()

    def _open(self, tag: str, dropped: bool) -> None:
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.dropped.append(dropped or self.dropped[self._stack[-1]])
        self.content.append([])
        self.content[self._stack[-1]].append(node)
        place = len(self._stack)
        self._stack.append(node)
        self._open_at.setdefault(tag, []).append(place)
        for name, fence in FENCES.items():
            if tag in fence:
                self._fences[name].append(place)

    def _last(self, names: Iterable[str]) -> int:
        return max((x[-1] for n in names if (x := self._open_at.get(n))), default=0)

    def _end(self, names: Iterable[str], scopes: Iterable[str] = (), fence: str | None = None) -> None:
        """Closes the innermost open element of these names, unless a scope, or a block of a fence, is open inside it.

        Takes as long as elements are closed, however many are open.
        """
        place = self._last(names)
        stop = self._last(scopes) if fence is None else self._fences[fence][-1] if self._fences[fence] else 0
        if not place or stop > place:
            return
        for k in range(len(self._stack) - 1, place - 1, -1):
            tag = self.tags[self._stack[k]]
            self._open_at[tag].pop()
            for name in FENCES:
                if tag in FENCES[name]:
                    self._fences[name].pop()
        del self._stack[place:]

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1
        while True:
            # beyond the last > no tag can end; an open comment still takes the rest
            found = TOKEN.search(source, at, last) if at < last else None
            if not found and (comment := source.find("<!--", max(at, 0))) >= 0:
                source = source[:comment]
            piece = source[at : found.start()] if found else source[at:]
            if piece:
                self._text.append(entities.unescape(piece) if "&" in piece else piece)
            if not found:
                return
            at = found.end()
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                return
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, closing, raw = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
            if closing:
                if tag in BLOCKS:
                    self._flush()
                    if tag == "p":
                        self._end((tag,), fence="outer")
                    else:
                        self._end((tag,), SCOPES.get(tag, ()))
                elif self._open_at.get(tag):
                    self._flush()
                    self._end((tag,), fence="p")
                elif tag == "br":
                    self._text.append(" ")
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else len(source)
                continue
            if tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._text.append(" ")
                continue
            inside = bool(self._open_at.get("article") or self._open_at.get("main"))
            dropped = tag in DROPPED or tag == "header" and not inside or bool(raw) and tag not in ("html", "body") and _marked(tag, raw, inside)
            if tag in BLOCKS or dropped:
                self._flush()
                if tag in BLOCKS:
                    self._end(("p",), fence="p")
                if tag in ENDED_BY:
                    self._end(ENDED_BY[tag], SCOPES[tag])
                if not raw.rstrip().endswith("/") or tag in BLOCKS:
                    self._open(tag, dropped)

    def hashes(self) -> list[int]:
        """A hash of each element's name, text and inner elements; 0 without text."""
        out = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            parts = [x if isinstance(x, str) else f"\x01{out[x]:x}" for x in self.content[i] if isinstance(x, str) or out[x]]
            if parts:
                value = xxhash.xxh64_intdigest("\x00".join([self.tags[i], *parts]))
                out[i] = value - (1 << 64) if value >> 63 else value
        return out

    def main(self, templates: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """The article's blocks in page order: those in article elements, else in main, else on the page."""
        gone = list(self.dropped)
        if templates:
            for i, h in enumerate(self.hashes()):
                gone[i] = gone[i] or i > 0 and gone[self.parents[i]] or h in templates
        wanted = next((t for t in ("article", "main") if any(x == t and not d for x, d in zip(self.tags, self.dropped))), None)
        inside = [wanted is None] * len(self.tags)
        for i in range(1, len(self.tags)):
            inside[i] = inside[i] or self.tags[i] == wanted or inside[self.parents[i]]
        return [text for node, text in self.blocks if inside[node] and not gone[node]]


def extract(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of one page; blocks that templates take all of stay."""
    page = Page(source or "")
    blocks = page.main(templates)
    return "\n\n".join(blocks or (page.main() if templates else blocks))


def host(url: Column) -> Column:
    """Lower-case host of an address without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def templates(pages: DataFrame, rule: Template = Template()) -> DataFrame:
    """(host, hashes): the template subtrees of each host that has any.

    At most 1 / share times the mean number of subtrees on its pages for a host, so the lists are short whatever its size.
    """

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            texts, trees = [], []
            for source in batch.column(1):
                page = Page(source.as_py() or "")
                value = xxhash.xxh64_intdigest("\x00".join(page.main()))
                texts.append(value - (1 << 64) if value >> 63 else value)
                trees.append(sorted({h for h, d in zip(page.hashes(), page.dropped) if h and not d}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.int64()), pa.array(trees, pa.list_(pa.int64()))], names=["host", "text", "trees"])

    rows = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host <> ''")
    different = rows.mapInArrow(run, "host string, text long, trees array<long>").groupBy("host", "text").agg(F.min("trees").alias("trees"))
    different = written(different, "html-trees")
    sizes = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= rule.pages)
    counts = different.select("host", F.explode("trees").alias("tree")).groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= rule.pages)
    often = counts.join(sizes, "host").where(F.col("n") >= rule.share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("tree").alias("hashes"))


def main_texts(pages: DataFrame, rule: Template = Template()) -> DataFrame:
    """(page_id, url, text, n_chars): a row for each row of pages, null ids and repeated rows too.

    A null html counts as empty and gives an empty text; a page without a host has no templates. An empty table gives no
    rows. Pages are read whole; columns besides page_id, url and html are not read.
    """
    found = written(templates(pages, rule), "html-templates").withColumnRenamed("host", "_host")
    hosts, hashes = found.agg(F.count("*"), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    found = F.broadcast(found) if hosts <= rule.broadcast_hosts and hashes <= rule.broadcast_hashes else found
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("_own"))
    rows = rows.join(found, F.col("_own") == F.col("_host"), "left").select(F.col("page_id").cast("long"), "url", "html", "hashes")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            texts = [extract(s.as_py(), set(t.as_py() or ())) for s, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
