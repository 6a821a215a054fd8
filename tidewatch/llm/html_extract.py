"""HTML main-text extraction with consensus host paths.

1. Every page's containers are scored by the running text they hold; each page votes for all its containers with text, named
   by generalised tag-class paths (``body>div.post-#``), in proportion to their scores.
2. Spark sums the votes per host and path; the path with most votes wins its host.
3. Every page is extracted again from the containers on its host's winning path. A page without such a container, or
   without text in it, and pages without a host use their own best container.

A path is the hash of its last name seeded by its parent's hash, so that names cost the same at any depth. The scanner goes
over the html once: quantifiers are possessive, open elements that an end tag or a sibling closes are found by kept places,
and what isn't closed at the end of a page (a tag, comment, script or quotation) ends it, as in browsers.

Words in class, id and role tell what is around an article. Those that have no other use count wherever they stand; those
that articles use as well (``alert``, ``discussion``) count only if the rest of the name says nothing (``alert-box``, not
``alert-level``), and as an id not inside an article. Of nested containers the outer one wins if both mark an article, so that
its heading and lead stay whatever the page's length.

Null and empty html give an empty text. Unclosed, misnested and unknown tags and overlong character references never fail.
Repeated rows are extracted each for itself; further columns pass through, whatever their names; an existing column of the
result's name is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm._common import free_name, materialise, schema_with, slices, url_host, with_column

#: HTML's raw-text and void elements, and those that flow inside a line.
RAW = "script style textarea title xmp iframe noembed noframes".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mfrac mi mn mo mover mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: Elements that never hold an article's text.
NEVER = set("nav aside footer form button select option svg template noscript iframe script style textarea title head dialog menu fieldset object canvas audio video datalist annotation annotation-xml".split())
CONTAINERS = set("body main article section div td center table tbody tr".split())
#: Elements that close an open element of the same kind: its slot among the kept places, and the slots that a scope hides.
SLOT = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
BLOCK_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()) | {"p"}
P_SCOPE = CONTAINERS | NEVER
LIST_SCOPE = set("ul ol dl table div article section main".split())
NO_PLACES = (-1,) * 6
#: Words in class, id or role that mark what is around an article wherever they stand.
AROUND = set(
    "nav navbar navigation sidebar footer adv advert adverts advertisement advertising adsense sponsored cookie cookies gdpr comments commentlist disqus breadcrumb breadcrumbs newsletter "
    "popup modal pagination pager masthead searchbox complementary contentinfo".split()
)
#: Words that do so if all other words of the name are among PLAIN ones.
PERHAPS = set(
    "ad ads menu side aside foot sponsor promo promotion banner consent notice notices alert comment respond responses discussion replies reply share sharing social related recommended recommendations "
    "subscribe signup subscription widget widgets overlay login register search toolbar copyright legal disclaimer skip".split()
)
PLAIN = set(
    "block box wrapper wrap container inner outer section area list item items bar panel module site page top bottom left right main links link text content post posts article articles entry slot unit "
    "form title heading head header body button buttons global primary secondary mobile desktop sticky fixed google user thread strip row col column group message policy to".split()
)
HEADING = set("header head topbar".split())
#: Words that mark an article, and those that mark what may hold one among other things.
ARTICLE = set("article entry post story".split())
HOLDER = set("content main text body page prose".split())

#: A start or end tag up to its ``>`` (the last group is empty if the page ends before), or the start of markup that isn't shown.
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]++|=)*+)(>)?|(!--)|[!?/])""")
_ATTR = re.compile(r"""([^\s/=>][^\s/=>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
_LONG_REFERENCE = re.compile(r"&#[xX]?[0-9a-fA-F]{12,};?")


def decode(text: str) -> str:
    """Character references decoded; numbers that no character has become U+FFFD, however long."""
    if "&" not in text:
        return text
    return unescape(_LONG_REFERENCE.sub("�", text))


def marks(name: str, both: bool = True) -> bool:
    """Whether a class, id or role says that its element stands around an article."""
    words = {w.lower() for w in _TOKEN.findall(name) if not w.isdigit()}
    if not AROUND.isdisjoint(words):
        return True
    return both and not PERHAPS.isdisjoint(words) and words <= PERHAPS | PLAIN


class Page:
    """Blocks of text in page order, each with its container; containers with parent, path and weight."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self.parent, self.path, self.weight = array("i", [-1]), array("Q", [0]), array("d", [0.5])
        self._line: list[str] = []
        self._linked = 0
        # tag, container, left out, inside an article, places of what SLOT names
        self._stack: list[tuple[str, int, bool, bool, tuple[int, ...]]] = [("", 0, False, False, NO_PLACES)]
        self._count: dict[str, int] = {}
        self._anchors = 0
        self._parse(html)

    def _flush(self) -> None:
        if self._line:
            text = _SPACE.sub(" ", "".join(self._line)).strip()
            if text:
                self.blocks.append((self._stack[-1][1], text, self._linked))
            self._line, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        own: dict[str, str] = {}
        if attributes.strip(" /"):
            for m in _ATTR.finditer(attributes):
                own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        _, container, out, in_article, places = self._stack[-1]
        names = own.get("class", "").split()
        words = {w.lower() for n in (*names, own.get("id", ""), own.get("role", "")) for w in _TOKEN.findall(n)}
        if not out:
            out = tag in NEVER or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
            if not out and words and tag not in ("body", "html", "main"):
                if tag == "article":  # a reader's comment or an advert may be one
                    out = any(not {"comment", "comments", "reply", "ad", "advert", "advertisement", "sponsored", "promo", "related"}.isdisjoint(w := {x.lower() for x in _TOKEN.findall(n)}) and w <= AROUND | PERHAPS | PLAIN for n in names)
                else:
                    out = any(map(marks, names)) or marks(own.get("role", "")) or marks(own.get("id", ""), not in_article)
            titled = in_article or not ARTICLE.isdisjoint(words)
            out = out or not titled and (tag == "header" or not HEADING.isdisjoint(words) and tag not in ("body", "html"))
        in_article = in_article or tag in ("article", "main")
        if tag in CONTAINERS and not out:
            name = ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in names})])
            self.path.append(xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), self.path[container]))
            self.parent.append(container)
            self.weight.append(0.6 if tag == "body" else 1.5 if tag == "article" or not ARTICLE.isdisjoint(words) else 1.3 if tag == "main" or not HOLDER.isdisjoint(words) else 1.0)
            container = len(self.path) - 1
        if tag in P_SCOPE:
            places = (-1, *places[1:])
        if tag in LIST_SCOPE:
            places = (places[0], -1, -1, -1, -1, -1)
        if (slot := SLOT.get(tag)) is not None:
            places = (*places[:slot], len(self._stack), *places[slot + 1 :])
            if slot == 3:
                places = (*places[:4], -1, places[5])
        self._stack.append((tag, container, out, in_article, places))
        self._count[tag] = self._count.get(tag, 0) + 1

    def _drop_from(self, i: int) -> None:
        for entry in self._stack[i:]:
            self._count[entry[0]] -= 1
        del self._stack[i:]

    def _end(self, tag: str) -> None:
        if self._count.get(tag):  # else nothing is walked
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == tag:
                    self._drop_from(i)
                    return

    def _parse(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            if (stop := m.start() if m else end) > at and not self._stack[-1][2]:
                said = decode(html[at:stop])
                self._line.append(said)
                self._linked += len(said) if self._anchors else 0
            if not m:
                break
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:  # a comment or a declaration: what isn't closed lasts to the end
                mark = "-->" if m[5] else ">"
                at = close + len(mark) if (close := html.find(mark, at)) >= 0 else end
                continue
            if not m[4]:
                break
            if tag in INLINE:
                if tag == "a":
                    self._anchors = 0 if m[1] else 1
                continue
            self._flush()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                at = close.end() if (close := _RAW_END[tag].search(html, at)) else end
                at = html.find(">", at) + 1 or end
            elif tag not in VOID:
                places = self._stack[-1][4]
                if tag in BLOCK_CLOSES_P and places[0] >= 0:
                    self._drop_from(places[0])
                elif (slot := SLOT.get(tag)) is not None:
                    near = places[3] if slot == 3 and places[3] >= 0 else places[4] if slot == 3 else places[slot]
                    if near >= 0:
                        self._drop_from(near)
                if not m[3].endswith("/"):
                    self._open(tag, m[3])
        self._flush()

    def scores(self) -> list[float]:
        """Of each container: characters of running text in it and below, less twice those inside links, times its weight."""
        inside = [0.0] * len(self.path)
        for c, text, linked in self.blocks:
            inside[c] += max(0, len(text) - 2 * linked)
        for c in range(len(inside) - 1, 0, -1):  # a parent comes before its children
            inside[self.parent[c]] += inside[c]
        return [s * w for s, w in zip(inside, self.weight)]

    def votes(self) -> list[tuple[int, int, float]]:
        """(path, its place, part of the page's votes) of every path with text."""
        by: dict[int, list[float]] = {}
        for c, (path, s) in enumerate(zip(self.path, self.scores())):
            own = by.setdefault(path, [c, 0.0])
            own[1] += s
        top = max((s for _, s in by.values()), default=0.0)
        return [(p, int(c), s / top) for p, (c, s) in by.items() if s > 0]

    def best(self, n: int = 1) -> list[tuple[int, float]]:
        """The n paths with most votes; of equal ones the deepest first, which leaves out what is no running text."""
        top = sorted(self.votes(), key=lambda v: (-round(v[2], 9), -v[1], v[0]))[:n]
        return [(p, s) for p, _, s in top]

    def text(self, path: int) -> str:
        """The blocks under the containers with this path, in page order, joined by one space."""
        under = bytearray(len(self.path))
        for c in range(len(under)):
            under[c] = self.path[c] == path or c > 0 and under[self.parent[c]]
        return " ".join(t for c, t, _ in self.blocks if under[c])

    def extract(self, path: int | None) -> str:
        said = self.text(path) if path is not None else ""
        if said:
            return said
        own = self.best()
        return self.text(own[0][0]) if own else " ".join(t for _, t, _ in self.blocks)


#: Winning paths of up to so many hosts (some 10 MB) are broadcast; more are joined by host.
BROADCAST_HOSTS = 50_000


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes, place) summed over all pages of a host: all containers vote, and Spark adds votes up before the
    shuffle."""

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 64):
                part = frame.iloc[i : i + 64]
                yield pd.DataFrame([(h, _signed(p), c, v) for h, html in zip(part["host"], part["html"]) for p, c, v in Page(html).votes()], columns=["host", "path", "place", "vote"])

    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host <> '' and html <> ''")
    votes = rows.mapInPandas(vote, "host string, path long, place long, vote double")
    return votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"), F.max("place").alias("place"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path): most votes, then the deepest place, then the least path."""
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("place"), F.col("path"))).alias("path"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds the main text of every page's whole html."""
    host, won = free_name(pages, "host"), free_name(pages, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            paths = (None if p is None else p % (1 << 64) for p in batch.column(won).to_pylist())
            said = [Page(html or "").extract(path) for html, path in zip(batch.column(html_col).to_pylist(), paths)]
            yield with_column(batch.drop_columns(won), out_col, pa.array(said, pa.string()))

    winners = materialise(winning_paths(host_votes(pages, url_col, html_col)), "host-paths")
    winners = winners.select(F.col("host").alias(host), F.col("path").alias(won))
    small = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = pages.withColumn(host, url_host(F.col(url_col))).join(F.broadcast(winners) if small else winners, host, "left").drop(host)
    return joined.mapInArrow(run, schema_with(pages, out_col, T.StringType()))
