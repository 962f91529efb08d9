"""Main text of HTML pages, with site template removal.

A page is read into elements with the end tags that HTML implies; scripts, styles and what else is never shown goes at once. Every
element that holds a whole block of text, wherever it stands, gets a hash of its subtree (tags, names and text). Hashes are counted
per host over all pages, and subtrees that recur on many pages of a host are deleted from each of them: menus, footers, notices,
lists of links. Running text of an article (paragraphs, headings, quotes and what is inline) must recur on more pages than the rest
does. What is not the page's own text and yet differs from page to page, such as reader comments, adverts, related links and forms,
no count can tell; of what is left, elements go whose tag or role says so, or a class or id made up of such a word and words that
only place it. Only then, if an article or main element of the page still has text, only text in those counts.

Counts are summed before they are shuffled. A host with P pages of S subtrees on average has fewer than S / ratio recurring ones,
so its template is a short list. Up to ``BROADCAST_ROWS`` subtrees in all are broadcast; beyond that pages join by host, and a host
of many pages is dealt into shares.
Hosts of fewer than ``MIN_PAGES`` pages have no template.

Null html gives an empty text, a null url belongs to the host ''. Repeated pages count as pages. Broken markup is read as far
as it goes: an unclosed element ends with its parent, an unclosed comment or script with the page, a '<' that starts no tag is
text. From a tag on whose quotes never end, quotes are not looked at any more. Elements more than ``DEPTH`` deep are read as their
parent's text. So a page of any length is read in time in proportion to it. Ties do not arise. An empty table gives no rows. Only
key, url and html are read; other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwright.llm.common import SHARE_ROWS, shared_join, split_keys, table, written
from hopwright.llm.line_dedup import host_of

RATIO = 0.5
#: For the running text of articles.
PROSE_RATIO = 0.8
MIN_PAGES = 10
#: 16 bytes a row and the host names.
BROADCAST_ROWS = 200_000
DEPTH = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style noscript template select option textarea iframe object embed svg math canvas audio video datalist input map title button".split())
ASIDE = frozenset("nav aside footer form dialog menu fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption body html head option".split())
#: Elements that end their like when it is still open, and the elements beyond which that is not looked for.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address".split())
#: Words that name what is not a page's own text, alone or at the end of a name.
WORDS = frozenset(
    "ad ads adv adbox adslot adsense dfp nav navbar sidenav navigation menu submenu footer header masthead topbar sidebar rail widget widgets banner cookie cookies consent gdpr notice notices alert popup modal overlay toast share sharing social related recommended promo promotion sponsored sponsor newsletter subscribe signup login breadcrumb breadcrumbs pagination pager comments comment disqus replies reply respond copyright skip toolbar paywall".split()
)
BEGINS = ("advert", "sidebar", "cookie", "comment", "sponsor", "breadcrumb", "newsletter", "subscri", "navigation", "footer", "adsby")
#: Words that only place what such a word names.
PLACES = frozenset(
    "area author bar block body bottom box button buttons col column container content count form group icons inner item items left link links list main meta module outer panel posts articles stories primary right row secondary section site slot space text thread title top unit wrap wrapper".split()
)
#: Names that begin so speak of the page around, not of the element.
STATES = frozenset("has no not with without is js hide show".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

QUOTED = re.compile(r"""[^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+>""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
READ = frozenset("class id role hidden style aria-hidden itemprop".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)


def attributes(text: str) -> dict[str, str]:
    if not text or "=" not in text and "hidden" not in text:
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text) if m[1].lower() in READ}


def _names(part: str) -> bool:
    return part in WORDS or part.startswith(BEGINS)


def unwanted(tag: str, named: dict[str, str], in_article: bool) -> bool:
    """Whether an element says of itself that it is not the page's own text."""
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not named or tag in ("html", "body"):
        return False
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(named.get("style", "")):
        return True
    if named.get("role", "").lower() in ROLES:
        return True
    if tag == "main":
        return False
    for token in f"{named.get('class', '')} {named.get('id', '')}".split():
        parts = [p.lower() for p in NAME_PART.findall(token)]
        if not parts or parts[0] in STATES:
            continue
        rest = [p for p in parts[1:] if not p.isdigit()]
        if rest and _names(rest[-1]):
            word = rest[-1]
        elif (_names(parts[0]) or parts[0] == "side") and all(p in PLACES or _names(p) for p in rest):
            word = parts[0]
        else:
            continue
        if tag == "article" and not word.startswith(("comment", "repl", "sponsor", "ad", "promo", "related")):
            continue
        if in_article and tag == "header" and word in ("header", "alert", "notice", "side"):
            continue
        return True
    return False


@dataclass
class Page:
    """The blocks of text of a page, in order. ``within`` is the innermost element that holds all of a block (-1: none), ``hashes``
    and ``up`` are the hashes and parents of the elements that hold blocks, parents first. Odd hashes are of an article's running
    text; ``aside`` marks what an element around says is not the page's own text."""

    texts: list[str] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    aside: list[bool] = field(default_factory=list)
    within: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)

    def main_text(self, template=frozenset()) -> str:
        gone = []
        for h, up in zip(self.hashes, self.up):
            gone.append(h in template or (up >= 0 and gone[up]))
        stay = [(t, a) for t, a, x, e in zip(self.texts, self.article, self.aside, self.within) if not x and (e < 0 or not gone[e])]
        only = any(a for _, a in stay)
        return "\n".join(t for t, a in stay if a or not only)


class _Element:
    __slots__ = ("tag", "name", "hidden", "aside", "article", "parts", "number")

    def __init__(self, tag, name, hidden, aside, article, number):
        self.tag, self.name, self.hidden, self.aside, self.article, self.parts, self.number = tag, name, hidden, aside, article, [], number


class _Reader:
    """Builds a Page from tags and texts in order."""

    def __init__(self):
        self.stack = [_Element("", "", False, False, False, -1)]
        self.open, self.flat = Counter(), Counter()
        self.hashes, self.up, self.found, self.pieces = [], [], [], []
        # The elements around the first piece of a block, how many of them hold all pieces so far, and how many are still open.
        self.around, self.common, self.still = self.stack[:], 1, 1

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                e = self.around[self.common - 1]
                self.found.append((text, bool(e.article), bool(e.aside), e.number))

    def close(self, depth: int) -> None:
        self.still = min(self.still, depth)
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.open[e.tag] -= 1
            h = xxhash.xxh64_intdigest("\0".join(map(str, (e.tag, e.name, *e.parts))))
            h = h & ~1 | bool(e.article and (e.tag in PROSE or e.tag not in BLOCKS))
            h = h - (1 << 64) if h >> 63 else h
            self.hashes[e.number] = h
            self.stack[-1].parts.append(h)

    def text(self, piece: str) -> None:
        top = self.stack[-1]
        if not piece:
            return
        piece = unescape(piece) if "&" in piece else piece
        own = " ".join(piece.split())
        top.parts.append(own)
        if top.hidden:
            return
        if own:
            if not any(map(str.strip, self.pieces)):
                self.around, self.common, self.still = self.stack[:], len(self.stack), len(self.stack)
            self.common = min(self.common, self.still)
        self.pieces.append(piece)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        if not self.open[tag]:
            return
        inner = tag not in ("html", "body", "article", "main", "table", "tr", "tbody", "div", "section")
        for depth in range(len(self.stack) - 1, 0, -1):
            at = self.stack[depth].tag
            if at == tag:
                self.close(depth)
                return
            if inner and at in ("article", "main", "body", "table", "td"):
                return

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in ENDS_P and self.open["p"]:
            self._end_like(frozenset(["p"]), BLOCKS | {"button"})
        if tag in SIBLINGS and any(self.open[t] for t in SIBLINGS[tag][0]):
            self._end_like(*SIBLINGS[tag])
        if tag in VOID:
            return
        if len(self.stack) > DEPTH:
            self.flat[tag] += 1
            return
        up, named = self.stack[-1], attributes(rest)
        hidden = up.hidden or tag in HIDDEN
        aside = up.aside or unwanted(tag, named, bool(up.article))
        main = tag in ("article", "main") or named.get("role", "").lower() == "main" or named.get("itemprop") == "articleBody"
        article = up.article or (main and not hidden and not aside)
        self.stack.append(_Element(tag, f"{named.get('class', '')}|{named.get('id', '')}", hidden, aside, article, len(self.up)))
        self.up.append(up.number)
        self.hashes.append(0)
        self.open[tag] += 1
        if rest.endswith("/") and tag in ("svg", "path"):
            self.close(len(self.stack) - 1)

    def _end_like(self, like: frozenset[str], beyond: frozenset[str]) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in like:
                self.close(depth)
                return
            if self.stack[depth].tag in beyond:
                return

    def page(self) -> Page:
        self.flush()
        self.close(1)
        used, place = set(), {-1: -1}
        for *_, number in self.found:
            while number >= 0 and number not in used:
                used.add(number)
                number = self.up[number]
        out = Page()
        for number in sorted(used):
            place[number] = len(out.hashes)
            out.hashes.append(self.hashes[number])
            out.up.append(place[self.up[number]])
        for text, article, aside, number in self.found:
            out.texts.append(text)
            out.article.append(article)
            out.aside.append(aside)
            out.within.append(place[number])
        return out


def read_page(html: str | None) -> Page:
    html = html or ""
    reader, n, at, begun, quotes = _Reader(), len(html), 0, 0, True
    # ``begun`` is where text that has not been handed on starts; a '<' that starts no tag stays in it.
    while (at := html.find("<", at)) >= 0:
        mark = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif mark in ("!", "?"):
            end = html.find(">", at) + 1
        else:
            name = TAG_NAME.match(html, at + 1 + (mark == "/"))
            if name is None and mark != "/":
                at += 1
                continue
            after = name.end() if name else at + 2
            end = html.find(">", after) + 1
            if end and name and quotes and ('"' in html[after:end] or "'" in html[after:end]):
                if m := QUOTED.match(html, after):
                    end = m.end()
                else:
                    quotes = False
            if end:
                reader.text(html[begun:at])
                begun = end
                if name:
                    tag, rest = name[0].lower(), html[after : end - 1]
                    if mark == "/":
                        reader.end(tag)
                    else:
                        reader.start(tag, rest)
                        if tag in RAW:
                            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(html, end)
                            end = begun = closing.start() if closing else n
                at = end
                continue
        if not end:  # no '>' follows: the rest is text
            break
        reader.text(html[begun:at])
        at = begun = end
    reader.text(html[begun:])
    return reader.page()


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given the hashes of its host's template."""
    return read_page(html).main_text(template)


_COLUMNS = {"texts": pa.list_(pa.string()), "article": pa.list_(pa.bool_()), "aside": pa.list_(pa.bool_()), "within": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64()), "up": pa.list_(pa.int32())}
_SCHEMA = "texts array<string>, article array<boolean>, aside array<boolean>, within array<int>, hashes array<bigint>, up array<int>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [read_page(h.as_py()) for h in batch.column(batch.num_columns - 1)]
        own = [pa.array([getattr(p, c) for p in pages], kind) for c, kind in _COLUMNS.items()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], *_COLUMNS])


def _cut(key: str):
    """Columns key, url, host, the host's template and the page's parts to key, url, text and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, drop = None, frozenset()
        for batch in batches:
            texts = []
            columns = [batch.column(i) for i in range(4, 4 + len(_COLUMNS))]
            for i, (name, template) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                if name != host:
                    host, drop = name, frozenset(template.as_py() or ())
                texts.append(Page(*(c[i].as_py() for c in columns)).main_text(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[key, "url", "text", "n_chars"])

    return run


def parse_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The page's key (``__key``), url, host and parts."""
    source = pages.select(F.col(key).alias("__key"), F.col("url"), host_of(F.col("url")).alias("host"), F.col("html"))
    kind = source.schema["__key"].dataType.simpleString()
    return source.mapInArrow(_parse, f"__key {kind}, url string, host string, {_SCHEMA}")


def templates(parsed: DataFrame, totals: DataFrame, split: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(``key``: host, ``hash``) of the subtrees that recur on at least ``min_pages`` pages and more than ``ratio`` of a host's, for
    running text of articles more than ``PROSE_RATIO``. ``totals`` has the pages ``n`` of each host, ``split`` the hosts of many."""
    each = parsed.select("host", F.explode(F.array_distinct("hashes")).alias("hash"))
    counts = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= min_pages)
    least = F.when(F.col("hash").bitwiseAND(F.lit(1)) == 1, F.lit(max(ratio, PROSE_RATIO))).otherwise(F.lit(ratio))
    found = shared_join(counts, F.col("host"), F.col("hash"), totals.filter(F.col("n") >= min_pages), split)
    return found.filter(F.col("times") > least * F.col("n")).select(F.col("host").alias("key"), "hash")


def extract(pages: DataFrame, key: str = "page_id", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """key, url, text and n_chars of each page."""
    parsed = written(parse_pages(pages, key), "parsed")
    totals = written(parsed.groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("n")), "hosts")
    split = split_keys(totals, totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], share_rows)
    found = written(templates(parsed, totals, split, ratio, min_pages), "templates")
    lists = found.groupBy("key").agg(F.collect_list("hash").alias("drop"))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = parsed.join(F.broadcast(lists.withColumnRenamed("key", "__host")), F.col("host") == F.col("__host"), "left")
    else:
        rows = shared_join(parsed, F.col("host"), F.col("__key"), lists, split)
    kind = parsed.schema["__key"].dataType.simpleString()
    return rows.select("__key", "url", "host", "drop", *_COLUMNS).mapInArrow(_cut(key), f"`{key}` {kind}, url string, text string, n_chars bigint")


def op3_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
