"""Main text of web pages by wrapper induction.

A page's DOM is folded into its *layout*: the block elements, where siblings of
one label (tag, class, id) are one node, a slot that repeats.  Layouts of one
host are aligned with the host's most frequent layout by simple tree matching.
A node whose text is the same wherever the host's pages have it is template; all
others are slots.  The main text is made of the slots that don't stand in a
menu, header, footer, sidebar, notice, advert, form, script, style or comment
list, within the page's article where it marks one.

Pages stay where they are: what is shuffled is a layout and one digest a node,
counted before the shuffle, so a host with a third of all pages is no hot spot.
Only nodes that turn out to be template are sent back to the pages' blocks.

Null and empty HTML gives an empty text, as does a page without main text; a
null URL, or one without ``://``, has the empty host.  Equal pages have equal
texts and count once as evidence.  A host whose pages show fewer than
``MIN_CONTENTS`` different main texts has no template.  Headings within an
article are never template.  Pages of any length are read whole, each in one
task; block elements deeper than ``MAX_DEPTH`` count as parts of the one at that
depth, and keep their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import arrow_batches, materialize
from .textbatch import _quoted

#: Different main texts that must agree on a node's text before it is template.
MIN_CONTENTS = 3
MAX_DEPTH = 200

# Names of HTML elements and of their usual roles.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SKIPPED = frozenset("script style textarea title head nav footer aside form noscript template menu dialog select button iframe object svg canvas audio video xmp noembed noframes".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
_ENDS_P = _BLOCKS - frozenset("body dd dt head html legend li noscript optgroup option summary tbody tfoot thead title tr".split()) | {"li", "dd", "dt"}
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
#: Elements beyond which an implied end doesn't reach.
_WALLS = frozenset("ul ol dl table article section div body aside nav td th".split())
_ROLE_WORDS = frozenset(
    "ad ads adbox advert advertisement adverts adsense adslot banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookiebar cookies copyright disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_HEADER_WORDS = frozenset("header pageheader siteheader".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))          # a comment
      | <(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)(?:>|\Z)  # a tag
      | <[!?][^>]*+(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}

#: Where a block stands, best first.
IN_ARTICLE, IN_MAIN, ELSEWHERE = 0, 1, 2


@lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> tuple[str, bool, bool, int]:
    """Label, whether its role is that of boilerplate, whether it is a header, and where its content stands."""
    label, words, role, article = tag, set(), "", tag == "article"
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name in ("class", "id"):
            for one in value.split():
                parts = _WORD.findall(one)
                words.update(parts[:1] + parts[-1:] + ["".join(parts)])
            label += (".", "#")[name == "id"] + _DIGITS.sub("0", " ".join(value.split()))
        elif name == "role":
            role = value.strip()
        else:
            article |= value.strip() == "articlebody"
    frame = tag in ("html", "body", "main")
    skipped = tag in _SKIPPED or role in _ROLES or (not frame and bool(words & _ROLE_WORDS if tag != "article" else words & {"comment", "comments", "reply"}))
    header = tag == "header" or (not frame and tag not in _HEADINGS and bool(words & _HEADER_WORDS))
    return label.replace("\n", " "), skipped, header, IN_ARTICLE if article else IN_MAIN if tag == "main" or role == "main" else ELSEWHERE


class Page:
    """One page's layout and blocks, read in one pass over its tags.

    ``labels`` and ``parents`` are the layout's nodes, parents first; ``texts``
    the pieces of text of each; ``blocks`` (node, place, text, characters in
    links, whether a heading) those of no boilerplate role, in page order.
    """

    def __init__(self, html: str) -> None:
        self.labels, self.parents, self.depths, self.texts = [""], [-1], [0], [[]]
        self.blocks: list[tuple[int, int, str, int, bool]] = []
        self._nodes: dict[tuple[int, str], int] = {}
        self._piece: list[str] = []
        self._linked = 0
        #: open elements: tag, node, boilerplate, place, heading, link
        self._open: list[tuple[str, int, bool, int, bool, bool]] = [("", 0, False, ELSEWHERE, False, False)]
        self._count: dict[str, int] = {}
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            self._text(html[at : m.start() if m else size])
            if not m:
                break
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in _RAW:
                end = _RAW_END[tag].search(html, at)
                self._text(html[at : end.start() if end else size], tag in ("title", "textarea"))
                at = end.start() if end else size
        self._flush()

    def _text(self, raw: str, decode: bool = True) -> None:
        if raw:
            piece = unescape(raw) if decode and "&" in raw else raw
            self._piece.append(piece)
            if self._open[-1][5]:
                self._linked += len("".join(piece.split()))

    def _flush(self) -> None:
        """End the block at hand."""
        if self._piece:
            text = " ".join("".join(self._piece).split())
            if text:
                _, node, skipped, place, heading, _ = self._open[-1]
                self.texts[node].append(text)
                if not skipped:
                    self.blocks.append((node, place, text, self._linked, heading))
            self._piece.clear()
        self._linked = 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag in ("td", "th"):
            self._piece.append(" ")
        if tag in _ENDS_P and self._count.get("p"):
            self._end("p")
        for other in _ENDS_SAME.get(tag, ()):
            if self._count.get(other):
                for one in reversed(self._open):
                    if one[0] == other:
                        self._end(other)
                        break
                    if one[0] in _WALLS:
                        break
        _, node, skipped, place, heading, link = self._open[-1]
        read = _element if len(attributes) <= 200 else _element.__wrapped__  # what is kept stays small
        label, boilerplate, header, own = read(tag, attributes.strip())
        place = min(place, own)
        boilerplate |= header and place != IN_ARTICLE
        block = tag in _BLOCKS or (boilerplate and not skipped)
        if block:
            self._flush()
            if self.depths[node] < MAX_DEPTH:
                child = self._nodes.get((node, label))
                if child is None:
                    child = self._nodes[node, label] = len(self.labels)
                    self.labels.append(label)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                    self.texts.append([])
                node = child
        if tag not in _VOID:
            self._open.append((tag, node, skipped or boilerplate, place, heading or tag in _HEADINGS, link or tag == "a"))
            self._count[tag] = self._count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        """Close the nearest open element of that name, and all within it; an inline one only up to its block."""
        if not self._count.get(tag):
            return
        if tag not in _BLOCKS:
            for one in reversed(self._open):
                if one[0] == tag:
                    break
                if one[0] in _BLOCKS:
                    return
        while True:
            one = self._open[-1]
            if one[1] != self._open[-2][1] or one[0] in _BLOCKS or one[2] != self._open[-2][2]:
                self._flush()
            self._open.pop()
            self._count[one[0]] -= 1
            if one[0] == tag:
                return

    def main_blocks(self) -> list[tuple[int, int, str, int, bool]]:
        """Blocks of the article; else of the main part; else of the page, without lists of links."""
        for place in (IN_ARTICLE, IN_MAIN):
            if found := [b for b in self.blocks if b[1] == place]:
                return found
        return [b for b in self.blocks if 2 * b[3] <= len("".join(b[2].split()))]

    def layout(self) -> str:
        return "\n".join(f"{p} {label}" for p, label in zip(self.parents[1:], self.labels[1:], strict=True))

    def digests(self) -> list[int]:
        """A signed 64-bit digest of each node's text; 0 for none."""
        return [_digest("\n".join(t)) if t else 0 for t in self.texts]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) or 1


def tree_of(layout: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of a layout's nodes; node 0 is the root."""
    labels, children = [""], [[]]
    for line in layout.split("\n") if layout else []:
        parent, _, label = line.partition(" ")
        children[int(parent)].append(len(labels))
        labels.append(label)
        children.append([])
    return labels, children


def match_trees(one: str, other: str) -> list[int]:
    """For each node of ``one`` its partner in ``other``, or -1, by simple tree matching.

    The matching of most nodes that keeps labels, parents and the order of
    siblings.  Siblings have different labels in a layout, so of a child's
    pairs only one has a weight, and the best choice of children is the
    heaviest increasing sequence of their partners' places.
    """
    a, a_children = tree_of(one)
    b, b_children = tree_of(other)
    chosen: list[list[tuple[int, int]]] = [[] for _ in a]
    pairs: list[tuple[int, int, list[tuple[int, int, int]]]] = []  # node, partner, (place, child, number of its pair)
    index: dict[int, int] = {}
    stack = [(0, 0)]
    while stack:  # parents before children
        x, y = stack.pop()
        index[x] = len(pairs)
        places = {b[c]: (i, c) for i, c in enumerate(b_children[y])}
        common = [(places[a[c]][0], c, places[a[c]][1]) for c in a_children[x] if a[c] in places]
        pairs.append((x, y, common))
        stack.extend((c, d) for _, c, d in common)
    weight = [1] * len(pairs)
    for number in range(len(pairs) - 1, -1, -1):  # children before parents
        x, y, common = pairs[number]
        total, kept = _heaviest([(place, weight[index[c]]) for place, c, _ in common], len(b_children[y]))
        weight[number] += total
        chosen[x] = [(common[i][1], common[i][2]) for i in kept]
    partner = [-1] * len(a)
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        partner[x] = y
        stack.extend(chosen[x])
    return partner


def _heaviest(items: list[tuple[int, int]], places: int) -> tuple[int, list[int]]:
    """The heaviest subsequence of increasing places: its weight and indices; earliest items on ties."""
    best = [(0, -1)] * (places + 1)  # by place, largest weights of prefixes, and the last item of each
    back = []
    for i, (place, weight) in enumerate(items):
        top, last, at = 0, -1, place
        while at > 0:
            if best[at][0] > top:
                top, last = best[at]
            at -= at & -at
        back.append(last)
        at = place + 1
        while at <= places:
            if top + weight > best[at][0]:
                best[at] = (top + weight, i)
            at += at & -at
    top, last, at = 0, -1, places
    while at > 0:
        if best[at][0] > top:
            top, last = best[at]
        at -= at & -at
    kept = []
    while last >= 0:
        kept.append(last)
        last = back[last]
    return top, kept[::-1]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


_LAYOUT = "host string, layout_id long, layout string, digests array<long>, content long"


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's layout, digests of its nodes and of its main text."""
    names = ["host", "layout_id", "layout", "digests", "content"]
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(html.as_py() or "")
            layout = page.layout()
            rows.append((host, _digest(layout), layout, page.digests(), _digest("\n\n".join(b[2] for b in page.main_blocks()))))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def induce(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Template nodes of all hosts: ``host``, ``layout_id``, ``template`` (nodes of that layout).

    Layouts without a template node have no row.
    """
    arrow_batches(pages.sparkSession)
    source = pages.select(host_of(_quoted(url)).alias("host"), _quoted(html).alias("html"))
    seen = materialize(source.mapInArrow(_layouts, _LAYOUT))  # some hundred bytes a page, read three times
    nodes = seen.select("host", "layout_id", F.posexplode("digests").alias("node", "digest"))
    nodes = nodes.groupBy("host", "layout_id", "node").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    contents = seen.select("host", "layout_id", "content").distinct().groupBy("host", "layout_id").agg(F.count("*").alias("contents"))
    layouts = seen.groupBy("host", "layout_id", "layout").agg(F.count("*").alias("pages")).join(contents, ["host", "layout_id"])
    chosen = layouts.groupBy("host").agg(F.max_by(F.col("layout"), F.struct("pages", "layout_id")).alias("model"), F.sum("contents").alias("all_contents"))

    @F.pandas_udf("array<int>")
    def partners(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([match_trees(x, y) for x, y in zip(one, other, strict=True)])

    # a host with fewer contents than that can have no template
    aligned = layouts.join(chosen.filter(F.col("all_contents") >= MIN_CONTENTS), "host").select("host", "layout_id", "contents", F.posexplode(partners("layout", "model")).alias("node", "slot"))
    placed = nodes.select("host", "layout_id", "node", "low", "high").join(aligned.filter("slot >= 0"), ["host", "layout_id", "node"])
    constant = placed.groupBy("host", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("contents").alias("support"))
    constant = constant.filter((F.col("low") == F.col("high")) & (F.col("low") != 0) & (F.col("support") >= MIN_CONTENTS))
    return placed.join(constant.select("host", "slot"), ["host", "slot"], "left_semi").groupBy("host", "layout_id").agg(F.collect_list("node").alias("template"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's layout and the blocks of its main part; the HTML stays behind."""
    block = pa.list_(pa.struct([("node", pa.int32()), ("kept", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        layouts, blocks = [], []
        for html in batch.column("_html"):
            page = Page(html.as_py() or "")
            layouts.append(_digest(page.layout()))
            blocks.append([{"node": n, "kept": heading and place == IN_ARTICLE, "text": t} for n, place, t, _, heading in page.main_blocks()])
        at = batch.schema.get_field_index("_html")
        columns = [batch.column(i) for i in range(at)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(layouts, pa.int64()), pa.array(blocks, block)], [*batch.schema.names[:at], "_layout", "_blocks"])


def extract(pages: DataFrame, keep: list[str] | None = None, html: str = "html", url: str = "url") -> DataFrame:
    """``keep`` columns of ``pages`` (all but the HTML by default) with ``text`` and ``n_chars``.

    Blocks of text are joined by an empty line; white space within one is one
    space.  New columns take the place of equally named ones.
    """
    arrow_batches(pages.sparkSession)
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars") and (keep is not None or c != html)]
    # written first, so that its size decides whether it is broadcast to the blocks or joined by shuffles
    wrappers = materialize(induce(pages, html, url)).withColumnsRenamed({"host": "_host", "layout_id": "_layout"})
    source = pages.select(*[_quoted(c).alias(f"_{i}") for i, c in enumerate(keep)], host_of(_quoted(url)).alias("_host"), _quoted(html).alias("_html"))
    new = T._parse_datatype_string("_layout long, _blocks array<struct<node int, kept boolean, text string>>")
    read = source.mapInArrow(_blocks, T.StructType([*source.schema.fields[:-1], *new]))
    joined = read.join(wrappers, ["_host", "_layout"], "left")
    content = F.filter("_blocks", lambda b: b["kept"] | F.col("template").isNull() | ~F.array_contains(F.col("template"), b["node"]))
    text = F.array_join(F.transform(content, lambda b: b["text"]), "\n\n")
    return joined.select(*[F.col(f"_{i}") for i in range(len(keep))], text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long")).toDF(*keep, "text", "n_chars")
