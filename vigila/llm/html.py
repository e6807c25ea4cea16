"""Main text of web pages by tag-path ratios.

Every text block of a page has a root-to-leaf path of block elements (with
their class and id).  Text length and punctuation are summed over the blocks
of each path, and the share of it that stands in links is taken off.  The two
ratios per block are smoothed over neighbouring blocks of the same container
and fused.  Paths that reach a part of the page's best path are content, and
so is whatever stands in the lowest container that holds all of them, and
headings in the containers above it, but for blocks of links.  Elements that name themselves as something other than the
article (menus, headers, footers, sidebars, notices, adverts, forms, comments)
never count, and if a page marks its article, that part is taken whole.  A
class or id that has such a word doesn't count on an element that holds the
article: an unnamed article or main, or else most of the page's text.

Each page is read on its own, whole, in one pass; nothing is shuffled.

Defined results: null or empty html gives an empty text; markup that is never
closed ends with its container; equal rows get equal results; an empty table
gives an empty result; other columns are not read.  A line break inside a
block is white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td "
    "th blockquote pre figure figcaption address fieldset details summary center hgroup header footer nav aside form "
    "hr menu dialog search".split())
#: Never main text.
NEVER = frozenset(
    "head title script style noscript template nav footer aside form button select textarea option iframe object svg "
    "math canvas audio video dialog menu search datalist".split())
#: Words of a class or id, and roles, that name something other than the article.
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion "
    "banner cookie cookies consent gdpr notice notices sidebar aside menu menus nav navbar navigation breadcrumb "
    "breadcrumbs comment comments disqus reply replies respond share sharing social related recommended newsletter "
    "subscribe subscription signup popup modal overlay footer masthead toolbar pagination pager login search".split())
TALK = frozenset("comment comments reply replies respond disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: An open element that these start tags end: the tags, and where the search for it stops.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
#: What may stand in an unclosed head; any other start tag, or text, ends it.
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
_PUNCT = re.compile(r"[.,;:!?。、，！？]")
_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HEADING = re.compile(r"h[1-6](?:\.|$)")
#: A path counts from this part of the best path's score.
PART = 0.3


def _names(attributes: str) -> frozenset[str]:
    """Words of class and id, and pairs of them, so that side-bar is a sidebar."""
    names = set()
    for one in attributes.split():
        words = [w.lower() for w in _TOKEN.findall(one)]
        names.update(words, map("".join, zip(words, words[1:])))
    return frozenset(names)


#: Words that say nothing of what an element holds (fixed values).
NEUTRAL = frozenset("area block body box btn button buttons column container content group holder inner item items "
                    "left link links list main module outer panel right row section widget wrap wrapper".split())


def _wholly(attributes: str) -> frozenset[str]:
    """Words of those classes and ids that consist of banning and neutral words only:
    inside a marked article share-price and related-work are content."""
    names = set()
    for one in attributes.split():
        words = [w.lower() for w in _TOKEN.findall(one)]
        pairs = list(map("".join, zip(words, words[1:])))
        if pairs and any(x in OTHER for x in pairs) or all(w in OTHER or w in NEUTRAL for w in words):
            names.update(words, pairs)
    return frozenset(names)


class _Tree:
    """Numbered nodes, each with its parent's number, which is smaller: a path is one
    number, whatever its depth."""

    def __init__(self):
        self.up, self.name, self.known = [-1], [""], {}

    def child(self, parent: int, name: str, same: bool = True) -> int:
        """The child of this name; a new one each time if not ``same``."""
        found = self.known.get((parent, name)) if same else None
        if found is None:
            found = len(self.up)
            self.up.append(parent)
            self.name.append(name)
            if same:
                self.known[parent, name] = found
        return found

    def sums(self, values: dict[int, float]) -> list[float]:
        """For each node the sum of the values in and below it."""
        out = [0.0] * len(self.up)
        for i, v in values.items():
            out[i] += v
        for i in range(len(out) - 1, 0, -1):
            out[self.up[i]] += out[i]
        return out


class _Page(HTMLParser):
    """Blocks of a page: [path, container, text pieces, characters in links, marked,
    in a form, the innermost element whose class or id bans the block].  Paths and
    banning elements are numbers of trees, so deep pages take linear space."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, path up to it, banned, marked, in a link, banned by class or id
        self.open: list[tuple] = []
        self.paths, self.bans = _Tree(), _Tree()
        self.blocks: list[list] = []
        self.fresh = True

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD and tag != "head":
            self._end_head()
        if tag in BLOCK:
            self._end("p", stop="article main section div td th body")
            self.fresh = True
        if tag in ENDS:
            tags, stop = ENDS[tag]
            self._end(tags, stop)
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        a = {k: v or "" for k, v in attrs}
        said = f"{a.get('class', '')} {a.get('id', '')}"
        names = _names(said)
        _, path, banned, marked, linked, by = self.open[-1] if self.open else ("", 0, "", False, False, 0)
        main = tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody"
        if not banned or banned == "form":
            if tag in NEVER or a.get("role") in ROLES:
                banned = tag
            elif tag in ("html", "body"):
                pass
            elif main:
                if names & TALK:
                    banned = "comment"
                elif self.bans.name[by] != "talk":
                    by = 0  # an article is not what the words of its wrappers say
            elif not marked and tag == "header":
                banned = "other"
            elif (not _HEADING.match(tag) and _wholly(said) & OTHER) if marked else names & (OTHER | {"header"}):
                talk = names & TALK or self.bans.name[by] == "talk"  # of the element or of one around it
                by = self.bans.child(by, "talk" if talk else "other", same=False)
        if tag in BLOCK:
            path = self.paths.child(path, ".".join((tag, *sorted(names))))
        marked = marked or (main and not banned and not by)
        self.open.append((tag, path, banned, marked, linked or tag == "a", by))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def _end_head(self):
        if self.open and self.open[-1][0] == "head":
            del self.open[-1]
            self.fresh = True

    def _end(self, tags, stop):
        tags, stop = tags.split(), stop.split()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in stop:
                return
            if self.open[i][0] in tags:
                del self.open[i:]
                self.fresh = True
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.fresh = True
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if tag not in BLOCK and self.open[i][0] in BLOCK:
                return  # an inline element doesn't close its container

    def handle_data(self, data):
        if not data.isspace():
            self._end_head()
        _, path, banned, marked, linked, by = self.open[-1] if self.open else ("", 0, "", False, False, 0)
        if banned and banned != "form":
            if not data.isspace():
                self.fresh = True
            return
        if self.fresh:
            if data.isspace():
                return
            self.blocks.append([path, max(self.paths.up[path], 0), [], 0, marked, banned == "form", by])
            self.fresh = False
        b = self.blocks[-1]
        b[2].append(data)
        b[3] += len(data) if linked else 0


def _smooth(values: list[float], groups: list[int]) -> list[float]:
    out = []
    for i, v in enumerate(values):
        near = [values[j] for j in (i - 1, i + 1) if 0 <= j < len(values) and groups[j] == groups[i]]
        out.append((2 * v + sum(near)) / (2 + len(near)))
    return out


def main_text(page: str | None) -> str:
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    blocks = [(path, box, " ".join("".join(t).split()), link, marked, form, by)
              for path, box, t, link, marked, form, by in parser.blocks]
    blocks = [b for b in blocks if b[2]]
    # a class or id bans its element, unless that holds most of the page's text
    if not any(b[4] for b in blocks):
        bans, plain = parser.bans, {}
        for b in blocks:
            plain[b[6]] = plain.get(b[6], 0) + max(len(b[2]) - b[3], 0)
        held, most = bans.sums(plain), sum(plain.values()) / 2
        fine = [True] * len(held)
        for i in range(1, len(held)):
            fine[i] = fine[bans.up[i]] and held[i] > most and bans.name[i] != "talk"
        blocks = [b for b in blocks if fine[b[6]]]
    else:
        blocks = [b for b in blocks if not b[6]]
    # a form is not main text, unless the page is one large form
    if 2 * sum(len(b[2]) for b in blocks if b[5]) <= sum(len(b[2]) for b in blocks):
        blocks = [b for b in blocks if not b[5]]
    if any(b[4] for b in blocks):
        blocks = [b for b in blocks if b[4]]
    # length and punctuation per block of each path, without what stands in links
    sums: dict[int, list[float]] = {}
    for path, _, text, link, *_ in blocks:
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += max(len(text) - link, 0)
        s[2] += len(_PUNCT.findall(text))
        s[3] += len(text)
    boxes = [b[1] for b in blocks]
    length = _smooth([sums[b[0]][1] / sums[b[0]][0] for b in blocks], boxes)
    points = _smooth([sums[b[0]][2] / sums[b[0]][0] * sums[b[0]][1] / sums[b[0]][3] for b in blocks], boxes)
    score: dict[int, float] = {}
    for b, n, p in zip(blocks, length, points):
        score[b[0]] = max(score.get(b[0], 0.0), n * (1 + p))
    best = max(score.values(), default=0.0)
    strong = {}
    for b in blocks:
        if score[b[0]] >= PART * best:
            strong[b[1]] = strong.get(b[1], 0) + 1
    # the lowest container that holds every path that counts: children have larger numbers
    paths = parser.paths
    below = paths.sums(strong)
    seed = max((i for i, n in enumerate(below) if n == below[0]), default=0)
    inside, above = [seed == 0] * len(below), {seed}
    for i in range(1, len(below)):
        inside[i] = i == seed or inside[paths.up[i]]
    while seed > 0:
        seed = paths.up[seed]
        above.add(seed)

    def content(b) -> bool:
        if b[4] or score[b[0]] >= PART * best:
            return True
        # a heading of the text may stand in a container above
        heads = _HEADING.match(paths.name[b[0]]) and b[1] in above
        return bool(inside[b[1]] or heads) and b[3] * 2 <= len(b[2])

    return "\n".join(b[2] for b in blocks if content(b))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            text = pa.array([main_text(h) for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"),
                        pages["html"].cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
