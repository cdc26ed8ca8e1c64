"""Main text of web pages by two-pass block rules.

Pass one cuts a page into blocks at block-level tags and classifies each by its place (inside navigation, footers,
adverts, forms, comments and the like), its link density, its length and its share of stop words: good, bad or open
(short). On a page whose text holds hardly any of the listed stop words (another language), length alone makes a block
good. A form, or a box that only its layout names (widget, sidebar, header, ...) speak against, is no bad place when it
holds most of the page's text and no article stands outside of it. Pass two walks the open blocks: each inherits the label of the nearest decided blocks
before and after it, those in its own section (article, aside, ...) first; where they differ, the nearer one wins, and a
tie is good inside an article. Blocks of links inside an article decide nothing for others. One narrow Arrow pass over the
pages; a page is one row, so nothing is shuffled.

Defined results. Null or empty html, or none that is kept: the empty string. Broken markup: unknown end tags are
ignored, open ones end with the page, hidden ones (an option, a template) with the element around them; a script or style
without an end is raw text up to the page's end. Repeated rows: each is extracted. Null ids and urls are carried. Empty tables give
no rows. Nothing is cut at any length; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent function words of four languages.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on or she so than that the their
them then there they this to was we were when which who will with would you
à au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu
que qui sa se ses son sont sur un une vous
aber als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für haben hat ich im ist mit nach
nicht noch nur oder sein sich sie sind so über um und von vor war werden wie wir zu zum zur
al como con del el ella ellos era esta este fue ha hay las lo los más muy no o para pero por se sin sobre su sus también
todo y ya
""".split())
#: Tags.
RAW = frozenset("script style noscript title iframe textarea".split())
HIDDEN = frozenset("template svg object select datalist optgroup option button canvas math audio video map".split())
PLACES = frozenset("nav footer aside form dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article main section aside nav footer header div form".split())
#: Words of class, id and role attributes that name what isn't the article.
BAD_NAMES = re.compile(r"(?:^|[\s_\-])(?<!has-)(?<!no-)(?<!with-)(?:ads?|advert(?:s|isement|ising)?|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|"
                       r"sidebar|side|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|replies|reply|"
                       r"disqus|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|signup|login|search|pager|pagination|"
                       r"widget|toolbar|contentinfo|complementary|skip|hidden)(?=$|[\s_\-\d])", re.I)
#: Those of them that layouts use for the box around an article as well.
SOFT_NAMES = re.compile(r"(?:^|[\s_\-])(?:banner|promo(?:tion)?|sidebar|side|header|masthead|alert|popup|modal|overlay|share|sharing|social|signup|login|search|widget|toolbar)(?=$|[\s_\-\d])", re.I)
TITLE_NAMES = re.compile(r"\bheader\b|(?<=[_-])header", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_HIDE = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


#: A bad place: its number, and whether holding most of the page clears it.
Causes = tuple[tuple[int, bool], ...]


class Block:
    __slots__ = ("parts", "linked", "causes", "bad", "section", "article", "label", "text", "heading")

    def __init__(self, causes: Causes, section: int, article: bool, heading: bool):
        self.parts, self.linked, self.causes, self.section, self.article, self.heading = [], 0, causes, section, article, heading
        self.label, self.bad = "", False


def speaks_against(tag: str, attrs: str, article: bool) -> str:
    """Whether a tag, or its class, id, role or a hiding attribute, says that this isn't article text: hard, soft or ''."""
    hard = tag in PLACES and tag != "form" or tag == "header" and not article or bool(attrs and _HIDE.search(attrs))
    names = " ".join(x for g in _NAMES.findall(attrs or "") for x in g if x)
    if article:  # the header inside an article holds its title
        names = TITLE_NAMES.sub("", names)
    named = bool(names and BAD_NAMES.search(names))
    if hard or named and BAD_NAMES.search(SOFT_NAMES.sub(" ", names)):
        return "hard"
    return "soft" if named or tag == "form" else ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, each with its place; blocks without text are left out."""
    out: list[Block] = []
    open_tags: list[tuple[str, Causes, int, bool]] = []  # tag, bad places around, section, article
    hushed: list[str] = []  # an element that isn't shown, and the open ones in it
    now, links, sections, places = None, 0, 0, 0
    skip, pos, end = None, 0, len(page)

    def place() -> tuple[Causes, int, bool]:
        return open_tags[-1][1:] if open_tags else ((), 0, False)

    def caused(tag: str, attrs: str, causes: Causes, article: bool) -> Causes:
        nonlocal places
        how = speaks_against(tag, attrs, article)
        if not how:
            return causes
        places += 1
        return (*causes, (places, how == "soft"))

    while pos < end:
        if skip:  # raw text up to the end tag
            m = re.compile(rf"</{skip}\s*>", re.I).search(page, pos)
            if m or skip in ("script", "style"):
                pos = m.end() if m else end
            skip = None
            continue
        m = _TOKEN.match(page, pos)
        if m is None:  # a '<' that opens no tag
            m_text, pos = page[pos], pos + 1
            closing = tag = None
        else:
            pos = m.end()
            closing, tag, attrs, m_text = m.groups()
        if m_text is not None:
            if hushed:
                continue
            if now is None:
                if m_text.isspace():
                    continue
                now = Block(*place(), False)
                out.append(now)
            now.parts.append((m_text, links > 0))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                skip = tag
            continue
        if hushed and not closing and hushed[0] in ("option", "optgroup") and tag not in INLINE and tag not in HIDDEN:
            hushed.clear()  # an option alone ends with the next block
        if hushed:
            if not closing:
                if tag not in VOID and tag not in INLINE and not attrs.rstrip().endswith("/"):
                    hushed.append(tag)
                continue
            if tag in hushed:
                del hushed[len(hushed) - 1 - hushed[::-1].index(tag):]
                continue
            if tag in INLINE:
                continue
            hushed.clear()  # the element around it ends
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1 if links else int(bool(_HREF.search(attrs)))
            continue
        if tag == "br" or tag == "img" or tag == "input":
            if now is not None:
                now.parts.append((" ", False))
            continue
        if tag in HIDDEN:
            if not closing and not attrs.rstrip().endswith("/"):
                hushed.append(tag)
            continue
        if tag == "head" or tag in INLINE:
            continue
        now = None
        if tag in VOID:
            continue
        if closing:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    del open_tags[k:]
                    links = 0
                    break
            continue
        if tag in SECTIONS or tag in PLACES or tag in ("ul", "ol", "table", "body"):
            causes, section, article = place()
            if tag != "body":
                causes = caused(tag, attrs, causes, article)
            if tag in SECTIONS:
                sections += 1
                section = sections
            open_tags.append((tag, causes, section, article or tag in ("article", "main")))
        else:
            causes, section, article = place()
            now = Block(caused(tag, attrs, causes, article), section, article, tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
            out.append(now)
    size: dict[int, int] = {}
    for b in out:
        # an entity may be cut by no tag, so parts are decoded on their own
        b.linked = sum(len(t) for t, a in b.parts if a)
        b.text = " ".join(html.unescape("".join(t for t, _ in b.parts)).split())
        for number, _ in b.causes:
            size[number] = size.get(number, 0) + len(b.text)
    most = sum(len(b.text) for b in out) / 2
    named = [{number for number, _ in b.causes} for b in out if b.article and b.text]
    beside = {number for number in size if any(number not in around for around in named)}  # an article stands outside of it
    for b in out:
        b.bad = any(not soft or size[number] <= most or number in beside for number, soft in b.causes)
    return [b for b in out if b.text]


def classify(blocks: list[Block], short_words: int = 10, stop_share: float = 0.1, link_share: float = 0.5, known_share: float = 0.15, long_letters: int = 60) -> None:
    """Both passes; sets each block's label to good or bad."""
    shown = [b for b in blocks if not (b.bad or b.linked > link_share * sum(len(t) for t, _ in b.parts))]
    words = {id(b): _LETTERS.findall(b.text.lower()) for b in shown}
    stops = {k: sum(map(STOP_WORDS.__contains__, w)) for k, w in words.items()}
    known = sum(stops.values()) >= known_share * sum(map(len, words.values()))  # a language with a list
    for b in blocks:
        own = words.get(id(b))
        if own is None:
            b.label = "bad"
        elif b.heading:
            b.label = ""
        elif known:
            b.label = "good" if len(own) >= short_words and stops[id(b)] >= stop_share * len(own) else ""
        else:
            b.label = "good" if sum(map(len, own)) >= long_letters else ""
    decided = ["" if b.article and not b.bad and b.label == "bad" else b.label for b in blocks]

    # one sweep each way gives every open block its neighbours, so a page of open blocks costs linear time
    before: dict[tuple[int, int], tuple[int, str]] = {}
    for step, order in ((-1, range(len(blocks))), (1, range(len(blocks) - 1, -1, -1))):
        last_any, last_in = None, {}
        for k in order:
            before[k, step] = last_in.get(blocks[k].section), last_any
            if decided[k]:
                last_any = (k, decided[k])
                last_in[blocks[k].section] = last_any
    for k, b in enumerate(blocks):
        if b.label:
            continue
        near = [before[k, s][0] for s in (-1, 1) if before[k, s][0]] or [before[k, s][1] for s in (-1, 1) if before[k, s][1]]
        labels = {x[1] for x in near}
        if b.article and not any(before[k, s][0] for s in (-1, 1)):
            b.label = "good"  # an article without any decided block
        elif not labels:
            b.label = "good"
        elif len(labels) == 1:
            b.label = labels.pop()
        else:
            gap = sorted((abs(x[0] - k), x[1]) for x in near)
            b.label = gap[0][1] if gap[0][0] != gap[1][0] else ("good" if b.article else "bad")


def main_text(page: str | None, **options) -> str:
    blocks = blocks_of(page or "")
    classify(blocks, **options)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), **options) -> DataFrame:
    """One row per page: the columns ``keep``, text and n_chars (its code points)."""
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                rows = batch.slice(first, 200)
                text = [main_text(x.as_py(), **options) for x in rows.column(html_column)]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*[f"`{c}`" for c in dict.fromkeys([*keep, html_column])]).mapInArrow(run, schema)
