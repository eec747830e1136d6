"""Operator 12: the main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass decides
blocks by what they hold: the share of stop words, the length and the share of
text inside links, and by where they stand (navigation, forms, notices and the
like are never main text; an article's own blocks are not turned down for
having few stop words). Blocks that these rules leave open, mostly short ones,
inherit in the second pass the label of the nearest decided blocks.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadcast.llm.workers import map_arrow

# Function words of four languages.
STOP_WORDS = frozenset("""
a about after all an and are as at be been but by can for from had has have he her his if in into is it its more no not
of on one or our out she so than that the their them there they this to was we were what when which who will with you
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im
ist kann man mit nach nicht noch nur oder sich sie sind so um und uns von vor war was wenn werden wie wir zu zum zur
au aux avec ce ces cette dans de des du elle en est et il je la le les leur lui mais ne nous on ou où par pas plus pour
qu que qui sa se ses son sont sur un une vous
al como con del el en entre era es esta este ha hay las lo los más me muy o para pero por se sin sobre su sus también
tiene una y ya
""".split())

#: Tags whose content is no markup and no text; only their own end tag ends them.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}

#: Tags that are never part of the main text, and tags that hold it.
OUTSIDE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "head", "noscript", "template", "svg", "math", "object",
           "select", "button", "datalist"}
INSIDE = {"article", "main"}

#: Tags that hold blocks, and those that only part them.
HOLDERS = OUTSIDE | INSIDE | {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "fieldset", "blockquote"}
PARTERS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "thead", "tbody", "dt", "dd", "pre", "hr", "address",
           "figcaption", "summary", "caption", "body", "html", "legend", "option", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Words of a class or id that name a part around the text.
AROUND = frozenset("""
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion menu nav navbar
navigation breadcrumb breadcrumbs sidebar sidenav footer header masthead cookie cookies consent gdpr notice notices alert
popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended
recommendations widget toolbar pagination pager comment comments commentary reply replies respond disqus form copyright
""".split())
REMARKS = frozenset("comment comments reply replies respond disqus".split())

PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200          # code points
FEW, MANY = 0.10, 0.20         # shares of stop words
LINKED = 0.5                   # share of text inside links

GOOD, BAD, OPEN, POOR = 1, 0, None, 2


class Block:
    __slots__ = ("parts", "linked", "region", "outside", "inside", "heading")

    def __init__(self, region, outside, inside, heading):
        self.parts, self.linked = [], 0
        self.region, self.outside, self.inside, self.heading = region, outside, inside, heading


def named(attributes: str) -> set:
    """The words of the class, id and role attributes."""
    found = set()
    for groups in MARKS.findall(attributes):
        found.update(re.split(r"[^a-z]+", "".join(groups).lower()))
    return found


def blocks(page: str):
    """The blocks of a page: parts of text, code points in links, and where the block stands."""
    holders = []   # (tag, outside, inside, region) of the open tags that hold blocks
    outside, inside, region, regions = False, False, 0, 0
    link = 0
    block = Block(region, outside, inside, False)
    at = 0
    while at < len(page):
        part = PART.match(page, at)
        at = part.end()
        closing, tag, attributes = part.groups()
        if tag is None:
            text = part.group()
            if text.startswith("<!") or text.startswith("<?"):
                continue
            text = html.unescape(text)
            block.parts.append(text)
            if link:
                block.linked += len("".join(text.split()))
            continue
        if at == len(page) and not part.group().endswith(">"):
            break  # a tag that the page's end cuts off
        tag = tag.lower()
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "a":
            link = 0 if closing else 1
            continue
        if tag == "br":
            block.parts.append("\n")
            continue
        if tag not in HOLDERS and tag not in PARTERS:
            continue
        link = 0
        yield block
        heading = False
        own = outside
        if tag in HOLDERS:
            if not closing:
                names = named(attributes) if attributes else set()
                holders.append((tag, outside, inside, region))
                regions += 1
                if tag in INSIDE:
                    outside, inside, region = bool(names & REMARKS), True, regions
                elif tag in OUTSIDE or names & AROUND:
                    outside, region = True, regions
                if tag == "header" and inside and not holders[-1][1]:
                    outside = "heading"
            else:
                for k in range(len(holders) - 1, -1, -1):
                    if holders[k][0] == tag:
                        _, outside, inside, region = holders[k]
                        del holders[k:]
                        break
            own = outside
        elif not closing:
            heading = tag in HEADINGS
            if tag not in ("body", "html") and attributes and named(attributes) & AROUND:
                own = True
        if own == "heading":
            own = not heading
        block = Block(region, own, inside, heading)
    yield block


def first_pass(text: str, block: Block):
    """GOOD, BAD or OPEN by position, link share, length and share of stop words; POOR for want of stop words only."""
    if block.outside:
        return BAD
    solid = len("".join(text.split()))
    if block.linked > LINKED * solid:
        return BAD
    if len(text) < SHORT or block.heading:
        return OPEN
    words = WORDS.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if share >= MANY or (share >= FEW and (len(text) > LONG or block.inside)):
        return GOOD
    return OPEN if block.inside or share >= FEW else POOR


def second_pass(labels: list, found: list) -> list:
    """Open blocks take the label of the nearest decided one, in their own region if it has any.

    At equal distance the block before counts, but for headings, which belong
    to what they stand above. A region without a decided block is main text if it is
    an article's, or if the page has no decided block at all.
    """
    def nearest(own):
        before, after, last = [None] * len(labels), [None] * len(labels), {}
        for order, out in ((range(len(labels)), before), (range(len(labels) - 1, -1, -1), after)):
            last.clear()
            for k in order:
                if labels[k] is not OPEN:
                    last[own(k)] = k
                out[k] = last.get(own(k))
        return before, after

    # An advert or a list of links within an article says nothing of the text beside it.
    near = nearest(lambda k: -1 if found[k].inside and labels[k] == BAD else found[k].region)
    anywhere = nearest(lambda k: 0)
    out = list(labels)
    for k, label in enumerate(labels):
        if label is not OPEN:
            continue
        for before, after in ((near[0][k], near[1][k]), (None, None) if found[k].inside else (anywhere[0][k], anywhere[1][k])):
            if before is not None or after is not None:
                late = found[k].heading
                pick = before if after is None or (before is not None and k - before + late <= after - k) else after
                out[k] = labels[pick]
                break
        else:
            out[k] = GOOD
    return out


def main_text(page: str) -> str:
    """The main text of one page: its blocks in order, one line each."""
    texts, found = [], []
    for block in blocks(page):
        text = " ".join("".join(block.parts).split())
        if text:
            texts.append(text)
            found.append(block)
    # A page that marks its main text says so of all of it.
    marked = any(b.inside and not b.outside for b in found)
    labels = [BAD if marked and not b.inside else first_pass(t, b) for t, b in zip(texts, found, strict=True)]
    # Stop words tell blocks of a page apart; a page without any good block is in another language.
    poor = BAD if GOOD in labels else GOOD
    labels = [poor if label == POOR else label for label in labels]
    return "\n".join(t for t, label in zip(texts, second_pass(labels, found), strict=True) if label == GOOD)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The rows with the main text of their page and its number of code points.

    Character references are decoded, white space within a block becomes one
    blank, blocks are parted by a line feed. A null or empty page, and one
    without main text, gives an empty text. Markup that the page's end cuts
    off is no text. Other columns stay, except those named like the two new
    ones, which are replaced; the page itself goes. Equal rows give equal
    results, an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, count_col)]

    def texts(batches):
        for batch in batches:
            out = [main_text(page or "") for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), *batch.columns[1:]],
                ["made_text", "made_count", *batch.schema.names[1:]])

    names = [f"c{k}" for k in range(len(kept))]
    own = pages.select(F.col(f"`{html_col}`").cast("string").alias("page"), *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)))
    schema = ", ".join(["made_text string", "made_count long", *(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[1:])])
    return map_arrow(own, texts, schema).select(*names, "made_text", "made_count").toDF(*kept, text_col, count_col)
