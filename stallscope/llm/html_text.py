"""HTML extraction by block rules in two passes.

Pass one classifies each block on its own: by the containers it stands in, link density, length and stop-word
density, as good, bad or undecided (short, or long without enough stop words). In pass two an undecided block
takes the label of its nearest decided neighbours: good if both sides are good, the label of the nearer one if
they differ (bad at equal distance). Only blocks of the same region are neighbours: the blocks of one article or
main element, or else the page outside them. In a region that is an article without any decided block, undecided
blocks are good; elsewhere they are bad.

A block is the text between two block-level tags. Character references are decoded, white space inside a block
becomes one space, empty blocks vanish. Null or empty html gives an empty text; rows stay as they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from stallscope.llm.common import slices

# HTML element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea noscript template iframe noembed noframes svg math object xmp button select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTAINERS = frozenset(
    "article aside blockquote body dialog div dl fieldset figure footer form header main menu nav ol section table td th ul".split()
)
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog search".split())
REGION_TAGS = frozenset(("article", "main"))

# Words of class, id and role attributes that mark boilerplate.
MARKERS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disclaimer disqus feedback footer gdpr hidden login menu modal nav navbar navigation newsletter notice notification "
    "overlay pager pagination popup promo promotion recommended related replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored sponsors subscribe subscription teaser toolbar widget".split()
)
#: Outside articles only; an article has a header of its own.
OUTER_MARKERS = frozenset(("header", "masthead", "top", "topbar"))

# Stop words: the commonest function words of each language.
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was were "
        "which will with you "
        "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht sich sie sind "
        "um und von war wie wird zu zum zur "
        "al como con de del el en era es esta este la las le lo los más no para pero por que se sin su sus un una y "
        "au aux avec ce cette dans des du elle est et il ils je les leur mais ne nous ou par pas plus pour qu que qui sa ses son sont sur une vous"
    ).split()
)


@dataclass(frozen=True)
class Rules:
    link_density: float = 0.33  # more than this share of a block's characters inside links: bad
    short: int = 70  # characters; shorter blocks are undecided
    long: int = 200  # characters; longer blocks need fewer stop words
    stop_density: float = 0.10  # share of stop words that decides for good
    stop_density_long: float = 0.05


@dataclass
class Block:
    region: int  # 0: outside articles
    boilerplate: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPLIT = re.compile(r"[^a-z0-9]+")


def is_marked(attributes: str, inside: bool) -> bool:
    """True when class, id, role or style of an element say that it is boilerplate or hidden."""
    if not attributes.strip():
        return False
    lower = attributes.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", lower):
        return True
    for m in ATTRIBUTE.finditer(lower):
        if m[1] in ("class", "id", "role"):
            words = set(SPLIT.split(m[2] or m[3] or m[4] or ""))
            if words & MARKERS or not inside and words & OUTER_MARKERS:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what pass one needs to know of each. Tolerates unclosed and stray tags."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, boilerplate here or above, region
    regions, links, at, current = 0, 0, 0, None
    unclosed: set[str] = set()

    def text(s: str) -> None:
        nonlocal current
        if not s:
            return
        if current is None:
            _, boilerplate, region = stack[-1] if stack else ("", False, 0)
            current = Block(region, boilerplate)
            out.append(current)
        s = entities.unescape(s)
        current.pieces.append(s)
        if links:
            current.linked += len("".join(s.split()))

    while True:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        follows = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if follows in ("!", "?"):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        if not (follows == "/" or follows.isascii() and follows.isalpha()):
            text("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if m:
            closing, tag, attributes, at = bool(m[1]), m[2].lower(), m[3], m.end()
        else:  # a stray end tag, an unclosed quote, or a tag that the page's end cuts off
            end = page.find(">", lt)
            name = re.match(r"[a-zA-Z0-9:-]*", page[lt + 1 + (follows == "/") : lt + 41])[0].lower()
            closing, tag, attributes, at = follows == "/", name, "", len(page) if end < 0 else end + 1
        if tag in RAW_TAGS:
            if not closing and tag not in unclosed and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
                if end is None and tag in ("script", "style", "textarea", "title", "noscript", "iframe"):
                    break  # never closed: the rest of the page is inside it
                if end is None:
                    unclosed.add(tag)  # not searched again
                else:
                    stop = page.find(">", end.start())
                    at = len(page) if stop < 0 else stop + 1
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        current, links = None, 0
        if tag not in CONTAINERS:
            continue
        if closing:
            if any(name == tag for name, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif not attributes.rstrip().endswith("/") or tag not in VOID_TAGS:
            _, boilerplate, region = stack[-1] if stack else ("", False, 0)
            if tag in REGION_TAGS and not boilerplate and not region:
                regions += 1
                region = regions
            outer = tag == "header" and not region
            stack.append((tag, boilerplate or tag in BOILERPLATE_TAGS or outer or is_marked(attributes, bool(region)), region))
    return [b for b in out if b.text]


def first_label(block: Block, rules: Rules) -> bool | None:
    """True: good, False: bad, None: undecided."""
    if block.boilerplate:
        return False
    text = block.text
    if block.linked > rules.link_density * len(text):
        return False
    if len(text) < rules.short:
        return None
    words = [w.strip(".,;:!?\"'()[]%#*$&|<>-").lower() for w in text.split()]
    density = sum(w in STOP_WORDS for w in words) / len(words)
    return True if density >= (rules.stop_density_long if len(text) > rules.long else rules.stop_density) else None


def labels(found: list[Block], rules: Rules) -> list[bool]:
    """Whether each block is main text, after both passes."""
    first = [first_label(b, rules) for b in found]
    out = [bool(x) for x in first]
    for region in {b.region for b in found}:
        members = [i for i, b in enumerate(found) if b.region == region and not (region and b.boilerplate)]
        before: list[tuple[int, bool] | None] = []  # (place, label) of the nearest decided block up to each member
        last = None
        for k, i in enumerate(members):
            last = (k, first[i]) if first[i] is not None else last
            before.append(last)
        last = None
        for k in range(len(members) - 1, -1, -1):
            i = members[k]
            if first[i] is not None:
                last = (k, first[i])
                continue
            sides = [x for x in (before[k], last) if x is not None]
            if not sides:
                out[i] = region > 0
            elif len({label for _, label in sides}) == 1:
                out[i] = sides[0][1]
            else:
                (p, label), (q, other) = sides
                out[i] = label if k - p < q - k else other if q - k < k - p else False
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labels(found, rules), strict=True) if good)


def extract_text(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h, rules) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
